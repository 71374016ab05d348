"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, tidy

#: Labelled rows of each class that the model is fitted on, those with the smallest hash of their id.
PER_CLASS = 4_000
#: Documents of the other class that each sampled document is compared with.
PARTNERS = 8
#: A score of at least this is predicted as label 1.
THRESHOLD = 0.3
FOLDS = 5

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
STOPS = b".,;:"
SYMBOLS = b"!#$%&*^|~"
FEATURES = ("words", "word_length", "distinct", "adjacent", "bars", "symbols", "upper", "stops", "same_lines", "line_length", "bangs")


def features(text: str | None) -> list[float]:
    """Numbers about a whole text; all zero for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    letters = max(share(LETTERS), 1 / size)
    ranks = np.array([hash(w) for w in words])
    adjacent = float(np.mean(ranks[1:] == ranks[:-1])) if n > 1 else 0.0
    return [
        math.log1p(n), math.log1p((size - n) / n), len(set(words)) / n, math.sqrt(adjacent), math.sqrt(words.count(b"|") / n), math.sqrt(share(SYMBOLS)), share(UPPER) / letters,
        share(STOPS), 1 - len(set(lines)) / len(lines), math.log1p(size / len(lines)), math.sqrt(raw.count(b"!!") / n),
    ]


@dataclass(frozen=True)
class Ranking:
    """score = logistic(weights . (x - mean) / scale - cut + logit(THRESHOLD)): ``cut`` lands on THRESHOLD."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(raw + math.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> Ranking:
    """Bradley-Terry: P(good beats bad) = logistic(s(good) - s(bad)), s linear in the features, by Newton steps.

    The cut is the quantile of all training scores, in steps of a quarter of a percent, that separates the classes
    best (mean of both classes' accuracy; the middle one if several do). Without rows of both classes all weights are 0.
    """
    k = len(FEATURES)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    both = np.concatenate([good, bad])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    g, b = (good - mean) / scale, (bad - mean) / scale
    n = max(len(g), len(b))
    rows = np.arange(n * PARTNERS)
    diff = g[(rows // PARTNERS) % len(g)] - b[(rows * 7919 + rows // n) % len(b)] if len(b) else g[:0]
    w = np.zeros(k)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ (1 - p) / len(diff) - ridge * w
        step = np.linalg.solve((diff.T * (p * (1 - p))) @ diff / len(diff) + ridge * np.eye(k), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    sg, sb = np.sort(g @ w), np.sort(b @ w)
    cuts = np.unique(np.quantile(np.concatenate([sg, sb]), np.linspace(0, 1, 401)))
    right = (1 - np.searchsorted(sg, cuts) / len(sg) + np.searchsorted(sb, cuts) / len(sb)) / 2
    best = cuts[right >= right.max() - 1e-12]
    return Ranking(mean, scale, w, float((best[0] + best[-1]) / 2))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS) -> Ranking:
    """A model of the labelled rows whose crc32(doc_id) mod ``folds`` is not 0, at most ``per_class`` of each class."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"))
    known = known.where(F.crc32(F.col("id").cast("string")) % folds != 0)
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(per_class) for q in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = texts.join(F.broadcast(picked[0].union(picked[1])), "id").select("id", "text", "quality")  # 2 * per_class rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("quality", pa.int64()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            yield rows_of(schema, id=batch.column(0).to_pylist(), quality=batch.column(2).cast(pa.int64()), x=[features(t) for t in batch.column(1).to_pylist()])

    found = sorted((r["quality"], r["id"], r["x"]) for r in rows.mapInArrow(tidy(run), "id long, quality long, x array<double>").collect())
    parts = [np.array([x for q, _, x in found if q == want], dtype=float).reshape(-1, len(FEATURES)) for want in (1, 0)]
    return fit(*parts)


def quality_scores(docs: DataFrame, model: Ranking, folds: int = FOLDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null or empty text has all features 0 and gets their score. With a null doc_id held_out is false. Repeated rows
    score alike; columns other than text play no part.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield rows_of(schema, doc_id=batch.column(0), score=model.score(x))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ranking) -> DataFrame:
    """``docs`` without the rows the model predicts as label 0, all columns as they were."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(tidy(run), schema)
