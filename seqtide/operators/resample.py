"""Null models: exact shuffle expectations, Monte-Carlo chi-square, sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from seqtide.operators import hypothesis as hy
from seqtide.operators import sequence as sq
from seqtide.operators.ordered import Seq


def falling(x: Column, n: int) -> Column:
    """x (x-1) ... (x-n+1)."""
    out = x.cast("double")
    for j in range(1, n):
        out = out * (x - j)
    return out


def window_nulls(seq: Seq, flags: Mapping[str, Column], n: int = 3, group: str = "session_no") -> DataFrame:
    """Windows of ``n`` events that all carry a flag, against three null models.

    ``theory``: independent events, p^n. ``global_null``: the values of an entity shuffled over
    all its events. ``session_null``: shuffled inside each session. The two shuffle nulls are the
    exact means over all permutations (the share of permutations that fill a given window is
    K(K-1).../N(N-1)...), so no replicate of the log is made and there is no sampling error.
    """
    marked = seq.with_columns({f"__h_{k}": F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    hits = sq.ngrams(marked, {k: F.col(f"__h_{k}") for k in flags}, n, group)
    per_group = hits.df.groupBy(*seq.keys, group).agg(
        F.count(F.lit(1)).alias("__m"),
        F.count_if("is_window").alias("__w"),
        *[F.count_if(f"__h_{k}").alias(f"__k_{k}") for k in flags],
        *[F.count_if(f"{k}_all").alias(f"__o_{k}") for k in flags],
    )
    inside = {
        k: F.when(F.col("__m") >= n, F.col("__w") * falling(F.col(f"__k_{k}"), n) / falling(F.col("__m"), n)).otherwise(0.0)
        for k in flags
    }
    per_key = per_group.groupBy(*seq.keys).agg(
        F.sum("__m").alias("__N"),
        F.sum("__w").alias("__W"),
        *[F.sum(f"__k_{k}").alias(f"__K_{k}") for k in flags],
        *[F.sum(f"__o_{k}").alias(f"__O_{k}") for k in flags],
        *[F.sum(inside[k]).alias(f"__S_{k}") for k in flags],
    )
    spread = {
        k: F.when(F.col("__N") >= n, F.col("__W") * falling(F.col(f"__K_{k}"), n) / falling(F.col("__N"), n)).otherwise(0.0)
        for k in flags
    }
    total = per_key.agg(
        F.sum("__N").alias("events"),
        F.sum("__W").alias("windows"),
        *[F.sum(f"__K_{k}").alias(f"__K_{k}") for k in flags],
        *[F.sum(f"__O_{k}").alias(f"__O_{k}") for k in flags],
        *[F.sum(f"__S_{k}").alias(f"__S_{k}") for k in flags],
        *[F.sum(spread[k]).alias(f"__G_{k}") for k in flags],
    )
    rows = [
        F.struct(
            F.lit(k).alias("flag"),
            F.col("events"),
            F.col("windows"),
            F.col(f"__O_{k}").alias("observed"),
            (F.col("windows") * F.pow(F.col(f"__K_{k}") / F.col("events"), n)).alias("theory"),
            F.col(f"__G_{k}").alias("global_null"),
            F.col(f"__S_{k}").alias("session_null"),
        )
        for k in flags
    ]
    out = total.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("windows > 0")
    ratio = {c: F.coalesce(F.try_divide(F.col("observed"), F.col(c)), F.lit(0.0)) for c in ("theory", "global_null", "session_null")}
    return out.withColumns({f"ratio_{c}": r for c, r in ratio.items()})


def _draw(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Hypergeometric draws of any size.

    The library's sampler ends at 10^9. Beyond, the normal law with the exact mean and variance is used, rounded and
    kept in range; there all cells that matter are so large that it differs by less than a replicate's own error, and
    where the smaller side is small the binomial limit of the law is drawn.
    """
    most = 999_999_999
    if (good <= most).all() and (bad <= most).all():
        return rng.hypergeometric(good, bad, np.minimum(take, good + bad))
    total = (good + bad).astype(float)
    share = np.where(total > 0, good / np.maximum(total, 1), 0.0)
    mean = take * share
    spread = mean * (1 - share) * (total - take) / np.maximum(total - 1, 1)
    low, high = np.maximum(0, take - bad), np.minimum(good, take)
    normal = np.rint(rng.normal(mean, np.sqrt(np.maximum(spread, 0))))
    few = rng.binomial(np.minimum(good, take), np.clip(np.where(good < take, take, good) / np.maximum(total, 1), 0, 1))
    return np.clip(np.where(spread < 100, few, normal), low, high).astype(np.int64)


@F.pandas_udf(LongType())
def _tables_at_least(rows: pd.Series, cols: pd.Series, stat: pd.Series, reps: pd.Series, seed: pd.Series) -> pd.Series:
    """How many of ``reps`` random tables with these margins reach the statistic."""
    out = []
    for r, c, observed, n_rep, s in zip(rows, cols, stat, reps, seed):
        r, c = np.asarray(r, dtype=np.int64), np.asarray(c, dtype=np.int64)
        rng = np.random.default_rng(int(s) & 0x7FFFFFFF)
        total = r.sum()
        left = np.tile(c, (int(n_rep), 1))
        score = np.zeros(int(n_rep))
        for i, need in enumerate(r):
            need = np.full(int(n_rep), need)
            for j in range(len(c)):
                rest = left[:, j + 1 :].sum(axis=1)
                cell = _draw(rng, left[:, j], rest, need) if i < len(r) - 1 else left[:, j].copy()
                left[:, j] = left[:, j] - cell
                need = need - cell
                score += cell.astype(float) ** 2 * total / (r[i] * c[j])
        out.append(int((score - total >= observed - 1e-9).sum()))
    return pd.Series(out)


def chi_square_mc(
    cells: DataFrame, keys: Sequence[str], a: str, b: str, reps: int = 2000, seed: int = 7, batch: int = 500, p_below: float = 0.10
) -> DataFrame:
    """Chi-square with a Monte-Carlo p where a cell expects fewer than 5 or p is under 0.10.

    Shuffling one label against the other keeps both margins and nothing else, so tables are
    drawn from the margins alone: the work depends on the number of categories and not on the
    number of events, and the replicates of a key run in separate batches.
    """
    if reps % batch:
        raise ValueError("reps must be a multiple of batch")
    base = hy.chi_square(cells, keys, a, b, yates=False)
    k = list(keys)
    margins = []
    for column, name in ((a, "__rows"), (b, "__cols")):
        sums = cells.groupBy(*k, column).agg(F.sum("cell").alias("__m"))
        margins.append(sums.groupBy(*k).agg(F.sort_array(F.collect_list("__m")).alias(name)))
    needed = base.filter(F.col("low_expected") | (F.col("p") < p_below)).select(*k, "chi2")
    jobs = needed.join(margins[0], k).join(margins[1], k) if k else needed.crossJoin(margins[0]).crossJoin(margins[1])
    jobs = jobs.withColumn("__batch", F.explode(F.sequence(F.lit(0), F.lit(reps // batch - 1))))
    jobs = jobs.withColumn("__seed", F.xxhash64(F.lit(seed), "__batch", *k))
    # Spread the batches: they come out of one row per key.
    jobs = jobs.repartition(*k, "__batch")
    counts = jobs.withColumn("__hit", _tables_at_least("__rows", "__cols", "chi2", F.lit(batch).cast("long"), "__seed"))
    p = counts.groupBy(*k).agg(((F.sum("__hit") + 1) / (F.lit(reps) + 1)).alias("__mc"))
    out = base.join(p, k, "left") if k else base.crossJoin(p)
    return out.withColumn("monte_carlo", F.col("__mc").isNotNull()).withColumn("p", F.coalesce("__mc", "p")).drop("__mc")


def hash_sample(df: DataFrame, unique: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Reproducible sample of ``n`` rows: the first by md5(seed | id)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in unique])
    return df.withColumn("__h", F.md5(text)).orderBy("__h", *unique).limit(n).drop("__h")
