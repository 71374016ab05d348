"""Personal data: fixed patterns as seeds, contexts bootstrapped from them, and identifiers the contexts reveal."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows_of, tidy

KINDS = ("email", "ip", "card", "phone")
#: A kind that only the method knows: opaque strings such as access tokens.
SECRET = "secret"
#: Context rounds; patterns need this many different seeds and this confidence; identifiers this score.
ROUNDS, SEEDS, PATTERN_CONFIDENCE, IDENTIFIER_SCORE = 3, 5, 0.8, 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
#: What an identifier of a kind must look like at least, beyond its context.
SHAPES = {
    "email": re.compile(r"[^\s@]+@[^\s@]+\Z"),
    "ip": re.compile(r"[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,}\Z"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9]){11,18}\Z"),
    "phone": re.compile(r"\(?[0-9](?:[ ().-]*[0-9]){6,14}\Z"),
    SECRET: re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_-]{16,}\Z"),
}
#: Digits in groups; a group after the first has two digits or more, so that a lone number behind an identifier isn't part of it.
GROUPS = re.compile(r"(?<![A-Za-z0-9_@+])\(?[0-9]+(?:[\x20().-]{1,3}[0-9]{2,})+(?![0-9])")
#: A part without space that has this many digits is an identifier of its own.
OWN_DIGITS = 9
TOKEN = re.compile(r"[^\s\"'<>,;=]+")
#: Words that tell of a secret, before a sign of assignment.
TELLING = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth[ _-]?key)[\"']?\s*[:=]+\s*[\"']?\Z")
#: Of the secrets that a telling word gives away one in so many is no seed: patterns have to find it, which measures them.
HELD_OUT = 3
#: Words longer than this stand in a pattern by their hash, so that a pattern is short however long the words around it.
LONG_WORD = 64


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[::-2]))) % 10 == 0


def seeds(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: by kind in the order of ``KINDS``, then by start; leftmost, not overlapping within a kind."""
    if not text or not ANY.search(text):
        return []
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            found.append(("email", start, domain.end()))
        at = text.find("@", last)
    found.extend(("ip", *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found.extend(("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15)
    return found


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shaped(word: str) -> str:
    """A word as it stands in a pattern: lower-cased, digits as 0, a very long one as its hash."""
    return re.sub("[0-9]", "0", word.lower()) if len(word) <= LONG_WORD else hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()


def wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def words_before(text: str, start: int, most: int = 2) -> tuple[list[str], str]:
    """Up to ``most`` whole words before a place, nearest first, and the marks between the nearest and the place."""
    words, marks, i = [], "", start
    while i and len(words) < most:
        j = i
        if wordy(text[i - 1]):
            while j and wordy(text[j - 1]):
                j -= 1
            words.append(shaped(text[j:i]))
        else:
            while j and not wordy(text[j - 1]):
                j -= 1
            marks = "".join(text[j:i].split()) if not words else marks
        i = j
    return words, shaped(marks)


def word_after(text: str, end: int) -> str:
    """The whole word or run of marks after a place, without the space between."""
    i, n = end, len(text)
    while i < n and text[i].isspace():
        i += 1
    j = i
    while j < n and not text[j].isspace() and wordy(text[j]) == wordy(text[i]):
        j += 1
    return shaped(text[i:j])


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a place, from wide to narrow: the two words before it, the word on either side, the one
    word before it, and the marks around it alone."""
    before, marks = words_before(text, start)
    after, out = word_after(text, end), []
    if len(before) == 2:
        out.append(f"{before[1]} {before[0]} {marks}_")
    if before:
        out.append(f"{before[0]} {marks}_")
        if after:
            out.append(f"{before[0]} {marks}_ {after}")
    if len(marks) > 1 and after and not wordy(after[0]):
        out.append(f"{marks}_{after}")
    return out


def grouped(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each run of digits in groups with inner spaces that as a whole looks like a kind."""
    for m in GROUPS.finditer(text):
        run, after = m[0], text[m.end() : m.end() + 1]
        if " " not in run or after in ("_", "@") or after.isalnum() or not any(SHAPES[k].match(run) for k in ("card", "phone")):
            continue
        if not any(SHAPES["ip"].match(part) or sum(map(str.isdigit, part)) >= OWN_DIGITS for part in run.split(" ")):
            yield m.span()


def told(text: str, start: int) -> bool:
    """Whether a telling word and a sign of assignment stand right before a place."""
    return bool(TELLING.search(text, max(0, text.rfind("\n", 0, start) + 1), start)) if text[start - 1 : start] in ("=", ":", " ", "\t", '"', "'") else False


def held_out(instance: str) -> bool:
    return int(hashlib.md5(instance.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % HELD_OUT == 0


def occurrences(text: str | None) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, instance, pattern, start, end) of each seed (base spans, and secrets that a telling word gives away), and of
    every other run of groups of digits and every other token that looks like a kind. These have no kind ("" or, if they
    are secrets held out from the seeds, "-")."""
    spans = seeds(text)
    for kind, a, b in spans:
        for p in contexts(text, a, b):
            yield kind, text[a:b].lower(), p, a, b
    if not text or not ANY.search(text):
        return
    taken = sorted((a, b) for _, a, b in spans)
    runs = [(a, b) for a, b in grouped(text) if not any(s < b and a < e for s, e in taken)]
    for a, b in runs:
        for p in contexts(text, a, b):
            yield "", text[a:b].lower(), p, a, b
    taken += runs
    for m in TOKEN.finditer(text):
        token = m[0].rstrip(".:!?)")
        a, b = m.start(), m.start() + len(token)
        if len(token) < 5 or not ANY.search(token) or not any(shape.match(token) for shape in SHAPES.values()):
            continue
        kind = ""
        if SHAPES[SECRET].match(token) and told(text, a):
            kind = "-" if held_out(token.lower()) else SECRET  # whatever digits in it look like
        elif any(s < b and a < e for s, e in taken):
            continue
        for p in contexts(text, a, b):
            yield kind, token.lower(), p, a, b


def base_rows(docs: DataFrame) -> DataFrame:
    """doc_id, tk (hash of the text), spans (base, as text) per row."""
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("base", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows_of(schema, doc_id=batch.column(0), tk=batch.column(1), base=[shown(seeds(t)) for t in batch.column(2).to_pylist()])

    return docs.mapInArrow(tidy(run), "doc_id long, tk long, base string")


def occurrence_rows(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("kind", pa.string()), ("instance", pa.string()), ("pattern", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            rows = [(doc, tk, *o) for doc, tk, text in ids for o in occurrences(text)]
            yield rows_of(schema, **{f.name: [r[k] for r in rows] for k, f in enumerate(schema)})

    return docs.mapInArrow(tidy(run), "doc_id long, tk long, kind string, instance string, pattern string, start long, end long")


def discover(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, instance) of identifiers that are no seeds: ``found`` as from ``occurrence_rows``.

    The graph joins patterns to the instances seen in them. In turn a pattern's confidence in a kind is the mean score
    of its instances (with one instance of doubt added; those held out are not judged), and an instance's score is the
    chance that one of its patterns is right. Seeds have score 1. Patterns with fewer than ``SEEDS`` different seeds, or
    below the confidence, are left out, and an instance has to look like its kind. Only sums per pattern and instance
    are shuffled, never pairs.
    """
    edges = cut(found.groupBy("pattern", "instance").agg(F.max(F.col("kind") == "-").alias("held")))
    sure = cut(found.where("kind not in ('', '-')").select("instance", "kind").distinct().withColumn("score", F.lit(1.0)).withColumn("seed", F.lit(1)))
    size = edges.groupBy("pattern").agg(F.count_if(~F.col("held")).alias("n"))
    scores = sure
    for _ in range(rounds):
        by_pattern = edges.where("not held").join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.sum("seed").alias("seeds"))
        good = by_pattern.where(F.col("seeds") >= SEEDS).join(size, "pattern").withColumn("confidence", F.col("total") / (F.col("n") + 1))
        good = good.where(F.col("confidence") >= PATTERN_CONFIDENCE).select("pattern", "kind", "confidence")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))
        new = edges.join(good, "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("score"))
        shape = F.lit(False)
        for kind, pattern in SHAPES.items():
            shape = shape | ((F.col("kind") == kind) & F.col("instance").rlike("^(?:" + pattern.pattern.replace(r"\Z", r"\z") + ")"))
        new = new.where(shape).join(sure.select("instance").distinct(), "instance", "left_anti").select("instance", "kind", "score", F.lit(0).alias("seed"))
        scores = cut(sure.unionByName(new))
    best = scores.where("seed = 0").groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best"))
    return best.where(F.col("best.score") >= IDENTIFIER_SCORE).select("instance", F.col("best.kind").alias("kind"))


def added_spans(found: DataFrame, fresh: DataFrame) -> DataFrame:
    """(doc_id, tk, kind, start, end) beside the base spans: occurrences of the seeds that are secrets, and of the
    discovered instances, wherever they stand."""
    seen = found.select("doc_id", "tk", "instance", "start", "end", "kind").distinct()
    names = fresh.unionByName(found.where(F.col("kind") == SECRET).select("instance", "kind").distinct()).toDF("instance", "as_kind")
    return seen.where(F.col("kind").isin("", "-", SECRET)).join(names, "instance").select("doc_id", "tk", F.col("as_kind").alias("kind"), "start", "end").distinct()


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and
    discovered ones, kind:start:end in code points, end exclusive, by kind and start; the kind "secret" comes last).

    A null or empty text has no spans. Null ids and repeated rows are passed on (repeated rows count once in the graph);
    other columns are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.col("text").cast("string").alias("text"))
    base = base_rows(texts)
    found = cut(occurrence_rows(texts))
    span = F.concat_ws(":", "kind", "start", "end")
    more = added_spans(found, discover(found)).groupBy(F.col("doc_id").alias("more_id"), F.col("tk").alias("more_tk")).agg(F.collect_set(span).alias("more"))
    spans = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    order = F.transform(
        F.array_union(spans, F.coalesce("more", F.array().cast("array<string>"))),
        lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in (*KINDS, SECRET)]), F.split(s, ":")[0]).alias("k"), F.split(s, ":")[1].cast("long").alias("a"), s.alias("s")),
    )
    count = lambda kind: F.size(F.filter(spans, lambda s: s.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")
    same = (F.col("tk") == F.col("more_tk")) & F.col("doc_id").eqNullSafe(F.col("more_id"))
    return base.join(more, same, "left").select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(F.col("base"), 256).alias("base_sha256"), F.array_join(F.transform(F.array_sort(order), lambda x: x["s"]), ",").alias("spans")
    )


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(shown(spans).encode()).hexdigest()
