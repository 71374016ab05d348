"""Helpers shared by the corpus operators: words, shingles, written intermediate tables, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtide.session import checkpoint_dir

#: Rows of a side that may be broadcast; two longs a row, so at most 32 MB.
BROADCAST_ROWS = 1_000_000

#: Rows that a task's function is given at a time.
SLICE_ROWS = 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Tables written while a pipeline stage was being set up.
_STAGE: dict = {"open": False, "tables": []}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends here and survives lost executors. What was
    shuffled for it is deleted when it is written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/seqtide-llm-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    if _STAGE["open"]:
        _STAGE["tables"].append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(fn):
    """A pipeline stage. Its result is written before the next stage starts, so the tables that ``cut`` wrote in
    earlier stages are deleted when it starts; those of other callers stay. Where the session has Spark's default of
    10,000 rows to an Arrow batch it is set to ``SLICE_ROWS``: rows hold whole texts, and an executor keeps the buffers of
    its largest batches from stage to stage."""

    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _STAGE["tables"]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_STAGE["tables"].pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if spark.conf.get(BATCH, "10000") == "10000":
            spark.conf.set(BATCH, str(SLICE_ROWS))
        _STAGE["open"] = True
        try:
            return fn(spark, docs, sf_dir)
        finally:
            _STAGE["open"] = False

    return run


def release() -> None:
    """Gives memory that Arrow and the allocator keep for later back to the system; workers live from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """``run`` (a function from batches to batches) on slices of at most ``SLICE_ROWS`` rows, which it may turn into Python
    objects at once, that releases a worker's memory when its task ends."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS))
        finally:
            release()

    return task


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id stands in ``gone`` (one column); rows with a null doc_id stay, whatever else the columns are called."""
    return docs.join(bounded(gone.toDF(fresh(docs))), F.col("doc_id").cast("long") == F.col(fresh(docs)), "left_anti")


def fresh(df: DataFrame, name: str = "other_id") -> str:
    """A column name like ``name`` that ``df`` hasn't."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def meet(rows: DataFrame, once: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of ``rows`` with ``once``, which has each key once and, in column ``n``, how many rows of ``rows`` it meets.

    Keys that meet more than a thousandth of all these rows are at most a thousand: they are broadcast, so that their
    rows stay where they are. The others are joined by a shuffle in which no key weighs.
    """
    total = once.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * 1000 > F.lit(total)
    common = F.broadcast(once.where(hot).drop(n))
    rare = once.where(~hot).drop(n).hint("shuffle_merge")
    return rows.join(common, key).unionByName(rows.join(F.broadcast(once.where(hot).select(key)), key, "left_anti").join(rare, key))


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words in order; a shorter sequence is one shingle, no words are none."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(k, len(words)), dtype=np.uint64)
    for j in range(min(k, len(words))):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(shingles(hash_words(word_list(text)), k))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the longs Spark has."""
    return x.view(np.int64)


def rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: longs) as (node, component), component being the smallest node.

    Each round every node points to the neighbour (or itself) that comes first in an order by a hash of node and
    round, and the edges are replaced by those between the nodes pointed to. The order changes by round, so long paths
    shrink by a constant factor as stars do; the number of rounds is logarithmic. Nothing is collected.
    """
    spark = edges.sparkSession
    left = cut(edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        to = cut(both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a")))["v"].alias("to")).select(F.col("a").alias("node"), "to"))
        steps.append(to)
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = left.join(a, "a").join(b, "b").where("x != y")
        left = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    roots = steps[-1]
    for to in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        known = to.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
        roots = cut(known)
    least = roots.groupBy("to").agg(F.least(F.min("node"), F.first("to")).alias("component"))
    return roots.join(least, "to").select("node", "component")
