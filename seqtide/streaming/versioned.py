"""Tables that streams update by key, in versions of key buckets with a manifest that says which version counts.

A batch writes new files for the buckets it touches and then, as its last step, a manifest: every bucket's version and
how far each stream has come. Readers take the newest complete manifest. A batch that stops half way leaves files that
no manifest names, and its next run writes them anew; a batch that runs again after its manifest does nothing. No file
that counts is ever overwritten. A table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtide.sources import ingest

#: Rows of a manifest: a bucket with its version (stream null), or a stream with the last batch it has merged (bucket null).
MANIFEST = "bucket int, version long, stream string, epoch long"

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Versioned:
    """A table at ``path`` with unique ``keys`` in ``buckets`` buckets by their hash."""

    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    buckets: int = 64

    def newest(self, spark: SparkSession) -> int:
        """Number of the newest complete manifest, 0 without one. Lists the manifest folder."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        glob = hadoop.Path(f"{self.path}/manifest/version=*/_SUCCESS")
        found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or []), default=0)

    def manifest(self, spark: SparkSession, number: int) -> tuple[dict[int, int], dict[str, int]]:
        """Versions by bucket and merged batches by stream; at most ``buckets`` rows and one per stream."""
        if not number:
            return {}, {}
        rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={number}").collect()
        return {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}, {r["stream"]: r["epoch"] for r in rows if r["stream"] is not None}

    def read(self, spark: SparkSession, at: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The table as of manifest ``at`` (else the newest), or its buckets in ``only``; reads the files of these buckets alone."""
        versions, _ = self.manifest(spark, self.newest(spark) if at is None else at)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items()) if only is None or b in set(only)]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def apply(self, updates: DataFrame, merge: Merge, stream: str, epoch: int) -> bool:
        """Merge a batch of a stream once; false if it had been merged before."""
        spark = updates.sparkSession
        now = self.newest(spark)
        versions, streams = self.manifest(spark, now)
        if streams.get(stream, -1) >= epoch:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in updates.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
        merged = merge(self.read(spark, now, touched), updates).select(*self.schema.fieldNames()).withColumn("bucket", bucket)
        number = now + 1
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={number}")
        rows = [(b, v, None, None) for b, v in {**versions, **dict.fromkeys(touched, number)}.items()]
        rows += [(None, None, s, e) for s, e in {**streams, stream: epoch}.items()]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={number}")
        return True

    def sink(self, merge: Merge, stream: str = "stream") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch is merged once, however often it runs."""

        def handle(batch: DataFrame, epoch: int) -> None:
            self.apply(batch, merge, stream, epoch)

        return handle

    def drop_superseded(self, spark: SparkSession, keep: int = 2) -> int:
        """Delete manifests before the newest ``keep`` and the bucket folders that no manifest kept names; how many folders went."""
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        newest = self.newest(spark)
        kept = [self.manifest(spark, n)[0] for n in range(max(1, newest - keep + 1), newest + 1)]
        named = {(v, b) for versions in kept for b, v in versions.items()}
        gone = 0
        for folder in ("manifest/version=*", "data/version=*/bucket=*"):
            glob = hadoop.Path(f"{self.path}/{folder}")
            files = glob.getFileSystem(conf)
            for found in files.globStatus(glob) or []:
                parts = dict(p.split("=") for p in found.getPath().toString().split("/") if p.startswith(("version=", "bucket=")))
                version, bucket = int(parts["version"]), parts.get("bucket")
                old = version <= newest - keep if bucket is None else version <= newest and (version, int(bucket)) not in named
                if old:
                    gone += files.delete(found.getPath(), True)
        return gone


def replace_rows(keys: Sequence[str], order: Sequence[str]) -> Merge:
    """Whole rows replaced by the batch's latest."""
    return lambda stored, updates: ingest.upsert_replace(stored, updates.select(*stored.columns), keys, order)


def set_columns(keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> Merge:
    """Only ``columns`` take the batch's latest values; the others stay, and are null for new keys."""
    return lambda stored, updates: ingest.upsert_partial(stored, ingest.latest(updates.select(*dict.fromkeys([*keys, *columns, *order])), keys, order).select(*keys, *columns), keys, columns)


def add_counts(keys: Sequence[str], counts: dict[str, str], ratio: tuple[str, str, str] | None = None, newest: str | None = None) -> Merge:
    """A mart of sums: each batch is reduced to one row per key before it meets the stored rows, to which it is added.

    ``counts``: column -> SQL expression summed over the batch. ``ratio``: (column, part, whole), 0 for an empty whole.
    ``newest``: a column that keeps its greatest value.
    """

    def merge(stored: DataFrame, updates: DataFrame) -> DataFrame:
        tops = [F.max(newest).alias(f"__{newest}")] if newest else []
        delta = updates.groupBy(*keys).agg(*[F.sum(F.expr(e)).cast("long").alias(f"__{c}") for c, e in counts.items()], *tops)
        out = stored.join(delta, list(keys), "full_outer")
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in counts})
        if ratio:
            out = out.withColumn(ratio[0], F.coalesce(F.try_divide(F.col(ratio[1]), F.col(ratio[2])), F.lit(0.0)))
        return out.withColumn(newest, F.greatest(newest, f"__{newest}")) if newest else out

    return merge
