"""Structured Streaming jobs: intake with a late-row table, sessions and windowed counts in append mode.

Sinks are tables in a shared folder. Every batch writes under its own epoch, so a batch that runs again after a failure
leaves the same result. Tables updated by key are in ``versioned``, the stateful fold is in ``fold``.

Sessions and windows keep state only until the watermark has passed them. They read the table that ``intake_sink``
writes, which has put aside what the watermark would drop, so no row is lost without a trace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from seqtide.sources import ingest

DELAY = "1 day"
DELAY_S = 86400


def read_landed(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """File stream over landed tables; the batch size bounds what one trigger holds."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def event_time(epoch: str = "ts") -> Column:
    return F.timestamp_seconds(F.col(epoch))


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = DELAY) -> DataFrame:
    """Each event id once; the state is dropped when the watermark has passed."""
    timed = events.withColumn("event_time", event_time())
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def start(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None
) -> StreamingQuery:
    """Run on what is there, or every ``every`` (for intake: 20 minutes)."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def epoch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own directory; a repeated batch replaces it."""

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return handle


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def intake_sink(target: str, late: str, source: str, schema: T.StructType, key: str = "event_id") -> Callable[[DataFrame, int], None]:
    """Insert-or-ignore into the event table, with late rows on a side table.

    A row is late when it is more than a day behind the newest row that earlier epochs stored for its source. The
    comparison is explicit, since a watermark would drop such rows without a trace. Epochs look only at smaller ones,
    so a batch that runs again after a failure finds what it found at first and writes the same rows. Marks are a small
    table of their own (``target`` + "_marks", per epoch); the target is partitioned by epoch and day, and only the
    days a batch brings are read for the comparison by key.
    """
    marks_path = f"{target.rstrip('/')}_marks"
    stored_schema = T.StructType([*schema.fields, T.StructField("epoch", T.LongType()), T.StructField("day", T.LongType())])
    marks_schema = T.StructType([schema[source], T.StructField("mark", T.LongType()), T.StructField("epoch", T.LongType())])
    columns = schema.fieldNames()
    day = F.floor(F.col("ts") / DELAY_S).cast("long")

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        earlier = read_or_empty(spark, marks_path, marks_schema).filter(F.col("epoch") < epoch)
        marks = earlier.groupBy(source).agg(F.max("mark").alias("mark"))
        rows = batch.select(*columns).join(marks, source, "left")
        is_late = F.coalesce(F.col("ts") < F.col("mark") - DELAY_S, F.lit(False))
        rows.filter(is_late).drop("mark").select(*columns).write.mode("overwrite").parquet(f"{late}/epoch={epoch}")
        fresh = rows.filter(~is_late).drop("mark")
        span = fresh.agg(F.min(day).alias("first"), F.max(day).alias("last")).first()
        stored = read_or_empty(spark, target, stored_schema).filter((F.col("epoch") < epoch) & F.col("day").between(span["first"], span["last"])).select(*columns)
        kept = ingest.insert_ignore(stored, fresh, [key], ["ts"]).select(*columns)
        kept.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{target}/epoch={epoch}")
        written = read_or_empty(spark, target, stored_schema).filter(F.col("epoch") == epoch)
        written.groupBy(source).agg(F.max("ts").cast("long").alias("mark")).write.mode("overwrite").parquet(f"{marks_path}/epoch={epoch}")

    return handle


def sessions(events: DataFrame, gap_s: int = 1200, delay: str = DELAY) -> DataFrame:
    """Sessions per entity. ``session_window`` merges events exactly one gap apart; whole
    seconds and a gap one second shorter split them there."""
    timed = events.withColumn("event_time", event_time()).withWatermark("event_time", delay)
    win = F.session_window("event_time", f"{gap_s - 1} seconds")
    return timed.groupBy("entity", win).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


def day_part_counts(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Tumbling 6-hour counts and means per mode."""
    timed = events.withColumn("event_time", event_time()).withWatermark("event_time", delay)
    out = timed.groupBy(F.window("event_time", "6 hours").alias("w"), "mode").agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("avg_metric"))
    return out.select(F.unix_timestamp("w.start").alias("start_ts"), "mode", "n", "avg_metric")


def weekly_rates(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Sliding 7-day win rate per entity, moved by a day."""
    timed = events.withColumn("event_time", event_time()).withWatermark("event_time", delay)
    out = timed.groupBy("entity", F.window("event_time", "7 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("win").alias("win_rate"))
    return out.select("entity", F.unix_timestamp("w.start").alias("start_ts"), "n", "win_rate")


def closing_row(spark: SparkSession, schema: T.StructType, after: int, key: str = "entity") -> DataFrame:
    """One row of no entity (``key`` -1) at time ``after``: it moves the watermark past all others, which closes their
    windows in append mode, and its own never close."""
    free = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    return spark.createDataFrame([tuple({key: -1, "ts": after}.get(c) for c in schema.fieldNames())], free)
