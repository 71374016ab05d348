"""Incremental intake and table maintenance: marks, insert-or-ignore, upserts, marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtide.session import cut_lineage


def read_dimension(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A seed file (CSV with a header) under its declared schema: (rows with complete keys, lines that don't fit).

    Nothing is inferred. Of rows with one key the first by their other columns stays, as insert-or-ignore has it.
    """
    declared = T.StructType([*schema.fields, T.StructField("line", T.StringType())])
    raw = spark.read.schema(declared).option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").csv(path)
    raw = cut_lineage(raw)  # a reader that prunes columns finds fewer bad lines
    fits = F.col("line").isNull()
    for k in keys:
        fits = fits & F.col(k).isNotNull()
    rest = [c for c in schema.fieldNames() if c not in keys]
    kept = raw.filter(fits).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])
    return kept.select(*schema.fieldNames()), raw.filter(~fits)


def high_water(target: DataFrame, entity: str, ts: str) -> DataFrame:
    """Newest stored time per entity."""
    return target.groupBy(entity).agg(F.max(ts).alias("mark"))


def only_new(updates: DataFrame, marks: DataFrame, entity: str, ts: str) -> DataFrame:
    """Rows after the entity's mark; entities without a mark keep all rows."""
    joined = updates.join(marks, entity, "left")
    return joined.filter(F.col("mark").isNull() | (F.col(ts) > F.col("mark"))).drop("mark")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order``; combines map-side, so a key with very many
    versions is no problem."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col("__b")[c].alias(c) for c in rest])


def insert_ignore(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows to append: updates without stored keys, one per key (the first by ``order``)."""
    fresh = updates.join(target.select(*keys), list(keys), "left_anti")
    rest = [c for c in fresh.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return fresh.groupBy(*keys).agg(first.alias("__b")).select(*keys, *[F.col("__b")[c].alias(c) for c in rest])


def upsert_replace(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole rows replaced: the target without updated keys plus the latest updates."""
    newest = latest(updates, keys, order).select(*target.columns)
    return target.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest)


def upsert_partial(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Only the named columns change; new keys get NULL elsewhere. Updates have unique keys."""
    renamed = updates.select(*keys, F.lit(True).alias("__upd"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = target.join(renamed, list(keys), "full_outer")
    out = [F.when(F.col("__upd"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns]
    return joined.select(*out)


def set_stats(events: DataFrame, entity: str, deck: str, win: str, stamp: Column) -> DataFrame:
    """Mart of events and wins per (entity, deck) with the win share (0 without events)."""
    out = events.filter(F.col(deck).isNotNull()).groupBy(entity, deck).agg(
        F.count(F.lit(1)).alias("battles"), F.sum(F.col(win).cast("long")).alias("wins")
    )
    return out.withColumn("confidence", F.coalesce(F.try_divide(F.col("wins"), F.col("battles")), F.lit(0.0))).withColumn(
        "last_updated", stamp
    )


def used_sets(sets: DataFrame, events: DataFrame, deck: str) -> DataFrame:
    """Sets that some event uses."""
    return sets.join(events.select(deck).distinct(), deck, "left_semi")


def members_of(lines: DataFrame, wanted: DataFrame, deck: str = "deck") -> DataFrame:
    """All lines of the wanted sets: one semi-join instead of chunked id lists."""
    return lines.join(wanted.select(deck).distinct(), deck, "left_semi")


def backlog(events: DataFrame, metric: str, *needed: str) -> DataFrame:
    """Events that could be scored but have no metric yet."""
    ready = F.col(metric).isNull()
    for c in needed:
        ready = ready & F.col(c).isNotNull()
    return events.filter(ready)


def backfill(events: DataFrame, scores: DataFrame, keys: Sequence[str], metric: str, score: str) -> DataFrame:
    """Fill a missing metric from a score table with unique keys."""
    joined = events.join(scores.select(*keys, F.col(score).alias("__score")), list(keys), "left")
    return joined.withColumn(metric, F.coalesce(F.col(metric), F.col("__score"))).drop("__score").select(*events.columns)


def complete_sets(lines: DataFrame, deck: str, size: int) -> DataFrame:
    """Sets with exactly ``size`` distinct items."""
    return lines.groupBy(deck).agg(F.count_distinct("item").alias("__n")).filter(F.col("__n") == size).select(deck)


def write_table(df: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
