"""Buckets, thresholds, baselines and residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtide.operators.ordered import small_ordered
from seqtide.operators.ranks import SLOTS_PER_OCTAVE, value_slot
from seqtide.schemas import THRESHOLD_LIMITS


def _array(limits: Sequence[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in sorted(limits)])


def next_threshold(value: str | Column, limits: Sequence[int] = THRESHOLD_LIMITS) -> Column:
    """Lowest threshold above the value, NULL above the last. For a fixed short list."""
    v = F.col(value) if isinstance(value, str) else value
    return F.array_min(F.filter(_array(limits), lambda t: t > v))


def last_threshold(value: str | Column, limits: Sequence[int] = THRESHOLD_LIMITS) -> Column:
    """Highest threshold at or under the value."""
    v = F.col(value) if isinstance(value, str) else value
    return F.array_max(F.filter(_array(limits), lambda t: t <= v))


def next_or_last_threshold(value: str | Column, limits: Sequence[int] = THRESHOLD_LIMITS) -> Column:
    """Next threshold, or the last one for values beyond it."""
    return F.coalesce(next_threshold(value, limits), F.when(F.col(value).isNotNull() if isinstance(value, str) else value.isNotNull(), F.lit(max(limits)).cast("long")))


def threshold_band(df: DataFrame, value: str, low: float, high: float, limits: Sequence[int] = THRESHOLD_LIMITS, name: str = "threshold") -> DataFrame:
    """One row per event and threshold with ``low <= value - threshold <= high``.

    Only matching pairs are emitted; events outside every band vanish.
    """
    v = F.col(value)
    return df.withColumn(name, F.explode(F.filter(_array(limits), lambda t: (v - t >= low) & (v - t <= high))))


def asof_threshold(df: DataFrame, value: str, thresholds: DataFrame, limit: str, direction: str = "last", name: str = "threshold") -> DataFrame:
    """As-of match against a threshold table of any size: the highest threshold at or under the value (``last``) or the
    lowest above it (``next``), null if there is none. Rows with a null value vanish.

    Values fall into slots, an order-preserving function of the number (4096 to an octave). Per slot that occurs there is
    one row with the thresholds inside it and the nearest one of the slots before (or after) it, so the rows meet their
    slot in an ordinary join and are neither ordered nor written. The slot table has a row for each slot in use, however
    many rows there are; it is carried over slots within an octave and then over octaves.
    """
    if direction not in ("last", "next"):
        raise ValueError("direction is last or next")
    up = direction == "last"
    fold, pick = (F.max, F.greatest) if up else (F.min, F.least)
    rows = df.withColumn(value, F.col(value).cast("double")).filter(F.col(value).isNotNull()).withColumn("__slot", value_slot(value))
    marks = thresholds.select(F.col(limit).cast("double").alias("__lim")).filter("__lim is not null")
    inside = marks.groupBy(value_slot("__lim").alias("__slot")).agg(F.array_sort(F.collect_set("__lim")).alias("__lims"))
    slots = rows.select("__slot").distinct().join(inside, "__slot", "full_outer")
    nearest = F.array_max("__lims") if up else F.array_min("__lims")
    slots = slots.withColumns({"__octave": F.floor(F.col("__slot") / SLOTS_PER_OCTAVE), "__own": nearest})
    order = F.col("__slot").asc() if up else F.col("__slot").desc()
    earlier = Window.partitionBy("__octave").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    octaves = slots.groupBy("__octave").agg(fold("__own").alias("__whole"))  # at most 4,200 rows: all a double has
    order = F.col("__octave").asc() if up else F.col("__octave").desc()
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = octaves.select("__octave", fold("__whole").over(before).alias("__far"))
    carry = pick(fold("__own").over(earlier), F.col("__far"))
    table = slots.join(carried, "__octave").select("__slot", "__lims", carry.alias("__carry"))
    fits = (lambda x: x <= F.col(value)) if up else (lambda x: x > F.col(value))
    near = F.filter("__lims", fits)
    found = F.coalesce(F.array_max(near) if up else F.array_min(near), F.col("__carry"))
    return rows.join(table, "__slot", "left").withColumn(name, found).drop("__slot", "__lims", "__carry")


def baseline(df: DataFrame, bucket: str, value: str, min_n: int, name: str = "expected") -> DataFrame:
    """Mean of the value per bucket with at least ``min_n`` values."""
    return (
        df.filter(F.col(value).isNotNull() & F.col(bucket).isNotNull())
        .groupBy(bucket)
        .agg(F.avg(value).alias(name), F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= min_n)
        .drop("__n")
    )


def residualize(df: DataFrame, bucket: str, value: str, curve: DataFrame, name: str = "residual") -> DataFrame:
    """Value minus the expected value of its bucket; rows of unknown buckets vanish."""
    return df.join(curve, bucket).withColumn(name, F.col(value) - F.col("expected"))


def entity_bias(df: DataFrame, entity: str, residual: str = "residual", name: str = "bias") -> DataFrame:
    """Mean residual per entity (self-normalisation)."""
    return df.groupBy(entity).agg(F.avg(residual).alias(name))


def bucket_zscore(df: DataFrame, bucket: str, value: str, more_than: int = 5, name: str = "z") -> DataFrame:
    """Z-score inside the bucket; buckets too small or without spread fall back to all rows."""
    stats = (
        df.groupBy(bucket)
        .agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"), F.count(value).alias("__n"))
        .filter((F.col("__n") > more_than) & (F.col("__s") > 0))
    )
    overall = df.agg(F.avg(value).alias("__gm"), F.stddev_samp(value).alias("__gs"))
    out = df.join(stats, bucket, "left").crossJoin(F.broadcast(overall))  # one row
    z = F.coalesce(
        (F.col(value) - F.col("__m")) / F.col("__s"), F.try_divide(F.col(value) - F.col("__gm"), F.col("__gs"))
    )
    return out.withColumn(name, z).drop("__m", "__s", "__n", "__gm", "__gs")


def increments(buckets: DataFrame, bucket: str, value: str, key: str | None = None, width: float | None = None) -> DataFrame:
    """Change of the value from bucket to bucket; with ``width`` only between adjacent ones.

    One row per bucket: the value range over the width bounds the table.
    """
    base = buckets if key else buckets.withColumn("__key", F.lit(0))
    keys = key or "__key"
    seq = small_ordered(base, keys, bucket).near(
        {
            "__pv": lambda w: F.lag(value).over(w),
            "__pb": lambda w: F.lag(bucket).over(w),
        },
        back=1,
    )
    step = F.col(value) - F.col("__pv")
    if width is not None:
        step = F.when(F.col(bucket) - F.col("__pb") == width, step)
    return seq.frame.withColumn("increment", step).drop("__pv", "__pb", "__key")
