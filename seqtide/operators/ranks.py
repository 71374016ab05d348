"""Average ranks per key at any size, without a one-task window.

Values are first counted per (key, value). The cumulative counts then come in two
levels: inside a slot of the value range, and over the slots of the key. The slot is a
pure, order-preserving function of the value (the leading bits of the number), so the plan
needs no sampling and gives the same result when a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS_PER_OCTAVE = 4096


def value_slot(value: str | Column, per_octave: int = SLOTS_PER_OCTAVE) -> Column:
    """Order-preserving integer prefix of a number: octave and leading part of the mantissa.

    Rounding of ``log2`` near a power of two moves a value by no more than to the edge of
    the neighbouring slot, so the order is kept.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * per_octave)
    # Octaves of a double lie between -1074 and 1023; the shift keeps slots above zero.
    slot = (octave + 1100) * per_octave + part + 1
    return F.when(v == 0, F.lit(0)).when(v > 0, slot).otherwise(-slot).cast("long")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, **counts: Column) -> DataFrame:
    """Rows per (key, value); each keyword is a condition counted as a column."""
    return (
        df.filter(F.col(value).isNotNull())
        .withColumn("__v", F.col(value).cast("double"))
        .groupBy(*keys, "__v")
        .agg(*[F.sum(c.cast("long")).alias(name) for name, c in counts.items()])
    )


def add_ranks(counts: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """Add ``ties`` (rows with this value) and ``avg_rank`` to a table of value counts."""
    keyed = counts.withColumn("ties", total).withColumn("__slot", value_slot("__v"))
    inside = Window.partitionBy(*keys, "__slot").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = keyed.withColumn("__cum", F.sum("ties").over(inside))
    slots = keyed.groupBy(*keys, "__slot").agg(F.sum("ties").alias("__slot_n"))
    before = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    skips = slots.select(*keys, "__slot", F.coalesce(F.sum("__slot_n").over(before), F.lit(0)).alias("__skip"))
    return (
        local.join(skips, [*keys, "__slot"])
        .withColumn("avg_rank", F.col("__skip") + F.col("__cum") - (F.col("ties") - 1) / 2)
        .drop("__slot", "__cum", "__skip")
    )


def add_rank_columns(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str] | Sequence[tuple[str, str]], weight: str | None = None
) -> DataFrame:
    """Add the average rank inside the key for several columns: ``{column: rank name}``, or pairs of the two."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    out = df
    for column, name in columns.items() if isinstance(columns, Mapping) else columns:
        counts = df.groupBy(*keys, F.col(column).alias("__v")).agg(w.alias("__n"))
        ranks = add_ranks(counts, keys, F.col("__n")).select(*keys, F.col("__v").alias(column), F.col("avg_rank").alias(name))
        out = out.join(ranks, [*keys, column])
    return out
