"""Sets of items attached to events: levels, support, lift, top-n sets, regression rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtide.operators.ordered import small_ordered


def basket_levels(lines: DataFrame, special: Column | None = None) -> DataFrame:
    """Mean level per basket without NULLs; a special item is kept apart as its own level."""
    plain = F.col("level") if special is None else F.when(~special, F.col("level"))
    aggs = [F.coalesce(F.avg(plain), F.lit(0.0)).alias("avg_level"), F.count(F.lit(1)).alias("size")]
    if special is not None:
        aggs.append(F.coalesce(F.max(F.when(special, F.col("level"))), F.lit(0.0)).alias("special_level"))
    return lines.groupBy("deck").agg(*aggs)


def deck_counts(events: DataFrame, keys: Sequence[str], deck: str, **conditions: Column) -> DataFrame:
    """Events per (keys, deck), with conditional counts.

    Baskets are joined to these counts, not to the events: a deck that holds a third of all
    events is one row per key here, so its items are not multiplied by its events.
    """
    aggs = [F.count(F.lit(1)).alias("uses"), *[F.count_if(c).alias(n) for n, c in conditions.items()]]
    return events.groupBy(*keys, F.col(deck).alias("deck")).agg(*aggs)


def item_counts(events: DataFrame, lines: DataFrame, keys: Sequence[str], deck: str, **conditions: Column) -> DataFrame:
    """Item frequency per key: events whose basket holds the item, total and by condition."""
    used = deck_counts(events, keys, deck, **conditions)
    sums = [F.sum("uses").alias("n"), *[F.sum(c).alias(c) for c in conditions]]
    return used.join(lines.select("deck", "item"), "deck").groupBy(*keys, "item").agg(*sums)


def item_support(events: DataFrame, lines: DataFrame, bucket: str, deck: str, min_events: int) -> DataFrame:
    """Share of the events of each bucket whose basket holds the item."""
    totals = events.groupBy(bucket).agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= min_events)
    return item_counts(events, lines, [bucket], deck).join(totals, bucket).withColumn("freq", F.col("n") / F.col("total"))


def item_lift(events: DataFrame, lines: DataFrame, bucket: str, deck: str, condition: Column, min_events: int, min_item: int) -> DataFrame:
    """Lift of an item under a condition: P(item | condition) / P(item) per bucket."""
    totals = events.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(condition).alias("total_hit")
    ).filter(F.col("total") >= min_events)
    counts = item_counts(events, lines, [bucket], deck, hits=condition).filter(F.col("n") >= min_item)
    out = counts.join(totals, bucket)
    freq, given = F.col("n") / F.col("total"), F.coalesce(F.try_divide(F.col("hits"), F.col("total_hit")), F.lit(0.0))
    return out.withColumn("freq", freq).withColumn("freq_hit", given).withColumn("lift", given / freq)


def dominance(support: DataFrame, bucket: str, min_buckets: int = 5) -> DataFrame:
    """Z-score of an item's share in a bucket over the buckets that hold the item."""
    spread = support.groupBy("item").agg(
        F.count(F.lit(1)).alias("buckets"), F.avg("freq").alias("__m"), F.stddev_samp("freq").alias("__s")
    ).filter((F.col("buckets") >= min_buckets) & (F.col("__s") > 0))
    out = support.join(spread, "item")
    return out.withColumn("z", (F.col("freq") - F.col("__m")) / F.col("__s")).select(bucket, "item", "freq", "buckets", "z")


def top_n(df: DataFrame, keys: Sequence[str], by: str, tie: str, n: int, name: str = "place") -> DataFrame:
    """First ``n`` rows per key by descending value.

    Each task first keeps the best ``n`` of its own rows per key (Spark's window group
    limit), so a hot key sends at most ``n`` rows per task through the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col(tie).asc())
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def topn_sets(support: DataFrame, bucket: str, n: int, by: str = "freq") -> DataFrame:
    """The set of the ``n`` most frequent items per bucket (an array of at most ``n``)."""
    return top_n(support, [bucket], by, "item", n).groupBy(bucket).agg(F.sort_array(F.collect_set("item")).alias("items"))


def topn_change(sets: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Jaccard distance between the sets of adjacent buckets."""
    base = sets if keys else sets.withColumn("__key", F.lit(0))
    seq = small_ordered(base, list(keys) or ["__key"], order).near({"__prev": lambda w: F.lag("items").over(w)}, back=1)
    union = F.size(F.array_union("items", "__prev"))
    distance = F.when(F.col("__prev").isNotNull(), F.when(union > 0, 1 - F.size(F.array_intersect("items", "__prev")) / union).otherwise(F.lit(0.0)))
    return seq.frame.withColumn("distance", distance).drop("__prev", "__key")
