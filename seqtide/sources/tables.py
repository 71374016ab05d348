"""Table scans and the adapter from star-schema tables to the event and basket model.

The adapter is deterministic: every model column is a formula over the given tables, with
NULLs made on purpose (every 23rd event has no metric, and so on) so that NULL rules are
exercised. Decks change every three days, with a short detour at some events, so that runs
of one deck exist at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtide import schemas
from seqtide.functions.scalar import epoch_of

# One time zone per region key.
REGION_ZONES = {
    0: "Africa/Johannesburg",
    1: "America/New_York",
    2: "Asia/Tokyo",
    3: "Europe/Rome",
    4: "Asia/Dubai",
}
DEFAULT_ZONE = "Europe/Rome"
DECK_PERIOD_S = 259200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: one row per event with outcome, metrics, rating change and decks."""
    raw = read(spark, sf_dir, "events")
    # Row counts come from the parquet footers; no data page is read.
    decks = read(spark, sf_dir, "orders").count()
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("long")
    base = raw.select(
        u.alias("entity"),
        e,
        epoch_of("ts").alias("ts"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "Ladder")
        .when(F.col("event_type") == "signup", "Ranked")
        .otherwise("Other")
        .alias("mode"),
        k.alias("k"),
        F.col("value"),
    )
    k = F.col("k")
    win = (k % 2).cast("int")

    def unless(divisor: int, column: Column) -> Column:
        return F.when(e % divisor != 0, column)

    return base.select(
        "entity",
        "event_id",
        "ts",
        "mode",
        win.alias("win"),
        unless(23, F.least(F.col("value"), F.lit(100.0))).alias("metric"),
        unless(29, k.cast("double")).alias("metric2"),
        unless(31, (e % 41 - 20) / F.lit(10.0)).alias("level"),
        unless(17, F.when((win == 1) | (e % 37 == 0), F.lit(30)).otherwise(F.lit(-30)).cast("long")).alias("change"),
        (6000 + 40 * (F.col("entity") % 100)).alias("current_rating"),
        (k % 4).alias("score_for"),
        (F.floor(k / 4) % 4).cast("long").alias("score_against"),
        (F.col("value") % 7).alias("leak_for"),
        ((e % 70) / F.lit(10.0)).alias("leak_against"),
        (
            (
                F.col("entity") * 131
                + F.floor(F.col("ts") / DECK_PERIOD_S) * 17
                + F.when(k % 10 == 0, 7).otherwise(0)
            )
            % decks
        ).cast("long").alias("deck"),
        (e * 11 % decks).alias("opp_deck"),
        (e * 13 % 1000).alias("opponent"),
    )


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set headers: the archetype of each deck."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("deck"),
        F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("archetype"),
    )


def deck_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basket lines, one row per (deck, item)."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("deck"), F.col("l_partkey").alias("item"))
        .agg(
            F.max("l_quantity").alias("level"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("evo"),
            F.max((F.col("l_linestatus") == "O").cast("int")).alias("hero"),
        )
    )


def deck_item_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basket lines by item class instead of single item, one row per (deck, class).

    The lines meet their classes before they are grouped: a largest level needs no table per item first.
    """
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deck"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("level"))
    classes = items(spark, sf_dir).select("item", F.col("rarity").alias("cls"))
    return lines.join(classes, "item").groupBy("deck", F.col("cls").alias("item")).agg(F.max("level").alias("level"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"),
        F.col("p_name").alias("item_name"),
        F.col("p_brand").alias("rarity"),
        F.col("p_type").alias("type"),
        F.col("p_size").alias("cost"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


def thresholds(spark: SparkSession) -> DataFrame:
    """The rating thresholds, sorted. A fixed list of 28 rows."""
    rows = [(f"T{i:02d}", limit) for i, limit in enumerate(schemas.THRESHOLD_LIMITS)]
    return spark.createDataFrame(rows, schemas.THRESHOLDS).orderBy("lower_limit")


def zone_of(region: Column) -> Column:
    out = F.lit(DEFAULT_ZONE)
    for key, zone in REGION_ZONES.items():
        out = F.when(region == key, F.lit(zone)).otherwise(out)
    return out


def with_zones(df: DataFrame, zones: DataFrame, key: str, default: str = DEFAULT_ZONE) -> DataFrame:
    """``df`` with the time zone of its ``key`` (say, a country): looked up in ``zones`` (``key``, zone), else the default."""
    return df.join(zones.select(key, "zone"), key, "left").withColumn("zone", F.coalesce("zone", F.lit(default)))


def with_region(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region key and time zone of the entity. Nations are a 25-row dimension."""
    nations = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("__nation"), F.col("n_regionkey").cast("long").alias("region")
    )
    joined = df.withColumn("__nation", F.col("entity") % 25).join(nations, "__nation", "left").drop("__nation")
    return joined.withColumn("tz", zone_of(F.col("region")))


def events_with_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event scan with the archetype of both decks (two left joins on the set header).

    Joined before the timeline is cut, so the windows still need one exchange. A deck that
    holds a large share of the events is split by the adaptive skew join.
    """
    headers = decks(spark, sf_dir)
    own = headers.select("deck", F.col("archetype").alias("arch"))
    other = headers.select(F.col("deck").alias("opp_deck"), F.col("archetype").alias("opp_arch"))
    return events(spark, sf_dir).join(own, "deck", "left").join(other, "opp_deck", "left")
