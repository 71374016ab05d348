"""Feature table: the same rows when entities are cut into segments; split and encoding rules."""

from pyspark.sql import functions as F

from seqtide.ml import features as ft
from seqtide.ml import models as md
from seqtide.operators.ordered import ordered
from seqtide.plans import timeline as tl


def log(spark):
    i = F.col("id")
    return spark.range(260).select(
        F.when(i % 3 != 0, F.lit(1)).otherwise(2 + i % 4).cast("long").alias("entity"),
        i.alias("event_id"),
        (1704067200 + F.floor(i / 2) * 20000).cast("long").alias("ts"),
        F.lit("Ladder").alias("mode"),
        ((i * 7919 % 13) % 2).cast("int").alias("win"),
        F.when(i % 11 != 0, (i * 31 % 100).cast("double")).alias("metric"),
        (i * 17 % 100).cast("double").alias("metric2"),
        F.when(i % 8 != 0, (i % 21 - 10) / 10).alias("level"),
        F.lit(30).cast("long").alias("change"),
        F.lit(6000).alias("current_rating"),
        (i % 6).alias("deck"),
        F.concat(F.lit("a"), (i % 3).cast("string")).alias("arch"),
        F.concat(F.lit("b"), (i % 4).cast("string")).alias("opp_arch"),
        (i % 5).cast("double").alias("leak_for"),
        (i % 4).alias("score_for"),
        (i % 3).alias("score_against"),
    )


def table(spark, max_rows):
    seq = tl.rated(ordered(log(spark), "entity", ["ts", "event_id"], max_rows))
    regions = spark.createDataFrame([(1, 3, "Europe/Rome"), (2, 2, "Asia/Tokyo")], "entity long, region long, tz string")
    return ft.feature_table(seq, regions, None, 30000)


def test_cut_entities_give_the_same_features(spark):
    # Frames reach 149 rows back, so a segment holds at least 150.
    plain, cut = table(spark, None), table(spark, 150)
    assert len(plain.columns) == 4 + len(ft.BASE) + 2 + 60
    columns = [F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in plain.dtypes]
    a = sorted(map(tuple, plain.select(*columns).collect()), key=str)
    b = sorted(map(tuple, cut.select(*columns).collect()), key=str)
    assert len(a) > 150 and a == b


def test_time_range_sums_are_equal_bit_for_bit_when_cut(spark):
    rows = spark.range(400).selectExpr("id", "if(id % 3 = 0, 2, 1) as k", "cast(id * id % 5000 as long) as ts", "cast(id % 7 as long) as v", "cast(id / 7.0 as decimal(38,12)) as d")
    want = {}
    data = [tuple(r) for r in rows.select("k", "ts", "id", "v", "d").collect()]
    for k, ts, i, _, _ in data:
        frame = [r for r in data if r[0] == k and (r[1], r[2]) < (ts, i) and r[1] >= ts - 300]
        want[i] = (len(frame), sum(r[3] for r in frame), sum(r[4] for r in frame))
    for size in (None, 13, 90):
        seq = ordered(rows, "k", ["ts", "id"], size).within({"n": F.lit(1).cast("long"), "s": F.col("v"), "x": F.col("d")}, "ts", 300)
        assert {r["id"]: (r["n"], r["s"], r["x"]) for r in seq.frame.collect()} == want


def test_last_k_split_needs_more_than_k_rows(spark):
    rows = [(1, t, t) for t in range(12)] + [(2, t, 100 + t) for t in range(10)]
    out = ft.last_k_split(spark.createDataFrame(rows, "entity long, ts long, event_id long")).collect()
    assert sorted(r["event_id"] for r in out if r["is_test"]) == list(range(2, 12))
    assert not any(r["is_test"] for r in out if r["entity"] == 2)


def test_codes_are_plain_numbers(spark):
    coded = md.encode(table(spark, None))
    assert not coded.schema["archetype_code"].metadata
    assert {r[0] for r in coded.select("archetype_code").distinct().collect()} == {0.0, 1.0, 2.0}
