"""Matched pairs against brute force over all pairs, with one stratum holding most rows."""

import random

from pyspark.sql import functions as F

from seqtide.operators import matching as mt


def rows(n=120, seed=4):
    rng = random.Random(seed)
    # Stratum "big" holds two thirds, entity 1 half of it.
    return [
        (i, "big" if i % 3 else f"s{i % 4}", 1 if i % 2 else 2 + i % 7, round(rng.random(), 2), float(rng.randrange(6)) / 5, rng.sample(range(12), 5))
        for i in range(n)
    ]


SCHEMA = "id long, stratum string, entity long, fine double, coarse double, items array<int>"


def test_match_other_follows_the_circle(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {r["id"]: r["other_id"] for r in mt.match_other(df, ["stratum"], "entity", ["id"]).collect()}
    info = {r[0]: r for r in rows()}
    circle = mt.circle(df, ["stratum"], ["id"], 42).collect()
    for me in circle:
        peers = [p for p in circle if p["stratum"] == me["stratum"] and p["entity"] != me["entity"]]
        want = min(peers, key=lambda p: (p["place"] - me["place"]) % me["around"])["id"] if peers else None
        assert got.get(me["id"]) == want
    assert all(info[a][1] == info[b][1] and info[a][2] != info[b][2] for a, b in got.items())


def test_match_where_finds_a_partner_whenever_one_exists(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a, b = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")

    def ok():
        return (F.size(F.array_intersect("items", "b_items")) <= 1) & (F.col("entity") != F.col("b_entity"))

    out = mt.match_where(a, b.select("stratum", "id", "entity", "items"), ["stratum"], ["id"], ["id"], ok).collect()
    got = {r["id"]: r["b_id"] for r in out}
    data = {r[0]: r for r in rows()}

    def fits(x, y):
        return data[x][1] == data[y][1] and data[x][2] != data[y][2] and len(set(data[x][5]) & set(data[y][5])) <= 1

    for x in (i for i in data if i % 2 == 0):
        partners = [y for y in data if y % 2 == 1 and fits(x, y)]
        assert (got.get(x) in partners) if partners else x not in got


def test_rows_without_a_partner_form_no_pairs(spark):
    # 100,000 rows of one deck and another hundred of its own entity: nothing matches, and all pairs would be 10^10.
    many = spark.range(100_000).selectExpr("id", "'s' as stratum", "id % 1000 as entity", "array('deck:1', concat('entity:', id % 1000)) as labels")
    out = mt.match_where(many, many, ["stratum"], ["id"], ["id"], lambda: F.col("id") < 0, labels="labels")
    assert out.count() == 0
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("labels", F.array(F.concat(F.lit("e"), F.col("entity").cast("string"))))
    a, b = df.filter("id % 2 = 0"), df.filter("id % 2 = 1").select("stratum", "id", "entity", "labels")
    ok = lambda: F.col("entity") != F.col("b_entity")
    with_, plain = (sorted((r["id"], r["b_id"]) for r in mt.match_where(a, b, ["stratum"], ["id"], ["id"], ok, labels=x).collect()) for x in ("labels", None))
    assert with_ == plain and with_


def test_match_nearest_is_the_nearest(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a, b = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    got = {r["id"]: (r["match"], r["distance"]) for r in mt.match_nearest(a, b, ["stratum"], "id", "coarse", "fine", 2.0, 0.3).collect()}
    data = {r[0]: r for r in rows()}
    for x in (i for i in data if i % 2 == 0):
        options = [
            (round(abs(data[x][4] - data[y][4]) + abs(data[x][3] - data[y][3]) / 2.0, 6), y)
            for y in data
            if y % 2 == 1 and data[y][1] == data[x][1] and abs(data[x][4] - data[y][4]) < 0.3
        ]
        best = min(options, default=None)
        if best and best[0] < 0.3:
            assert got[x] == (best[1], best[0])
        else:
            assert x not in got


def test_match_nearest_same_when_strata_are_cut(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a, b = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    plain = sorted(map(tuple, mt.match_nearest(a, b, ["stratum"], "id", "coarse", "fine", 2.0, 0.3).collect()))
    spark.conf.set("seqtide.maxRowsPerKey", "7")
    try:
        cut = sorted(map(tuple, mt.match_nearest(a, b, ["stratum"], "id", "coarse", "fine", 2.0, 0.3).collect()))
    finally:
        spark.conf.unset("seqtide.maxRowsPerKey")
    assert plain == cut
