"""Boundary rows of sessions, zones, texts and table maintenance."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from seqtide.functions import scalar as sc
from seqtide.operators import buckets as bk
from seqtide.operators import sequence as sq
from seqtide.operators.ordered import ordered
from seqtide.plans import timeline as tl
from seqtide.sources import extract as ex
from seqtide.sources import ingest as ig
from seqtide.sources import quality as ql


def log(spark, rows, schema="entity long, event_id long, ts long, win int, metric double"):
    return ordered(spark.createDataFrame(rows, schema), "entity", ["ts", "event_id"])


def test_gap_boundary(spark):
    seq = log(spark, [(1, i, t, 1, None) for i, t in enumerate((0, 1199, 2399, 3598))])
    got = [r["session_no"] for r in sq.sessionize(seq).df.orderBy("ts").collect()]
    assert got == [1, 1, 2, 2]
    strict = sq.sessionize(seq, gap_s=1200, split_at_equal=False).df.orderBy("ts").collect()
    assert [r["session_no"] for r in strict] == [1, 1, 1, 1]


def test_stop_tiers(spark):
    at, rows = 0, []
    for i, gap in enumerate((0, 1200, 7199, 7200, 71999, 72000)):
        at += gap
        rows.append((1, i, at, 1, None))
    got = [r["stop_type"] for r in sq.sessionize(log(spark, rows)).df.orderBy("ts").collect()]
    assert got == ["Short", "Short", "Long", "Long", "Quit", "End"]


def test_streaks_and_stress(spark):
    rows = [(1, i, i, w, None) for i, w in enumerate((1, 1, 0, 0, 0, 1, 0))]
    got = sq.streaks(sq.sessionize(log(spark, rows))).df.orderBy("ts").collect()
    assert [r["streak_before"] for r in got] == [0, 1, 2, -1, -2, -3, 1]
    fold = [(0, 50.0), (0, 40.0), (0, 30.0), (1, 50.0), (1, 50.0), (0, None)]
    rows = [(1, i, i, w, m) for i, (w, m) in enumerate(fold)]
    got = tl.with_stress(sq.sessionize(log(spark, rows))).df.orderBy("ts").collect()
    assert [r["stress_after"] for r in got] == [1.0, 2.5, 4.5, 2.5, 0.0, 1.0]


def test_rating_rebuild(spark):
    rows = [(1, 1, 1, 1, 30), (1, 2, 2, 1, None), (1, 3, 3, 0, -28), (1, 4, 4, 0, 31)]
    df = spark.createDataFrame(rows, "entity long, event_id long, ts long, win int, change long").withColumns(
        {"mode": F.lit("Ladder"), "current_rating": F.lit(6000)}
    )
    got = tl.rated(ordered(df, "entity", ["ts", "event_id"])).df.orderBy("ts").collect()
    assert [(r["rating_before"], r["rating_after"]) for r in got] == [(5998, 6028), (6028, 6028), (6028, 6000), (6000, 6000)]


def test_zones_and_thresholds(spark):
    df = spark.createDataFrame([(44.99,), (45.0,), (55.0,), (55.01,), (None,)], "v double")
    assert [r[0] for r in df.select(sc.zone("v")).collect()] == ["Bad", "Mid", "Mid", "Good", None]
    t = spark.createDataFrame([(4949,), (4950,), (5000,), (12000,)], "v long")
    got = t.select(bk.next_threshold("v"), bk.next_or_last_threshold("v"), bk.last_threshold("v")).collect()
    assert [tuple(r) for r in got] == [(5000, 5000, 4600), (5000, 5000, 4600), (5500, 5500, 5000), (None, 11500, 11500)]
    marks = spark.createDataFrame([(float(x),) for x in (4600, 5000, 5500, 11500)], "m double")
    rows = t.withColumn("id", F.monotonically_increasing_id())
    large = {r["v"]: r["threshold"] for r in bk.asof_threshold(rows, "v", marks, "m", "next").collect()}
    assert large == {4949: 5000, 4950: 5000, 5000: 5500, 12000: None}


def test_texts_and_dates(spark):
    df = spark.createDataFrame([("9y 36w 5d",), ("10h 21m",), ("",)], "t string")
    # 9 years of 365 days, 36 weeks and 5 days.
    assert [r[0] for r in df.select(sc.duration_seconds("t")).collect()] == [306028800 - 0 if 9 * 31536000 + 36 * 604800 + 5 * 86400 == 306028800 else 9 * 31536000 + 36 * 604800 + 5 * 86400, 37260, None]
    df = spark.createDataFrame([("11,068 / 11309 PB",), ("+31",), ("54%",), ("-7",), ("x",)], "t string")
    assert [r[0] for r in df.select(sc.clean_number("t")).collect()] == [11068.0, 31.0, 54.0, -7.0, None]
    days = [dt.date(2025, 12, 1), dt.date(2025, 11, 2), dt.date(2026, 1, 4)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in df.select(sc.season_days("d")).collect()] == [0, 27, 34]
    assert [r[0] for r in df.select(sc.year_week("d")).collect()] == [d.strftime("%Y-%W") for d in days]


def test_session_time_zone_does_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(1704067200,)], "ts long")
        got = df.select(sc.local_hour("ts", F.lit("Asia/Tokyo")), sc.epoch_of(sc.utc_timestamp("ts"))).first()
        assert tuple(got) == (9, 1704067200)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_content_hash(spark):
    a = [("Big Orc", 3, 0, 1), ("axe", 2, 1, 0)]
    schema = "id int, items array<struct<name:string, level:int, evo:int, hero:int>>"
    df = spark.createDataFrame([(1, a), (2, a[::-1]), (3, [("Big Orc", 4, 0, 1), ("axe", 2, 1, 0)])], schema)
    rows = df.select(sc.content_hash("items").alias("h"), sc.content_hash("items", False).alias("k")).collect()
    assert rows[0]["h"] == hashlib.sha256(b"axe:2:1:0,Big Orc:3:0:1").hexdigest()
    assert rows[0]["k"] == hashlib.sha256(b"axe:1:0,big-orc:0:1").hexdigest()
    assert rows[0]["h"] == rows[1]["h"] != rows[2]["h"]
    assert rows[0]["k"] == rows[1]["k"] == rows[2]["k"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5, 1), (2, 7, 0)], "id int, level int, evo int")
    new = spark.createDataFrame([(1, 6, None), (3, 1, None)], "id int, level int, evo int")
    got = {r["id"]: (r["level"], r["evo"]) for r in ig.upsert_partial(old, new, ["id"], ["level"]).collect()}
    assert got == {1: (6, 1), 2: (7, 0), 3: (1, None)}
    got = {r["id"]: (r["level"], r["evo"]) for r in ig.upsert_replace(old, new, ["id"], ["level"]).collect()}
    assert got == {1: (6, None), 2: (7, 0), 3: (1, None)}
    assert [r["id"] for r in ig.insert_ignore(old, new.union(new), ["id"], ["level"]).collect()] == [3]


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "v int, t string")
    good, bad = ql.expect(df, {"t": F.col("t").isin("a"), "v": F.col("v") < 3})
    assert [r["v"] for r in good.collect()] == [1]
    assert sorted((r["v"], r["rule"]) for r in bad.collect()) == [(2, "t"), (3, "v")]


def test_null_pair_and_empty_metric(spark):
    rows = [(1, 1, 1, 1, 50.0), (1, 2, 2, 1, None), (1, 3, 3, 1, 60.0)]
    got = tl.with_next(sq.sessionize(log(spark, rows)), ["metric"]).df.orderBy("ts").collect()
    assert [(r["next_metric"], r["has_next"]) for r in got] == [(None, True), (60.0, True), (None, False)]


PAGE = """
<html><body><div class="ui battle" id="battle_77" data-timestamp="1700000000.5" data-battle-type="pvp">
<div class="game_mode_header"> Ladder </div><div class="win_loss"><div class="ui red label">Defeat</div></div>
<div class="result_header">0 - 3</div><div class="trophy_container"><div class="ui basic label"> +31 <img src="t.png"></div></div>
<div class="team-segment"><a class="player_name_header" href="/player/ME/x">me</a>
<div class="deck_card__four_wide"><img class="deck_card" alt="Big Orc" data-card-key="big-orc-ev1"><div class="card-level">Lvl14</div></div>
<div class="deck_tower_card__container"><img class="deck_card" alt="Keep"><div class="level"><div>a</div><div>Lvl0</div></div></div></div>
<div class="team-segment"><a class="player_name_header" href="/player/ABC9/battles">you</a></div>
<div class="battle_level_diff">Δ Lvl: -0.5</div>
<div class="battle_stats"><div class="stats"><div class="item"><span class="name">Elixir Leaked</span><span class="value">1.25</span></div></div></div>
</div></body></html>"""


def test_event_page(spark):
    row = ex.extract_pages(spark.createDataFrame([("p", PAGE)], "page string, html string"), ["page"], "html", "events").first()
    assert (row["event_id"], row["ts"], row["mode"], row["win"], row["score_for"], row["score_against"]) == ("77", 1700000000, "Ladder", 0, 0, 3)
    # A gain on a loss is read from the opponent's side.
    assert (row["change"], row["opponent"], row["leak_for"], row["leak_against"], row["level"]) == (0, "ABC9", 1.25, None, -0.5)
    assert [tuple(i) for i in row["own_items"]] == [("Big Orc", 14, 1, 0), ("Keep", 16, 0, 0)]


@pytest.mark.parametrize("kind", ["events", *sorted(ex.SPECS)])
def test_empty_pages_give_no_error(spark, kind):
    pages = spark.createDataFrame([("a", ""), ("b", None), ("c", "<p>open <b>never")], "page string, html string")
    ex.extract_pages(pages, ["page"], "html", kind).collect()


def test_asof_equals_brute_force_in_both_directions(spark):
    import random

    rng = random.Random(5)
    vs = [rng.uniform(-1e4, 1e4) * 10 ** rng.randint(-8, 8) for _ in range(300)] + [0.0, -0.0, 1.0, 2.0, 2.0, 1024.0, -1024.0, 1e308, -1e308, None]
    ms = rng.sample([v for v in vs if v is not None], 60) + [1.5, 1.5, 2.0, None]
    rows = spark.createDataFrame(list(enumerate(vs)), "id int, v double")
    marks = spark.createDataFrame([(m,) for m in ms], "m double")
    known = [m for m in ms if m is not None]
    for direction, want in (("last", lambda v: max((m for m in known if m <= v), default=None)), ("next", lambda v: min((m for m in known if m > v), default=None))):
        got = {r["id"]: r["threshold"] for r in bk.asof_threshold(rows, "v", marks, "m", direction).collect()}
        assert got == {i: want(v) for i, v in enumerate(vs) if v is not None}
    none = bk.asof_threshold(rows, "v", marks.limit(0), "m").filter("threshold is not null").count()
    assert none == 0


def test_asof_neither_orders_nor_writes_the_rows(spark):
    from pyspark.sql import functions as F

    rows, marks = spark.range(1000).select("id", F.col("id").cast("double").alias("v")), spark.range(0, 1000, 7).select(F.col("id").alias("m"))
    plan = bk.asof_threshold(rows, "v", marks, "m")._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window" in line]
    assert len(over_rows) == 2 and "Checkpoint" not in plan and "ExistingRDD" not in plan


def test_seed_file_under_a_declared_schema(spark, tmp_path):
    from pyspark.sql import types as T

    from seqtide.sources import ingest as ig

    (tmp_path / "s.csv").write_text("item,name,cost\n1,a,5\n1,b,6\n2,c,x\n,d,7\n3,,\n")
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("name", T.StringType()), T.StructField("cost", T.IntegerType())])
    kept, bad = ig.read_dimension(spark, str(tmp_path / "s.csv"), schema, ["item"])
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 5), (3, None, None)] and kept.schema == schema
    assert bad.count() == 2


def test_content_hash_keeps_the_place_of_nulls(spark):
    from seqtide.functions import scalar as sc

    rows = [(1, [("a", 1, None, 1)]), (2, [("a", 1, 1, None)]), (3, [("a", None, 1, 1)]), (4, [(None, 1, 1, 1)])]
    df = spark.createDataFrame(rows, "id int, items array<struct<name:string,level:int,evo:int,hero:int>>")
    assert df.select(sc.content_hash("items").alias("h")).distinct().count() == 4


@pytest.mark.parametrize(("kind", "patterns"), [("events", 60), ("profile", 40), ("holdings", 20), ("set_stats", 12)])
def test_a_page_is_searched_once_for_each_field(spark, kind, patterns):
    """A value that stands in a plan several times is searched for as often."""
    pages = spark.createDataFrame([("p", PAGE)], "page string, html string")
    plan = ex.extract_pages(pages, ["page"], "html", kind)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") + plan.count("regexp_extract") <= patterns


def test_baskets_are_read_once(spark):
    events = ex.extract_pages(spark.createDataFrame([("p", PAGE)], "page string, html string"), ["page"], "html", "events")
    items = ex.each(events, ["page"], F.col("own_items"), "i")
    assert items.select("i.name", "i.level", "i.evo").collect() == [("Big Orc", 14, 1), ("Keep", 16, 0)]
    assert items._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 5


def test_search_from_the_first_tag_with_a_class(spark):
    pages = ['<p class="a">x</p><div class="hit">1</div>', 'hit <b>2</b><div class="hit">3</div>', '<div class="xhit">4</div><i class="b hit">5</i>', "<div class='hit", ""]
    got = [tuple(r) for r in spark.createDataFrame([(p,) for p in pages], "h string").select(ex.near(F.col("h"), "hit"), ex.text_in(F.col("h"), "hit")).collect()]
    assert got == [('<div class="hit">1</div>', "1"), (pages[1], "3"), (pages[2], "5"), (pages[3], None), ("", None)]
