"""Queries on scans, maintenance, quality, scalar functions, extraction and streams."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from checks import q_core, q_outcomes, q_trends  # noqa: F401  their queries are reported here
from checks import sql as Q
from checks.q_sets import arch_timeline
from checks.q_trends import regions
from checks.registry import ORACLES, QUERIES, query
from seqtide.functions import scalar as sc
from seqtide.operators import baskets as bs
from seqtide.operators import sequence as sq
from seqtide.plans import outcomes as oc
from seqtide.plans import timeline as tl
from seqtide.session import checkpoint_dir, cut_lineage
from seqtide.sources import extract as ex
from seqtide.sources import ingest as ig
from seqtide.sources import quality as ql
from seqtide.sources import reports as rp
from seqtide.sources import tables
from seqtide.streaming import fold, jobs
from seqtide.streaming import versioned as vt

EV = f"WITH {Q.EV}"
T = f"WITH {Q.tl()}"


# --- scans ------------------------------------------------------------------


@query("s01_j01_event_scan", f"{EV}, {Q.DECKS} SELECT entity, event_id, ts, mode, {Q.i('win')} AS win, {Q.r('metric')} AS metric, {Q.r('metric2')} AS metric2, {Q.r('level')} AS level, {Q.i('change')} AS change, e.deck, archetype FROM ev e LEFT JOIN decks USING (deck)")
def _(spark, sf):
    return tables.events_with_sets(spark, sf).select("entity", "event_id", "ts", "mode", "win", "metric", "metric2", "level", "change", "deck", F.col("arch").alias("archetype"))


@query(
    "s02_event_scan_two_headers_and_special_level",
    f"""{EV}, {Q.DECKS}, {Q.ITEMS}, sp AS (SELECT deck, max(level) AS special FROM deck_items WHERE item IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY 1)
    SELECT event_id, d1.archetype AS arch, d2.archetype AS opp_arch, {Q.r('special')} AS special FROM ev LEFT JOIN decks d1 ON d1.deck = ev.deck LEFT JOIN decks d2 ON d2.deck = ev.opp_deck LEFT JOIN sp ON sp.deck = ev.deck WHERE mode = 'Ladder'""",
)
def _(spark, sf):
    promo = tables.items(spark, sf).filter("type = 'PROMO'").select("item")
    special = tables.deck_items(spark, sf).join(promo, "item", "left_semi").groupBy("deck").agg(F.max("level").alias("special"))
    events = tables.events_with_sets(spark, sf).filter("mode = 'Ladder'")
    return events.join(special, "deck", "left").select("event_id", "arch", "opp_arch", "special")


@query("s03_p02_filtered_scan", "SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE event_type NOT LIKE '%sign%' AND event_type <> 'error' AND props LIKE '%7%'")
def _(spark, sf):
    raw = tables.read(spark, sf, "events")
    kept = raw.filter(~F.col("event_type").like("%sign%") & (F.col("event_type") != "error") & F.col("props").like("%7%"))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("s04_backlog_scan", f"{EV} SELECT event_id, deck, opp_deck FROM ev WHERE metric IS NULL AND deck IS NOT NULL AND opp_deck IS NOT NULL")
def _(spark, sf):
    return ig.backlog(tables.events(spark, sf), "metric", "deck", "opp_deck").select("event_id", "deck", "opp_deck")


@query("s05_dimension_scans", f"WITH {Q.THRESHOLDS} SELECT 'threshold' AS kind, CAST(lim AS VARCHAR) AS id FROM thr UNION ALL SELECT 'type', p_type FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT 'entity', CAST(c_custkey AS VARCHAR) FROM customer")
def _(spark, sf):
    kinds = [
        tables.thresholds(spark).select(F.lit("threshold").alias("kind"), F.col("lower_limit").cast("string").alias("id")),
        tables.items(spark, sf).select(F.lit("type").alias("kind"), F.col("type").alias("id")).distinct(),
        tables.entities(spark, sf).select(F.lit("entity").alias("kind"), F.col("entity").cast("string").alias("id")),
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("s06_j02_set_members_lookup", f"{EV}, {Q.ITEMS} SELECT deck, item, {Q.r('level')} AS level FROM deck_items WHERE deck IN (SELECT opp_deck FROM ev)")
def _(spark, sf):
    wanted = tables.events(spark, sf).select(F.col("opp_deck").alias("deck"))
    return ig.members_of(tables.deck_items(spark, sf), wanted).select("deck", "item", "level")


@query("j03_sets_used_by_events", f"{EV}, {Q.DECKS} SELECT deck, archetype FROM decks WHERE deck IN (SELECT deck FROM ev)")
def _(spark, sf):
    return ig.used_sets(tables.decks(spark, sf), tables.events(spark, sf), "deck")


# --- maintenance --------------------------------------------------------------

OLD, NEW = "event_id % 2 = 0", "event_id % 3 = 0"


def halves(spark, sf):
    ev = tables.events(spark, sf).select("event_id", "entity", "ts", "win", "metric", "deck")
    return ev.filter(OLD), ev.filter(NEW)


@query("s13_high_water_mark", f"{EV}, m AS (SELECT entity, max(ts) - 864000 AS mark FROM ev WHERE event_id % 2 = 0 GROUP BY 1) SELECT event_id, ev.entity, ts FROM ev LEFT JOIN m USING (entity) WHERE event_id % 3 = 0 AND (mark IS NULL OR ts > mark)")
def _(spark, sf):
    old, new = halves(spark, sf)
    marks = ig.high_water(old, "entity", "ts").withColumn("mark", F.col("mark") - 864000)
    return ig.only_new(new, marks, "entity", "ts").select("event_id", "entity", "ts")


@query("s14_j05_insert_or_ignore", f"{EV} SELECT event_id, entity FROM ev WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def _(spark, sf):
    old, new = halves(spark, sf)
    return ig.insert_ignore(old, new.unionByName(new), ["event_id"], ["ts"]).select("event_id", "entity")


ORD = "o_orderkey AS id, o_custkey AS c, o_totalprice AS v, o_orderpriority AS p"


@query(
    "s15_upsert_replace",
    f"""WITH t AS (SELECT {ORD} FROM orders WHERE o_orderkey % 2 = 0), u AS (SELECT o_orderkey AS id, o_custkey AS c, o_totalprice + 1 AS v, 'new' AS p FROM orders WHERE o_orderkey % 3 = 0)
    SELECT id, c, {Q.r('v')} AS v, p FROM u UNION ALL SELECT id, c, {Q.r('v')}, p FROM t WHERE id NOT IN (SELECT id FROM u)""",
)
def _(spark, sf):
    o = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("p"))
    upd = o.filter("id % 3 = 0").withColumns({"v": F.col("v") + 1, "p": F.lit("new")})
    older = o.filter("id % 3 = 0").withColumn("p", F.lit("mid"))
    return ig.upsert_replace(o.filter("id % 2 = 0"), older.unionByName(upd), ["id"], ["v"])


@query(
    "s16_s18_upsert_partial",
    f"""WITH t AS (SELECT {ORD} FROM orders WHERE o_orderkey % 2 = 0), u AS (SELECT o_orderkey AS id, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 3 = 0)
    SELECT coalesce(t.id, u.id) AS id, c, {Q.r('CASE WHEN u.id IS NOT NULL THEN u.v ELSE t.v END')} AS v, p FROM t FULL JOIN u ON t.id = u.id""",
)
def _(spark, sf):
    o = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("p"))
    upd = o.filter("id % 3 = 0").select("id", (F.col("v") + 1).alias("v"))
    return ig.upsert_partial(o.filter("id % 2 = 0"), upd, ["id"], ["v"])


@query("s17_set_statistics_mart", f"{EV} SELECT entity, deck, count(*) AS battles, {Q.i('sum(win)')} AS wins, {Q.r('avg(win)')} AS confidence FROM ev GROUP BY 1, 2")
def _(spark, sf):
    return ig.set_stats(tables.events(spark, sf), "entity", "deck", "win", F.current_timestamp()).drop("last_updated")


@query(
    "s19_backfill_metric",
    f"{EV}, {Q.DECKS}, sc AS (SELECT archetype, avg(metric) AS s FROM ev JOIN decks USING (deck) GROUP BY 1), ds AS (SELECT deck, s FROM decks JOIN sc USING (archetype)) SELECT event_id, {Q.r('coalesce(metric, s)')} AS metric FROM ev LEFT JOIN ds USING (deck)",
)
def _(spark, sf):
    ev, decks = tables.events(spark, sf), tables.decks(spark, sf)
    means = ev.join(decks, "deck").groupBy("archetype").agg(F.avg("metric").alias("s"))
    return ig.backfill(ev, decks.join(means, "archetype"), ["deck"], "metric", "s").select("event_id", "metric")


DUR = """concat_ws(', ', CASE WHEN {0} // 86400 > 0 THEN ({0} // 86400) || ' days' END, CASE WHEN {0} % 86400 // 3600 > 0 THEN ({0} % 86400 // 3600) || ' hours' END, CASE WHEN {0} % 3600 // 60 > 0 THEN ({0} % 3600 // 60) || ' minutes' END)"""


def told(name: str, expr: str, digits: int, scale: int = 1, end: str = "") -> str:
    """The SQL of one metric line."""
    return f"'{name}: ' || printf('%.{digits}f', {Q.rd(f'{expr} * {scale}', digits)}) || '{end}'"


SESSION_LINES = [f"'Events: ' || {Q.i('n_valid')}", *[told(*line) for line in rp.SESSION_METRICS]]
GLOBAL_LINES = [told(name, f"avg({expr})", digits, scale, end) for name, expr, digits, scale, end in rp.GLOBAL_METRICS]


@query(
    "s20_f04_session_log",
    f"""{T}, {Q.sessions()}, ln AS (SELECT entity, session_no, rn AS after, 0 AS line_no, '[' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') || '] ' || mode || ' vs ' || opponent || ' | ' || CASE WHEN win = 1 THEN 'WIN' ELSE 'LOSE' END || ' -> ' || score_for || '-' || score_against
      || CASE WHEN rating_after IS NOT NULL THEN ' | ' || rating_before || ' -> ' || rating_after || ' (' || CASE WHEN variation >= 0 THEN '+' ELSE '' END || variation || ')' ELSE '' END
      || CASE WHEN metric IS NOT NULL THEN ' | M: ' || printf('%.1f', CAST(round(CAST(metric AS DECIMAL(38, 9)), 1) AS DOUBLE)) || '%' ELSE ' | M: null' END || CASE WHEN metric2 IS NOT NULL THEN ' (M2: ' || printf('%.1f', metric2) || '%)' ELSE '' END
      || CASE WHEN level IS NOT NULL THEN ' - Lvl: ' || printf('%.1f', level) ELSE '' END AS line FROM tl
    UNION ALL SELECT entity, session_no, NULL, k, ls[k] FROM (SELECT entity, session_no, [{', '.join(SESSION_LINES)}] AS ls FROM sm), range(1, {len(SESSION_LINES) + 1}) AS t(k)
    UNION ALL SELECT entity, session_no, NULL, {len(SESSION_LINES) + 1}, '[STOP: ' || stop_type || ' (' || {DUR.format('break_s')} || ')]' FROM tl WHERE is_last AND stop_type <> 'End'
    UNION ALL SELECT entity, NULL, NULL, k, ls[k] FROM (SELECT entity, ['All sessions: ' || count(*), {', '.join(GLOBAL_LINES)}] AS ls FROM sm GROUP BY 1), range(1, {len(GLOBAL_LINES) + 2}) AS t(k))
    SELECT entity, session_no, {Q.i('after')} AS after, {Q.i('line_no')} AS line_no, line, 'r1' AS run FROM ln""",
)
def _(spark, sf):
    """The whole log written twice under one run id, and read back."""
    log = cut_lineage(rp.session_log(tl.timeline(spark, sf)))  # a write reads it twice, to find its ranges and to deal it
    path = f"{checkpoint_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    for _ in range(2):
        rp.write_session_log(log, path, "r1", 8)
    return spark.read.parquet(path).drop("entity_bucket")


REPORTED = {
    "debt_extinction": ("a15_debt_extinction", "measure", "''", "n1 + n2", "u", "p"),
    "fisher_streaks": ("a32_streak_odds_fisher", "kind", "CAST(entity AS VARCHAR)", "a + b + c + d", "odds", "p"),
    "odds_correlation": ("a33_p14_odds_correlation", "kind", "trait", "n", "rho", "p"),
    "streak_independence": ("a34_streak_zone_chi2", "''", "CAST(entity AS VARCHAR)", "n", "chi2", "p"),
    "time_kruskal": ("a56_time_kruskal", "axis", "measure", "n", "h", "p"),
}


@query(
    "s21_p16_report_rows",
    " UNION ALL ".join(
        f"SELECT '{test}' AS test, {section} AS section, {grp} AS grp, CAST({n} AS BIGINT) AS n, CAST({stat} AS DOUBLE) AS stat, {p} AS p, CASE WHEN {p} < 0.05 THEN 'significant' WHEN {p} IS NOT NULL THEN 'not significant' END AS verdict, 'r1' AS run FROM ({ORACLES[name]}) r"
        for test, (name, section, grp, n, stat, p) in REPORTED.items()
    ),
)
def _(spark, sf):
    """Five families of tests in the common schema, written twice under one run id, and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    sql = lambda e: F.expr(e.replace("VARCHAR", "STRING"))
    rows = [
        rp.report_rows(QUERIES[name](spark, sf).withColumns({"__n": sql(n)}), test, "__n", stat, p, section=sql(section), grp=sql(grp))
        for test, (name, section, grp, n, stat, p) in REPORTED.items()
    ]
    for _ in range(2):
        rp.write_report(functools.reduce(DataFrame.unionByName, rows), path, "r1")
    return spark.read.parquet(path)


@query(
    "s22_chart_points",
    f"""{T}, c AS (SELECT *, sum(CASE WHEN metric IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts, event_id) AS s FROM tl)
    SELECT entity, {Q.r('s')} AS x, {Q.r('metric')} AS y, CASE WHEN win = 1 THEN 'green' ELSE 'red' END AS mark FROM c WHERE metric IS NOT NULL
    UNION ALL SELECT entity, {Q.r('s + 0.5')}, NULL, stop_type FROM c WHERE is_last AND stop_type <> 'End' AND s > 0""",
)
def _(spark, sf):
    return rp.chart_points(tl.timeline(spark, sf))


# --- quality ---------------------------------------------------------------------


@query("q01_domain_checks", "SELECT rule, count(*) AS n FROM (SELECT 'type' AS rule FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') UNION ALL SELECT 'cost' FROM part WHERE p_size NOT BETWEEN 1 AND 40) GROUP BY 1")
def _(spark, sf):
    rules = {"type": F.col("type").isin("ECONOMY", "STANDARD", "PROMO"), "cost": F.col("cost").between(1, 40)}
    return ql.expect(tables.items(spark, sf), rules)[1].groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("q02_cross_column_rules", "SELECT rule, count(*) AS n FROM (SELECT 'promo_is_cheap' AS rule FROM part WHERE p_type = 'PROMO' AND p_size > 10 UNION ALL SELECT 'economy_price' FROM part WHERE p_type = 'ECONOMY' AND p_retailprice > 1000) GROUP BY 1")
def _(spark, sf):
    p = tables.read(spark, sf, "part")
    rules = {
        "promo_is_cheap": (F.col("p_type") != "PROMO") | (F.col("p_size") <= 10),
        "economy_price": (F.col("p_type") != "ECONOMY") | (F.col("p_retailprice") <= 1000),
    }
    return ql.expect(p, rules)[1].groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("q03_unsupported_flags", f"WITH {Q.ITEMS} SELECT deck, item FROM deck_items JOIN part ON p_partkey = item WHERE evo = 1 AND p_size % 2 <> 0")
def _(spark, sf):
    items = tables.items(spark, sf).withColumn("can_evolve", (F.col("cost") % 2 == 0).cast("int"))
    return ql.unsupported_flags(tables.deck_items(spark, sf), items, "evo", "can_evolve").select("deck", "item")


@query(
    "q04_keys_and_references",
    f"""{EV} SELECT 'duplicate_line' AS rule, count(*) AS n FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'deck_without_lines', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) UNION ALL SELECT 'event_without_entity', count(*) FROM ev WHERE entity NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customer_without_deck', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'event_without_deck', count(*) FROM ev WHERE deck NOT IN (SELECT o_orderkey FROM orders)""",
)
def _(spark, sf):
    lines, ev = tables.read(spark, sf, "lineitem"), tables.events(spark, sf)
    people, orders = tables.read(spark, sf, "customer"), tables.read(spark, sf, "orders")
    rules = {
        "duplicate_line": ql.duplicate_keys(lines, ["l_orderkey", "l_partkey"]),
        "deck_without_lines": ql.orphans(tables.decks(spark, sf), lines, "deck", "l_orderkey"),
        "event_without_entity": ql.orphans(ev, people, "entity", "c_custkey"),
        "customer_without_deck": ql.orphans(people, orders, "c_custkey", "o_custkey"),
        "event_without_deck": ql.orphans(ev.filter("deck is not null"), orders, "deck", "o_orderkey"),
    }
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n") for name, d in rules.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("q05_complete_sets", f"{EV}, ok AS (SELECT l_orderkey AS deck FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) = 4) SELECT event_id FROM ev WHERE deck IN (SELECT deck FROM ok) AND opp_deck IN (SELECT deck FROM ok)")
def _(spark, sf):
    whole = ig.complete_sets(tables.deck_items(spark, sf), "deck", 4)
    ev = tables.events(spark, sf).join(whole, "deck", "left_semi").join(whole.withColumnRenamed("deck", "opp_deck"), "opp_deck", "left_semi")
    return ev.select("event_id")


# --- projections and scalar functions ------------------------------------------------


@query(
    "p01_p07_zones_and_flags",
    f"""{T}, {Q.streaks()} SELECT event_id, CASE WHEN metric < 45 THEN 'Bad' WHEN metric > 55 THEN 'Good' WHEN metric IS NOT NULL THEN 'Mid' END AS zone, CASE WHEN level < -0.5 THEN 'Neg' WHEN level > 0.5 THEN 'Pos' WHEN level IS NOT NULL THEN 'Even' END AS level_zone,
    {Q.i('metric > 80')} AS is_high, {Q.i('metric < 30')} AS is_low, CASE WHEN win = 1 THEN 'W' WHEN metric < 40 THEN 'C' ELSE 'L' END AS symbol,
    CASE WHEN streak_before >= 2 THEN 'Win_Streak' WHEN streak_before <= -2 THEN 'Lose_Streak' ELSE 'No_Streak' END AS streak2, CASE WHEN win = 0 AND change > 0 THEN 0 ELSE {Q.i('coalesce(change, 0)')} END AS clean FROM sk""",
)
def _(spark, sf):
    return sq.streaks(tl.timeline(spark, sf)).df.select(
        "event_id", sc.zone("metric").alias("zone"), sc.zone("level", -0.5, 0.5, ("Neg", "Even", "Pos")).alias("level_zone"), (F.col("metric") > 80).alias("is_high"),
        (F.col("metric") < 30).alias("is_low"), sc.outcome_symbol("win", "metric").alias("symbol"), sc.streak_category("streak_before", 2).alias("streak2"), sc.clean_change("win", "change").alias("clean"),
    )


@query(
    "p08_p12_buckets_and_slots",
    f"""{T}, {Q.REGION}, h AS (SELECT tl.*, ((ts + shift_h * 3600) // 3600) % 24 AS hour FROM tl JOIN rg ON rg.nation = entity % 25)
    SELECT event_id, """ + ", ".join(f"CAST(floor(rating_before / {w}.0) * {w} AS BIGINT) AS b{w}" for w in (50, 100, 150, 200, 250, 400, 500, 1000, 1500))
    + f", CAST(floor(level / 0.5) AS BIGINT) AS level_half, hour // 4 AS slot4, hour // 6 AS slot6, hour // 8 AS slot8, CASE WHEN hour < 6 THEN 'Night' WHEN hour < 12 THEN 'Morning' WHEN hour < 18 THEN 'Afternoon' ELSE 'Evening' END AS slot, {Q.i('hour < 7')} AS night FROM h",
)
def _(spark, sf):
    rows = tl.timeline(spark, sf).df.join(regions(spark, sf), "entity", "left").withColumn("hour", sc.local_hour("ts", "tz"))
    return rows.select(
        "event_id", *[sc.bucket("rating_before", w).alias(f"b{w}") for w in (50, 100, 150, 200, 250, 400, 500, 1000, 1500)], F.floor(F.col("level") / 0.5).cast("long").alias("level_half"),
        sc.day_slot("hour", 4).alias("slot4"), sc.day_slot("hour", 6).alias("slot6"), sc.day_slot("hour", 8).alias("slot8"), sc.named_slot("hour").alias("slot"), (F.col("hour") < 7).alias("night"),
    )


@query("p15_reliability_filter", f"{EV} SELECT entity, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) > 50")
def _(spark, sf):
    return tables.events(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter("n > 50")


HASH = """WITH li AS (SELECT l_orderkey AS deck, p_name AS name, max(CAST(l_quantity AS BIGINT)) AS level, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS evo, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS hero FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


@query(
    "f01_f02_content_hash",
    f"""{HASH} SELECT deck, sha256(string_agg(name || ':' || level || ':' || evo || ':' || hero, ',' ORDER BY replace(lower(name), ' ', '-'))) AS deck_hash,
    sha256(string_agg(replace(lower(name), ' ', '-') || ':' || evo || ':' || hero, ',' ORDER BY replace(lower(name), ' ', '-'))) AS archetype_hash, string_agg(replace(lower(name), ' ', '-') || CASE WHEN evo = 1 THEN '-ev1' ELSE '' END, ' ' ORDER BY replace(lower(name), ' ', '-') || CASE WHEN evo = 1 THEN '-ev1' ELSE '' END) AS keys FROM li GROUP BY 1""",
)
def _(spark, sf):
    names = tables.items(spark, sf).select("item", F.col("item_name").alias("name"))
    lines = tables.deck_items(spark, sf).join(names, "item").groupBy("deck", "name").agg(F.max("level").cast("long").alias("level"), F.max("evo").alias("evo"), F.max("hero").alias("hero"))
    # A basket is a handful of items: the array per deck is bounded by the basket size.
    sets = lines.groupBy("deck").agg(F.collect_list(F.struct("name", "level", "evo", "hero")).alias("items"))
    keys = F.array_join(F.array_sort(F.transform("items", lambda i: sc.item_key(i["name"], i["evo"]))), " ")
    return sets.select("deck", sc.content_hash("items").alias("deck_hash"), sc.content_hash("items", False).alias("archetype_hash"), keys.alias("keys"))


@query(
    "f03_f05_durations_and_times",
    f"""WITH d AS (SELECT event_id, event_id % 9 AS y, event_id % 50 AS w, event_id % 7 AS dd, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT event_id, y * 31536000 + w * 604800 + dd * 86400 AS seconds, CASE WHEN {DUR.format('(event_id * 977)')} = '' THEN '< 1 minute' ELSE {DUR.format('(event_id * 977)')} END AS text, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS at, s AS back FROM d""",
)
def _(spark, sf):
    e = F.col("event_id")
    raw = tables.read(spark, sf, "events")
    text = F.concat((e % 9).cast("string"), F.lit("y "), (e % 50).cast("string"), F.lit("w "), (e % 7).cast("string"), F.lit("d"))
    s = sc.epoch_of("ts")
    return raw.select("event_id", sc.duration_seconds(text).alias("seconds"), sc.duration_text(e * 977).alias("text"), F.date_format(sc.utc_timestamp(s), "yyyy-MM-dd HH:mm:ss").alias("at"), sc.epoch_of(sc.utc_timestamp(s)).alias("back"))


@query(
    "f07_f08_weeks_and_seasons",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT *, date_trunc('month', d)::DATE AS m1, (date_trunc('month', d) - INTERVAL 1 MONTH)::DATE AS m0 FROM d),
    f AS (SELECT *, m1 + CAST((8 - isodow(m1)) % 7 AS INTEGER) AS f1, m0 + CAST((8 - isodow(m0)) % 7 AS INTEGER) AS f0 FROM m)
    SELECT o_orderkey, strftime(d, '%Y-%W') AS week, CAST(f1 AS VARCHAR) AS first_monday, CAST(d - CASE WHEN d >= f1 THEN f1 ELSE f0 END AS BIGINT) AS season_days FROM f""",
)
def _(spark, sf):
    o = tables.read(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    return o.select("o_orderkey", sc.year_week(d).alias("week"), sc.first_monday(d).cast("string").alias("first_monday"), sc.season_days(d).alias("season_days"))


@query(
    "f09_f10_numbers_and_math",
    f"""SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 + p_partkey % 1000 AS cleaned, {Q.r('exp(-p_size / 10.0::DOUBLE)')} AS e, {Q.r('sqrt(p_retailprice)')} AS root, {Q.r('greatest(0.0::DOUBLE, p_retailprice - 1000)')} AS over, p_partkey // 7 AS q, p_partkey % 7 AS m, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS pct FROM part""",
)
def _(spark, sf):
    p = tables.read(spark, sf, "part")
    n = F.col("p_size").cast("long") * 1000 + F.col("p_partkey") % 1000
    text = F.concat(F.format_number(n, 0), F.lit(" / 99999 PB"))
    pct = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("%"))).otherwise("n/a")
    return p.select(
        "p_partkey", sc.clean_number(text).cast("long").alias("cleaned"), F.exp(-F.col("p_size") / 10).alias("e"), F.sqrt("p_retailprice").alias("root"), F.greatest(F.lit(0.0), F.col("p_retailprice") - 1000).alias("over"),
        F.floor(F.col("p_partkey") / 7).alias("q"), (F.col("p_partkey") % 7).alias("m"), sc.clean_number(pct).alias("pct"),
    )


@query("f11_outcome_strings", f"""{T} SELECT event_id, concat(CASE prev2_win WHEN 1 THEN 'W' WHEN 0 THEN 'L' ELSE '' END, CASE prev_win WHEN 1 THEN 'W' WHEN 0 THEN 'L' ELSE '' END, CASE win WHEN 1 THEN 'W' ELSE 'L' END) AS pattern FROM tl""")
def _(spark, sf):
    s = tl.with_prev(tl.timeline(spark, sf), ["win"], 2)
    letter = {c: F.when(F.col(c) == 1, "W").when(F.col(c) == 0, "L") for c in ("win", "prev_win", "prev2_win")}
    return s.df.select("event_id", F.concat_ws("", letter["prev2_win"], letter["prev_win"], letter["win"]).alias("pattern"))


@query("f12_json_fields", """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, '{"e":' || event_id || ',"t":"' || event_type || '"}' AS payload FROM events""")
def _(spark, sf):
    raw = tables.read(spark, sf, "events")
    return raw.select("event_id", sc.json_field("props", "$.k").cast("long").alias("k"), sc.json_payload(e="event_id", t="event_type").alias("payload"))


@query(
    "f13_f14_e03_arrays_and_defaults",
    f"""WITH {Q.ITEMS}, s AS (SELECT deck, list(item ORDER BY item) AS items FROM deck_items GROUP BY 1), p AS (SELECT a.deck, a.items AS x, b.items AS y FROM s a LEFT JOIN s b ON b.deck = a.deck + 1)
    SELECT deck, {Q.i('len(x)')} AS n, x[1] AS first, {Q.i('coalesce(list_contains(x, 7), FALSE)')} AS has7, {Q.i('coalesce(len(list_intersect(x, y)), 0)')} AS shared, {Q.i('len(list_distinct(list_concat(x, coalesce(y, []))))')} AS joined, {Q.i('len(list_filter(x, lambda i: NOT list_contains(coalesce(y, []), i)))')} AS only_x FROM p""",
)
def _(spark, sf):
    s = tables.deck_items(spark, sf).groupBy("deck").agg(F.sort_array(F.collect_set("item")).alias("x"))
    nxt = s.select((F.col("deck") - 1).alias("deck"), F.col("x").alias("y"))
    p = s.join(nxt, "deck", "left").withColumn("y", F.coalesce("y", F.array().cast("array<bigint>")))
    return p.select(
        "deck", F.size("x").alias("n"), F.element_at("x", 1).alias("first"), F.array_contains("x", 7).alias("has7"), F.size(F.array_intersect("x", "y")).alias("shared"),
        F.size(F.array_union("x", "y")).alias("joined"), F.size(F.array_except("x", "y")).alias("only_x"),
    )


@query("e01_e04_table_sets", f"{EV} SELECT kind, count(*) AS n FROM (SELECT 'union' AS kind, x FROM (SELECT entity AS x FROM ev UNION SELECT opponent FROM ev) UNION ALL SELECT 'intersect', x FROM (SELECT entity AS x FROM ev INTERSECT SELECT opponent FROM ev) UNION ALL SELECT 'except', x FROM (SELECT opponent AS x FROM ev EXCEPT SELECT entity FROM ev)) GROUP BY 1")
def _(spark, sf):
    ev = tables.events(spark, sf)
    a, b = ev.select(F.col("entity").alias("x")), ev.select(F.col("opponent").alias("x"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": b.subtract(a)}
    out = None
    for kind, d in parts.items():
        n = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("g05_group_statistics", f"{T} SELECT mode, count(metric) AS n, {Q.r('avg(metric)')} AS avg, {Q.r('stddev_samp(metric)')} AS sd, {Q.r('var_samp(metric)')} AS variance FROM tl GROUP BY 1 HAVING count(metric) >= 20")
def _(spark, sf):
    return tl.timeline(spark, sf).df.groupBy("mode").agg(F.count("metric").alias("n"), F.avg("metric").alias("avg"), F.stddev_samp("metric").alias("sd"), F.var_samp("metric").alias("variance")).filter("n >= 20")


@query("g08_two_by_two", f"{T} SELECT entity, count(*) FILTER (metric < 45 AND next_metric > 55) AS a, count(*) FILTER (metric < 45 AND next_metric <= 55) AS b, count(*) FILTER (metric >= 45 AND next_metric > 55) AS c, count(*) FILTER (metric >= 45 AND next_metric <= 55) AS d FROM tl GROUP BY 1")
def _(spark, sf):
    low, high = F.col("metric") < 45, F.col("next_metric") > 55
    return tl.with_next(tl.timeline(spark, sf), ["metric"]).df.groupBy("entity").agg(F.count_if(low & high).alias("a"), F.count_if(low & ~high).alias("b"), F.count_if(~low & high).alias("c"), F.count_if(~low & ~high).alias("d"))


@query(
    "g16_hour_histogram",
    f"""{T}, {Q.REGION}, h AS (SELECT entity, ((ts + shift_h * 3600) // 3600) % 24 AS hour, count(*) AS n FROM tl JOIN rg ON rg.nation = entity % 25 GROUP BY 1, 2) SELECT entity, {Q.i('sum(n)')} AS n, {Q.r('max(n) / sum(n)')} AS top_share, count(*) AS hours FROM h GROUP BY 1""",
)
def _(spark, sf):
    rows = tl.timeline(spark, sf).df.join(regions(spark, sf), "entity", "left").groupBy("entity", sc.local_hour("ts", "tz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("entity").agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("top_share"), F.count(F.lit(1)).alias("hours"))


@query("g24_k03_top_categories", f"{EV}, {Q.DECKS}, c AS (SELECT archetype, count(*) AS n FROM ev JOIN decks USING (deck) GROUP BY 1) SELECT archetype, n FROM c ORDER BY n DESC, archetype LIMIT 10")
def _(spark, sf):
    return tables.events_with_sets(spark, sf).groupBy(F.col("arch").alias("archetype")).agg(F.count(F.lit(1)).alias("n")).filter("archetype IS NOT NULL").orderBy(F.col("n").desc(), "archetype").limit(10)


@query("k04_most_used_decks", f"{EV}, c AS (SELECT entity, deck, count(*) AS n FROM ev GROUP BY 1, 2) SELECT entity, deck, n, place FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, deck) AS place FROM c) WHERE place <= 3")
def _(spark, sf):
    return bs.top_n(tables.events(spark, sf).groupBy("entity", "deck").agg(F.count(F.lit(1)).alias("n")), ["entity"], "n", "deck", 3)


@query("k01_k05_sorted_extremes", f"{EV}, {Q.DECKS}, c AS (SELECT entity, archetype, avg(win) AS r FROM ev JOIN decks USING (deck) GROUP BY 1, 2) SELECT entity, arg_max(archetype, struct_pack(a := r, b := archetype)) AS best, {Q.r('max(r)')} AS best_rate, arg_min(archetype, struct_pack(a := r, b := archetype)) AS worst, {Q.r('min(r)')} AS worst_rate FROM c GROUP BY 1 ORDER BY best_rate DESC, entity")
def _(spark, sf):
    rates = tables.events_with_sets(spark, sf).filter("arch IS NOT NULL").groupBy("entity", "arch").agg(F.avg("win").alias("r"))
    return rates.groupBy("entity").agg(F.max_by("arch", F.struct("r", "arch")).alias("best"), F.max("r").alias("best_rate"), F.min_by("arch", F.struct("r", "arch")).alias("worst"), F.min("r").alias("worst_rate")).orderBy(F.col("best_rate").desc(), "entity")


@query("w19_category_frequency", f"WITH {Q.tl()}, {Q.DECKS}, a AS (SELECT event_id, entity, ts, archetype AS x FROM tl LEFT JOIN decks ON decks.deck = opp_deck), h AS (SELECT *, list(x) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l FROM a) SELECT event_id, {Q.r('coalesce(len(list_filter(l, lambda i: i = x)) / CAST(len(l) AS DOUBLE), 0)')} AS freq FROM h")
def _(spark, sf):
    s = arch_timeline(spark, sf).near({"l": lambda w: F.collect_list("opp_arch").over(w.rowsBetween(-10, -1))}, back=10)
    freq = F.coalesce(F.try_divide(F.size(F.filter("l", lambda x: x == F.col("opp_arch"))), F.size("l")), F.lit(0.0))
    return s.df.select("event_id", freq.alias("freq"))


@query("w23_average_ranks", f"{T} SELECT event_id, {Q.r('rank() OVER (PARTITION BY mode ORDER BY metric) + (count(*) OVER (PARTITION BY mode, metric) - 1) / 2.0')} AS avg_rank FROM tl WHERE metric IS NOT NULL")
def _(spark, sf):
    from seqtide.operators.ranks import add_rank_columns

    rows = tl.timeline(spark, sf).df.filter("metric IS NOT NULL").select("event_id", "mode", "metric")
    return add_rank_columns(rows, ["mode"], {"metric": "avg_rank"}).select("event_id", "avg_rank")


@query("h05_fisher", f"{EV} SELECT mode, a, b, c, d, {Q.r('a * d / CAST(b * c AS DOUBLE)')} AS odds, {Q.r(Q.fisher_sf('a', 'b', 'c', 'd'))} AS p FROM (SELECT mode, count(*) FILTER (win = 1 AND k > 50) AS a, count(*) FILTER (win = 1 AND k <= 50) AS b, count(*) FILTER (win = 0 AND k > 50) AS c, count(*) FILTER (win = 0 AND k <= 50) AS d FROM ev GROUP BY 1)")
def _(spark, sf):
    from seqtide.operators import hypothesis as hy

    k = F.get_json_object("props", "$.k").cast("long")
    raw = tables.read(spark, sf, "events").select("event_id", k.alias("k"))
    ev = tables.events(spark, sf).select("event_id", "mode", "win").join(raw, "event_id")
    w, h = F.col("win") == 1, F.col("k") > 50
    t = ev.groupBy("mode").agg(F.count_if(w & h).alias("a"), F.count_if(w & ~h).alias("b"), F.count_if(~w & h).alias("c"), F.count_if(~w & ~h).alias("d"))
    return hy.fisher_2x2(t, "a", "b", "c", "d")


# --- extraction: pages rendered from the given tables, then parsed back ------------------


def landed_events(spark, sf) -> DataFrame:
    """History pages of 25 events rendered from the event and basket tables."""
    lines = tables.deck_items(spark, sf)
    img = F.concat(
        F.lit('<div class="deck_card__four_wide"><img class="deck_card" alt="'), F.col("item").cast("string"), F.lit('" data-card-key="'), F.col("item").cast("string"),
        F.when(F.col("evo") == 1, "-ev1").otherwise(""), F.when(F.col("hero") == 1, "-hero").otherwise(""), F.lit('"><div class="card-level">Lvl'), F.col("level").cast("int").cast("string"), F.lit("</div></div>"),
    )
    decks = lines.groupBy("deck").agg(F.array_join(F.array_sort(F.collect_list(img)), "").alias("html"))
    tower = '<div class="deck_tower_card__container"><img class="deck_card" alt="Keep"><div class="level"><div>x</div><div>Lvl12</div></div></div>'
    ev = tables.events(spark, sf).join(decks.withColumnRenamed("html", "own"), "deck", "left").join(decks.select(F.col("deck").alias("opp_deck"), F.col("html").alias("other")), "opp_deck", "left")
    txt = lambda c: F.col(c).cast("string")
    div = F.concat(
        F.lit('<div class="ui battle" id="battle_'), txt("event_id"), F.lit('" data-timestamp="'), txt("ts"), F.lit('.0" data-battle-type="pvp"><div class="game_mode_header">'), txt("mode"),
        F.lit('</div><div class="win_loss"><div class="ui label">'), F.when(F.col("win") == 1, "Victory").otherwise("Defeat"), F.lit('</div></div><div class="result_header">'), txt("score_for"), F.lit(" - "), txt("score_against"), F.lit("</div>"),
        F.when(F.col("change").isNotNull(), F.concat(F.lit('<div class="trophy_container"><div class="ui basic label">'), F.when(F.col("change") > 0, "+").otherwise(""), txt("change"), F.lit("<i></i></div></div>"))).otherwise(""),
        F.when(F.col("level").isNotNull(), F.concat(F.lit('<div class="battle_level_diff">Δ Lvl: '), txt("level"), F.lit("</div>"))).otherwise(""),
        F.lit('<div class="team-segment">'), F.coalesce("own", F.lit("")), F.lit(tower), F.lit('</div><div class="team-segment"><a class="player_name_header" href="/player/'), txt("opponent"), F.lit('/x">n</a>'), F.coalesce("other", F.lit("")),
        F.lit('</div><div class="battle_stats"><div class="stats"><div class="item"><span class="name">Elixir Leaked</span><span class="value">'), txt("leak_for"),
        F.lit('</span></div><div class="item"><span class="name">Elixir Leaked</span><span class="value">'), txt("leak_against"), F.lit("</span></div></div></div></div>"),
    )
    page = F.floor(F.col("event_id") / 25)
    return ev.groupBy(page.alias("page")).agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", div.alias("d")))), lambda x: x["d"]), ""), F.lit("</body></html>")).alias("html"))


@query(
    "s07_event_page_extraction",
    f"""{EV} SELECT event_id, ts, mode, {Q.i('win')} AS win, score_for, score_against, CASE WHEN win = 0 AND change > 0 THEN 0 ELSE {Q.i('change')} END AS change, CAST(opponent AS VARCHAR) AS opponent, {Q.r('leak_for')} AS leak_for, {Q.r('leak_against')} AS leak_against, {Q.r('level')} AS level FROM ev""",
)
def _(spark, sf):
    rows = ex.extract_pages(landed_events(spark, sf), ["page"], "html", "events")
    return rows.select(F.col("event_id").cast("long").alias("event_id"), "ts", "mode", "win", "score_for", "score_against", "change", "opponent", "leak_for", "leak_against", "level")


@query(
    "s08_basket_extraction",
    f"""{EV}, {Q.ITEMS} SELECT event_id, CAST(item AS VARCHAR) AS name, CAST(d.level AS BIGINT) AS level, {Q.i('evo')} AS evo, {Q.i('hero')} AS hero FROM ev JOIN deck_items d USING (deck) UNION ALL SELECT event_id, 'Keep', 12, 0, 0 FROM ev""",
)
def _(spark, sf):
    rows = ex.extract_pages(landed_events(spark, sf), ["page"], "html", "events")
    return ex.each(rows.withColumn("event_id", F.col("event_id").cast("long")), ["event_id"], F.col("own_items"), "i").select("event_id", "i.*")


@query("s12_oldest_on_page", f"{EV} SELECT event_id // 25 AS page, min(ts) AS oldest_ts FROM ev GROUP BY 1")
def _(spark, sf):
    return ex.oldest_on_page(ex.extract_pages(landed_events(spark, sf), ["page"], "html", "events"), ["page"])


@query(
    "s09_profile_extraction",
    "SELECT c_custkey AS entity, c_name AS name, 'None' AS clan, c_custkey * 7 + 1000 AS rating, c_custkey * 3 AS wins, c_custkey * 2 AS losses, (c_custkey % 9) * 31536000 + (c_custkey % 50) * 604800 AS account_age_s, CAST(c_custkey % 13 AS DOUBLE) + 0.5 AS games_per_day FROM customer",
)
def _(spark, sf):
    # Short rows with long work: as many tasks as a shuffle has, however few row groups the file has.
    c = tables.entities(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "entity")
    n = lambda e: F.format_number(e, 0)
    row = lambda label, value: F.concat(F.lit(f"<tr><td><h5 class='ui header'>{label}</h5></td><td class='right aligned'>"), value, F.lit("</td></tr>"))
    html = F.concat(
        F.lit('<div class="p_head_item"><h1>'), F.col("name"), F.lit('</h1></div><div class="player_aux_info"><div class="ui header item">Not in Clan</div></div><div class="league_info_container"><i class="item_icon trophy"></i><div class="item">'),
        n(F.col("entity") * 7 + 1000), F.lit(' / 99999 PB</div><div class="item">Hall</div></div><table><tbody>'), row("Wins", n(F.col("entity") * 3)), row("Losses", n(F.col("entity") * 2)),
        row("Account Age", F.concat((F.col("entity") % 9).cast("string"), F.lit("y "), (F.col("entity") % 50).cast("string"), F.lit("w"))), row("Games per Day", ((F.col("entity") % 13) + 0.5).cast("string")), F.lit("</tbody></table>"),
    )
    out = ex.clean_profile(ex.extract_pages(c.select("entity", html.alias("html")), ["entity"], "html", "profile"))
    return out.select("entity", "name", "clan", "rating", "wins", "losses", "account_age_s", "games_per_day")


@query(
    "s10_holding_extraction",
    f"WITH {Q.ITEMS} SELECT deck, 'item' AS kind, CAST(item AS VARCHAR) AS name, CAST(level AS BIGINT) AS level, 1 AS found FROM deck_items UNION ALL SELECT deck, 'evolution', CAST(item AS VARCHAR), NULL, {Q.i('evo')} FROM deck_items",
)
def _(spark, sf):
    lines = tables.deck_items(spark, sf)
    name = F.col("item").cast("string")
    card = F.concat(F.lit('<a class="player_card_link player_card_item"><img class="deck_card" alt="'), name, F.lit('"><span class="player_cards__card_level">Lvl '), F.col("level").cast("int").cast("string"), F.lit("</span></a>"))
    evo = F.concat(F.lit('<div class="player_card'), F.when(F.col("evo") == 0, " not_found").otherwise(""), F.lit('"><img class="mini_card" alt="'), name, F.lit('"></div>'))
    pages = lines.groupBy("deck").agg(
        F.concat(F.array_join(F.collect_list(card), ""), F.lit('<div class="player_profile__evo_card_collection">'), F.array_join(F.collect_list(evo), ""), F.lit("</div>")).alias("html")
    )
    return ex.extract_pages(pages, ["deck"], "html", "holdings")


@query(
    "s11_set_statistics_extraction",
    f"""WITH {Q.ITEMS} SELECT deck, sha256(string_agg(item || ':' || evo || ':' || hero, ',' ORDER BY CAST(item AS VARCHAR))) AS archetype_hash, deck % 40 + 10 AS battles, CAST(round((deck % 40 + 10) * (deck % 100) / 100.0) AS BIGINT) AS wins FROM deck_items GROUP BY deck""",
)
def _(spark, sf):
    name = F.col("item").cast("string")
    img = F.concat(F.lit('<img class="deck_card" alt="'), name, F.lit('" data-card-key="'), name, F.when(F.col("evo") == 1, "-ev1").otherwise(""), F.when(F.col("hero") == 1, "-hero").otherwise(""), F.lit('">'))
    pages = tables.deck_items(spark, sf).groupBy("deck").agg(
        F.concat(
            F.lit('<div class="deck_segment">'), F.array_join(F.collect_list(img), ""), F.lit("<table><tr><td>All</td><td>1</td><td>1%</td></tr><tr><td>Player</td><td>"), F.first(F.col("deck") % 40 + 10).cast("string"),
            F.lit("</td><td>"), F.first(F.col("deck") % 100).cast("string"), F.lit("%</td></tr></table></div>"),
        ).alias("html")
    )
    rows = ex.set_wins(ex.with_set_hash(ex.extract_pages(pages, ["deck"], "html", "set_stats")))
    return rows.select("deck", "archetype_hash", "battles", "wins")


@query(
    "s07_page_outline",
    r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script\b.*?</script>', '', 'g'), '(?s)<style\b.*?</style>', '', 'g') AS h FROM pages)
    SELECT page_id, regexp_extract(h, '<title[^>]*>([^<]*)', 1) AS title, regexp_extract(h, '<html[^>]*\blang="([^"]*)', 1) AS lang, len(regexp_extract_all(h, '<h[123]\b')) AS headings, len(regexp_extract_all(h, '<a\b')) AS links,
    len(regexp_extract_all(h, '<[a-z]+[^>]*class="ad"[^>]*>')) AS ads, len(regexp_extract_all(h, '<p\b')) AS paragraphs,
    CAST(coalesce(list_sum([len(trim(regexp_replace(regexp_replace(t, '(?s)</p>.*', ''), '<[^>]*>', '', 'g'))) for t in regexp_split_to_array(h, '<p(?:\s[^>]*)?>')[2:]]), 0) AS BIGINT) AS text_chars FROM h""",
)
def _(spark, sf):
    return ex.extract_pages(tables.read(spark, sf, "pages"), ["page_id"], "html", "outline")


ZONES = " ".join(f"WHEN n_regionkey = {k} THEN '{z}'" for k, z in tables.REGION_ZONES.items())


@query(
    "f06_country_zones",
    f"SELECT c_custkey AS entity, n_name AS country, CASE WHEN n_nationkey % 4 = 1 THEN '{tables.DEFAULT_ZONE}' {ZONES} END AS zone FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def _(spark, sf):
    """Three of four countries are in the mapping table; the others get the default."""
    nation = tables.read(spark, sf, "nation")
    zones = nation.filter("n_nationkey % 4 != 1").select(F.col("n_name").alias("country"), tables.zone_of(F.col("n_regionkey")).alias("zone"))
    people = tables.read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("entity"), F.col("n_name").alias("country"))
    return tables.with_zones(people, zones, "country").select("entity", "country", "zone")


# --- streams --------------------------------------------------------------------------


def stream_events(spark, sf) -> DataFrame:
    schema = tables.read(spark, sf, "events").schema
    raw = jobs.read_landed(spark, sf, schema, "events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    e = F.col("event_id")
    return raw.select(
        F.col("user_id").alias("entity"), e, sc.epoch_of("ts").alias("ts"), F.when(F.col("event_type") == "signup", "Ranked").when(F.col("event_type") == "error", "Other").otherwise("Ladder").alias("mode"),
        (k % 2).cast("int").alias("win"), F.when(e % 23 != 0, F.least("value", F.lit(100.0))).alias("metric"),
    )


def run(spark, stream: DataFrame, mode: str = "append", handle=None, out: str | None = None) -> DataFrame:
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = out or f"{base}/out"
    q = jobs.start(stream, handle(out) if handle else jobs.epoch_sink(out), f"{base}/checkpoint", mode)
    q.awaitTermination()
    return spark.read.parquet(out).drop("epoch", "bucket")


@query("st01_intake_deduplicated", f"{EV} SELECT entity, event_id, ts FROM ev")
def _(spark, sf):
    twice = stream_events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run(spark, jobs.deduplicated(twice)).select("entity", "event_id", "ts")


@query(
    "st01_intake_with_marks",
    f"""{EV}, a AS (SELECT *, min(ts) OVER () AS lo, max(ts) OVER () AS hi FROM ev),
    b AS (SELECT *, CASE WHEN event_id % 50 = 7 THEN 3 ELSE least(3, (ts - lo) * 4 // (hi - lo + 1)) END AS batch FROM a),
    m AS (SELECT entity, max(ts) AS mark FROM b WHERE batch < 3 GROUP BY 1)
    SELECT b.entity, event_id, ts, {Q.i("CASE WHEN batch = 3 AND ts < mark - 86400 THEN 1 ELSE 0 END")} AS late FROM b LEFT JOIN m ON b.entity = m.entity""",
)
def _(spark, sf):
    """Four landed batches: by time, each with some rows of the one before again, the last with old rows; one runs twice."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/intake-{uuid.uuid4().hex}"
    columns = ["entity", "event_id", "ts"]
    ev = tables.events(spark, sf).select(*columns)
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    part = F.when(F.col("event_id") % 50 == 7, 3).otherwise(F.least(F.lit(3), F.floor((F.col("ts") - lo) * 4 / (hi - lo + 1)).cast("int")))
    dealt = ev.withColumn("batch", part)
    sink = jobs.intake_sink(f"{base}/events", f"{base}/late", "entity", ev.schema)
    for k in range(4):
        again = dealt.filter((F.col("batch") == k - 1) & (F.col("event_id") % 10 == 3) & (F.col("ts") >= lo + (hi - lo) * k // 4 - 3600))
        dealt.filter(F.col("batch") == k).union(again).select(*columns).write.parquet(f"{base}/landed/b{k}")
        stream = jobs.read_landed(spark, f"{base}/landed/*", ev.schema)
        jobs.start(stream, sink, f"{base}/checkpoint").awaitTermination()
    sink(spark.read.parquet(f"{base}/landed/b2"), 2)
    return spark.read.parquet(f"{base}/events").select(*columns, F.lit(0).alias("late")).union(spark.read.parquet(f"{base}/late").select(*columns, F.lit(1).alias("late")))


def thirds(spark, sf, columns) -> tuple[DataFrame, list[DataFrame], int]:
    """Events in three batches by time; every fiftieth comes with the last one, however old. Each batch repeats some rows of the one before."""
    ev = tables.events(spark, sf).select(*columns)
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    dealt = ev.withColumn("batch", F.when(F.col("event_id") % 50 == 7, 2).otherwise(F.least(F.lit(2), F.floor((F.col("ts") - lo) * 3 / (hi - lo + 1)).cast("int"))))
    again = [(F.col("batch") == k - 1) & (F.col("event_id") % 10 == 3) & (F.col("ts") >= lo + (hi - lo) * k // 3 - 3600) for k in range(3)]
    return ev, [dealt.filter((F.col("batch") == k) | again[k]).select(*columns) for k in range(3)], hi


THIRDS = f"""{Q.EV.replace("ev AS (", "ev0 AS (", 1)}, tb AS (SELECT *, CASE WHEN event_id % 50 = 7 THEN 2 ELSE least(2, (ts - min(ts) OVER ()) * 3 // (max(ts) OVER () - min(ts) OVER () + 1)) END AS batch FROM ev0),
tm AS (SELECT max(ts) AS mark FROM tb WHERE batch < 2), td AS (SELECT tb.*, batch = 2 AND ts < mark - 86400 AS late FROM tb, tm), ev AS (SELECT * EXCLUDE (batch, late) FROM td WHERE NOT late)"""


def appended(spark, sf, columns, job) -> tuple[DataFrame, DataFrame]:
    """What ``job`` appends over the intake of three batches and a closing row, and the rows that were late for it."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/append-{uuid.uuid4().hex}"
    ev, batches, hi = thirds(spark, sf, columns)
    schema = ev.withColumn("log", F.lit(0)).schema
    stored = StructType([*schema.fields, StructField("epoch", LongType()), StructField("day", LongType())])
    sink = jobs.intake_sink(f"{base}/events", f"{base}/late", "log", schema)
    for k, batch in enumerate(batches):
        rows = batch.withColumn("log", F.lit(0))
        rows = rows.union(jobs.closing_row(spark, schema, hi + 60 * 86400)) if k == 2 else rows
        rows.write.parquet(f"{base}/landed/b{k}")
        jobs.start(jobs.read_landed(spark, f"{base}/landed/*", schema), sink, f"{base}/checkpoint-intake").awaitTermination()
        stream = jobs.read_landed(spark, f"{base}/events", stored, files_per_batch=1_000_000)
        jobs.start(job(stream), jobs.epoch_sink(f"{base}/out"), f"{base}/checkpoint").awaitTermination()
    sink(spark.read.parquet(f"{base}/landed/b1"), 1)
    return spark.read.parquet(f"{base}/out").drop("epoch"), spark.read.schema(schema).parquet(f"{base}/late")


LATEST = "max(struct_pack(a := ts, b := event_id, w := win, l := level, m := metric))"


@query("st02_streaming_upsert", f"{EV}, l AS (SELECT entity, max(struct_pack(a := ts, b := event_id, w := win)) AS m FROM ev GROUP BY 1) SELECT entity, m.b AS event_id, m.a AS ts, {Q.i('m.w')} AS win FROM l")
def _(spark, sf):
    """Three batches of whole rows into a versioned table; the second runs once more at the end."""
    columns = ["entity", "event_id", "ts", "win"]
    ev, batches, _ = thirds(spark, sf, columns)
    base = f"{checkpoint_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    table = vt.Versioned(f"{base}/table", ("entity",), ev.schema, 8)
    sink = table.sink(vt.replace_rows(["entity"], ["ts", "event_id"]))
    for k, batch in enumerate(batches):
        batch.write.parquet(f"{base}/landed/b{k}")
        jobs.start(jobs.read_landed(spark, f"{base}/landed/*", ev.schema), sink, f"{base}/checkpoint").awaitTermination()
    sink(batches[1], 1)
    return table.read(spark)


@query(
    "st02_partial_upsert",
    f"""WITH {THIRDS}, a AS (SELECT entity, {LATEST} AS m FROM tb WHERE batch = 0 GROUP BY 1), b AS (SELECT entity, max(struct_pack(a := ts, b := event_id, l := level)) AS m FROM tb WHERE batch > 0 GROUP BY 1)
    SELECT coalesce(a.entity, b.entity) AS entity, a.m.m AS metric, {Q.i('a.m.w')} AS win, CASE WHEN b.entity IS NULL THEN a.m.l ELSE b.m.l END AS level, CASE WHEN b.entity IS NULL THEN a.m.a ELSE b.m.a END AS last_updated
    FROM a FULL JOIN b ON a.entity = b.entity""",
)
def _(spark, sf):
    """Whole profiles from the first batch; the later ones set level and time alone, and one of them runs twice."""
    columns = ["entity", "event_id", "ts", "win", "metric", "level"]
    _, batches, _ = thirds(spark, sf, columns)
    base = f"{checkpoint_dir(spark).rstrip('/')}/partial-{uuid.uuid4().hex}"
    rows = [b.select("entity", "metric", "win", "level", F.col("ts").alias("last_updated"), "event_id") for b in batches]
    table = vt.Versioned(f"{base}/table", ("entity",), rows[0].drop("event_id").schema, 8)
    order = ["last_updated", "event_id"]
    table.apply(ig.latest(rows[0], ["entity"], order), vt.replace_rows(["entity"], ["last_updated"]), "profiles", 0)
    sink = table.sink(vt.set_columns(["entity"], ["level", "last_updated"], order), "levels")
    for k in (1, 2):
        rows[k].write.parquet(f"{base}/landed/b{k}")
        jobs.start(jobs.read_landed(spark, f"{base}/landed/*", rows[0].schema), sink, f"{base}/checkpoint").awaitTermination()
    sink(rows[1], 0)
    return table.read(spark)


@query(
    "st02_s17_deck_mart",
    f"{EV} SELECT entity, deck, count(*) AS battles, {Q.i('sum(win)')} AS wins, {Q.r('sum(win) / count(*)')} AS confidence, max(ts) AS last_updated FROM ev WHERE deck IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf):
    """Deltas of three batches added up in a mart; a batch that runs again adds nothing."""
    columns = ["entity", "event_id", "ts", "win", "deck"]
    ev = tables.events(spark, sf).select(*columns)
    batches = [ev.filter(F.col("event_id") % 3 == k) for k in range(3)]
    base = f"{checkpoint_dir(spark).rstrip('/')}/mart-{uuid.uuid4().hex}"
    schema = StructType([ev.schema["entity"], ev.schema["deck"], StructField("battles", LongType()), StructField("wins", LongType()), StructField("confidence", DoubleType()), StructField("last_updated", LongType())])
    table = vt.Versioned(f"{base}/table", ("entity", "deck"), schema, 8)
    merge = vt.add_counts(["entity", "deck"], {"battles": "1", "wins": "win"}, ("confidence", "wins", "battles"), "last_updated")
    sink = table.sink(lambda stored, updates: merge(stored, updates.filter("deck is not null").withColumn("last_updated", F.col("ts"))))
    for k, batch in enumerate(batches):
        batch.write.parquet(f"{base}/landed/b{k}")
        jobs.start(jobs.read_landed(spark, f"{base}/landed/*", ev.schema), sink, f"{base}/checkpoint").awaitTermination()
        sink(batch, k)
    return table.read(spark)


SEED = T_.StructType([T_.StructField("item", LongType()), T_.StructField("name", T_.StringType()), T_.StructField("rarity", T_.StringType()), T_.StructField("cost", T_.IntegerType())])
PEOPLE = T_.StructType([T_.StructField("entity", LongType()), T_.StructField("name", T_.StringType()), T_.StructField("last_updated", LongType())])


@query(
    "s23_seed_load",
    """SELECT 'item' AS kind, p_partkey AS id, p_name AS name, p_brand AS detail FROM part UNION ALL SELECT 'entity', c_custkey, c_name, CAST(1700000000 + CASE WHEN c_custkey % 2 = 0 THEN 60 ELSE 0 END AS VARCHAR) FROM customer""",
)
def _(spark, sf):
    """Items and entities from seed files under declared schemas, loaded twice into versioned tables; then every second
    entity is updated and with it last_updated alone."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/seed-{uuid.uuid4().hex}"
    tables.read(spark, sf, "part").selectExpr("p_partkey as item", "p_name as name", "p_brand as rarity", "p_size as cost").write.option("header", "true").csv(f"{base}/items")
    tables.read(spark, sf, "customer").selectExpr("c_custkey as entity", "c_name as name", "1700000000 as last_updated").write.option("header", "true").csv(f"{base}/people")
    loaded = {}
    for name, schema, key in (("items", SEED, "item"), ("people", PEOPLE, "entity")):
        rows, _ = ig.read_dimension(spark, f"{base}/{name}", schema, [key])
        table = vt.Versioned(f"{base}/table-{name}", (key,), schema, 8)
        for _ in range(2):
            table.apply(rows, lambda stored, new: stored.unionByName(ig.insert_ignore(stored, new, [key], [key])), "seed", 0)  # noqa: B023
        loaded[name] = table
    seen = loaded["people"].read(spark).filter("entity % 2 = 0").select("entity", (F.col("last_updated") + 60).alias("last_updated"))
    loaded["people"].apply(seen, vt.set_columns(["entity"], ["last_updated"], ["last_updated"]), "updates", 0)
    items = loaded["items"].read(spark).selectExpr("'item' as kind", "item as id", "name", "rarity as detail")
    return items.unionByName(loaded["people"].read(spark).selectExpr("'entity' as kind", "entity as id", "name", "cast(last_updated as string) as detail"))


@query(
    "st03_streaming_sessions",
    f"""WITH {THIRDS}, gs AS (SELECT entity, ts, sum(CASE WHEN g IS NULL OR g >= 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts, event_id) AS s FROM (SELECT entity, event_id, ts, ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts, event_id) AS g FROM ev))
    SELECT entity, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, CAST(0 AS BIGINT) AS late FROM gs GROUP BY entity, s UNION ALL SELECT entity, count(*), min(ts), max(ts), CAST(1 AS BIGINT) FROM td WHERE late GROUP BY 1""",
)
def _(spark, sf):
    out, late = appended(spark, sf, ["entity", "event_id", "ts"], lambda stream: jobs.sessions(stream, 43200))
    missed = late.groupBy("entity").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("late", F.lit(0)).unionByName(missed.withColumn("late", F.lit(1)))


@query(
    "st04_tumbling_day_parts",
    f"WITH {THIRDS} SELECT ts // 21600 * 21600 AS start_ts, mode, count(*) AS n, {Q.r('avg(metric)')} AS avg_metric, CAST(0 AS BIGINT) AS late FROM ev GROUP BY 1, 2 UNION ALL SELECT NULL, mode, count(*), NULL, CAST(1 AS BIGINT) FROM td WHERE late GROUP BY mode",
)
def _(spark, sf):
    out, late = appended(spark, sf, ["entity", "event_id", "ts", "mode", "metric"], jobs.day_part_counts)
    missed = late.groupBy("mode").agg(F.count(F.lit(1)).alias("n")).selectExpr("cast(null as long) as start_ts", "mode", "n", "cast(null as double) as avg_metric")
    return out.withColumn("late", F.lit(0)).unionByName(missed.withColumn("late", F.lit(1)))


@query(
    "st05_sliding_week_rates",
    f"WITH {THIRDS}, x AS (SELECT entity, win, (ts // 86400 - d) * 86400 AS start_ts FROM ev, range(0, 7) AS t(d)) SELECT entity, start_ts, count(*) AS n, {Q.r('avg(win)')} AS win_rate, CAST(0 AS BIGINT) AS late FROM x GROUP BY 1, 2 UNION ALL SELECT entity, NULL, count(*), NULL, CAST(1 AS BIGINT) FROM td WHERE late GROUP BY 1",
)
def _(spark, sf):
    out, late = appended(spark, sf, ["entity", "event_id", "ts", "win"], jobs.weekly_rates)
    missed = late.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).selectExpr("entity", "cast(null as long) as start_ts", "n", "cast(null as double) as win_rate")
    return out.withColumn("late", F.lit(0)).unionByName(missed.withColumn("late", F.lit(1)))


ON_TIME = Q.tl().replace(Q.EV, THIRDS, 1)


@query(
    "st06_stateful_fold",
    f"""WITH {ON_TIME}, {Q.streaks()}, fo AS (SELECT entity, event_id, ts, {Q.i('win_streak - loss_streak')} AS streak, {Q.r('stress_after')} AS stress, {Q.r('max(metric) OVER (PARTITION BY entity ORDER BY ts, event_id)')} AS best, loss_streak >= 2 AND stress_after >= 3 AS risk, is_last FROM sk)
    SELECT entity, event_id, ts, streak, stress, best, CASE WHEN risk THEN 'quit risk' ELSE '' END AS alert FROM fo UNION ALL SELECT entity, NULL, ts + 43200, streak, stress, best, 'quit' FROM fo WHERE risk AND is_last
    UNION ALL SELECT entity, event_id, ts, NULL, NULL, NULL, 'late' FROM td WHERE late""",
)
def _(spark, sf):
    """Three batches in append mode, rows out of order within the delay; late rows are named as such."""
    out, late = appended(spark, sf, ["entity", "event_id", "ts", "win", "metric"], lambda stream: fold.entity_states(stream, 43200, idle_s=400 * 86400))
    missed = late.selectExpr("entity", "event_id", "ts", "cast(null as long) as streak", "cast(null as double) as stress", "cast(null as double) as best", "'late' as alert")
    return out.unionByName(missed)
