"""Queries on decks, items, null models, permutations and matched pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as Q
from checks.q_core import ODDS, PF, odds_and_profile
from checks.q_trends import GZ, regions
from checks.registry import query
from seqtide.functions.scalar import is_finite
from seqtide.operators import baskets as bs
from seqtide.operators import hypothesis as hy
from seqtide.operators import permutation as pm
from seqtide.operators import resample as rs
from seqtide.plans import sets as st
from seqtide.plans import swaps as sw
from seqtide.plans import timeline as tl
from seqtide.plans import trends as tr
from seqtide.sources import tables


def arch_timeline(spark, sf, mode="all"):
    return tl.build(tables.events_with_sets(spark, sf), mode)


ARCH = """ta AS (SELECT tl.*, d1.archetype AS arch, d2.archetype AS opp_arch FROM tl LEFT JOIN decks d1 ON d1.deck = tl.deck LEFT JOIN decks d2 ON d2.deck = tl.opp_deck)"""
TA = f"WITH {Q.tl()}, {Q.DECKS}, {ARCH}"
W = "PARTITION BY entity ORDER BY ts, event_id"
CLS = "bi AS (SELECT l_orderkey AS deck, p_brand AS item, max(l_quantity) AS level FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"

SWP = f"""{TA}, sp0 AS (SELECT *, lead(arch) OVER ({W}) AS n_arch, lead(metric2) OVER ({W}) AS n_value FROM ta),
sp AS (SELECT arch <> n_arch AS switch, CASE WHEN metric2 < 45 THEN 'Bad' WHEN metric2 > 55 THEN 'Good' ELSE 'Mid' END AS from_zone, CASE WHEN n_value < 45 THEN 'Bad' WHEN n_value > 55 THEN 'Good' ELSE 'Mid' END AS to_zone
  FROM sp0 WHERE metric2 IS NOT NULL AND n_value IS NOT NULL AND arch IS NOT NULL AND n_arch IS NOT NULL)"""


@query(
    "a45_w20_switch_transitions",
    f"{SWP}, c AS (SELECT switch, from_zone, to_zone, count(*) AS n FROM sp GROUP BY 1, 2, 3) SELECT {Q.i('switch')} AS switch, from_zone, to_zone, n, {Q.i('sum(n) OVER (PARTITION BY switch, from_zone)')} AS from_n, {Q.r('n * 100.0 / sum(n) OVER (PARTITION BY switch, from_zone)')} AS pct FROM c",
)
def _(spark, sf):
    return st.switch_transitions(st.switch_pairs(arch_timeline(spark, sf)))


SWT = f"c AS (SELECT switch, from_zone, to_zone, count(*) AS n FROM sp GROUP BY 1, 2, 3) SELECT {Q.i('switch')} AS switch, from_zone, to_zone, n, {Q.i('sum(n) OVER (PARTITION BY switch, from_zone)')} AS from_n, {Q.r('n * 100.0 / sum(n) OVER (PARTITION BY switch, from_zone)')} AS pct FROM c"


def _early(text: str) -> str:
    """The same statement on the first metric: only the part after the timeline changes."""
    head, tail = text.split("sp0 AS", 1)
    return head + "sp0 AS" + tail.replace("metric2", "metric")


@query("a68_switch_transitions_early_form", _early(f"{SWP}, {SWT}"))
def _(spark, sf):
    return st.switch_transitions(st.switch_pairs(arch_timeline(spark, sf), "metric"))


TRJ = f"""{TA}, tj0 AS (SELECT *, """ + ", ".join(f"lead(arch, {k}) OVER w AS a{k}, lead(metric2, {k}) OVER w AS m{k}, lead(level, {k}) OVER w AS l{k}" for k in range(1, 5)) + f""" FROM ta WINDOW w AS ({W})),
tj1 AS (SELECT *, arch <> a1 AS switch FROM tj0 WHERE metric2 < 45 AND m1 IS NOT NULL AND arch IS NOT NULL AND a1 IS NOT NULL),
tj AS (SELECT switch, 1 AS step, m1 AS m, l1 AS l FROM tj1 UNION ALL SELECT switch, 2, m2, l2 FROM tj1 WHERE a2 = a1 UNION ALL SELECT switch, 3, m3, l3 FROM tj1 WHERE a2 = a1 AND a3 = a1
  UNION ALL SELECT switch, 4, m4, l4 FROM tj1 WHERE a2 = a1 AND a3 = a1 AND a4 = a1)"""


@query("a45_switch_trajectories", f"{TRJ} SELECT {Q.i('switch')} AS switch, {Q.i('step')} AS step, count(m) AS n, {Q.r('avg(m)')} AS avg_metric2, {Q.r('avg(l)')} AS avg_level FROM tj GROUP BY 1, 2")
def _(spark, sf):
    return st.switch_trajectories(arch_timeline(spark, sf))


SLV = f"""{TA}, {Q.ITEMS}, lv AS (SELECT deck, avg(level) AS dl FROM deck_items GROUP BY 1), tb AS (SELECT ta.*, dl FROM ta LEFT JOIN lv USING (deck)),
sl0 AS (SELECT *, lead(dl) OVER w AS ndl, """ + ", ".join(f"lead(arch, {k}) OVER w AS a{k}, lead(level, {k}) OVER w AS l{k}" for k in range(1, 5)) + ", " + ", ".join(f"lag(arch, {k}) OVER w AS b{k}, lag(level, {k}) OVER w AS q{k}" for k in range(1, 4)) + f""" FROM tb WINDOW w AS ({W})),
sl1 AS (SELECT *, CASE WHEN ndl < dl - 0.1 THEN 'level_down' WHEN ndl > dl + 0.1 THEN 'level_up' ELSE 'no_change' END AS category,
  list_filter([level, CASE WHEN b1 = arch THEN q1 END, CASE WHEN b1 = arch AND b2 = arch THEN q2 END, CASE WHEN b1 = arch AND b2 = arch AND b3 = arch THEN q3 END], lambda x: x IS NOT NULL) AS pre,
  list_filter([l1, CASE WHEN a2 = a1 THEN l2 END, CASE WHEN a2 = a1 AND a3 = a1 THEN l3 END, CASE WHEN a2 = a1 AND a3 = a1 AND a4 = a1 THEN l4 END], lambda x: x IS NOT NULL) AS post,
  l1, CASE WHEN a2 = a1 THEN l2 END AS s2, CASE WHEN a2 = a1 AND a3 = a1 THEN l3 END AS s3, CASE WHEN a2 = a1 AND a3 = a1 AND a4 = a1 THEN l4 END AS s4
  FROM sl0 WHERE arch <> a1 AND dl IS NOT NULL AND ndl IS NOT NULL),
sl AS (SELECT * FROM sl1 WHERE len(pre) > 0 AND len(post) > 0)"""


@query(
    "a47_switch_levels",
    f"""{SLV}, sa AS (SELECT category, count(*) AS switches, sum(list_sum(pre)) / sum(len(pre)) AS a, sum(list_sum(post)) / sum(len(post)) AS b,
      sum(coalesce(s2, 0) + coalesce(s3, 0) + coalesce(s4, 0)) / nullif(count(s2) + count(s3) + count(s4), 0) AS c FROM sl GROUP BY 1)
    SELECT category, switches, {Q.r('a')} AS avg_pre, {Q.r('b')} AS avg_post, {Q.r('coalesce(c, b)')} AS avg_post_later, {Q.r('b - a')} AS delta FROM sa""",
)
def _(spark, sf):
    return st.switch_levels(st.switch_level_rows(arch_timeline(spark, sf), bs.basket_levels(tables.deck_items(spark, sf))))


@query(
    "a47_switch_level_steps",
    f"""{SLV}, sx AS (SELECT category, 1 AS step, l1 AS l FROM sl UNION ALL SELECT category, 2, s2 FROM sl UNION ALL SELECT category, 3, s3 FROM sl UNION ALL SELECT category, 4, s4 FROM sl)
    SELECT category, {Q.i('step')} AS step, count(*) AS n, {Q.r('avg(l)')} AS avg_level FROM sx WHERE l IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    return st.switch_level_steps(st.switch_level_rows(arch_timeline(spark, sf), bs.basket_levels(tables.deck_items(spark, sf))))


AST = f"{TA}, ax AS (SELECT arch, count(*) AS n, avg(win) * 100 AS w, avg(level) AS l FROM ta WHERE arch IS NOT NULL AND level IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)"


@query("a48_archetype_strength", f"{AST} SELECT arch, n, {Q.r('w')} AS win_pct, {Q.r('l')} AS avg_level FROM ax")
def _(spark, sf):
    return st.archetype_strength(arch_timeline(spark, sf).df)


@query("a48_archetype_correlation", f"{AST}, ay AS (SELECT round(w, 9) AS x, round(l, 9) AS y FROM ax) {Q.spearman('ay', [], 'x', 'y', 5)}")
def _(spark, sf):
    return st.archetype_correlation(arch_timeline(spark, sf).df)


FUN = f"""WITH {Q.tl()}, fu AS (SELECT *, CASE WHEN mode <> 'Ladder' OR next_mode <> 'Ladder' THEN 'no_ladder' WHEN metric IS NULL THEN 'no_metric' WHEN metric >= 45 THEN 'no_debt' WHEN deck <> next_deck THEN 'deck_change'
  WHEN next_opp_deck IS NULL OR next_rating_before IS NULL OR next_rating_before = 0 THEN 'incomplete' ELSE 'valid' END AS reason FROM tl WHERE has_next)"""


@query("q06_rejection_funnel", f"{FUN} SELECT reason, count(*) AS n FROM fu GROUP BY 1")
def _(spark, sf):
    return st.funnel_rows(tl.timeline(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


VOL = f"""{FUN}, {Q.ITEMS}, lv AS (SELECT deck AS next_opp_deck, avg(level) AS opp_level FROM deck_items GROUP BY 1 HAVING avg(level) > 0),
cv AS (SELECT CAST(floor(rating_before / 100.0) * 100 AS BIGINT) AS b, avg(opp_level) AS e FROM tl JOIN lv ON tl.opp_deck = lv.next_opp_deck WHERE mode = 'Ladder' AND rating_before <> 0 GROUP BY 1),
vo AS (SELECT win, opp_level AS raw, opp_level - e AS residual FROM fu JOIN lv USING (next_opp_deck) JOIN cv ON cv.b = CAST(floor(next_rating_before / 100.0) * 100 AS BIGINT) WHERE reason = 'valid'),
vl AS (SELECT win, 'raw' AS measure, raw AS value FROM vo UNION ALL SELECT win, 'residual', residual FROM vo)"""


@query("a49_h11_level_volatility", f"{VOL} {Q.welch('vl', ['measure'], 'win', 'value', '1', '0', 11)}")
def _(spark, sf):
    return st.level_volatility(st.level_volatility_rows(tl.timeline(spark, sf), bs.basket_levels(tables.deck_items(spark, sf))))


# --- items ---------------------------------------------------------------------

MM = f"""WITH {Q.tl()}, {Q.ITEMS}, oe AS (SELECT *, CAST(floor(rating_before / 150.0) * 150 AS BIGINT) AS bucket FROM tl WHERE mode = 'Ladder' AND rating_before <> 0),
ot AS (SELECT bucket, count(*) AS total FROM oe GROUP BY 1 HAVING count(*) >= 50),
su AS (SELECT bucket, item, count(*) AS n, any_value(total) AS total, count(*) / CAST(any_value(total) AS DOUBLE) AS freq FROM oe JOIN deck_items d ON d.deck = oe.opp_deck JOIN ot USING (bucket) GROUP BY 1, 2)"""


@query("g12_item_support", f"{MM} SELECT bucket, item, n, total, {Q.r('freq')} AS freq FROM su")
def _(spark, sf):
    return bs.item_support(st.opponent_events(tl.timeline(spark, sf), 150), tables.deck_items(spark, sf), "bucket", "opp_deck", 50).select(
        "bucket", "item", "n", "total", "freq"
    )


@query(
    "a39_g13_dominant_items",
    f"""{MM}, sp AS (SELECT item, count(*) AS buckets, avg(freq) AS m, stddev_samp(freq) AS s FROM su GROUP BY 1 HAVING count(*) >= 5 AND stddev_samp(freq) > 0)
    SELECT bucket, item, {Q.r('freq')} AS freq, buckets, {Q.r('(freq - m) / s')} AS z FROM su JOIN sp USING (item) WHERE (freq - m) / s > 2""",
)
def _(spark, sf):
    return st.dominant_items(tl.timeline(spark, sf), tables.deck_items(spark, sf))


@query(
    "a39_g14_meta_transitions",
    f"""{MM}, tp AS (SELECT bucket, item FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY freq DESC, item) AS k FROM su) WHERE k <= 15),
    se AS (SELECT bucket, list(item ORDER BY item) AS items FROM tp GROUP BY 1), sf AS (SELECT *, lag(items) OVER (ORDER BY bucket) AS p FROM se)
    SELECT bucket, {Q.r('CASE WHEN p IS NOT NULL THEN 1 - len(list_intersect(items, p)) / CAST(len(list_distinct(list_concat(items, p))) AS DOUBLE) END')} AS distance, {Q.i('len(items)')} AS size FROM sf""",
)
def _(spark, sf):
    return st.meta_transitions(tl.timeline(spark, sf), tables.deck_items(spark, sf))


@query(
    "a39_bucket_hostility",
    f"""{MM}, ce AS (SELECT entity, bucket, sum(metric2) AS s, count(*) AS n FROM oe WHERE metric2 IS NOT NULL GROUP BY 1, 2), ow AS (SELECT entity, sum(s) / sum(n) AS g FROM ce GROUP BY 1),
    hh AS (SELECT bucket, count(*) AS entities, avg(g - s / n) AS h FROM ce JOIN ow USING (entity) GROUP BY 1 HAVING count(*) >= 5)
    SELECT bucket, entities, {Q.r('h')} AS hostility, CASE WHEN h > 2 THEN 'hostile' WHEN h < -2 THEN 'friendly' ELSE 'neutral' END AS verdict FROM hh""",
)
def _(spark, sf):
    return st.bucket_hostility(tl.timeline(spark, sf))


@query(
    "a39_g17_loss_start_density",
    f"""WITH {Q.tl()}, la AS (SELECT *, CASE WHEN lag(win) OVER ({W}) IS DISTINCT FROM win THEN 1 ELSE 0 END AS new FROM tl WHERE mode = 'Ladder' AND rating_before <> 0),
    lb AS (SELECT *, sum(new) OVER ({W}) AS run FROM la), lc AS (SELECT entity, run, max(win) AS win, count(*) AS length, min_by(rating_before, struct_pack(a := ts, b := event_id)) % 150 AS o FROM lb GROUP BY 1, 2),
    ld AS (SELECT count(*) AS total, count(*) FILTER (o < 30) AS n_start, count(*) FILTER (o >= 30 AND o < 120) AS n_mid, count(*) FILTER (o >= 120) AS n_end FROM lc WHERE win = 0 AND length >= 3)
    SELECT total, n_start, n_mid, n_end, {Q.r('n_start / 30')} AS d_start, {Q.r('n_mid / 90')} AS d_mid, {Q.r('n_end / 30')} AS d_end,
      CASE WHEN n_end / 30 > n_mid / 90 * 1.2 THEN 'end' WHEN n_start / 30 > n_mid / 90 * 1.2 THEN 'start' ELSE 'even' END AS verdict FROM ld""",
)
def _(spark, sf):
    return st.loss_start_density(tl.timeline(spark, sf))


CI = f"""WITH {Q.tl()}, {CLS}, ce AS (SELECT *, CAST(floor(rating_before / 1000.0) * 1000 AS BIGINT) AS bucket, coalesce(metric2 < 40, FALSE) AS hit FROM tl WHERE mode = 'Ladder' AND rating_before <> 0),
ct AS (SELECT bucket, count(*) AS total, count(*) FILTER (hit) AS th FROM ce GROUP BY 1 HAVING count(*) >= 50),
cl AS (SELECT bucket, item, count(*) AS n, count(*) / CAST(any_value(total) AS DOUBLE) AS freq, CASE WHEN any_value(th) > 0 THEN count(*) FILTER (hit) / CAST(any_value(th) AS DOUBLE) ELSE 0 END AS fh FROM ce JOIN bi ON bi.deck = ce.opp_deck JOIN ct USING (bucket) GROUP BY 1, 2 HAVING count(*) >= 10),
cm AS (SELECT *, round(fh / freq, 9) AS lift FROM cl)"""


LINES = f"{Q.ITEMS}, bi AS (SELECT deck, item, level FROM deck_items)"
COUNTER = f"""{CI}, cn AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY lift DESC, item) AS place FROM cm)
    SELECT bucket, place, item, n, {Q.r('freq')} AS freq, {Q.r('fh')} AS freq_hit, {Q.r('lift')} AS lift, CASE WHEN lift > 1.5 AND freq > 0.10 THEN 'meta killer' WHEN lift > 2 THEN 'sniper' WHEN lift < 0.7 THEN 'safe' ELSE '' END AS verdict FROM cn WHERE place <= 15"""


@query("a42_g10_k02_counter_items", COUNTER.replace(CLS, LINES))
def _(spark, sf):
    return st.counter_items(tl.timeline(spark, sf), tables.deck_items(spark, sf))


@query("a42_counter_item_classes", COUNTER)
def _(spark, sf):
    return st.counter_items(tl.timeline(spark, sf), tables.deck_item_classes(spark, sf))


@query(
    "a38_gate_meta_shock",
    f"""{GZ}, {Q.ITEMS}, mc AS (SELECT threshold, zone, item, count(*) AS n FROM gz JOIN deck_items d ON d.deck = gz.opp_deck GROUP BY 1, 2, 3),
    mt AS (SELECT threshold, zone, list(item ORDER BY item) AS items FROM (SELECT *, row_number() OVER (PARTITION BY threshold, zone ORDER BY n DESC, item) AS k FROM mc) WHERE k <= 20 GROUP BY 1, 2),
    mo AS (SELECT *, CASE zone WHEN 'pre_stable' THEN 0 WHEN 'pre_early' THEN 1 WHEN 'post_early' THEN 2 ELSE 3 END AS step FROM mt), mp AS (SELECT *, lag(items) OVER (PARTITION BY threshold ORDER BY step) AS p FROM mo)
    SELECT {Q.i('threshold')} AS threshold, zone, {Q.i('step')} AS step, {Q.r('CASE WHEN p IS NOT NULL THEN 1 - len(list_intersect(items, p)) / CAST(len(list_distinct(list_concat(items, p))) AS DOUBLE) END')} AS distance FROM mp""",
)
def _(spark, sf):
    return st.gate_meta_shock(tr.gate_rows(tl.timeline(spark, sf)), tables.deck_items(spark, sf))


# --- fairness -------------------------------------------------------------------

AH = f"""{TA}, {Q.REGION}, ah AS (SELECT ta.*, region, CAST(((ts + shift_h * 3600) // 3600) % 24 AS BIGINT) AS hour FROM ta JOIN rg ON rg.nation = entity % 25)"""
FC = f"""{AH}, f0 AS (SELECT hour // 8 AS slot, CAST(floor(rating_before / 1500.0) * 1500 AS BIGINT) AS bucket, arch, opp_arch, entity FROM ah WHERE mode = 'Ladder' AND rating_before <> 0),
f1 AS (SELECT *, count(*) OVER (PARTITION BY slot, bucket) AS kn, count(*) OVER (PARTITION BY slot, bucket, arch) AS an FROM f0 WHERE arch IS NOT NULL AND opp_arch IS NOT NULL),
f2 AS (SELECT *, count(*) OVER (PARTITION BY slot, bucket, opp_arch) AS bn FROM f1 WHERE kn >= 20 AND an >= 3),
f3 AS (SELECT *, count(*) OVER (PARTITION BY slot, bucket) AS mn FROM f2 WHERE bn >= 3), fc AS (SELECT * FROM f3 WHERE mn >= 20)"""


def arch_hours(spark, sf, mode="all"):
    return tr.with_hour(arch_timeline(spark, sf, mode), regions(spark, sf))


@query("a43_matchmaking_fairness", f"{FC} {Q.chi_square('fc', ['slot', 'bucket'], 'arch', 'opp_arch', yates=False)}")
def _(spark, sf):
    return st.matchmaking_fairness(arch_hours(spark, sf))


@query("a43_h07_fairness_monte_carlo")
def _(spark, sf):
    return st.matchmaking_fairness_mc(arch_hours(spark, sf), 2000)


@query(
    "a43_h07_monte_carlo_facts",
    f"""{FC}, ch AS ({Q.chi_square('fc', ['slot', 'bucket'], 'arch', 'opp_arch', yates=False)}) SELECT slot, bucket, rows, cols, n, dof, chi2, CAST(low_expected = 1 OR p < 0.10 AS BIGINT) AS monte_carlo, CAST(1 AS BIGINT) AS p_inside, CAST(1 AS BIGINT) AS p_near FROM ch""",
)
def _(spark, sf):
    """The test with drawn tables: all that doesn't depend on the draws, and whether p is a share of them and near its asymptotic value."""
    out = st.matchmaking_fairness_mc(arch_hours(spark, sf), 2000)
    plain = st.matchmaking_fairness(arch_hours(spark, sf)).select("slot", "bucket", F.col("p").alias("asymptotic"))
    inside = F.when(F.col("monte_carlo"), F.col("p").between(1 / 2001, 1.0)).otherwise(F.col("p") == F.col("asymptotic"))
    return out.join(plain, ["slot", "bucket"]).select(
        "slot", "bucket", "rows", "cols", "n", "dof", "chi2", "monte_carlo", inside.alias("p_inside"), (F.abs(F.col("p") - F.col("asymptotic")) < 0.2).alias("p_near")
    )


@query("g15_entities_per_bucket", f"{FC} SELECT slot, bucket, count(*) AS n, count(DISTINCT entity) AS entities FROM f0 GROUP BY 1, 2")
def _(spark, sf):
    return st.players_per_bucket(arch_hours(spark, sf))


IFR = f"""{AH}, {CLS}, k0 AS (SELECT *, hour // 6 AS slot FROM ah WHERE mode = 'Ranked' AND arch IS NOT NULL AND opp_arch IS NOT NULL),
kn AS (SELECT slot, region, count(*) AS key_n FROM k0 GROUP BY 1, 2 HAVING count(*) >= 50), ka AS (SELECT slot, region, arch, count(*) AS arch_n FROM k0 GROUP BY 1, 2, 3 HAVING count(*) >= 10),
ki AS (SELECT slot, region, item FROM k0 JOIN bi ON bi.deck = k0.opp_deck JOIN kn USING (slot, region) GROUP BY slot, region, item, key_n HAVING count(*) > key_n * 0.05),
kr AS (SELECT k0.slot, k0.region, ki.item, k0.arch, CASE WHEN bi.item IS NULL THEN 'no' ELSE 'yes' END AS held FROM k0 JOIN ka USING (slot, region, arch) JOIN ki ON ki.slot = k0.slot AND ki.region = k0.region LEFT JOIN bi ON bi.deck = k0.opp_deck AND bi.item = ki.item),
kt AS ({Q.chi_square('kr', ['slot', 'region', 'item'], 'arch', 'held')})"""


TESTED = f"{IFR} SELECT slot, {Q.i('region')} AS region, item, rows, cols, n, dof, chi2, min_expected, low_expected, p FROM kt"
TOP = f"""{IFR}, kx AS (SELECT *, row_number() OVER (PARTITION BY slot, region ORDER BY p, item) AS place FROM kt WHERE p < 0.05),
    ke AS (SELECT slot, region, item, arch, avg(CASE WHEN held = 'yes' THEN 100.0::DOUBLE ELSE 0 END) AS rate FROM kr GROUP BY 1, 2, 3, 4),
    ky AS (SELECT slot, region, item, arg_max(arch, struct_pack(a := rate, b := arch)) AS max_arch, max(rate) AS max_rate, arg_min(arch, struct_pack(a := rate, b := arch)) AS min_arch, min(rate) AS min_rate FROM ke GROUP BY 1, 2, 3)
    SELECT slot, {Q.i('region')} AS region, place, item, chi2, p, max_arch, {Q.r('max_rate')} AS max_rate, min_arch, {Q.r('min_rate')} AS min_rate, {Q.r('max_rate - min_rate')} AS delta FROM kx JOIN ky USING (slot, region, item) WHERE place <= 5"""


def both_units(sql: str, items: str) -> str:
    """The statement over single items and over their classes."""
    return f"SELECT 'item' AS unit, * REPLACE (CAST(item AS VARCHAR) AS item) FROM ({items}) UNION ALL SELECT 'class' AS unit, * FROM ({sql})"


def of_units(single: DataFrame, classes: DataFrame) -> DataFrame:
    return single.withColumns({"unit": F.lit("item"), "item": F.col("item").cast("string")}).unionByName(classes.withColumn("unit", F.lit("class")))


@query("a65_item_fairness_tests", both_units(TESTED, TESTED.replace(CLS, LINES)))
def _(spark, sf):
    """Items and their classes: none of many thousand items is in every twentieth basket, so classes are what is tested there."""
    rows = arch_hours(spark, sf)
    return of_units(st.item_fairness(rows, tables.deck_items(spark, sf))[0], st.item_fairness(rows, tables.deck_item_classes(spark, sf))[0])


@query("a65_item_class_fairness_tests", TESTED)
def _(spark, sf):
    return st.item_fairness(arch_hours(spark, sf), tables.deck_item_classes(spark, sf))[0]


@query("a65_k05_item_fairness_top", both_units(TOP, TOP.replace(CLS, LINES)))
def _(spark, sf):
    rows = arch_hours(spark, sf)
    return of_units(*(st.item_fairness_top(*st.item_fairness(rows, lines)) for lines in (tables.deck_items(spark, sf), tables.deck_item_classes(spark, sf))))


@query("a65_k05_item_class_fairness_top", TOP)
def _(spark, sf):
    return st.item_fairness_top(*st.item_fairness(arch_hours(spark, sf), tables.deck_item_classes(spark, sf)))


# --- targeting --------------------------------------------------------------------

THREATS = [(f"Brand#{t}", f"Brand#{(t + d) % 25 + 1}", "hard" if d < 6 else "soft") for t in range(1, 7) for d in range(3, 15, 2)]
TH = "th AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in THREATS) + ") AS t(threat, item, kind))"


MET = f"""WITH {Q.tl('Ladder')}, {CLS}, {TH}, nm AS (SELECT DISTINCT threat FROM th), an AS (SELECT deck, threat, count(*) FILTER (kind = 'hard') AS h, count(*) FILTER (kind = 'soft') AS s FROM bi JOIN th USING (item) GROUP BY 1, 2),
    ev2 AS (SELECT tl.deck, tl.opp_deck FROM tl WHERE rating_before >= 6000 AND rating_before < 12000 AND tl.deck IN (SELECT deck FROM bi) AND tl.opp_deck IN (SELECT deck FROM bi)),
    en AS (SELECT nm.threat, coalesce(h > 0 OR s >= 2, FALSE) AS safe, bi.item IS NOT NULL AS meets FROM ev2 CROSS JOIN nm LEFT JOIN an ON an.deck = ev2.deck AND an.threat = nm.threat LEFT JOIN bi ON bi.deck = ev2.opp_deck AND bi.item = nm.threat),
    eo AS (SELECT threat, count(*) FILTER (NOT safe) AS vulnerable, count(*) FILTER (NOT safe AND meets) AS vulnerable_met, count(*) FILTER (safe) AS safe, count(*) FILTER (safe AND meets) AS safe_met FROM en GROUP BY 1),
    ep AS (SELECT *, coalesce(vulnerable_met * 100.0::DOUBLE / nullif(vulnerable, 0), 0) AS v, coalesce(safe_met * 100.0::DOUBLE / nullif(safe, 0), 0) AS s FROM eo)
    SELECT threat, vulnerable, vulnerable_met, safe, safe_met, {Q.r('v')} AS vulnerable_pct, {Q.r('s')} AS safe_pct, {Q.r('v / nullif(s, 0)')} AS ratio, CASE WHEN v > s * 1.5 THEN 'targeted' WHEN s > v THEN 'inverse' ELSE 'neutral' END AS verdict FROM ep"""
ITEM_TH = "th AS (SELECT t.p_partkey AS threat, a.p_partkey AS item, CASE a.p_brand WHEN 'Brand#4' THEN 'hard' ELSE 'soft' END AS kind FROM part t JOIN part a ON a.p_size = t.p_size WHERE t.p_brand = 'Brand#3' AND a.p_brand IN ('Brand#4', 'Brand#5'))"


@query("a54_e03_threat_encounters", MET.replace(CLS, LINES).replace(TH, ITEM_TH))
def _(spark, sf):
    """Threats are the items of one brand; those of the same size of two other brands answer them, hard or soft."""
    part = tables.read(spark, sf, "part")
    answers = part.filter("p_brand in ('Brand#4', 'Brand#5')").select(F.col("p_size").alias("trait"), F.col("p_partkey").alias("item"), F.when(F.col("p_brand") == "Brand#4", "hard").otherwise("soft").alias("kind"))
    threats = part.filter("p_brand = 'Brand#3'").select(F.col("p_size").alias("trait"), F.col("p_partkey").alias("threat"))
    events = tl.timeline(spark, sf, "Ladder").df.filter("rating_before >= 6000 AND rating_before < 12000")
    return st.threat_encounters(events, tables.deck_items(spark, sf), threats, answers)


@query("a54_threat_class_encounters", MET)
def _(spark, sf):
    threats = spark.createDataFrame(THREATS, "threat string, item string, kind string")
    events = tl.timeline(spark, sf, "Ladder").df.filter("rating_before >= 6000 AND rating_before < 12000")
    return st.threat_encounters(events, tables.deck_item_classes(spark, sf), threats)


SNIPERS = f"""{AH}, {CLS}, b0 AS (SELECT *, coalesce(metric2 < 40, FALSE) AS hit FROM ah WHERE mode = 'Ladder' AND rating_before >= 7000 AND rating_before < 8000),
    b1 AS (SELECT count(*) AS t, count(*) FILTER (hit) AS th FROM b0), b2 AS (SELECT b0.*, bi.item FROM b0 JOIN bi ON bi.deck = b0.opp_deck),
    b3 AS (SELECT item, count(*) AS n, count(*) / CAST(any_value(t) AS DOUBLE) AS freq, round(count(*) FILTER (hit) / CAST(any_value(th) AS DOUBLE) / (count(*) / CAST(any_value(t) AS DOUBLE)), 9) AS lift FROM b2, b1 GROUP BY 1 HAVING count(*) >= 5),
    b4 AS (SELECT *, row_number() OVER (ORDER BY lift DESC, item) AS place FROM b3 WHERE lift > 1.05 AND freq < 0.5),
    b5 AS (SELECT item, avg(CASE WHEN hour < 7 THEN 100.0::DOUBLE ELSE 0 END) AS night, count(DISTINCT opponent) / CAST(count(*) AS DOUBLE) AS ratio FROM b2 GROUP BY 1),
    b6 AS (SELECT item, max(c) / CAST(sum(c) AS DOUBLE) AS share FROM (SELECT item, floor(rating_before / 250.0) AS b, count(*) AS c FROM b2 GROUP BY 1, 2) GROUP BY 1)
    SELECT item, place, n, {Q.r('freq')} AS freq, {Q.r('lift')} AS lift, {Q.r('night')} AS night_pct, {Q.r('ratio')} AS opponent_ratio, {Q.r('share')} AS bucket_share FROM b4 JOIN b5 USING (item) JOIN b6 USING (item) WHERE place <= 5"""


def sniper_rows(spark, sf):
    return arch_hours(spark, sf).filter("mode = 'Ladder' AND rating_before >= 7000 AND rating_before < 8000")


@query("a55_g16_sniper_confounding", both_units(SNIPERS, SNIPERS.replace(CLS, LINES).replace("lift > 1.05 AND freq < 0.5", "lift > 1.8 AND freq < 0.15")))
def _(spark, sf):
    """Items at the reference's limits and classes, which are more even, at lower ones."""
    rows = sniper_rows(spark, sf)
    return of_units(st.sniper_confounding(rows, tables.deck_items(spark, sf)), st.sniper_confounding(rows, tables.deck_item_classes(spark, sf), 1.05, 0.5))


@query("a55_sniper_class_confounding", SNIPERS)
def _(spark, sf):
    """Classes instead of items, at lower limits."""
    return st.sniper_confounding(sniper_rows(spark, sf), tables.deck_item_classes(spark, sf), 1.05, 0.5)


# --- confounding ---------------------------------------------------------------------

CF = f"""{AH}, {Q.ITEMS}, tower AS (SELECT p_partkey AS item FROM part WHERE p_type = 'PROMO'),
lv AS (SELECT deck, coalesce(avg(level) FILTER (item NOT IN (SELECT item FROM tower)), 0) AS al, coalesce(max(level) FILTER (item IN (SELECT item FROM tower)), 0) AS sl FROM deck_items GROUP BY 1),
cf AS (SELECT ah.*, a.al AS own_level, a.sl AS own_special, b.al AS opp_level, b.sl AS opp_special FROM ah JOIN lv a ON a.deck = ah.deck JOIN lv b ON b.deck = ah.opp_deck WHERE mode = 'Ladder' AND rating_before <> 0 AND arch IS NOT NULL)"""


def conf_rows(spark, sf):
    promo = tables.items(spark, sf).filter("type = 'PROMO'").select("item", F.lit(True).alias("promo"))
    lines = tables.deck_items(spark, sf).join(promo, "item", "left")
    levels = bs.basket_levels(lines, F.coalesce("promo", F.lit(False)))
    return st.confounding_rows(arch_hours(spark, sf), levels)


@query(
    "g23_j04_basket_levels",
    f"""WITH {Q.ITEMS}, tower AS (SELECT p_partkey AS item FROM part WHERE p_type = 'PROMO')
    SELECT deck, {Q.r('coalesce(avg(level) FILTER (item NOT IN (SELECT item FROM tower)), 0)')} AS avg_level, count(*) AS size, {Q.r('coalesce(max(level) FILTER (item IN (SELECT item FROM tower)), 0)')} AS special_level FROM deck_items GROUP BY 1""",
)
def _(spark, sf):
    promo = tables.items(spark, sf).filter("type = 'PROMO'").select("item", F.lit(True).alias("promo"))
    lines = tables.deck_items(spark, sf).join(promo, "item", "left")
    return bs.basket_levels(lines, F.coalesce("promo", F.lit(False)))


@query(
    "a57_confounding_correlations",
    f"""{CF}, cp AS (SELECT 'rating_opp_level' AS pair, rating_before AS x, round(opp_level, 9) AS y FROM cf UNION ALL SELECT 'rating_own_level', rating_before, round(own_level, 9) FROM cf UNION ALL SELECT 'own_opp_level', round(own_level, 9), round(opp_level, 9) FROM cf
      UNION ALL SELECT 'own_special_level', own_special, round(own_level, 9) FROM cf WHERE own_special > 0 UNION ALL SELECT 'own_opp_special', own_special, opp_special FROM cf WHERE own_special > 0 AND opp_special > 0 UNION ALL SELECT 'rating_metric2', rating_before, metric2 FROM cf WHERE metric2 IS NOT NULL)
    {Q.spearman('cp', ['pair'], 'x', 'y', 11)}""",
)
def _(spark, sf):
    return st.confounding_correlations(conf_rows(spark, sf))


@query(
    "a57_confounding_kruskal",
    f"""{CF}, cb AS (SELECT *, CAST(floor(rating_before / 500.0) * 500 AS BIGINT) AS bucket FROM cf), cc AS (SELECT *, CAST(hour // 6 AS VARCHAR) AS slot FROM cb WHERE bucket IN (SELECT bucket FROM cb GROUP BY 1 HAVING count(*) >= 50)),
    c1 AS (SELECT bucket, 'opp_level' AS measure, slot AS grp, round(opp_level, 9) AS value FROM cc UNION ALL SELECT bucket, 'metric2', slot, metric2 FROM cc),
    c2 AS (SELECT bucket, 'opp_level' AS measure, arch AS grp, round(opp_level, 9) AS value FROM cc UNION ALL SELECT bucket, 'metric2', arch, metric2 FROM cc UNION ALL SELECT bucket, 'own_level', arch, round(own_level, 9) FROM cc)
    SELECT *, 'slot' AS axis FROM ({Q.kruskal('c1', ['bucket', 'measure'], 'grp', 'value', 6)}) UNION ALL SELECT *, 'arch' AS axis FROM ({Q.kruskal('c2', ['bucket', 'measure'], 'grp', 'value', 10)})""",
)
def _(spark, sf):
    return st.confounding_kruskal(conf_rows(spark, sf))


SWI = f"""WITH {Q.tl()}, sc AS (SELECT *, row_number() OVER (PARTITION BY entity, session_no ORDER BY ts, event_id) AS k FROM tl WHERE mode IN ('Ladder', 'Ranked')),
wn AS (SELECT *, lead(1, 2) OVER w IS NOT NULL AS fullw, count(metric) OVER g = 3 AS known, min(metric) OVER g > 80 OR max(metric) OVER g < 40 AS streak FROM sc
  WINDOW w AS (PARTITION BY entity, session_no ORDER BY ts, event_id), g AS (PARTITION BY entity, session_no ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
wk AS (SELECT *, (ts % 86400) // 21600 AS slot FROM wn WHERE fullw AND known)"""


@query("a67_streaks_by_slot", f"{SWI} {Q.chi_square('wk', [], 'slot', 'streak')}")
def _(spark, sf):
    return st.streaks_by_slot(st.streak_windows(tl.timeline(spark, sf)))


@query(
    "a67_k04_streaks_by_deck",
    f"""{SWI}, wd AS (SELECT *, count(*) OVER (PARTITION BY entity, deck) AS dn FROM wk), wr AS (SELECT entity, deck, row_number() OVER (PARTITION BY entity ORDER BY dn DESC, deck) AS place FROM (SELECT DISTINCT entity, deck, dn FROM wd)),
    wt AS (SELECT wd.entity, wd.deck, streak FROM wd JOIN wr ON wr.entity = wd.entity AND wr.deck = wd.deck WHERE place <= 3 AND dn > 2) {Q.chi_square('wt', ['entity'], 'deck', 'streak')}""",
)
def _(spark, sf):
    return st.streaks_by_deck(st.streak_windows(tl.timeline(spark, sf)), min_n=2)


# --- null models -----------------------------------------------------------------------


def null_sql(base: str, rows: str, flags: dict[str, str]) -> str:
    parts = []
    for name, cond in flags.items():
        parts.append(
            f"""SELECT '{name}' AS flag, CAST(sum(nn) AS BIGINT) AS events, CAST(sum(ww) AS BIGINT) AS windows, CAST(sum(oo) AS BIGINT) AS observed, sum(ww) * power(sum(kk) / sum(nn), 3) AS theory,
            sum(CASE WHEN nn >= 3 THEN ww * kk * (kk - 1) * (kk - 2) / (nn * (nn - 1) * (nn - 2)) ELSE 0 END) AS global_null, sum(ss) AS session_null FROM (
              SELECT entity, sum(m) AS nn, sum(w) AS ww, sum(k) AS kk, sum(o) AS oo, sum(CASE WHEN m >= 3 THEN w * k * (k - 1) * (k - 2) / (m * (m - 1) * (m - 2)) ELSE 0 END) AS ss FROM (
                SELECT entity, session_no, CAST(count(*) AS DOUBLE) AS m, greatest(count(*) - 2, 0) AS w, CAST(count(*) FILTER (f) AS DOUBLE) AS k, count(*) FILTER (f AND f1 AND f2) AS o FROM (
                  SELECT *, lead(f) OVER w AS f1, lead(f, 2) OVER w AS f2 FROM (SELECT *, {cond} AS f FROM {rows}) WINDOW w AS (PARTITION BY entity, session_no ORDER BY ts, event_id)) GROUP BY 1, 2) GROUP BY 1)"""
        )
    return f"""{base}, nl AS ({' UNION ALL '.join(parts)}) SELECT flag, events, windows, observed, {Q.r('theory')} AS theory, {Q.r('global_null')} AS global_null, {Q.r('session_null')} AS session_null,
    {Q.r('coalesce(observed / nullif(theory, 0), 0)')} AS ratio_theory, {Q.r('coalesce(observed / nullif(global_null, 0), 0)')} AS ratio_global_null, {Q.r('coalesce(observed / nullif(session_null, 0), 0)')} AS ratio_session_null FROM nl WHERE windows > 0"""


def scored(column: str) -> str:
    return f"WITH {Q.tl()}, va AS (SELECT * FROM tl WHERE mode IN ('Ladder', 'Ranked') AND {column} IS NOT NULL)"


@query("a04_h17_extreme_streaks", null_sql(scored("metric"), "va", {"high": "metric > 80", "low": "metric < 30"}))
def _(spark, sf):
    return st.extreme_streaks(tl.timeline(spark, sf), "metric", 80.0, 30.0)


@query("a04_extreme_streaks_second_metric", null_sql(scored("metric2"), "va", {"high": "metric2 > 80", "low": "metric2 < 30"}))
def _(spark, sf):
    return st.extreme_streaks(tl.timeline(spark, sf), "metric2", 80.0, 30.0)


@query("a20_extreme_level_streaks", null_sql(scored("level"), "va", {"high": "level > 0.5", "low": "level < -0.5"}))
def _(spark, sf):
    return st.extreme_streaks(tl.timeline(spark, sf), "level", 0.5, -0.5)


ZS = f"""{scored('level')}, vb AS (SELECT *, CAST(floor(rating_before / 200.0) * 200 AS BIGINT) AS b FROM va), bs AS (SELECT b, avg(level) AS m, stddev_samp(level) AS s FROM vb WHERE b IS NOT NULL GROUP BY 1 HAVING count(*) > 5 AND stddev_samp(level) > 0),
gs AS (SELECT avg(level) AS gm, stddev_samp(level) AS gs FROM vb), vz AS (SELECT vb.*, round(coalesce((level - m) / s, (level - gm) / gs), 9) AS z FROM vb LEFT JOIN bs USING (b), gs)"""


@query("a21_normalized_level_streaks", null_sql(ZS, "vz", {"low": "z < -2"}))
def _(spark, sf):
    return st.normalized_level_streaks(tl.timeline(spark, sf), below=-2.0)


@query("a21_normalized_level_streaks_wide", null_sql(ZS, "vz", {"low": "z < -1"}))
def _(spark, sf):
    """A limit that thin data reach."""
    return st.normalized_level_streaks(tl.timeline(spark, sf), below=-1.0)


OPJ = f"""WITH {PF}, {ODDS}, oj AS (SELECT entity, odds AS x, ers AS y FROM od JOIN pf USING (entity) WHERE kind = 'pity' AND odds IS NOT NULL AND NOT isinf(odds))"""


@query("h04_permutation_spearman", f"{OPJ} SELECT * FROM {Q.permutation('oj', [], 'x', 'y', 'entity', 10_000)}")
def _(spark, sf):
    _, odds, profile = odds_and_profile(spark, sf)
    joined = odds.filter((F.col("kind") == "pity") & is_finite("odds")).join(profile.select("entity", "ers"), "entity")
    return pm.permutation_spearman(joined.select("entity", "odds", "ers"), [], "odds", "ers", "entity", 10_000)


@query("h03_partial_spearman", f"""WITH {PF}, rk AS (SELECT rank() OVER (ORDER BY fsi) + (count(*) OVER (PARTITION BY fsi) - 1) / 2.0 AS rx, rank() OVER (ORDER BY avg_metric) + (count(*) OVER (PARTITION BY avg_metric) - 1) / 2.0 AS ry, rank() OVER (ORDER BY total_events) + (count(*) OVER (PARTITION BY total_events) - 1) / 2.0 AS rz FROM pf),
cc AS (SELECT count(*) AS n, corr(rx, ry) AS r_xy, corr(rx, rz) AS r_xz, corr(ry, rz) AS r_yz FROM rk) SELECT n, {Q.r('r_xy')} AS r_xy, {Q.r('r_xz')} AS r_xz, {Q.r('r_yz')} AS r_yz, {Q.r('(r_xy - r_xz * r_yz) / sqrt((1 - r_xz * r_xz) * (1 - r_yz * r_yz))')} AS r_partial FROM cc""")
def _(spark, sf):
    _, _, profile = odds_and_profile(spark, sf)
    return hy.partial_spearman(profile, [], "fsi", "avg_metric", "total_events")


@query("k06_hash_sample", f"WITH {Q.EV} SELECT entity, event_id FROM ev ORDER BY md5('42|' || event_id), event_id LIMIT 500")
def _(spark, sf):
    return rs.hash_sample(tables.events(spark, sf).select("entity", "event_id"), ["event_id"], 500)


# --- swaps --------------------------------------------------------------------------------

SCORE = """pr AS (SELECT arch, opp_arch, avg(metric2) AS ps FROM ta WHERE metric2 IS NOT NULL AND arch IS NOT NULL AND opp_arch IS NOT NULL GROUP BY 1, 2),
si AS (SELECT arch, avg(metric2) AS ss FROM ta WHERE metric2 IS NOT NULL AND arch IS NOT NULL GROUP BY 1), ov AS (SELECT avg(metric2) AS os FROM ta WHERE metric2 IS NOT NULL AND arch IS NOT NULL)"""

ODS = f"""{TA}, {Q.REGION}, {SCORE}, lr AS (SELECT * FROM ta WHERE mode = 'Ladder' AND metric2 IS NOT NULL),
os0 AS (SELECT entity, session_no, count(*) AS valid, count(DISTINCT deck) AS dk, min(deck) AS deck, min(arch) AS arch, avg(metric2) AS real, min(ts) AS ts0, min_by(rating_before, struct_pack(a := ts, b := event_id)) AS r0 FROM lr GROUP BY 1, 2),
os1 AS (SELECT os0.*, region, (((ts0 + shift_h * 3600) // 3600) % 24) // 4 AS slot, CAST(floor(r0 / 500.0) AS BIGINT) AS band, strftime(make_timestamp(ts0 * 1000000), '%Y-%W') AS week FROM os0 JOIN rg ON rg.nation = entity % 25 WHERE valid >= 3 AND dk = 1 AND r0 IS NOT NULL),
mt AS (SELECT entity, session_no, opp_arch, count(*) AS met FROM lr WHERE opp_arch IS NOT NULL GROUP BY 1, 2, 3)"""


def hx(seed: int, *cols: str) -> str:
    return "CAST(('0x' || substr(md5('" + str(seed) + "|' || " + " || '|' || ".join(cols) + "), 1, 8)) AS BIGINT)"


SSW = f"""{ODS}, ci AS (SELECT *, row_number() OVER (PARTITION BY region, slot, band ORDER BY {hx(42, 'entity', 'session_no')}, entity, session_no) - 1 AS place, count(*) OVER (PARTITION BY region, slot, band) AS around FROM os1),
pa AS (SELECT a.entity, a.session_no, a.arch, a.real, b.entity AS be, b.session_no AS bs, row_number() OVER (PARTITION BY a.entity, a.session_no ORDER BY (b.place - a.place + a.around) % a.around) AS k FROM ci a JOIN ci b ON a.region = b.region AND a.slot = b.slot AND a.band = b.band AND a.entity <> b.entity),
pb AS (SELECT * FROM pa WHERE k = 1)"""


@query("j11_session_swap_pairs", f"{SSW} SELECT entity, session_no, be AS other_entity, bs AS other_session_no FROM pb")
def _(spark, sf):
    return sw.session_swap_pairs(arch_timeline(spark, sf), regions(spark, sf)).select("entity", "session_no", "other_entity", "other_session_no")


def hypo(pairs: str, keep: str) -> str:
    return f"""hy AS (SELECT {keep}, any_value(real) AS real, sum(coalesce(ps, ss, os) * met) / sum(met) AS hypo FROM {pairs} p JOIN mt ON mt.entity = p.be AND mt.session_no = p.bs LEFT JOIN pr ON pr.arch = p.arch AND pr.opp_arch = mt.opp_arch LEFT JOIN si ON si.arch = p.arch, ov GROUP BY {keep})"""


@query("a51_h12_j14_session_swap", f"{SSW}, {hypo('pb', 'p.entity, p.session_no')} {Q.paired_t('hy', [], 'real', 'hypo')}")
def _(spark, sf):
    return sw.session_swap(arch_timeline(spark, sf), regions(spark, sf))


CSW = f"""{ODS}, {Q.ITEMS}, di AS (SELECT deck, list(DISTINCT item) AS items, coalesce(list(DISTINCT item) FILTER (item IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7')), []) AS keys FROM deck_items GROUP BY 1),
cs AS (SELECT os1.*, CASE WHEN real < 45 THEN 'Neg' WHEN real > 55 THEN 'Pos' END AS cat, items, keys FROM os1 JOIN di USING (deck)),
cb AS (SELECT *, row_number() OVER (PARTITION BY region, week, slot, band, cat ORDER BY {hx(42, 'entity', 'session_no')}, entity, session_no) - 1 AS place, count(*) OVER (PARTITION BY region, week, slot, band, cat) AS around FROM cs WHERE cat IS NOT NULL),
cq AS (SELECT cs.*, x.ca, x.cb FROM cs JOIN (VALUES ('Neg', 'Neg'), ('Pos', 'Pos'), ('Neg', 'Pos')) AS x(ca, cb) ON cs.cat = x.ca),
cr AS (SELECT a.ca, a.cb, a.entity, a.session_no, a.arch, a.real, b.entity AS be, b.session_no AS bs, row_number() OVER (PARTITION BY a.ca, a.cb, a.entity, a.session_no ORDER BY (b.place - {hx(43, 'a.entity', 'a.session_no', 'a.ca', 'a.cb')} % b.around + b.around) % b.around) AS k
  FROM cq a JOIN cb b ON a.region = b.region AND a.week = b.week AND a.slot = b.slot AND a.band = b.band AND a.cb = b.cat AND a.entity <> b.entity AND len(list_intersect(a.items, b.items)) <= 3 AND len(list_intersect(a.keys, b.keys)) = 0),
ct AS (SELECT * FROM cr WHERE k = 1)"""


def cond_pairs(spark, sf):
    lines = tables.deck_items(spark, sf)
    keys = tables.read(spark, sf, "part").filter("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("item"))
    seq = arch_timeline(spark, sf)
    return seq, sw.conditional_swap_pairs(seq, regions(spark, sf), lines, keys)


@query("j12_f07_conditional_swap_pairs", f"{CSW} SELECT ca, cb, entity, session_no, be AS b_entity, bs AS b_session_no FROM ct")
def _(spark, sf):
    return cond_pairs(spark, sf)[1].select("ca", "cb", "entity", "session_no", "b_entity", "b_session_no")


@query("a52_session_swap_conditional", f"{CSW}, {hypo('ct', 'p.ca, p.cb, p.entity, p.session_no')} {Q.paired_t('hy', ['ca', 'cb'], 'real', 'hypo')}")
def _(spark, sf):
    seq, pairs = cond_pairs(spark, sf)
    return sw.conditional_swap(pairs, seq)


NSW = f"""{TA}, {Q.REGION}, {Q.ITEMS}, {SCORE}, lv AS (SELECT deck, avg(level) AS dl FROM deck_items GROUP BY 1), lr AS (SELECT * FROM ta WHERE mode = 'Ladder' AND metric2 IS NOT NULL),
sm AS (SELECT entity, session_no, CASE WHEN avg(metric2) < 45 THEN 'Neg' WHEN avg(metric2) > 55 THEN 'Pos' END AS kind FROM lr GROUP BY 1, 2),
kp AS (SELECT lr.*, kind, coalesce(avg(win) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.5) AS recent FROM lr JOIN sm USING (entity, session_no) WHERE kind IS NOT NULL AND rating_before IS NOT NULL AND metric2 <> 0),
se AS (SELECT event_id, kind, arch, opp_arch, metric2, region, CAST(((ts + shift_h * 3600) // 3600) % 24 AS BIGINT) AS hour, CAST(floor(rating_before / 50.0) AS BIGINT) AS band, round(recent, 9) AS recent, round(dl, 9) AS deck_level FROM kp JOIN lv USING (deck) JOIN rg ON rg.nation = entity % 25),
nn AS (SELECT a.event_id, b.event_id AS match, a.arch, b.opp_arch, a.metric2 AS real, round(abs(a.recent - b.recent) + abs(a.deck_level - b.deck_level) / 14.0, 6) AS distance FROM se a JOIN se b ON a.kind = 'Neg' AND b.kind = 'Pos' AND a.region = b.region AND a.hour // 6 = b.hour // 6 AND a.band // 4 = b.band // 4),
np AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, match) AS k FROM nn WHERE distance < 0.3), nq AS (SELECT * FROM np WHERE k = 1)"""


def swap_events(spark, sf, hours: int = 1, bands: int = 1):
    seq = arch_timeline(spark, sf)
    rows = sw.swap_events(seq, regions(spark, sf), bs.basket_levels(tables.deck_items(spark, sf)))
    return seq, rows.withColumns({"hour": F.floor(F.col("hour") / hours).cast("long"), "band": F.floor(F.col("band") / bands).cast("long")})


@query("j13_match_swap_pairs", f"{NSW} SELECT event_id, match, {Q.r('distance')} AS distance FROM nq")
def _(spark, sf):
    """Strata of six hours and four bands: most events find a partner."""
    return sw.match_swap_pairs(swap_events(spark, sf, 6, 4)[1])


FINE = NSW.replace("a.hour // 6 = b.hour // 6 AND a.band // 4 = b.band // 4", "a.hour = b.hour AND a.band = b.band")


@query("j13_match_swap_pairs_fine", f"{FINE} SELECT event_id, match, {Q.r('distance')} AS distance FROM nq")
def _(spark, sf):
    """The strata of one hour and one band."""
    return sw.match_swap_pairs(swap_events(spark, sf)[1])


@query(
    "a50_match_swap",
    f"""{NSW}, hs AS (SELECT real, coalesce(ps, ss, os) AS hypo FROM nq LEFT JOIN pr ON pr.arch = nq.arch AND pr.opp_arch = nq.opp_arch LEFT JOIN si ON si.arch = nq.arch, ov) {Q.paired_t('hs', [], 'hypo', 'real')}""",
)
def _(spark, sf):
    seq, events = swap_events(spark, sf, 6, 4)
    return sw.match_swap(events, sw.match_swap_pairs(events), seq)


@query(
    "a50_match_swap_fine",
    f"""{FINE}, hs AS (SELECT real, coalesce(ps, ss, os) AS hypo FROM nq LEFT JOIN pr ON pr.arch = nq.arch AND pr.opp_arch = nq.opp_arch LEFT JOIN si ON si.arch = nq.arch, ov) {Q.paired_t('hs', [], 'hypo', 'real')}""",
)
def _(spark, sf):
    seq, events = swap_events(spark, sf)
    return sw.match_swap(events, sw.match_swap_pairs(events), seq)


HSW = f"""{TA}, {SCORE}, hs0 AS (SELECT *, lead(arch) OVER w AS n_arch, lag(1, 3) OVER w IS NOT NULL AND lead(1, 3) OVER w IS NOT NULL AS fullw, [lag(opp_arch, 1) OVER w, lag(opp_arch, 2) OVER w, lag(opp_arch, 3) OVER w] AS opps,
  avg(metric2) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS avg_prev, avg(metric2) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS avg_next FROM ta WINDOW w AS ({W})),
hs1 AS (SELECT event_id, n_arch AS arch, avg_prev, avg_next, unnest(opps) AS opp_arch FROM hs0 WHERE fullw AND arch <> n_arch AND avg_prev IS NOT NULL AND avg_next IS NOT NULL),
hs2 AS (SELECT event_id, any_value(avg_prev) AS p, avg(coalesce(ps, ss, os)) AS h, any_value(avg_next) AS n FROM hs1 LEFT JOIN pr ON pr.arch = hs1.arch AND pr.opp_arch = hs1.opp_arch LEFT JOIN si ON si.arch = hs1.arch, ov WHERE hs1.opp_arch IS NOT NULL GROUP BY 1)"""


@query("a46_deck_switch_hypothetical", f"{HSW} SELECT count(*) AS switches, {Q.r('avg(p)')} AS avg_prev, {Q.r('avg(h)')} AS avg_hypo, {Q.r('avg(n)')} AS avg_next, {Q.r('avg(n) - avg(h)')} AS gap FROM hs2")
def _(spark, sf):
    return sw.switch_summary(sw.hypothetical_switches(arch_timeline(spark, sf)))
