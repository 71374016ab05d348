"""Queries on what follows an event, and on streaks, stress and transitions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import query
from seqtide.plans import outcomes as oc
from seqtide.plans import timeline as tl
from seqtide.session import checkpoint_dir

T = f"WITH {Q.tl()}"
FULL3 = "next_metric IS NOT NULL AND next_level IS NOT NULL AND next_metric2 IS NOT NULL"


def long3(where: str, name: str = "lg", keys: str = "win", cols=("next_metric", "next_level", "next_metric2")) -> str:
    parts = " UNION ALL ".join(f"SELECT {keys}, '{c}' AS measure, CAST({c} AS DOUBLE) AS value FROM tl WHERE {where}" for c in cols)
    return f"{name} AS ({parts})"


DEBT = long3(f"metric < 45 AND {FULL3}")
CREDIT = long3(f"metric > 55 AND {FULL3}", "cr")


@query("a15_debt_extinction", f"{T}, {DEBT} {Q.mwu('lg', ['measure'], 'win', 'value', '1', '0', 'less', 10)}")
def _(spark, sf):
    return oc.debt_extinction(tl.timeline(spark, sf), exact=False)


@query("a15_on_a_written_timeline", f"{T}, {DEBT} {Q.mwu('lg', ['measure'], 'win', 'value', '1', '0', 'less', 10)}")
def _(spark, sf):
    name = f"timeline_{uuid.uuid4().hex}"
    return oc.debt_extinction(tl.materialize(tl.timeline(spark, sf), name, f"{checkpoint_dir(spark).rstrip('/')}/{name}"), exact=False)


@query(
    "a15_controls",
    f"{T} SELECT {Q.i('win')} AS win, count(*) AS n, {Q.r('avg(metric)')} AS avg_metric, {Q.r('avg(level)')} AS avg_level, {Q.r('avg(leak_against - leak_for)')} AS avg_leak_diff FROM tl WHERE metric < 45 AND {FULL3} GROUP BY win",
)
def _(spark, sf):
    return oc.zone_controls(tl.timeline(spark, sf), "debt")


@query("a16_favorable_outcome", f"{T}, f AS (SELECT win, next_metric FROM tl WHERE metric > 55) {Q.mwu('f', [], 'win', 'next_metric', '1', '0', 'two-sided', 10)}")
def _(spark, sf):
    return oc.favorable_outcome(tl.timeline(spark, sf), exact=False)


@query(
    "a29_debt_credit_combined",
    f"{T}, {DEBT}, {CREDIT} SELECT *, 'debt' AS section FROM ({Q.mwu('lg', ['measure'], 'win', 'value', '1', '0', 'less', 10)}) UNION ALL SELECT *, 'credit' AS section FROM ({Q.mwu('cr', ['measure'], 'win', 'value', '1', '0', 'two-sided', 10)})",
)
def _(spark, sf):
    return oc.debt_credit_combined(tl.timeline(spark, sf), exact=False)


DQ = f"""{T}, dq AS (SELECT *, CASE WHEN score_for = 0 AND score_against = 3 THEN 'crushing' WHEN score_against - score_for = 1 THEN 'close' END AS quality
FROM tl WHERE win = 0 AND metric IS NOT NULL AND next_metric IS NOT NULL)"""


@query("a17_defeat_quality", f"""{DQ} {Q.mwu('dq', [], 'quality', 'next_metric', "'crushing'", "'close'", 'greater', 10)}""")
def _(spark, sf):
    return oc.defeat_quality(tl.timeline(spark, sf), exact=False)


@query("a17_defeat_leak", f"{DQ} SELECT quality, count(*) AS n, {Q.r('avg(leak_for)')} AS avg_leak FROM dq WHERE quality IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return oc.defeat_rows(tl.timeline(spark, sf)).groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.avg("leak_for").alias("avg_leak"))


EP = f"""{T}, z AS (SELECT *, CASE WHEN metric < 45 THEN 'Debt' WHEN metric > 55 THEN 'Credit' ELSE 'Normal' END AS state FROM tl WHERE metric IS NOT NULL AND level IS NOT NULL),
z1 AS (SELECT *, CASE WHEN lag(state) OVER sw IS DISTINCT FROM state THEN 1 ELSE 0 END AS new FROM z WINDOW sw AS (PARTITION BY entity, session_no ORDER BY ts, event_id)),
z2 AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts, event_id) AS run FROM z1),
ep AS (SELECT entity, run, max(state) AS state, count(*) AS length, sum(level) AS sl, sum(metric2) AS sm, count(metric2) AS nm FROM z2 GROUP BY 1, 2)"""


@query(
    "a18_episode_durations",
    f"{EP} SELECT state, count(*) AS episodes, {Q.r('avg(length)')} AS avg_length, max(length) AS max_length, {Q.i('sum(length)')} AS events, {Q.r('sum(sl) / sum(length)')} AS avg_level, {Q.r('coalesce(sum(sm) / sum(nm), 0)')} AS avg_metric2 FROM ep GROUP BY 1",
)
def _(spark, sf):
    return oc.episode_durations(tl.timeline(spark, sf))


@query(
    "a18_debt_credit_levels",
    f"""{EP}, ml AS (SELECT state, 'level' AS measure, level AS value FROM z UNION ALL SELECT state, 'metric2', metric2 FROM z) {Q.mwu('ml', ['measure'], 'state', 'value', "'Debt'", "'Credit'", 'less', 11)}""",
)
def _(spark, sf):
    return oc.debt_credit_levels(tl.timeline(spark, sf), exact=False)


@query(
    "a19_g11_punishment_tradeoff",
    f"""{T}, v AS (SELECT metric2, level FROM tl WHERE mode IN ('Ladder', 'Ranked') AND metric2 IS NOT NULL AND level IS NOT NULL),
    c AS (SELECT count(*) AS total, count(*) FILTER (metric2 < 45) AS bad_metric, count(*) FILTER (level < -0.5) AS bad_level, count(*) FILTER (metric2 < 45 AND level < -0.5) AS both_bad FROM v),
    c2 AS (SELECT *, bad_metric * bad_level / CAST(total AS DOUBLE) AS expected FROM c)
    SELECT total, bad_metric, bad_level, both_bad, {Q.r('expected')} AS expected, {Q.r('both_bad / expected')} AS ratio, CASE WHEN both_bad / expected < 0.85 THEN 'tradeoff' WHEN both_bad / expected > 1.15 THEN 'double' ELSE 'independent' END AS verdict, s.rho, s.p
    FROM c2, ({Q.spearman('v', [], 'metric2', 'level')}) s""",
)
def _(spark, sf):
    return oc.punishment_tradeoff(tl.timeline(spark, sf))


RISK = f"""{T}, l AS (SELECT *, prev_win IS NOT DISTINCT FROM 0 AS l1, prev2_win IS NOT DISTINCT FROM 0 AS l2, coalesce(metric < 40, FALSE) AS c0,
  coalesce(prev_win = 0 AND prev_metric < 40, FALSE) AS c1, coalesce(prev2_win = 0 AND prev2_metric < 40, FALSE) AS c2,
  CASE WHEN next_metric > 60 THEN 'pity' ELSE 'none' END AS grp, n - pos AS remaining FROM tl WHERE win = 0 AND next_metric IS NOT NULL),
rk AS (SELECT 'Loss' AS risk, * FROM l UNION ALL SELECT 'Loss2', * FROM l WHERE l1 UNION ALL SELECT 'Loss3', * FROM l WHERE l1 AND l2 UNION ALL SELECT 'Counter', * FROM l WHERE c0
  UNION ALL SELECT 'Counter2', * FROM l WHERE c0 AND c1 UNION ALL SELECT 'Counter3', * FROM l WHERE c0 AND c1 AND c2)"""


@query("a07_pity_and_session_length", f"""{RISK} {Q.mwu('rk', ['risk'], 'grp', 'remaining', "'pity'", "'none'", 'greater', 10)}""")
def _(spark, sf):
    return oc.pity_and_session_length(tl.timeline(spark, sf), exact=False)


@query(
    "a08_pity_and_return_time",
    f"""{RISK} SELECT risk, n1, n2, {Q.r('x.m1 / 3600')} AS mean1, {Q.r('x.m2 / 3600')} AS mean2, u, z, p FROM ({Q.mwu('rk', ['risk'], 'grp', 'break_s', "'pity'", "'none'", 'less', 10)}) m
    JOIN (SELECT risk, avg(break_s) FILTER (grp = 'pity') AS m1, avg(break_s) FILTER (grp = 'none') AS m2 FROM rk WHERE break_s IS NOT NULL GROUP BY 1) x USING (risk)""",
)
def _(spark, sf):
    return oc.pity_and_return_time(tl.timeline(spark, sf), exact=False)


@query(
    "a10_cannon_fodder",
    f"""{T}, {Q.streaks()}, st AS (SELECT metric, stress_before, CASE WHEN stress_before <= 0.1 THEN 'low' WHEN stress_before >= 2 THEN 'high' END AS grp FROM sk WHERE metric IS NOT NULL)
    SELECT m.*, s.n AS n_all, s.rho, s.p AS rho_p FROM ({Q.mwu('st', [], 'grp', 'metric', "'low'", "'high'", 'less')}) m, ({Q.spearman('st', [], 'stress_before', 'metric')}) s""",
)
def _(spark, sf):
    return oc.cannon_fodder(tl.timeline(spark, sf), exact=False)


@query(
    "a11_p06_dangerous_sequences",
    f"""{T}, sy AS (SELECT *, CASE WHEN win = 1 THEN 'W' WHEN metric < 40 THEN 'C' ELSE 'L' END AS s FROM tl),
    tr AS (SELECT s || lead(s) OVER sw || lead(s, 2) OVER sw AS triplet, pos + 2 = n AND stop_type <> 'End' AS quit FROM sy WINDOW sw AS (PARTITION BY entity, session_no ORDER BY ts, event_id)),
    pb AS (SELECT s, count(*) / sum(count(*)) OVER () AS p FROM sy GROUP BY 1),
    ct AS (SELECT triplet, count(*) AS count, count(*) FILTER (quit) AS quits FROM tr WHERE triplet IS NOT NULL GROUP BY 1),
    ex AS (SELECT ct.*, (SELECT p FROM pb WHERE s = substr(triplet, 1, 1)) * (SELECT p FROM pb WHERE s = substr(triplet, 2, 1)) * (SELECT p FROM pb WHERE s = substr(triplet, 3, 1)) * (SELECT sum(count) FROM ct) AS expected FROM ct)
    SELECT triplet, count, quits, {Q.r('quits / count')} AS quit_rate, {Q.r('expected')} AS expected, {Q.r('count / expected')} AS ratio FROM ex WHERE count >= 10""",
)
def _(spark, sf):
    return oc.dangerous_sequences(tl.timeline(spark, sf))


def _zone(c: str) -> str:
    return f"CASE WHEN {c} < 45 THEN 'Unfavorable' WHEN {c} > 55 THEN 'Favorable' WHEN {c} IS NOT NULL THEN 'Even' END"


def _side(c: str) -> str:
    return f"CASE WHEN {c} < -0.5 THEN 'Disadvantage' WHEN {c} > 0.5 THEN 'Advantage' WHEN {c} IS NOT NULL THEN 'Even' END"


MK = f"""{T}, mk0 AS (
  SELECT 'metric' AS chain, {_zone('metric')} AS a, {_zone('next_metric')} AS b FROM tl WHERE has_next UNION ALL
  SELECT 'metric2', {_zone('metric2')}, {_zone('next_metric2')} FROM tl WHERE has_next UNION ALL
  SELECT 'level', {_side('level')}, {_side('next_level')} FROM tl WHERE has_next UNION ALL
  SELECT 'outcome_metric', CASE WHEN win = 1 THEN 'Win' ELSE 'Loss' END, {_zone('next_metric')} FROM tl WHERE has_next UNION ALL
  SELECT 'outcome_metric2', CASE WHEN win = 1 THEN 'Win' ELSE 'Loss' END, {_zone('next_metric2')} FROM tl WHERE has_next UNION ALL
  SELECT 'outcome_level', CASE WHEN win = 1 THEN 'Win' ELSE 'Loss' END, {_side('next_level')} FROM tl WHERE has_next),
mk AS (SELECT * FROM mk0 WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(
    "a13_g07_markov_transitions",
    f"""{MK}, c AS (SELECT chain, a, b, count(*) AS cell FROM mk GROUP BY 1, 2, 3),
    d AS (SELECT *, cell / sum(cell) OVER (PARTITION BY chain, a) AS o, sum(cell) OVER (PARTITION BY chain, b) / sum(cell) OVER (PARTITION BY chain) AS e FROM c)
    SELECT chain, a AS from_state, b AS to_state, cell, {Q.r('o')} AS observed, {Q.r('e')} AS expected, {Q.i('abs(o - e) > 0.05')} AS marked FROM d""",
)
def _(spark, sf):
    return oc.markov_chains(tl.timeline(spark, sf))


@query("a13_markov_chi2", f"{MK}, m3 AS (SELECT * FROM mk WHERE chain NOT LIKE 'outcome%') {Q.chi_square('m3', ['chain'], 'a', 'b')}")
def _(spark, sf):
    return oc.markov_tests(tl.timeline(spark, sf))


RET = f"""{T}, ra AS (SELECT *, CAST(floor(rating_before / 200.0) * 200 AS BIGINT) AS b FROM tl),
cv AS (SELECT b, avg(level) AS expected FROM ra WHERE mode IN ('Ladder', 'Ranked') AND rating_before <> 0 AND level IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
bi AS (SELECT entity, avg(level - expected) AS bias FROM ra JOIN cv USING (b) WHERE mode IN ('Ladder', 'Ranked') AND rating_before <> 0 AND level IS NOT NULL GROUP BY 1),
tt AS (SELECT *, CASE WHEN n < 2 THEN 'control' WHEN metric IS NOT NULL AND prev_metric IS NOT NULL THEN CASE WHEN metric < 45 AND prev_metric < 45 THEN 'bad' WHEN metric > 55 AND prev_metric > 55 THEN 'good' ELSE 'control' END END AS tail0 FROM ra),
fi AS (SELECT *, lag(tail0) OVER w AS tail, lag(stop_type) OVER w AS prev_stop FROM tt WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)),
re AS (SELECT f.entity, prev_stop, tail, metric, metric2, level, level - expected - coalesce(bias, 0) AS residual FROM fi f LEFT JOIN cv USING (b) LEFT JOIN bi USING (entity)
  WHERE is_start AND prev_stop IS NOT NULL AND metric IS NOT NULL AND tail IS NOT NULL)"""


@query(
    "a14_j09_return_after_streak",
    f"""{RET} SELECT prev_stop, tail, count(*) AS n, {Q.r('avg(metric)')} AS avg_metric, {Q.r('avg(metric2)')} AS avg_metric2, {Q.r('avg(level)')} AS avg_level, {Q.r('avg(residual)')} AS avg_residual
    FROM re WHERE prev_stop IN (SELECT prev_stop FROM re WHERE tail = 'control' GROUP BY 1 HAVING count(*) >= 5) GROUP BY 1, 2""",
)
def _(spark, sf):
    return oc.return_after_streak(oc.return_rows(tl.timeline(spark, sf)))


@query(
    "a14_return_tests",
    f"""{RET} SELECT *, 'bad' AS tail FROM ({Q.mwu('re', ['prev_stop'], 'tail', 'round(residual, 9)', "'bad'", "'control'", 'less', 5)}) UNION ALL
    SELECT *, 'good' AS tail FROM ({Q.mwu('re', ['prev_stop'], 'tail', 'round(residual, 9)', "'good'", "'control'", 'greater', 5)})""",
)
def _(spark, sf):
    return oc.return_tests(oc.return_rows(tl.timeline(spark, sf)).withColumn("residual", F.round("residual", 9)), exact=False)


@query(
    "a14_return_trend",
    f"""{RET}, bt AS (SELECT *, CASE prev_stop WHEN 'Short' THEN 0 WHEN 'Long' THEN 1 ELSE 2 END AS tier FROM re WHERE tail = 'bad' AND metric2 IS NOT NULL AND level IS NOT NULL),
    bl AS (SELECT tier, 'metric2' AS measure, metric2 AS value FROM bt UNION ALL SELECT tier, 'level', level FROM bt) {Q.spearman('bl', ['measure'], 'tier', 'value', 11)}""",
)
def _(spark, sf):
    return oc.return_trend(oc.return_rows(tl.timeline(spark, sf)))


@query(
    "a22_h13_pity_lift",
    f"""{T}, v AS (SELECT *, has_prev3 AND prev_win = 0 AND prev2_win = 0 AND prev3_win = 0 AS lost FROM tl WHERE n > 3 AND metric IS NOT NULL),
    c AS (SELECT count(*) AS base_n, count(*) FILTER (metric > 60) AS base_hits, count(*) FILTER (lost) AS n, count(*) FILTER (lost AND metric > 60) AS hits FROM v),
    d AS (SELECT *, base_hits / CAST(base_n AS DOUBLE) AS baseline FROM c)
    SELECT base_n, base_hits, n, hits, {Q.r('baseline')} AS baseline, {Q.r('hits / n')} AS rate, {Q.r('hits / n / baseline')} AS lift, {Q.r(Q.binomial_sf('hits', 'n', 'baseline'))} AS p FROM d""",
)
def _(spark, sf):
    return oc.pity_lift(tl.timeline(spark, sf))


@query(
    "a23_paywall",
    f"""{T}, v AS (SELECT *, lag(win) OVER (PARTITION BY entity ORDER BY ts, event_id) AS bw, CAST(floor(rating_before / 400.0) * 400 AS BIGINT) AS bucket FROM tl),
    w AS (SELECT * FROM v WHERE mode = 'Ladder' AND rating_before <> 0 AND level IS NOT NULL AND bw IS NOT NULL),
    mt AS ({Q.mwu('w', ['bucket'], 'bw', 'level', '1', '0', 'less', 10)}),
    mx AS (SELECT bucket, avg(level) FILTER (bw = 1) - avg(level) FILTER (bw = 0) AS delta FROM w GROUP BY 1)
    SELECT mt.*, {Q.r('delta')} AS delta, {Q.i('p < 0.05 AND delta < -0.1')} AS flagged FROM mt JOIN mx USING (bucket) WHERE n1 + n2 >= 50""",
)
def _(spark, sf):
    return oc.paywall(tl.timeline(spark, sf), exact=False)


@query(
    "a24_rating_at_streaks",
    f"""{T}, l AS (SELECT *, avg(rating_before) OVER f AS h, count(*) OVER f AS hn, lead(1, 2) OVER w IS NOT NULL AS fw, avg(rating_before) OVER g AS rr, max(metric2) OVER g AS mx, min(metric2) OVER g AS mn
      FROM tl WHERE mode = 'Ladder' AND rating_before <> 0 AND metric2 IS NOT NULL
      WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id), f AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), g AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    b AS (SELECT count(*) AS total, count(*) FILTER (rating_before > h) AS above, count(*) FILTER (rating_before < h) AS below,
      count(*) FILTER (fw AND mx < 45) AS bn, count(*) FILTER (fw AND mx < 45 AND rr > h) AS bh, avg(rr - h) FILTER (fw AND mx < 45) AS bd,
      count(*) FILTER (fw AND mn > 55) AS gn, count(*) FILTER (fw AND mn > 55 AND rr < h) AS gh, avg(rr - h) FILTER (fw AND mn > 55) AS gd FROM l WHERE hn >= 10),
    k AS (SELECT 'bad_above' AS kind, bn AS n, bh AS hits, bd AS avg_delta, above / CAST(total AS DOUBLE) AS baseline FROM b UNION ALL SELECT 'good_below', gn, gh, gd, below / CAST(total AS DOUBLE) FROM b)
    SELECT kind, n, hits, {Q.r('avg_delta')} AS avg_delta, {Q.r('baseline')} AS baseline, {Q.r('hits / n')} AS rate, {Q.r('hits / n / baseline')} AS lift, {Q.r(Q.binomial_sf('hits', 'n', 'baseline'))} AS p FROM k""",
)
def _(spark, sf):
    return oc.rating_at_streaks(tl.timeline(spark, sf))


MR = f"{T}, mr AS (SELECT CAST(floor(rating_before / 200.0) * 200 AS BIGINT) AS bucket, metric2 FROM tl WHERE mode = 'Ladder' AND rating_before <> 0 AND metric2 IS NOT NULL)"


@query("a25_p08_meta_ranges", f"{MR} SELECT bucket, count(*) AS n, {Q.r('avg(metric2)')} AS avg, {Q.r('stddev_samp(metric2)')} AS sd FROM mr GROUP BY 1 HAVING count(*) >= 50")
def _(spark, sf):
    return oc.meta_ranges(tl.timeline(spark, sf))[0]


@query("a25_h08_meta_ranges_kruskal", f"{MR} {Q.kruskal('mr', [], 'bucket', 'metric2', 50)}")
def _(spark, sf):
    return oc.meta_ranges(tl.timeline(spark, sf))[1]


@query(
    "a26_climbing_impact",
    f"""{T}, ci AS (SELECT entity, rating_before, 'metric' AS measure, metric AS value FROM tl WHERE mode = 'Ladder' AND rating_before <> 0 UNION ALL SELECT entity, rating_before, 'metric2', metric2 FROM tl WHERE mode = 'Ladder' AND rating_before <> 0
      UNION ALL SELECT entity, rating_before, 'level', level FROM tl WHERE mode = 'Ladder' AND rating_before <> 0), sp AS ({Q.spearman('ci', ['entity', 'measure'], 'rating_before', 'value', 21)})
    SELECT measure, count(*) AS entities, {Q.r('avg(rho)')} AS avg_rho, count(*) FILTER (rho > 0 AND p < 0.05) AS sig_pos, count(*) FILTER (rho < 0 AND p < 0.05) AS sig_neg FROM sp WHERE rho IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    return oc.climbing_impact(tl.timeline(spark, sf))


HK = f"""{T}, hk AS (SELECT *, first_value(rating_before) OVER (PARTITION BY entity, session_no ORDER BY ts, event_id) AS r0 FROM tl), {Q.THRESHOLDS},
hb AS (SELECT *, (SELECT max(lim) FROM thr WHERE lim <= r0) AS band FROM hk WHERE n > 3 AND r0 <> 0)"""
HKS = ", ".join(
    f"{Q.r(f'coalesce(avg({c}) FILTER (pos <= 3), 0) * {m}')} AS hook_{c}, {Q.r(f'coalesce(avg({c}) FILTER (pos > 3), 0) * {m}')} AS rest_{c}"
    for c, m in (("win", 100), ("metric", 1), ("level", 1))
)


@query("a27_hook_by_threshold", f"{HK} SELECT {Q.i('band')} AS band, count(*) FILTER (is_start) AS sessions, {HKS} FROM hb GROUP BY band HAVING count(*) FILTER (is_start) >= 20")
def _(spark, sf):
    return oc.hook_by_threshold(tl.timeline(spark, sf))


@query("a27_hook_by_fixed_width", f"{HK} SELECT CAST(floor(r0 / 1000.0) * 1000 AS BIGINT) AS band, count(*) FILTER (is_start) AS sessions, {HKS} FROM hb GROUP BY 1 HAVING count(*) FILTER (is_start) >= 20")
def _(spark, sf):
    return oc.hook_by_threshold(tl.timeline(spark, sf), width=1000)


SKL = f"""{T}, sl AS (SELECT *, CASE WHEN metric < 45 THEN 'Bad' WHEN metric > 55 THEN 'Good' ELSE 'Even' END AS zone, CASE WHEN leak_for < leak_against THEN 'Better' WHEN leak_for > leak_against THEN 'Worse' ELSE 'Equal' END AS skill FROM tl WHERE metric IS NOT NULL)"""


@query("a28_g09_skill_matrix", f"{SKL} SELECT zone, skill, count(*) AS n, {Q.r('avg(win) * 100')} AS win_pct FROM sl WHERE skill <> 'Equal' GROUP BY 1, 2 HAVING count(*) >= 10")
def _(spark, sf):
    return oc.skill_matrix(tl.timeline(spark, sf))


@query("a28_leak_pressure", f"""{SKL} {Q.mwu('sl', [], 'zone', 'leak_for', "'Bad'", "'Good'", 'greater')}""")
def _(spark, sf):
    return oc.leak_pressure(tl.timeline(spark, sf), exact=False)


DS = f"{T}, ds AS (SELECT level, next_level FROM tl WHERE metric < 45 AND NOT coalesce(prev_metric < 45, FALSE) AND deck = next_deck AND level IS NOT NULL AND next_level IS NOT NULL)"


@query("a30_h10_debt_progression", f"{DS} {Q.wilcoxon('ds', [], 'level', 'next_level', 'two-sided', 20)}")
def _(spark, sf):
    return oc.debt_progression(tl.timeline(spark, sf), exact=False)


@query(
    "a31_j08_residual_after_debt",
    f"""{T}, cv AS (SELECT CAST(floor(rating_before / 200.0) * 200 AS BIGINT) AS b, avg(level) AS expected FROM tl WHERE mode = 'Ladder' AND rating_before <> 0 AND level IS NOT NULL GROUP BY 1 HAVING count(*) >= 50),
    rd AS (SELECT win, round(next_level - expected, 9) AS residual FROM tl JOIN cv ON cv.b = CAST(floor(next_rating_before / 200.0) * 200 AS BIGINT) WHERE metric < 45 AND next_mode = 'Ladder' AND next_rating_before <> 0 AND next_level IS NOT NULL)
    {Q.mwu('rd', [], 'win', 'residual', '1', '0', 'less', 10)}""",
)
def _(spark, sf):
    return oc.residual_after_debt(tl.timeline(spark, sf), exact=False)


WS = f"""{T}, w0 AS (SELECT win, 'metric' AS measure, round(next_metric - metric, 9) AS value FROM tl WHERE metric < 45 AND next_metric IS NOT NULL UNION ALL
SELECT win, 'level', round(next_level - level, 9) FROM tl WHERE metric < 45 AND next_metric IS NOT NULL), ws AS (SELECT * FROM w0 WHERE value IS NOT NULL)"""


@query("a59_worsening_shares", f"{WS} SELECT measure, {Q.i('win')} AS win, count(*) AS n, {Q.r('avg(value)')} AS avg_delta, {Q.r('avg(CASE WHEN value < 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100')} AS worse_pct FROM ws GROUP BY measure, win")
def _(spark, sf):
    return oc.worsening_shares(oc.worsening_rows(tl.timeline(spark, sf)))


@query("a59_worsening_test", f"{WS} {Q.mwu('ws', ['measure'], 'win', 'value', '1', '0', 'less', 10)}")
def _(spark, sf):
    return oc.worsening_test(oc.worsening_rows(tl.timeline(spark, sf)), exact=False)


SP = f"""{T}, s0 AS (SELECT *, sum(2 * win - 1) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS net FROM tl),
sp AS (SELECT *, CASE WHEN net >= 3 THEN 'hot' WHEN net <= -3 THEN 'tilt' END AS temper FROM s0 WHERE pos > 5 AND metric2 IS NOT NULL AND level IS NOT NULL),
sn AS (SELECT * FROM sp WHERE net IN (SELECT net FROM sp GROUP BY 1 HAVING count(*) >= 20))"""


@query("a61_speed_table", f"{SP} SELECT {Q.i('net')} AS net, count(*) AS n, {Q.r('avg(metric2)')} AS avg_metric2, {Q.r('avg(level)')} AS avg_level FROM sn GROUP BY net")
def _(spark, sf):
    return oc.speed_table(oc.speed_rows(tl.timeline(spark, sf)))


@query("a61_speed_correlation", f"{SP} {Q.spearman('sn', [], 'net', 'metric2', 101)}")
def _(spark, sf):
    return oc.speed_correlation(oc.speed_rows(tl.timeline(spark, sf)))


@query("a61_hot_against_tilt", f"""{SP} {Q.mwu('sp', [], 'temper', 'metric2', "'hot'", "'tilt'", 'less')}""")
def _(spark, sf):
    return oc.hot_against_tilt(oc.speed_rows(tl.timeline(spark, sf)), exact=False)


@query(
    "a69_metric_deltas",
    f"""{T}, m AS (SELECT entity, event_id, metric - lag(metric) OVER (PARTITION BY entity ORDER BY ts, event_id) AS d FROM tl WHERE metric IS NOT NULL)
    SELECT entity, event_id, {Q.r('d')} AS delta, CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' ELSE 'same' END AS direction FROM m WHERE d IS NOT NULL""",
)
def _(spark, sf):
    return oc.metric_deltas(tl.timeline(spark, sf))


@query(
    "a70_g22_stop_patterns",
    f"""{T}, p AS (SELECT concat(CASE prev2_win WHEN 1 THEN 'W' WHEN 0 THEN 'L' ELSE '' END, CASE prev_win WHEN 1 THEN 'W' WHEN 0 THEN 'L' ELSE '' END, CASE win WHEN 1 THEN 'W' ELSE 'L' END) AS pattern, stop_type FROM tl WHERE is_last AND stop_type <> 'End')
    SELECT pattern, count(*) FILTER (stop_type = 'Short') AS "Short", count(*) FILTER (stop_type = 'Long') AS "Long", count(*) FILTER (stop_type = 'Quit') AS "Quit" FROM p GROUP BY 1""",
)
def _(spark, sf):
    return oc.stop_patterns(tl.timeline(spark, sf))
