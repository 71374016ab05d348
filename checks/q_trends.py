"""Queries on session halves, time of day, slopes and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import query
from seqtide.functions import scalar as sc
from seqtide.operators import baskets as bs
from seqtide.operators import buckets as bk
from seqtide.plans import timeline as tl
from seqtide.plans import trends as tr
from seqtide.sources import tables

T = f"WITH {Q.tl()}"
TL = f"WITH {Q.tl('Ladder')}"


def _halves() -> str:
    k = "(CASE WHEN n < 8 THEN 2 ELSE 3 END)"
    parts = []
    for c in ("win", "metric", "metric2", "level"):
        parts.append(
            f"SELECT entity, session_no, max(n) AS n, 'ends' AS split, '{c}' AS measure, avg({c}) FILTER (pos <= {k}) AS a, avg({c}) FILTER (n - pos < {k}) AS b FROM tl WHERE n >= 4 "
            f"GROUP BY 1, 2 HAVING count({c}) FILTER (pos <= {k}) = max({k}) AND count({c}) FILTER (n - pos < {k}) = max({k})"
        )
        parts.append(
            f"SELECT entity, session_no, max(n) AS n, 'hook', '{c}', avg({c}) FILTER (pos <= 3), avg({c}) FILTER (pos > 3) FROM tl WHERE n >= 4 "
            f"GROUP BY 1, 2 HAVING count({c}) FILTER (pos <= 3) >= 2 AND count({c}) FILTER (pos > 3) > 0"
        )
    return f"{T}, hv AS ({' UNION ALL '.join(parts)})"


HV = _halves()


@query("a53_session_trends", f"{HV} {Q.wilcoxon('hv', ['split', 'measure'], 'a', 'b', 'greater', 11)}")
def _(spark, sf):
    return tr.session_trends(tr.session_halves(tl.timeline(spark, sf)), exact=False)


@query("a53_length_against_change", f"{HV}, hc AS (SELECT measure, n AS len, round(b - a, 9) AS change FROM hv WHERE split = 'hook') {Q.spearman('hc', ['measure'], 'len', 'change', 5)}")
def _(spark, sf):
    return tr.length_against_change(tr.session_halves(tl.timeline(spark, sf)))


HOUR = f"""{T}, {Q.REGION}, hr AS (SELECT tl.*, region, CAST(((ts + shift_h * 3600) // 3600) % 24 AS BIGINT) AS hour FROM tl JOIN rg ON rg.nation = entity % 25)"""
SLOT = "CASE WHEN hour < 6 THEN 'Night' WHEN hour < 12 THEN 'Morning' WHEN hour < 18 THEN 'Afternoon' ELSE 'Evening' END"
TIME = f"""{HOUR}, tm0 AS (""" + " UNION ALL ".join(
    f"SELECT 'slot' AS axis, '{c}' AS measure, {SLOT} AS grp, {c} AS value FROM hr WHERE {c} IS NOT NULL UNION ALL "
    f"SELECT 'rating', '{c}', CAST(CAST(floor(rating_before / 1000.0) * 1000 AS BIGINT) AS VARCHAR), {c} FROM hr WHERE {c} IS NOT NULL AND rating_before <> 0"
    for c in ("metric", "metric2", "level")
) + """), tm AS (SELECT axis, measure, grp, value FROM (SELECT *, count(*) OVER (PARTITION BY axis, measure, grp) AS gc FROM tm0) WHERE axis = 'slot' OR gc >= 20)"""


def regions(spark, sf):
    ids = tables.events(spark, sf).select("entity").distinct()
    return tables.with_region(ids, spark, sf)


def time_rows(spark, sf):
    return tr.time_rows(tr.with_hour(tl.timeline(spark, sf), regions(spark, sf)))


@query("a56_f06_time_stats", f"{TIME} SELECT axis, measure, grp, count(*) AS n, {Q.r('avg(value)')} AS avg, {Q.r('coalesce(stddev_samp(value), 0)')} AS sd, {Q.r('coalesce(var_samp(value), 0)')} AS variance FROM tm GROUP BY 1, 2, 3")
def _(spark, sf):
    return tr.time_stats(time_rows(spark, sf))


@query("a56_time_kruskal", f"{TIME} {Q.kruskal('tm', ['axis', 'measure'], 'grp', 'value')}")
def _(spark, sf):
    return tr.time_kruskal(time_rows(spark, sf))


@query("a56_h09_time_levene", f"{TIME} {Q.levene('tm', ['axis', 'measure'], 'grp', 'value')}")
def _(spark, sf):
    return tr.time_levene(time_rows(spark, sf))


@query(
    "a68_time_of_day_metric_early_form",
    f"""{HOUR}, tz AS (SELECT {SLOT} AS slot, metric FROM hr WHERE metric IS NOT NULL) SELECT slot, count(*) AS n, {Q.r('avg(metric)')} AS avg, {Q.r('var_samp(metric)')} AS variance FROM tz GROUP BY 1""",
)
def _(spark, sf):
    rows = tr.with_hour(tl.timeline(spark, sf), regions(spark, sf)).filter("metric IS NOT NULL")
    return rows.groupBy(sc.named_slot("hour").alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("metric").alias("avg"), F.var_samp("metric").alias("variance")
    )


@query(
    "a58_metric_against_second",
    f"""{T}, m2 AS (SELECT metric, metric2 FROM tl WHERE mode IN ('Ladder', 'Ranked')) SELECT w.*, s.rho, s.p AS rho_p FROM ({Q.wilcoxon('m2', [], 'metric', 'metric2', 'two-sided')}) w, ({Q.spearman('m2', [], 'metric', 'metric2')}) s""",
)
def _(spark, sf):
    return tr.metric_against_second(tl.timeline(spark, sf), exact=False)


RB = f"""{HOUR}, us AS (SELECT entity, hour, avg(metric2) AS u FROM hr WHERE metric2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
bd AS (SELECT *, lag(is_last AND coalesce(metric < 45 AND prev_metric < 45 AND prev2_metric < 45, FALSE)) OVER w AS after_bad, lag(hour) OVER w AS h_stop,
  avg(rating_before) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS recent FROM hr WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)),
rb AS (SELECT b.entity, event_id, metric, metric2, level, CASE WHEN rating_before <> 0 THEN rating_before - recent END AS rating_excess, u2.u - u1.u AS hour_gain
  FROM bd b LEFT JOIN us u1 ON u1.entity = b.entity AND u1.hour = h_stop LEFT JOIN us u2 ON u2.entity = b.entity AND u2.hour = b.hour WHERE is_start AND after_bad AND metric IS NOT NULL)"""


@query("a60_return_breakdown", f"{RB} SELECT entity, event_id, {Q.r('metric')} AS metric, {Q.r('metric2')} AS metric2, {Q.r('level')} AS level, {Q.r('rating_excess')} AS rating_excess, {Q.r('hour_gain')} AS hour_gain FROM rb")
def _(spark, sf):
    return tr.return_breakdown(tl.timeline(spark, sf), regions(spark, sf))


@query(
    "a60_return_breakdown_summary",
    f"""{RB}, mm AS (SELECT count(*) AS n, avg(rating_excess) AS e, avg(level) FILTER (metric2 IS NOT NULL) AS l, avg(metric2) FILTER (level IS NOT NULL) AS m2, avg(metric) FILTER (level IS NOT NULL AND metric2 IS NOT NULL) AS m FROM rb),
    rx AS (SELECT round(rating_excess, 9) AS x, metric AS y FROM rb)
    SELECT mm.n, {Q.r('e')} AS avg_excess, {Q.r('l')} AS avg_level, {Q.r('m2')} AS avg_metric2, {Q.r('m')} AS avg_metric, s.rho, s.p FROM mm, ({Q.spearman('rx', [], 'x', 'y')}) s""",
)
def _(spark, sf):
    rows = tr.return_breakdown(tl.timeline(spark, sf), regions(spark, sf))
    return tr.return_breakdown_summary(rows.withColumn("rating_excess", F.round("rating_excess", 9)))


@query("a60_return_hour_test", f"""{RB}, rg2 AS (SELECT metric, CASE WHEN hour_gain > 2 THEN 'better' WHEN hour_gain IS NOT NULL THEN 'worse' END AS grp FROM rb) {Q.mwu('rg2', [], 'grp', 'metric', "'better'", "'worse'", 'greater', 2)}""")
def _(spark, sf):
    return tr.return_hour_test(tr.return_breakdown(tl.timeline(spark, sf), regions(spark, sf)), min_n=2, exact=False)


@query(
    "a62_h14_climbing_slopes",
    f"""{T}, cs AS (SELECT CAST(CAST(floor(rating_before / 1000.0) * 1000 AS BIGINT) AS VARCHAR) AS section, rating_before AS x, level AS y FROM tl WHERE mode = 'Ladder' AND rating_before IS NOT NULL AND level IS NOT NULL),
    cu AS (SELECT * FROM cs UNION ALL SELECT 'all', x, y FROM cs), ol AS ({Q.ols_line('cu', ['section'], 'x', 'y', 100)}), ex AS (SELECT section, regr_slope(y, x) * 60 / -0.08::DOUBLE * 100 AS e FROM cu GROUP BY 1)
    SELECT ol.*, {Q.r('e')} AS explained_pct FROM ol JOIN ex USING (section)""",
)
def _(spark, sf):
    return tr.climbing_slopes(tl.timeline(spark, sf))


@query(
    "a63_h15_climbing_zscores",
    f"""{T}, cz AS (SELECT *, CAST(floor(rating_before / 100.0) * 100 AS BIGINT) AS bucket FROM tl WHERE has_next AND mode = 'Ladder' AND rating_before IS NOT NULL),
    sl AS (SELECT regr_slope(metric2, rating_before) AS s FROM cz WHERE metric2 IS NOT NULL),
    ag AS (SELECT bucket, count(*) FILTER (win = 1) AS n_win, count(*) FILTER (win = 0) AS n_loss, avg(next_metric2) FILTER (win = 1) AS mean_win, avg(next_metric2) FILTER (win = 0) AS mean_loss,
      var_samp(next_metric2) FILTER (win = 1) AS vw, var_samp(next_metric2) FILTER (win = 0) AS vl FROM cz WHERE next_metric2 IS NOT NULL GROUP BY 1),
    zz AS (SELECT *, (mean_win - mean_loss - s * 60) / sqrt(vw / n_win + vl / n_loss) AS z FROM ag, sl WHERE n_win >= 20 AND n_loss >= 20)
    SELECT bucket, n_win, n_loss, {Q.r('mean_win')} AS mean_win, {Q.r('mean_loss')} AS mean_loss, {Q.r('z')} AS z, {Q.r('least(1.0, 2 * ' + Q.normal_sf('abs(z)') + ')')} AS p,
      CASE WHEN z < -2 THEN 'lower' WHEN z > 2 THEN 'higher' ELSE 'as expected' END AS verdict FROM zz""",
)
def _(spark, sf):
    return tr.climbing_zscores(tl.timeline(spark, sf))


@query(
    "a44_level_saturation",
    f"""{T} SELECT CAST(floor(rating_before / 500.0) * 500 AS BIGINT) AS bucket, count(*) AS n, {Q.r('avg(level)')} AS avg, {Q.r('var_samp(level)')} AS variance, {Q.r('avg(CASE WHEN level = 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100')} AS zero_pct
    FROM tl WHERE mode = 'Ladder' AND rating_before <> 0 AND level IS NOT NULL GROUP BY 1 HAVING count(*) >= 20""",
)
def _(spark, sf):
    return tr.level_saturation(tl.timeline(spark, sf))


BP = f"""{T}, bp0 AS (SELECT CAST(floor(rating_before / 1000.0) * 1000 AS BIGINT) AS band, level, rating_before FROM tl WHERE mode = 'Ladder' AND rating_before <> 0 AND level IS NOT NULL),
bp1 AS (SELECT band, (rating_before - band) // 100 AS sub, count(*) AS n, avg(level) AS avg FROM bp0 WHERE band IN (SELECT band FROM bp0 GROUP BY 1 HAVING count(*) >= 100) GROUP BY 1, 2 HAVING count(*) >= 10),
bp AS (SELECT *, avg - lag(avg) OVER (PARTITION BY band ORDER BY sub) AS increment, row_number() OVER (PARTITION BY band ORDER BY sub) - 1 AS k FROM bp1),
bq AS (SELECT *, count(increment) OVER (PARTITION BY band) AS steps FROM bp)"""


@query("a41_p09_g18_band_progression", f"{BP} SELECT band, {Q.i('sub')} AS sub, n, {Q.r('avg')} AS avg, {Q.r('increment')} AS increment FROM bp")
def _(spark, sf):
    return tr.band_progression(tl.timeline(spark, sf))


@query(
    "a41_band_slopes",
    f"""{BP}, bz AS (SELECT band, max(steps) AS steps, avg(increment) FILTER (k <= steps // 2) AS f, avg(increment) FILTER (k > steps // 2) AS s FROM bq WHERE increment IS NOT NULL AND steps > 2 GROUP BY 1)
    SELECT band, steps, {Q.r('f')} AS first_slope, {Q.r('s')} AS second_slope, {Q.i('s < f - 0.05')} AS flattening FROM bz""",
)
def _(spark, sf):
    return tr.band_slopes(tr.band_progression(tl.timeline(spark, sf)))


GK = f"""{T}, {Q.THRESHOLDS}, gk AS (SELECT *, (SELECT min(lim) FROM thr WHERE lim > rating_before) AS gate FROM tl WHERE mode = 'Ladder' AND rating_before <> 0)"""


@query(
    "a36_p13_gatekeeping",
    f"""{GK}, gl AS (SELECT 'metric' AS measure, metric AS value, CASE WHEN gate - rating_before <= 150 THEN 'danger' ELSE 'safe' END AS grp FROM gk WHERE gate IS NOT NULL UNION ALL
      SELECT 'level', level, CASE WHEN gate - rating_before <= 150 THEN 'danger' ELSE 'safe' END FROM gk WHERE gate IS NOT NULL UNION ALL SELECT 'metric2', metric2, CASE WHEN gate - rating_before <= 150 THEN 'danger' ELSE 'safe' END FROM gk WHERE gate IS NOT NULL)
    {Q.mwu('gl', ['measure'], 'grp', 'value', "'danger'", "'safe'", 'less', 10)}""",
)
def _(spark, sf):
    return tr.gatekeeping(tl.timeline(spark, sf), exact=False)


@query(
    "j06_asof_thresholds",
    f"{GK} SELECT entity, event_id, {Q.i('gate')} AS next_gate, (SELECT {Q.i('max(lim)')} FROM thr WHERE lim <= rating_before) AS last_gate, {Q.i('coalesce(gate, 11500) - rating_before')} AS distance FROM gk",
)
def _(spark, sf):
    rows = tl.timeline(spark, sf).df.filter("mode = 'Ladder' AND rating_before <> 0")
    return rows.select(
        "entity", "event_id", bk.next_threshold("rating_before").alias("next_gate"), bk.last_threshold("rating_before").alias("last_gate"),
        (bk.next_or_last_threshold("rating_before") - F.col("rating_before")).alias("distance"),
    )


@query(
    "j06_asof_large_table",
    "SELECT o_orderkey, CAST(l.s_acctbal AS DOUBLE) AS last_mark FROM orders o ASOF LEFT JOIN (SELECT DISTINCT s_acctbal FROM supplier) l ON o.o_totalprice / 20 >= l.s_acctbal",
)
def _(spark, sf):
    left = tables.read(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 20).alias("v"))
    marks = tables.read(spark, sf, "supplier").select("s_acctbal")
    return bk.asof_threshold(left, "v", marks, "s_acctbal", "last", "last_mark").select("o_orderkey", "last_mark")


@query(
    "j06_asof_next",
    f"{GK} SELECT entity, event_id, CAST((SELECT min(s_acctbal) FROM supplier WHERE s_acctbal > rating_before) AS DOUBLE) AS next_mark FROM gk",
)
def _(spark, sf):
    rows = tl.timeline(spark, sf).df.filter("mode = 'Ladder' AND rating_before <> 0")
    marks = tables.read(spark, sf, "supplier").select("s_acctbal")
    return bk.asof_threshold(rows, "rating_before", marks, "s_acctbal", "next", "next_mark").select("entity", "event_id", "next_mark")


@query(
    "j07_threshold_band",
    f"{T}, {Q.THRESHOLDS} SELECT entity, event_id, {Q.i('lim')} AS threshold FROM tl JOIN thr ON rating_before - lim BETWEEN -150 AND 150 WHERE mode = 'Ladder'",
)
def _(spark, sf):
    rows = tl.timeline(spark, sf).df.filter("mode = 'Ladder'")
    return bk.threshold_band(rows, "rating_before", -150, 150).select("entity", "event_id", "threshold")


OL = f"""{TL}, {Q.ITEMS}, bl AS (SELECT deck AS opp_deck, avg(level) AS opp_level FROM deck_items GROUP BY 1), {Q.THRESHOLDS},
ol0 AS (SELECT *, CAST(floor(rating_before / 100.0) * 100 AS BIGINT) AS b FROM tl JOIN bl USING (opp_deck) WHERE rating_before IS NOT NULL AND opp_level > 0),
oe AS (SELECT b, avg(opp_level) AS expected FROM ol0 GROUP BY 1 HAVING count(*) >= 5),
ol AS (SELECT *, round(opp_level - expected, 9) AS residual, (SELECT min(lim) FROM thr WHERE lim > rating_before) - rating_before AS dist FROM ol0 JOIN oe USING (b)),
og AS (SELECT *, CASE WHEN dist <= 50 THEN 'danger' WHEN dist <= 100 THEN 'control' END AS zone FROM ol)"""


def opp_rows(spark, sf):
    levels = bs.basket_levels(tables.deck_items(spark, sf))
    rows = tr.opponent_level_rows(tl.timeline(spark, sf, "Ladder"), levels)
    return rows.withColumn("residual", F.round("residual", 9))


@query(
    "a37_symmetric_gatekeeping",
    f"""{OL}, mt AS ({Q.mwu('og', [], 'zone', 'residual', "'danger'", "'control'", 'greater')}), dl AS (SELECT avg(residual) FILTER (zone = 'danger') - avg(residual) FILTER (zone = 'control') AS d FROM og)
    SELECT mt.*, {Q.r('d')} AS delta, {Q.r('d - 0.0485')} AS excess_growth FROM mt, dl""",
)
def _(spark, sf):
    return tr.symmetric_gatekeeping(opp_rows(spark, sf), exact=False)


@query(
    "a40_opponent_level_curve",
    f"{OL}, oc AS (SELECT b, count(*) AS n, avg(opp_level) AS a FROM ol GROUP BY 1 HAVING count(*) >= 10) SELECT b, n, {Q.r('a')} AS avg, {Q.r('a - lag(a) OVER (ORDER BY b)')} AS increment FROM oc",
)
def _(spark, sf):
    return tr.opponent_level_curve(opp_rows(spark, sf))


@query(
    "g18_adjacent_increments_only",
    f"""{OL}, oc AS (SELECT b, avg(opp_level) AS a FROM ol GROUP BY 1), st AS (SELECT b, a, a - lag(a) OVER (ORDER BY b) AS d, b - lag(b) OVER (ORDER BY b) AS w FROM oc)
    SELECT count(*) AS steps, {Q.r('avg(d)')} AS avg_increase FROM st WHERE w = 100""",
)
def _(spark, sf):
    curve = opp_rows(spark, sf).groupBy("b").agg(F.avg("opp_level").alias("avg"))
    steps = bk.increments(curve, "b", "avg", width=100).filter("increment IS NOT NULL")
    return steps.agg(F.count(F.lit(1)).alias("steps"), F.avg("increment").alias("avg_increase"))


GZ = f"""{T}, {Q.THRESHOLDS}, us AS (SELECT entity, avg(metric2) AS usual FROM tl WHERE metric2 IS NOT NULL GROUP BY 1),
la AS (SELECT *, coalesce(lag(deck) OVER (PARTITION BY entity ORDER BY ts, event_id) <> deck, FALSE) AS switch FROM tl WHERE mode = 'Ladder' AND rating_before <> 0 AND metric2 IS NOT NULL),
gz0 AS (SELECT la.*, lim AS threshold, rating_before - lim AS d, usual - metric2 AS hostility FROM la JOIN thr ON lim > 0 AND rating_before - lim BETWEEN -150 AND 150 JOIN us USING (entity)),
gz AS (SELECT *, CASE WHEN d < -75 THEN 'pre_stable' WHEN d < 0 THEN 'pre_early' WHEN d < 75 THEN 'post_early' ELSE 'post_stable' END AS zone FROM gz0),
ga AS (SELECT threshold, zone, count(*) AS n, avg(metric2) AS m, avg(hostility) AS h, avg(CASE WHEN switch THEN 1.0::DOUBLE ELSE 0.0 END) * 100 AS s FROM gz GROUP BY 1, 2),
gf AS (SELECT threshold FROM ga WHERE n >= 10 GROUP BY 1 HAVING count(*) = 4)"""


@query("a38_w20_gate_zones", f"{GZ} SELECT {Q.i('threshold')} AS threshold, zone, n, {Q.r('m')} AS avg_metric2, {Q.r('h')} AS hostility, {Q.r('s')} AS switch_pct FROM ga WHERE threshold IN (SELECT threshold FROM gf)")
def _(spark, sf):
    return tr.gate_zones(tr.gate_rows(tl.timeline(spark, sf)))


@query(
    "a38_w21_gate_attempts",
    f"""{GZ}, nz AS (SELECT *, (SELECT min(lim) FROM thr WHERE lim > rating_before) AS g0 FROM la), ng AS (SELECT *, CASE WHEN g0 - rating_before <= 75 THEN g0 END AS gate FROM nz),
    nl AS (SELECT *, CASE WHEN gate IS NOT NULL AND lag(gate) OVER (PARTITION BY entity ORDER BY ts, event_id) IS DISTINCT FROM gate THEN 1 ELSE 0 END AS entry FROM ng),
    na AS (SELECT *, sum(entry) OVER (PARTITION BY entity, gate ORDER BY ts, event_id) AS att FROM nl WHERE gate IS NOT NULL),
    nb AS (SELECT gate AS threshold, CASE WHEN att >= 4 THEN '4+' ELSE CAST(CAST(att AS BIGINT) AS VARCHAR) END AS attempt, count(*) AS n, avg(usual - metric2) AS h FROM na JOIN us USING (entity) GROUP BY 1, 2)
    SELECT {Q.i('threshold')} AS threshold, attempt, n, {Q.r('h')} AS hostility FROM nb WHERE threshold IN (SELECT threshold FROM nb WHERE attempt = '1' AND n >= 10)""",
)
def _(spark, sf):
    return tr.gate_attempts(tl.timeline(spark, sf))
