"""Timeline, session, profile and odds queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import query
from seqtide.operators import hypothesis as hy
from seqtide.operators import sequence as sq
from seqtide.operators.ordered import ordered
from seqtide.plans import profiles as pr
from seqtide.plans import timeline as tl
from seqtide.sources import tables

SESSION_COLS = ["entity", "event_id", "ts", "session_no", "pos", "n", "break_s", "stop_type"]


@query("w01_sessionize", f"WITH {Q.tl()} SELECT entity, event_id, ts, session_no, pos, n, {Q.i('break_s')} AS break_s, stop_type FROM tl")
def _(spark, sf):
    return tl.timeline(spark, sf).df.select(*SESSION_COLS)


@query(
    "w01_sessionize_after_mode_filter",
    f"WITH {Q.tl('Ladder_Ranked')} SELECT entity, event_id, session_no, pos, n, {Q.i('break_s')} AS break_s, stop_type, rating_before FROM tl",
)
def _(spark, sf):
    return tl.timeline(spark, sf, "Ladder_Ranked").df.select(
        "entity", "event_id", "session_no", "pos", "n", "break_s", "stop_type", "rating_before"
    )


@query(
    "w02_breaks_and_stop_tiers",
    f"WITH {Q.tl()} SELECT stop_type, count(*) AS sessions, {Q.r('avg(break_s)')} AS avg_break_s, {Q.i('max(break_s)')} AS max_break_s FROM tl WHERE is_last GROUP BY 1",
)
def _(spark, sf):
    return tl.timeline(spark, sf).df.filter("is_last").groupBy("stop_type").agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("break_s").alias("avg_break_s"), F.max("break_s").alias("max_break_s")
    )


@query(
    "w03_rating_reconstruction",
    f"WITH {Q.tl()} SELECT entity, event_id, {Q.i('rating_before')} AS rating_before, {Q.i('rating_after')} AS rating_after, {Q.i('variation')} AS variation FROM tl WHERE mode = 'Ladder'",
)
def _(spark, sf):
    seq = tl.rated(ordered(tables.events(spark, sf), "entity", ["ts", "event_id"]))
    return seq.df.filter("mode = 'Ladder'").select("entity", "event_id", "rating_before", "rating_after", "variation")


@query(
    "w04_next_in_session_and_across",
    f"""WITH {Q.tl()} SELECT entity, event_id, {Q.r('next_metric')} AS next_metric, {Q.i('next_win')} AS next_win, {Q.i('has_next')} AS has_next,
    {Q.r('lag(metric) OVER (PARTITION BY entity ORDER BY ts, event_id)')} AS before_metric FROM tl""",
)
def _(spark, sf):
    seq = tl.with_next(tl.timeline(spark, sf), ["metric", "win"])
    seq = seq.near({"before_metric": lambda w: F.lag("metric").over(w)}, back=1)
    return seq.df.select("entity", "event_id", "next_metric", "next_win", "has_next", "before_metric")


@query(
    "w05_positions_and_slices",
    f"""WITH {Q.tl()}, f AS (SELECT entity, session_no, lead(metric) OVER (PARTITION BY entity ORDER BY session_no) AS m, metric FROM tl WHERE is_start)
    SELECT t.entity, t.session_no, count(*) FILTER (pos <= 3) AS head_n, count(*) FILTER (n - pos < 2) AS last2_n, {Q.i('max(n - pos)')} AS max_remaining,
    {Q.r('avg(t.metric) FILTER (pos > 3)')} AS tail_metric, {Q.r('max(f.m)')} AS next_first_metric
    FROM tl t JOIN f USING (entity, session_no) GROUP BY 1, 2""",
)
def _(spark, sf):
    seq = tl.timeline(spark, sf)
    rows = seq.df.groupBy("entity", "session_no").agg(
        F.count_if(F.col("pos") <= 3).alias("head_n"),
        F.count_if(F.col("n") - F.col("pos") < 2).alias("last2_n"),
        F.max(F.col("n") - F.col("pos")).alias("max_remaining"),
        F.avg(F.when(F.col("pos") > 3, F.col("metric"))).alias("tail_metric"),
        F.max(F.when(F.col("is_start"), F.struct("session_no", "metric"))).alias("first"),
    )
    nxt = ordered(rows, "entity", "session_no", slab=1e5).near({"nf": lambda w: F.lead("first").over(w)}, ahead=1)
    return nxt.df.select(
        "entity", "session_no", "head_n", "last2_n", "max_remaining", "tail_metric", F.col("nf.metric").alias("next_first_metric")
    )


STREAK_COLS = "entity, event_id, win_streak, loss_streak, streak_before, counter_streak"


@query("w06_streaks", f"WITH {Q.tl()}, {Q.streaks()} SELECT entity, event_id, {Q.i('win_streak')} AS win_streak, {Q.i('loss_streak')} AS loss_streak, {Q.i('streak_before')} AS streak_before, {Q.i('counter_streak')} AS counter_streak FROM sk")
def _(spark, sf):
    return sq.counter_streak(sq.streaks(tl.timeline(spark, sf))).df.select(
        "entity", "event_id", "win_streak", "loss_streak", "streak_before", "counter_streak"
    )


@query("w07_accumulated_stress", f"WITH {Q.tl()}, {Q.streaks()} SELECT entity, event_id, {Q.r('stress_before')} AS stress_before, {Q.r('stress_after')} AS stress_after FROM sk")
def _(spark, sf):
    return tl.with_stress(tl.timeline(spark, sf)).df.select("entity", "event_id", "stress_before", "stress_after")


@query(
    "w08_windows_all_of_three",
    f"""WITH {Q.tl()}, w AS (SELECT *, lead(1, 2) OVER sw IS NOT NULL AS is_window, min(CASE WHEN metric > 60 THEN 1 ELSE 0 END) OVER (sw ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS hi,
    min(CASE WHEN metric < 40 THEN 1 ELSE 0 END) OVER (sw ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS lo FROM tl WINDOW sw AS (PARTITION BY entity, session_no ORDER BY ts, event_id))
    SELECT entity, count(*) FILTER (is_window) AS windows, count(*) FILTER (is_window AND hi = 1) AS high_hits, count(*) FILTER (is_window AND lo = 1) AS low_hits FROM w GROUP BY 1""",
)
def _(spark, sf):
    seq = sq.ngrams(tl.timeline(spark, sf), {"hi": F.col("metric") > 60, "lo": F.col("metric") < 40}, 3)
    return seq.df.groupBy("entity").agg(
        F.count_if("is_window").alias("windows"), F.count_if("hi_all").alias("high_hits"), F.count_if("lo_all").alias("low_hits")
    )


@query(
    "w09_last_three_condition",
    f"""WITH {Q.tl()} SELECT entity, event_id, CAST(has_prev3 AND prev_win = 0 AND prev2_win = 0 AND prev3_win = 0 AS BIGINT) AS after_losses,
    CAST(has_prev3 AND prev_win = 1 AND prev2_win = 1 AND prev3_win = 1 AS BIGINT) AS after_wins FROM tl WHERE pos > 3""",
)
def _(spark, sf):
    seq = sq.last_n_all(tl.timeline(spark, sf), {"after_losses": F.col("win") == 0, "after_wins": F.col("win") == 1}, 3)
    return seq.df.filter("pos > 3").select("entity", "event_id", "after_losses", "after_wins")


ZONED = f"""WITH {Q.tl()}, z AS (SELECT *, CASE WHEN metric < 45 THEN 'Debt' WHEN metric > 55 THEN 'Credit' ELSE 'Normal' END AS state FROM tl WHERE metric IS NOT NULL AND level IS NOT NULL),
z1 AS (SELECT *, CASE WHEN lag(state) OVER sw IS DISTINCT FROM state THEN 1 ELSE 0 END AS new FROM z WINDOW sw AS (PARTITION BY entity, session_no ORDER BY ts, event_id)),
z2 AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts, event_id) AS run FROM z1)"""


@query(
    "w10_run_length_episodes",
    f"{ZONED} SELECT entity, session_no, {Q.i('run')} AS run_no, max(state) AS state, count(*) AS length, min(ts) AS first_ts, {Q.r('avg(level)')} AS avg_level FROM z2 GROUP BY entity, session_no, run",
)
def _(spark, sf):
    seq = tl.timeline(spark, sf)
    state = F.when(F.col("metric") < 45, "Debt").when(F.col("metric") > 55, "Credit").otherwise("Normal")
    valid = seq.filter("metric IS NOT NULL AND level IS NOT NULL").with_columns({"state": state})
    return sq.episodes(valid, "state", measures={"avg_level": F.avg("level")}).select(
        "entity", "session_no", "run_no", "state", "length", "first_ts", "avg_level"
    )


@query(
    "w11_start_of_episode",
    f"WITH {Q.tl()} SELECT entity, event_id FROM tl WHERE metric < 45 AND (prev_metric IS NULL OR prev_metric >= 45)",
)
def _(spark, sf):
    seq = tl.with_prev(tl.timeline(spark, sf), ["metric"])
    return seq.df.filter("metric < 45 AND (prev_metric IS NULL OR prev_metric >= 45)").select("entity", "event_id")


LOSS_RUNS = f"""WITH {Q.tl('Ladder')}, l AS (SELECT *, CASE WHEN lag(win) OVER w IS DISTINCT FROM win THEN 1 ELSE 0 END AS new FROM tl WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)),
l2 AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts, event_id) AS run FROM l),
lr AS (SELECT entity, run, max(win) AS win, count(*) AS length, min_by(rating_before, struct_pack(a := ts, b := event_id)) AS start_rating FROM l2 GROUP BY 1, 2)"""


@query(
    "w12_loss_streak_start_value",
    f"{LOSS_RUNS} SELECT entity, {Q.i('run')} AS run_no, length, {Q.i('start_rating')} AS start_rating FROM lr WHERE win = 0 AND length >= 3",
)
def _(spark, sf):
    seq = tl.timeline(spark, sf, "Ladder")
    runs = sq.episodes(
        seq, "win", group=None, measures={"start_rating": F.min_by("rating_before", F.struct("ts", "event_id"))}
    )
    return runs.filter("win = 0 AND length >= 3").select("entity", "run_no", "length", "start_rating")


@query(
    "w13_rolling_mean_with_minimum",
    f"""WITH {Q.tl()} SELECT entity, event_id, {Q.r('CASE WHEN count(metric2) OVER f >= 10 THEN avg(metric2) OVER f END')} AS mean20,
    {Q.r('CASE WHEN count(metric2) OVER g >= 10 THEN avg(metric2) OVER g END')} AS mean50
    FROM tl WINDOW f AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), g AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""",
)
def _(spark, sf):
    seq = tl.timeline(spark, sf)
    seq = sq.rolling_mean(sq.rolling_mean(seq, "metric2", "mean20", 20, 10), "metric2", "mean50", 50, 10)
    return seq.df.select("entity", "event_id", "mean20", "mean50")


@query(
    "w14_rolling_win_rate_and_net_wins",
    f"""WITH {Q.tl()} SELECT entity, event_id, {Q.r('coalesce(avg(win) OVER f, 0.5)')} AS recent_rate, {Q.i('coalesce(sum(2 * win - 1) OVER f, 0)')} AS net5,
    {Q.r('avg(win) OVER g')} AS rate100
    FROM tl WINDOW f AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), g AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)""",
)
def _(spark, sf):
    seq = tl.timeline(spark, sf).near(
        {
            "recent_rate": lambda w: F.coalesce(F.avg("win").over(w.rowsBetween(-5, -1)), F.lit(0.5)),
            "net5": lambda w: F.coalesce(F.sum(2 * F.col("win") - 1).over(w.rowsBetween(-5, -1)), F.lit(0)),
            "rate100": lambda w: F.avg("win").over(w.rowsBetween(-100, -1)),
        },
        back=100,
    )
    return seq.df.select("entity", "event_id", "recent_rate", "net5", "rate100")


@query(
    "w18_running_best",
    f"""WITH {Q.tl('Ladder')} SELECT entity, event_id, {Q.i('max(rating_before) OVER w')} AS best, {Q.i('max(rating_before) OVER w - rating_before')} AS below_best
    FROM tl WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)""",
)
def _(spark, sf):
    seq = sq.running_best(tl.timeline(spark, sf, "Ladder"), "rating_before")
    return seq.df.select("entity", "event_id", "best", (F.col("best") - F.col("rating_before")).alias("below_best"))


@query(
    "w22_time_and_events_so_far",
    f"""WITH {Q.tl()} SELECT entity, event_id, {Q.i('coalesce(prev_gap, 0)')} AS since_prev, {Q.i('ts - min(ts) OVER (PARTITION BY entity, session_no)')} AS session_s, pos - 1 AS before_in_session FROM tl""",
)
def _(spark, sf):
    seq = tl.timeline(spark, sf)
    # The session start time: latest start so far.
    seq = seq.running({"t0": ("max", F.when(F.col("is_start"), F.col("ts")))})
    return seq.df.select(
        "entity", "event_id", F.coalesce("prev_gap", F.lit(0)).alias("since_prev"), (F.col("ts") - F.col("t0")).alias("session_s"),
        (F.col("pos") - 1).alias("before_in_session"),
    )


SM_COLS = ("avg_metric", "avg_metric2", "sd_metric", "sd_metric2", "avg_level", "win_rate", "loss_rate", "win_when_low", "loss_when_high")
SM_SELECT = (
    "entity, session_no, events, first_ts, last_ts, CAST(break_s AS BIGINT) AS break_s, stop_type, n_valid, n_extreme, "
    + ", ".join(f"{Q.r(c)} AS {c}" for c in SM_COLS)
)


@query("g01_session_summary", f"WITH {Q.tl()}, {Q.sessions()} SELECT {SM_SELECT} FROM sm")
def _(spark, sf):
    return pr.session_summary(tl.timeline(spark, sf))


@query(
    "g02_global_session_means",
    f"WITH {Q.tl()}, {Q.sessions()} SELECT count(*) AS sessions, " + ", ".join(f"{Q.r(f'avg({c})')} AS {c}" for c in pr.GLOBAL_METRICS) + " FROM sm",
)
def _(spark, sf):
    return pr.global_summary(pr.session_summary(tl.timeline(spark, sf)))


PF_LONG = ("total_events", "sessions", "l_streak_count", "max_loss_streak_tolerated", "counter_streak_continuations", "is_reliable")
PF_DOUBLE = (
    "fsi", "impulsivity", "ers", "avg_session_min", "events_per_session", "win_continuation_pct", "loss_continuation_pct",
    "win_pct", "avg_metric", "avg_metric2", "avg_level",
)
PF_SELECT = "entity, " + ", ".join([*(f"{Q.i(c)} AS {c}" for c in PF_LONG), *(f"{Q.r(c)} AS {c}" for c in PF_DOUBLE)])
PF = f"{Q.tl()}, {Q.streaks()}, {Q.profile()}"


@query("g03_behaviour_profile", f"WITH {PF} SELECT {PF_SELECT} FROM pf")
def _(spark, sf):
    return pr.behaviour_profile(pr.with_state(tl.timeline(spark, sf)))


@query("a01_reliable_profiles", f"WITH {PF} SELECT {PF_SELECT} FROM pf WHERE is_reliable")
def _(spark, sf):
    seq = pr.with_state(pr.reliable(tl.timeline(spark, sf)))
    return pr.behaviour_profile(seq)


@query(
    "g04_earlier_profile",
    f"""WITH {Q.EV}, g AS (SELECT *, ts - lag(ts) OVER w AS prev_gap, lead(ts) OVER w - ts AS next_gap, row_number() OVER w AS rn,
      sum(win) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS w3, count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r3
      FROM ev WHERE mode <> 'Other' WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)),
    s AS (SELECT *, (prev_gap IS NULL OR prev_gap > 43200) AS is_start, (next_gap IS NULL OR next_gap > 43200) AS is_last,
      sum(CASE WHEN prev_gap IS NULL OR prev_gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts, event_id) AS session_no FROM g),
    t AS (SELECT *, rn - max(CASE WHEN win = 1 THEN rn WHEN is_start THEN rn - 1 END) OVER (PARTITION BY entity, session_no ORDER BY ts, event_id) AS loss_streak FROM s),
    p AS (SELECT entity, session_no, count(*) AS n, max(ts) - min(ts) AS dur, sum(metric) AS ms, count(metric) AS mn, sum(level) AS ls, count(level) AS ln,
      max(CASE WHEN is_last THEN CASE WHEN win = 0 THEN (1 + 0.5::DOUBLE * loss_streak) * CASE WHEN metric < 45 THEN 1.4::DOUBLE ELSE 1.0 END ELSE 0.0 END END) AS score,
      count(*) FILTER (r3 = 3 AND w3 = 0) AS l3, count(*) FILTER (r3 = 3 AND w3 = 3) AS w3 FROM t GROUP BY 1, 2)
    SELECT entity, {Q.i('sum(n)')} AS total_events, count(*) AS sessions, {Q.rd('avg(score)', 3)} AS fsi,
      {Q.rd('coalesce(avg(dur / 60.0::DOUBLE) FILTER (dur > 0), 0)', 2)} AS avg_session_min, {Q.rd('sum(n)::DOUBLE / count(*)', 2)} AS events_per_session,
      {Q.i('sum(l3)')} AS loss_streaks, {Q.i('sum(w3)')} AS win_streaks, {Q.rd('coalesce(sum(ms) / nullif(sum(mn), 0), 50)', 2)} AS avg_metric,
      {Q.rd('coalesce(sum(ls) / nullif(sum(ln), 0), 0)', 2)} AS avg_level, CAST(sum(n) > 100 AND sum(n)::DOUBLE / count(*) > 3 AS BIGINT) AS is_reliable
    FROM p GROUP BY entity""",
)
def _(spark, sf):
    seq = ordered(tables.events(spark, sf).filter("mode <> 'Other'"), "entity", ["ts", "event_id"])
    return pr.old_profile(sq.sessionize(seq, "ts", 43200, 86400, 172800, split_at_equal=False))


def profile(spark, sf, mode="all"):
    return pr.behaviour_profile(pr.with_state(tl.timeline(spark, sf, mode)))


ODDS = """od AS (
  SELECT entity, kind, a, b, c, d, CASE WHEN b * c <> 0 THEN a * d / CAST(b * c AS DOUBLE) WHEN a * d <> 0 THEN CAST('inf' AS DOUBLE) END AS odds FROM (
    SELECT entity, unnest(['pity', 'punish']) AS kind, unnest([pa, ua]) AS a, unnest([pb, ub]) AS b, unnest([pc, uc]) AS c, unnest([pd, ud]) AS d FROM (
      SELECT entity, count(*) FILTER (l3 AND metric > 60) AS pa, count(*) FILTER (l3 AND metric <= 60) AS pb, count(*) FILTER (NOT l3 AND metric > 60) AS pc,
        count(*) FILTER (NOT l3 AND metric <= 60) AS pd, count(*) FILTER (w3 AND metric < 40) AS ua, count(*) FILTER (w3 AND metric >= 40) AS ub,
        count(*) FILTER (NOT w3 AND metric < 40) AS uc, count(*) FILTER (NOT w3 AND metric >= 40) AS ud
      FROM (SELECT *, prev_win = 0 AND prev2_win = 0 AND prev3_win = 0 AS l3, prev_win = 1 AND prev2_win = 1 AND prev3_win = 1 AS w3 FROM tl WHERE pos > 3 AND metric IS NOT NULL)
      GROUP BY entity)))"""


def with_class(df):
    return df.withColumn(
        "odds_class", F.when(F.isnan("odds"), "nan").when(F.col("odds") == float("inf"), "inf").otherwise("finite")
    ).withColumn("odds", F.when(F.col("odds_class") == "finite", F.col("odds")))


CLASSED = f"CASE WHEN odds IS NULL THEN 'nan' WHEN isinf(odds) THEN 'inf' ELSE 'finite' END AS odds_class, {Q.r('CASE WHEN NOT isinf(odds) THEN odds END')} AS odds"


@query(
    "a32_streak_odds_fisher",
    f"WITH {Q.tl()}, {ODDS} SELECT entity, kind, a, b, c, d, {CLASSED}, {Q.r(Q.fisher_sf('a', 'b', 'c', 'd'))} AS p FROM od",
)
def _(spark, sf):
    return with_class(pr.streak_odds(tl.timeline(spark, sf)))


PITY = f"""WITH {Q.tl()}, {Q.sessions()}, pr AS (SELECT *, lead(n_valid) OVER w AS n2, lead(avg_metric) OVER w AS m2 FROM sm WINDOW w AS (PARTITION BY entity ORDER BY session_no)),
pp AS (SELECT entity, count(*) AS pairs, count(*) FILTER (avg_metric < 45 AND m2 > 55) AS a, count(*) FILTER (avg_metric < 45 AND NOT m2 > 55) AS b,
  count(*) FILTER (NOT avg_metric < 45 AND m2 > 55) AS c, count(*) FILTER (NOT avg_metric < 45 AND NOT m2 > 55) AS d FROM pr WHERE n_valid >= 2 AND n2 >= 2 GROUP BY 1),
ps AS (SELECT *, {Q.fisher_sf('a', 'b', 'c', 'd')} AS p, CASE WHEN b * c <> 0 THEN a * d / CAST(b * c AS DOUBLE) WHEN a * d <> 0 THEN CAST('inf' AS DOUBLE) END AS odds FROM pp WHERE pairs >= 2)"""


@query("a02_session_pity", f"{PITY} SELECT entity, pairs, a, b, c, d, {CLASSED}, {Q.r('p')} AS p, CAST(p < 0.05 AS BIGINT) AS significant FROM ps")
def _(spark, sf):
    return with_class(pr.session_pity(tl.timeline(spark, sf)))


@query(
    "a02_session_pity_share",
    f"{PITY} SELECT count(*) AS tested, count(*) FILTER (p < 0.05) AS significant, {Q.r('count(*) FILTER (p < 0.05) * 100.0 / count(*)')} AS pct FROM ps",
)
def _(spark, sf):
    return pr.significant_share(pr.session_pity(tl.timeline(spark, sf)))


SPREAD = f"""{PF}, {Q.sessions()}, sd AS (SELECT entity, count(*) AS sessions, stddev_samp(avg_metric) AS sd FROM sm WHERE events >= 3 GROUP BY 1 HAVING count(*) >= 3),
sf AS (SELECT sd.entity, sd.sessions, sd, sd * sd AS variance, fsi FROM sd JOIN pf USING (entity))"""


def spread(spark, sf):
    seq = tl.timeline(spark, sf)
    return pr.spread_of_sessions(seq, pr.behaviour_profile(pr.with_state(seq)))


@query("a03_std_of_sessions", f"WITH {SPREAD} SELECT entity, sessions, {Q.r('sd')} AS sd, {Q.r('fsi')} AS fsi, {Q.r('variance')} AS variance FROM sf")
def _(spark, sf):
    return spread(spark, sf)


@query(
    "a03_h18_variance_ratio",
    f"""WITH {SPREAD}, q AS (SELECT count(*) FILTER (fsi < 0.81) AS n_low, count(*) FILTER (fsi > 1.20) AS n_high, coalesce(avg(variance) FILTER (fsi < 0.81), 0) AS var_low,
    coalesce(avg(variance) FILTER (fsi > 1.20), 0) AS var_high FROM sf) SELECT n_low, n_high, {Q.r('var_low')} AS var_low, {Q.r('var_high')} AS var_high,
    {Q.r('CASE WHEN var_low > 0 THEN var_high / var_low END')} AS ratio FROM q""",
)
def _(spark, sf):
    return pr.variance_ratio(spread(spark, sf))


@query("a03_fsi_variance_correlation", f"WITH {SPREAD} {Q.spearman('sf', [], 'fsi', 'variance', 3)}")
def _(spark, sf):
    return hy.spearman(spread(spark, sf), [], "fsi", "variance", 3)


OP = f"WITH {PF}, {ODDS}"
HALVES = """pj AS (SELECT od.entity, odds, ers, total_events FROM od JOIN pf USING (entity) WHERE kind = 'pity' AND odds IS NOT NULL AND NOT isinf(odds)),
hv AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ers, entity) <= floor(count(*) OVER () / 2) THEN 'low' ELSE 'high' END AS half FROM pj)"""


def odds_and_profile(spark, sf):
    seq = tl.timeline(spark, sf)
    return seq, pr.streak_odds(seq), pr.behaviour_profile(pr.with_state(seq))


@query(
    "a05_pity_by_ers_half",
    f"""{OP}, {HALVES}, rk AS (SELECT rank() OVER (ORDER BY ers) + (count(*) OVER (PARTITION BY ers) - 1) / 2.0 AS rx, rank() OVER (ORDER BY odds) + (count(*) OVER (PARTITION BY odds) - 1) / 2.0 AS ry,
    rank() OVER (ORDER BY total_events) + (count(*) OVER (PARTITION BY total_events) - 1) / 2.0 AS rz FROM pj),
    cc AS (SELECT count(*) AS n, corr(rx, ry) AS r_xy, corr(rx, rz) AS r_xz, corr(ry, rz) AS r_yz FROM rk),
    mw AS ({Q.mwu('hv', [], 'half', 'odds', "'high'", "'low'", 'greater')})
    SELECT mw.*, cc.n, {Q.r('r_xy')} AS r_xy, {Q.r('r_xz')} AS r_xz, {Q.r('r_yz')} AS r_yz,
    {Q.r('(r_xy - r_xz * r_yz) / sqrt((1 - r_xz * r_xz) * (1 - r_yz * r_yz))')} AS r_partial FROM mw, cc WHERE cc.n >= 4""",
)
def _(spark, sf):
    _, odds, profile_ = odds_and_profile(spark, sf)
    return pr.pity_by_ers(odds, profile_, exact=False)


@query(
    "g19_median_split",
    f"{OP}, {HALVES} SELECT half, count(*) AS n, {Q.r('min(ers)')} AS min_ers, {Q.r('max(ers)')} AS max_ers, {Q.r('avg(odds)')} AS avg_odds FROM hv GROUP BY 1",
)
def _(spark, sf):
    _, odds, profile_ = odds_and_profile(spark, sf)
    joined = odds.filter((F.col("kind") == "pity") & pr.is_finite("odds")).join(profile_.select("entity", "ers"), "entity")
    return pr.median_split(joined, "ers", "entity").groupBy("half").agg(
        F.count(F.lit(1)).alias("n"), F.min("ers").alias("min_ers"), F.max("ers").alias("max_ers"), F.avg("odds").alias("avg_odds")
    )


@query(
    "a06_return_metric_by_ers_half",
    f"""WITH {PF}, fm AS (SELECT entity, metric, lag(stop_type) OVER (PARTITION BY entity ORDER BY session_no) AS ps FROM tl WHERE is_start),
    rt2 AS (SELECT entity, avg(metric) AS v FROM fm WHERE ps IN ('Long', 'Quit') AND metric IS NOT NULL GROUP BY 1),
    hv AS (SELECT v, CASE WHEN row_number() OVER (ORDER BY ers, entity) <= floor(count(*) OVER () / 2) THEN 'low' ELSE 'high' END AS half FROM rt2 JOIN pf USING (entity))
    SELECT * FROM ({Q.mwu('hv', [], 'half', 'v', "'high'", "'low'", 'greater')}) WHERE n1 + n2 >= 4""",
)
def _(spark, sf):
    seq = tl.timeline(spark, sf)
    return pr.return_by_ers(seq, pr.behaviour_profile(pr.with_state(seq)), exact=False)


@query(
    "a09_g21_churn_by_odds",
    f"""WITH {Q.tl()}, {ODDS}, la AS (SELECT entity, max(ts) AS last_ts FROM tl GROUP BY 1),
    st AS (SELECT odds, CASE WHEN (SELECT max(ts) FROM tl) - last_ts > 7200 THEN 'churned' ELSE 'active' END AS state FROM od JOIN la USING (entity) WHERE kind = 'pity' AND odds IS NOT NULL AND NOT isinf(odds))
    {Q.mwu('st', [], 'state', 'odds', "'active'", "'churned'", 'greater', 5)}""",
)
def _(spark, sf):
    # The driver events end within hours of each other for most entities: two hours idle.
    seq = tl.timeline(spark, sf)
    return pr.churn_by_odds(seq, pr.streak_odds(seq), idle_s=7200, exact=False)


@query(
    "a33_p14_odds_correlation",
    f"""{OP}, tp AS (SELECT kind, coalesce(max(odds) FILTER (NOT isinf(odds)), 10) AS top FROM od WHERE odds IS NOT NULL GROUP BY 1),
    oc AS (SELECT kind, trait, CASE WHEN isinf(odds) THEN top * 1.5 ELSE odds END AS o, CASE trait WHEN 'fsi' THEN fsi ELSE ers END AS v
      FROM od JOIN tp USING (kind) JOIN pf USING (entity), (SELECT unnest(['fsi', 'ers']) AS trait) WHERE odds IS NOT NULL)
    {Q.spearman('oc', ['kind', 'trait'], 'o', 'v', 3)}""",
)
def _(spark, sf):
    _, odds, profile_ = odds_and_profile(spark, sf)
    return pr.odds_correlation(odds, profile_)


@query(
    "a33_h04_odds_correlation_permuted",
    f"""{OP}, tp AS (SELECT kind, coalesce(max(odds) FILTER (NOT isinf(odds)), 10) AS top FROM od WHERE odds IS NOT NULL GROUP BY 1),
    oc AS (SELECT kind, trait, entity, CASE WHEN isinf(odds) THEN top * 1.5 ELSE odds END AS o, CASE trait WHEN 'fsi' THEN fsi ELSE ers END AS v
      FROM od JOIN tp USING (kind) JOIN pf USING (entity), (SELECT unnest(['fsi', 'ers']) AS trait) WHERE odds IS NOT NULL)
    SELECT s.*, q.reps, q.extreme, q.p AS perm_p FROM ({Q.spearman('oc', ['kind', 'trait'], 'o', 'v', 3)}) s LEFT JOIN {Q.permutation('oc', ['kind', 'trait'], 'o', 'v', 'entity', 10_000, min_n=3)} q USING (kind, trait)""",
)
def _(spark, sf):
    _, odds, profile_ = odds_and_profile(spark, sf)
    return pr.odds_correlation(odds, profile_, reps=10_000)


SZ = """sz AS (SELECT entity, CASE WHEN streak_before >= 3 THEN 'Win_Streak' WHEN streak_before <= -3 THEN 'Lose_Streak' ELSE 'No_Streak' END AS streak,
CASE WHEN metric < 45 THEN 'Unfavorable' WHEN metric > 55 THEN 'Favorable' ELSE 'Even' END AS zone FROM sk WHERE metric IS NOT NULL)"""


@query("a34_streak_zone_chi2", f"WITH {Q.tl()}, {Q.streaks()}, {SZ} {Q.chi_square('sz', ['entity'], 'streak', 'zone')}")
def _(spark, sf):
    return pr.streak_zone_independence(tl.timeline(spark, sf))


@query(
    "a34_streak_zone_report",
    f"""SELECT entity, dof, chi2, {Q.r('dof * pow(1 - 2.0 / (9 * dof) + 1.6448536269514722 * sqrt(2.0 / (9 * dof)), 3)')} AS critical,
    CAST(chi2 > dof * pow(1 - 2.0 / (9 * dof) + 1.6448536269514722 * sqrt(2.0 / (9 * dof)), 3) AS BIGINT) AS exceeds
    FROM (WITH {Q.tl()}, {Q.streaks()}, {SZ} {Q.chi_square('sz', ['entity'], 'streak', 'zone', yates=False)})""",
)
def _(spark, sf):
    return pr.streak_zone_report(tl.timeline(spark, sf)).select("entity", "dof", "chi2", "critical", "exceeds")


@query("a34_h07_significant_share")
def _(spark, sf):
    return pr.report_share(pr.streak_zone_report(tl.timeline(spark, sf), 10_000))


@query("g06_contingency", f"WITH {Q.tl()}, {Q.streaks()}, {SZ} SELECT streak, zone, count(*) AS cell FROM sz GROUP BY 1, 2")
def _(spark, sf):
    return hy.contingency(pr.streak_zone_rows(tl.timeline(spark, sf)), [], "streak", "zone")


@query("h06_chi_square_all", f"WITH {Q.tl()}, {Q.streaks()}, {SZ} {Q.chi_square('sz', [], 'streak', 'zone')}")
def _(spark, sf):
    return hy.chi_square(hy.contingency(pr.streak_zone_rows(tl.timeline(spark, sf)), [], "streak", "zone"), [], "streak", "zone")


@query(
    "a35_g20_odds_by_sensitivity",
    f"""{OP} SELECT kind, CASE WHEN fsi < 0.85 THEN 'low' WHEN fsi <= 1.30 THEN 'mid' ELSE 'high' END AS fsi_group, count(*) AS n, {Q.r('avg(odds)')} AS avg_odds, {Q.r('avg(fsi)')} AS avg_fsi
    FROM od JOIN pf USING (entity) WHERE odds IS NOT NULL AND NOT isinf(odds) GROUP BY 1, 2""",
)
def _(spark, sf):
    _, odds, profile_ = odds_and_profile(spark, sf)
    return pr.odds_by_sensitivity(odds, profile_)


@query(
    "a64_odds_against_events_and_rating",
    f"""{OP}, rat AS (SELECT DISTINCT entity, current_rating FROM ev), oc AS (SELECT against, odds, CASE against WHEN 'total_events' THEN total_events ELSE current_rating END AS v
      FROM od JOIN pf USING (entity) JOIN rat USING (entity), (SELECT unnest(['total_events', 'current_rating']) AS against) WHERE kind = 'pity' AND odds IS NOT NULL AND NOT isinf(odds))
    {Q.spearman('oc', ['against'], 'odds', 'v')}""",
)
def _(spark, sf):
    _, odds, profile_ = odds_and_profile(spark, sf)
    ratings = tables.events(spark, sf).select("entity", "current_rating").distinct()
    return pr.odds_correlates(odds, profile_, ratings)


@query(
    "a12_short_session_bonus",
    f"""WITH {PF}, sb AS (SELECT trait, events_per_session AS x, CASE trait WHEN 'metric' THEN avg_metric ELSE avg_level END AS y FROM pf, (SELECT unnest(['metric', 'level']) AS trait))
    {Q.spearman('sb', ['trait'], 'x', 'y', 5)}""",
)
def _(spark, sf):
    p = profile(spark, sf)
    long = p.select(
        F.col("events_per_session").alias("x"),
        F.explode(F.array(F.struct(F.lit("metric").alias("trait"), F.col("avg_metric").alias("y")), F.struct(F.lit("level").alias("trait"), F.col("avg_level").alias("y")))).alias("t"),
    ).select("x", "t.*")
    return hy.spearman(long, ["trait"], "x", "y", 5)
