"""Session summaries, behaviour profiles per entity and conditional-odds tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtide.functions.scalar import is_finite, report_round, streak_category, zone
from seqtide.operators import hypothesis as hy
from seqtide.operators import permutation as pm
from seqtide.operators import resample as rs
from seqtide.operators import sequence as sq
from seqtide.operators.ordered import Seq, ordered
from seqtide.session import cut_lineage

# Weight of a stop by its tier.
STOP_WEIGHTS = {"Short": 1.0, "Long": 2.5, "Quit": 5.0, "End": 0.0}


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def session_summary(seq: Seq) -> DataFrame:
    """One row per session with 12 metrics; empty statistics are 0, as in the reports.

    The average level is the ratio of the level sum to the events with a valid metric.
    """
    scored = F.col("mode").isin("Ladder", "Ranked")
    ok, ok2 = F.col("metric").isNotNull() & scored, F.col("metric2").isNotNull() & scored
    n = F.count_if(ok)
    low, high = ok & (F.col("metric") < 40), ok & (F.col("metric") > 80)
    won = F.col("win") == 1
    return seq.df.groupBy(*seq.keys, "session_no").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max("break_s").alias("break_s"),
        F.max("stop_type").alias("stop_type"),
        n.alias("n_valid"),
        F.coalesce(F.avg(F.when(ok, F.col("metric"))), F.lit(0.0)).alias("avg_metric"),
        F.coalesce(F.avg(F.when(ok2, F.col("metric2"))), F.lit(0.0)).alias("avg_metric2"),
        F.coalesce(F.stddev_samp(F.when(ok, F.col("metric"))), F.lit(0.0)).alias("sd_metric"),
        F.coalesce(F.stddev_samp(F.when(ok2, F.col("metric2"))), F.lit(0.0)).alias("sd_metric2"),
        _share(F.coalesce(F.sum("level"), F.lit(0.0)), n).alias("avg_level"),
        F.count_if(low | high).alias("n_extreme"),
        _share(F.count_if(ok & won), n).alias("win_rate"),
        _share(F.count_if(ok & ~won), n).alias("loss_rate"),
        _share(F.count_if(low & won), F.count_if(low)).alias("win_when_low"),
        _share(F.count_if(high & ~won), F.count_if(high)).alias("loss_when_high"),
    )


GLOBAL_METRICS = (
    "n_valid", "avg_metric", "avg_metric2", "sd_metric", "sd_metric2", "avg_level", "n_extreme", "win_rate",
    "win_when_low", "loss_when_high",
)


def global_summary(summary: DataFrame) -> DataFrame:
    """Means of the session metrics over all sessions."""
    return summary.agg(F.count(F.lit(1)).alias("sessions"), *[F.avg(c).alias(c) for c in GLOBAL_METRICS])


def with_state(seq: Seq) -> Seq:
    """Streaks, stress and counter streak, as the profile needs them."""
    return sq.counter_streak(sq.stress(sq.streaks(seq)))


def behaviour_profile(seq: Seq) -> DataFrame:
    """17 metrics per entity from a timeline ``with_state``.

    ``fsi``: weighted sensitivity of quits per loss; ``ers``: impulsivity * exp(-fsi).
    """
    lost, won, last = F.col("win") == 0, F.col("win") == 1, F.col("is_last")
    weight = F.lit(0.0)
    for stop, value in STOP_WEIGHTS.items():
        weight = F.when(F.col("stop_type") == stop, F.lit(value)).otherwise(weight)
    quits = lost & last & (weight > 0)
    base = seq.df.groupBy(*seq.keys).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.max("session_no").alias("sessions"),
        F.coalesce(F.sum(F.when(~F.col("is_start"), F.col("prev_gap"))), F.lit(0)).alias("__play_s"),
        F.count_if(lost).alias("__losses"),
        F.count_if(won).alias("__wins"),
        F.coalesce(F.sum(F.when(quits, weight / F.col("stress_after"))), F.lit(0.0)).alias("__sens"),
        F.count_if(quits).alias("__quits"),
        F.count_if(won & ~last).alias("__win_cont"),
        F.count_if(lost & ~last).alias("__loss_cont"),
        F.count_if(lost & ~last & (F.col("loss_streak") >= 2)).alias("l_streak_count"),
        F.count_if(lost & ~last & (F.col("counter_streak") >= 2)).alias("counter_streak_continuations"),
        F.coalesce(F.max(F.when(lost & ~last, F.col("loss_streak"))), F.lit(0)).alias("max_loss_streak_tolerated"),
        F.coalesce(F.avg("metric"), F.lit(50.0)).alias("__m1"),
        F.coalesce(F.avg("metric2"), F.lit(50.0)).alias("__m2"),
        F.coalesce(F.avg("level"), F.lit(0.0)).alias("__lv"),
    )
    fsi, impulsivity = _share(F.col("__sens"), F.col("__losses")), _share(F.col("__sens"), F.col("__quits"))
    return base.select(
        *seq.keys,
        "total_events",
        "sessions",
        report_round(fsi, 3).alias("fsi"),
        report_round(impulsivity, 3).alias("impulsivity"),
        report_round(impulsivity * F.exp(-fsi), 3).alias("ers"),
        report_round(F.col("__play_s") / 60.0 / F.col("sessions"), 2).alias("avg_session_min"),
        report_round(F.col("total_events") / F.col("sessions"), 2).alias("events_per_session"),
        "l_streak_count",
        "max_loss_streak_tolerated",
        report_round(_share(F.col("__win_cont") * 100.0, F.col("__wins")), 1).alias("win_continuation_pct"),
        report_round(_share(F.col("__loss_cont") * 100.0, F.col("__losses")), 1).alias("loss_continuation_pct"),
        report_round(F.col("__wins") * 100.0 / F.col("total_events"), 1).alias("win_pct"),
        report_round(F.col("__m1"), 2).alias("avg_metric"),
        report_round(F.col("__m2"), 2).alias("avg_metric2"),
        report_round(F.col("__lv"), 2).alias("avg_level"),
        (F.col("total_events") > 50).alias("is_reliable"),
        "counter_streak_continuations",
    )


def reliable(seq: Seq, min_events: int = 50) -> Seq:
    """Only entities with more than ``min_events`` events in the timeline."""
    kept = seq.df.groupBy(*seq.keys).count().filter(F.col("count") > min_events).select(*seq.keys)
    return seq.with_df(seq.df.join(kept, list(seq.keys), "left_semi"))


def old_profile(seq: Seq, min_total: int = 100, min_per_session: float = 3.0) -> DataFrame:
    """Earlier profile form: sensitivity per session end, from the losing tail of the session.

    A session that ends on a loss scores (1 + 0.5 * losing tail), times 1.4 when the metric of
    its last event is under 45. Streak counters look at the three events before each event,
    across sessions.
    """
    tail = F.col("loss_streak").cast("double")
    score = F.when(
        F.col("win") == 0, (1 + 0.5 * tail) * F.when(F.col("metric") < 45, 1.4).otherwise(1.0)
    ).otherwise(F.lit(0.0))
    before = sq.streaks(seq).near(
        {
            "__wins3": lambda w: F.sum("win").over(w.rowsBetween(-3, -1)),
            "__rows3": lambda w: F.count("win").over(w.rowsBetween(-3, -1)),
        },
        back=3,
    )
    three = F.col("__rows3") == 3
    per_session = before.df.groupBy(*seq.keys, "session_no").agg(
        F.count(F.lit(1)).alias("__n"),
        F.max(F.when(F.col("is_last"), score)).alias("__score"),
        (F.max("ts") - F.min("ts")).alias("__dur"),
        F.count_if(three & (F.col("__wins3") == 0)).alias("__l3"),
        F.count_if(three & (F.col("__wins3") == 3)).alias("__w3"),
        F.sum("metric").alias("__ms"),
        F.count("metric").alias("__mn"),
        F.sum("level").alias("__ls"),
        F.count("level").alias("__ln"),
    )
    out = per_session.groupBy(*seq.keys).agg(
        F.sum("__n").alias("total_events"),
        F.count(F.lit(1)).alias("sessions"),
        report_round(F.avg("__score"), 3).alias("fsi"),
        report_round(F.coalesce(F.avg(F.when(F.col("__dur") > 0, F.col("__dur") / 60)), F.lit(0.0)), 2).alias("avg_session_min"),
        report_round(F.sum("__n") / F.count(F.lit(1)), 2).alias("events_per_session"),
        F.sum("__l3").alias("loss_streaks"),
        F.sum("__w3").alias("win_streaks"),
        report_round(F.coalesce(F.try_divide(F.sum("__ms"), F.sum("__mn")), F.lit(50.0)), 2).alias("avg_metric"),
        report_round(F.coalesce(F.try_divide(F.sum("__ls"), F.sum("__ln")), F.lit(0.0)), 2).alias("avg_level"),
    )
    return out.withColumn(
        "is_reliable", (F.col("total_events") > min_total) & (F.col("total_events") / F.col("sessions") > min_per_session)
    )


# --- conditional odds -------------------------------------------------------


def streak_odds(seq: Seq, n: int = 3, high: float = 60.0, low: float = 40.0) -> DataFrame:
    """2x2 tables per entity: n losses before -> metric over ``high`` (pity), n wins before ->
    metric under ``low`` (punish); with odds and exact one-sided p. Rows from position n + 1."""
    flagged = sq.last_n_all(seq, {"__lost": F.col("win") == 0, "__won": F.col("win") == 1}, n)
    rows = flagged.df.filter((F.col("pos") > n) & F.col("metric").isNotNull())
    wide = rows.groupBy(*seq.keys).agg(
        F.count_if(F.col("__lost") & (F.col("metric") > high)).alias("pity_a"),
        F.count_if(F.col("__lost") & ~(F.col("metric") > high)).alias("pity_b"),
        F.count_if(~F.col("__lost") & (F.col("metric") > high)).alias("pity_c"),
        F.count_if(~F.col("__lost") & ~(F.col("metric") > high)).alias("pity_d"),
        F.count_if(F.col("__won") & (F.col("metric") < low)).alias("punish_a"),
        F.count_if(F.col("__won") & ~(F.col("metric") < low)).alias("punish_b"),
        F.count_if(~F.col("__won") & (F.col("metric") < low)).alias("punish_c"),
        F.count_if(~F.col("__won") & ~(F.col("metric") < low)).alias("punish_d"),
    )
    keys = list(seq.keys)
    stacked = wide.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("kind"), *[F.col(f"{kind}_{c}").alias(c) for c in "abcd"])
                    for kind in ("pity", "punish")
                ]
            )
        ).alias("t"),
    ).select(*keys, "t.*")
    return hy.fisher_2x2(stacked, "a", "b", "c", "d")


def session_pity(seq: Seq, low: float = 45.0, high: float = 55.0, min_n: int = 2, min_pairs: int = 2) -> DataFrame:
    """Per entity: a session averaging under ``low`` -> the next one over ``high``."""
    summary = session_summary(seq)
    pairs = seq.derive(summary.select(*seq.keys, "session_no", "n_valid", "avg_metric"), ["session_no"], slab=1e5)
    pairs = pairs.near(
        {"__n2": lambda w: F.lead("n_valid").over(w), "__m2": lambda w: F.lead("avg_metric").over(w)}, ahead=1
    )
    ok = (F.col("n_valid") >= min_n) & (F.col("__n2") >= min_n)
    was_low, is_high = F.col("avg_metric") < low, F.col("__m2") > high
    table = (
        pairs.df.filter(ok)
        .groupBy(*seq.keys)
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.count_if(was_low & is_high).alias("a"),
            F.count_if(was_low & ~is_high).alias("b"),
            F.count_if(~was_low & is_high).alias("c"),
            F.count_if(~was_low & ~is_high).alias("d"),
        )
        .filter(F.col("pairs") >= min_pairs)
    )
    return hy.fisher_2x2(table, "a", "b", "c", "d").withColumn("significant", F.col("p") < 0.05)


def significant_share(results: DataFrame, flag: str = "significant") -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if(F.col(flag)).alias("significant"),
        (F.coalesce(F.try_divide(F.count_if(F.col(flag)) * 100.0, F.count(F.lit(1))), F.lit(0.0))).alias("pct"),
    )


def finite_odds(odds: DataFrame) -> DataFrame:
    """NaN odds dropped; infinite odds become 1.5 times the largest finite one of their kind."""
    known = odds.filter(~F.isnan("odds"))
    tops = known.groupBy("kind").agg(
        F.coalesce(F.max(F.when(is_finite("odds"), F.col("odds"))), F.lit(10.0)).alias("__top")
    )
    # One row per kind.
    return known.join(tops, "kind").withColumn(
        "odds", F.when(is_finite("odds"), F.col("odds")).otherwise(F.col("__top") * 1.5)
    ).drop("__top")


def odds_against_traits(odds: DataFrame, profile: DataFrame) -> DataFrame:
    """Long form: kind, trait (fsi or ers), entity, odds (finite), v."""
    joined = cut_lineage(finite_odds(odds).join(profile.select("entity", "fsi", "ers"), "entity"))
    traits = F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("v")) for t in ("fsi", "ers")])
    return joined.select("kind", "entity", "odds", F.explode(traits).alias("t")).select("kind", "entity", "odds", "t.trait", "t.v")


def odds_correlation(odds: DataFrame, profile: DataFrame, reps: int | None = None) -> DataFrame:
    """Spearman of the odds with fsi and with ers, per kind; with ``reps`` also the permutation p of each (``perm_p``)."""
    long = odds_against_traits(odds, profile)
    out = hy.spearman(long, ["kind", "trait"], "odds", "v", min_n=3)
    if not reps:
        return out
    shuffled = pm.permutation_spearman(long, ["kind", "trait"], "odds", "v", "entity", reps, min_n=3)
    return out.join(shuffled.select("kind", "trait", "reps", "extreme", F.col("p").alias("perm_p")), ["kind", "trait"], "left")


def median_split(df: DataFrame, by: str, tie: str, name: str = "half") -> DataFrame:
    """Exact count-based halves: the lower floor(n / 2) rows by ``by`` are ``low``.

    The row number over everything runs on the skew-safe ordered windows.
    """
    seq = ordered(df.withColumn("__one", F.lit(0)), "__one", [by, tie], slab=0.05).number("__no")
    size = df.agg(F.count(F.lit(1)).alias("__size"))
    joined = seq.frame.crossJoin(F.broadcast(size))  # one row
    half = F.when(F.col("__no") <= F.floor(F.col("__size") / 2), "low").otherwise("high")
    return joined.withColumn(name, half).drop("__one", "__no", "__size")


def pity_by_ers(odds: DataFrame, profile: DataFrame, exact: bool = True) -> DataFrame:
    """Median split on ers: are the pity odds of the upper half larger? With the partial
    correlation that holds the number of events fixed."""
    pity = odds.filter((F.col("kind") == "pity") & is_finite("odds")).select("entity", "odds")
    # One row per entity, used by two tests: computed once.
    joined = cut_lineage(pity.join(profile.select("entity", "ers", "total_events"), "entity"))
    halves = median_split(joined, "ers", "entity")
    test = hy.mann_whitney(halves, [], "half", "odds", "high", "low", "greater", exact=exact)
    partial = hy.partial_spearman(joined, [], "ers", "odds", "total_events")
    return test.crossJoin(partial.select("n", "r_xy", "r_xz", "r_yz", "r_partial")).filter("n >= 4")  # one row each


def return_by_ers(seq: Seq, profile: DataFrame, exact: bool = True) -> DataFrame:
    """Mean first metric after a Long or Quit stop, by the upper and lower half of ers."""
    firsts = session_firsts(seq, ["metric"])
    back = firsts.filter(F.col("prev_stop").isin("Long", "Quit") & F.col("first_metric").isNotNull())
    means = back.groupBy("entity").agg(F.avg("first_metric").alias("avg_return"))
    halves = median_split(cut_lineage(means.join(profile.select("entity", "ers"), "entity")), "ers", "entity")
    return hy.mann_whitney(halves, [], "half", "avg_return", "high", "low", "greater", exact=exact).filter("n1 + n2 >= 4")


def session_firsts(seq: Seq, columns: list[str]) -> DataFrame:
    """First event of each session with the stop tier of the session before it."""
    lagged = seq.near({"prev_stop": lambda w: F.lag("stop_type").over(w)}, back=1)
    return lagged.df.filter("is_start").select(
        *seq.keys, "session_no", "prev_stop", *[F.col(c).alias(f"first_{c}") for c in columns]
    )


def churn_by_odds(seq: Seq, odds: DataFrame, idle_s: int = 3 * 86400, min_n: int = 5, exact: bool = True) -> DataFrame:
    """Entities idle longer than ``idle_s`` at the end of the data against the active ones."""
    last = seq.df.groupBy(*seq.keys).agg(F.max("ts").alias("last_ts"))
    now = seq.df.agg(F.max("ts").alias("now"))
    pity = odds.filter((F.col("kind") == "pity") & is_finite("odds")).select("entity", "odds")
    rows = pity.join(last, "entity").crossJoin(F.broadcast(now))  # one row
    state = F.when(F.col("now") - F.col("last_ts") > idle_s, "churned").otherwise("active")
    return hy.mann_whitney(rows.withColumn("state", state), [], "state", "odds", "active", "churned", "greater", min_n, exact=exact)


# Limits of the sensitivity groups.
FSI_LOW, FSI_HIGH = 0.85, 1.30


def odds_by_sensitivity(odds: DataFrame, profile: DataFrame) -> DataFrame:
    """Mean finite odds in the low, middle and high sensitivity group."""
    joined = odds.filter(is_finite("odds")).join(profile.select("entity", "fsi"), "entity")
    level = F.when(F.col("fsi") < FSI_LOW, "low").when(F.col("fsi") <= FSI_HIGH, "mid").otherwise("high")
    return joined.groupBy("kind", level.alias("fsi_group")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("odds").alias("avg_odds"), F.avg("fsi").alias("avg_fsi")
    )


def odds_correlates(odds: DataFrame, profile: DataFrame, ratings: DataFrame) -> DataFrame:
    """Spearman of the finite pity odds with the number of events and with the current rating."""
    pity = odds.filter((F.col("kind") == "pity") & is_finite("odds")).select("entity", "odds")
    joined = pity.join(profile.select("entity", "total_events"), "entity").join(ratings, "entity")
    joined = cut_lineage(joined)
    long = joined.select(
        "odds",
        F.explode(
            F.array(
                F.struct(F.lit("total_events").alias("against"), F.col("total_events").cast("double").alias("v")),
                F.struct(F.lit("current_rating").alias("against"), F.col("current_rating").cast("double").alias("v")),
            )
        ).alias("t"),
    ).select("odds", "t.*")
    return hy.spearman(long, ["against"], "odds", "v")


def spread_of_sessions(seq: Seq, profile: DataFrame, min_events: int = 3, min_sessions: int = 3) -> DataFrame:
    """Standard deviation of session means per entity, next to fsi."""
    summary = session_summary(seq).filter(F.col("events") >= min_events)
    spread = summary.groupBy(*seq.keys).agg(
        F.count(F.lit(1)).alias("sessions"), F.stddev_samp("avg_metric").alias("sd")
    ).filter(F.col("sessions") >= min_sessions)
    return spread.join(profile.select("entity", "fsi"), "entity").withColumn("variance", F.col("sd") * F.col("sd"))


def variance_ratio(spread: DataFrame, low: float = 0.81, high: float = 1.20) -> DataFrame:
    """Mean variance of the low and the high sensitivity group and their ratio."""
    is_low, is_high = F.col("fsi") < low, F.col("fsi") > high
    out = spread.agg(
        F.count_if(is_low).alias("n_low"),
        F.count_if(is_high).alias("n_high"),
        F.coalesce(F.avg(F.when(is_low, F.col("variance"))), F.lit(0.0)).alias("var_low"),
        F.coalesce(F.avg(F.when(is_high, F.col("variance"))), F.lit(0.0)).alias("var_high"),
    )
    return out.withColumn("ratio", F.when(F.col("var_low") > 0, F.col("var_high") / F.col("var_low")))


def streak_zone_rows(seq: Seq, threshold: int = 3) -> DataFrame:
    """Rows (entity, streak category before the event, zone of the metric)."""
    return sq.streaks(seq).df.filter(F.col("metric").isNotNull()).select(
        *seq.keys,
        streak_category("streak_before", threshold).alias("streak"),
        zone("metric", labels=("Unfavorable", "Even", "Favorable")).alias("zone"),
    )


def streak_zone_independence(seq: Seq) -> DataFrame:
    """Chi-square per entity: is the metric zone independent of the streak before it?"""
    cells = hy.contingency(streak_zone_rows(seq), list(seq.keys), "streak", "zone")
    return hy.chi_square(cells, list(seq.keys), "streak", "zone")


def streak_zone_report(seq: Seq, reps: int | None = None) -> DataFrame:
    """The test per entity with its critical value and whether the statistic exceeds it.

    With ``reps`` p is the Monte-Carlo one wherever a cell expects fewer than 5 events or p is close to the limit.
    """
    cells = hy.contingency(streak_zone_rows(seq), list(seq.keys), "streak", "zone")
    keys = list(seq.keys)
    out = rs.chi_square_mc(cells, keys, "streak", "zone", reps) if reps else hy.chi_square(cells, keys, "streak", "zone", yates=False)
    critical = critical_chi2(F.col("dof"))
    return out.withColumn("critical", critical).withColumn("exceeds", (F.col("chi2") > critical).cast("int")).withColumn("significant", (F.col("p") < 0.05).cast("int"))


def report_share(report: DataFrame) -> DataFrame:
    """How many entities there are, and the share of significant ones by critical value and by p: one row."""
    return report.agg(F.count(F.lit(1)).alias("entities"), F.avg("exceeds").alias("share_exceeding"), F.avg("significant").alias("share_significant"))


def critical_chi2(dof: Column, prob: float = 0.95) -> Column:
    """Wilson-Hilferty value of the chi-square quantile (for the report column)."""
    z = {0.95: 1.6448536269514722, 0.99: 2.3263478740408408}[prob]
    d = dof.cast("double")
    return d * F.pow(1 - 2 / (9 * d) + F.lit(z) * F.sqrt(2 / (9 * d)), 3)

