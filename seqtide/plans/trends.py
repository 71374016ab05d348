"""Head against tail of sessions, times of day, rating slopes and gatekeeping thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtide.functions import tails
from seqtide.functions.scalar import bucket, local_hour, named_slot
from seqtide.operators import buckets as bk
from seqtide.operators import hypothesis as hy
from seqtide.operators import sequence as sq
from seqtide.operators.ordered import Seq, ordered
from seqtide.plans import timeline as tl
from seqtide.plans.outcomes import measures, rated_rows
from seqtide.schemas import THRESHOLD_LIMITS

TREND_VALUES = ("win", "metric", "metric2", "level")


def session_halves(seq: Seq, min_len: int = 4, hook: int = 3) -> DataFrame:
    """Per session of at least ``min_len`` events: means of both ends and of hook and rest.

    The ends have 2 events under 8, else 3, and count only when complete; hook needs all
    but one value and the rest one.
    """
    k = F.when(F.col("n") < 8, 2).otherwise(3)
    first, last = F.col("pos") <= k, F.col("n") - F.col("pos") < k
    head = F.col("pos") <= hook
    aggs = []
    for c in TREND_VALUES:
        v = F.col(c).cast("double")
        for name, where in (("start", first), ("end", last), ("head", head), ("tail", ~head)):
            aggs += [F.avg(F.when(where, v)).alias(f"{name}_{c}"), F.count(F.when(where, v)).alias(f"n_{name}_{c}")]
    rows = seq.df.filter(F.col("n") >= min_len).groupBy(*seq.keys, "session_no").agg(F.max("n").alias("n"), *aggs)
    k = F.when(F.col("n") < 8, 2).otherwise(3)
    items = []
    for c in TREND_VALUES:
        full = (F.col(f"n_start_{c}") == k) & (F.col(f"n_end_{c}") == k)
        rest = (F.col(f"n_head_{c}") >= hook - 1) & (F.col(f"n_tail_{c}") > 0)
        for split, a, b, ok in (("ends", f"start_{c}", f"end_{c}", full), ("hook", f"head_{c}", f"tail_{c}", rest)):
            items.append(
                F.when(ok, F.struct(F.lit(split).alias("split"), F.lit(c).alias("measure"), F.col(a).alias("a"), F.col(b).alias("b")))
            )
    return rows.select(*seq.keys, "session_no", "n", F.explode(F.array_compact(F.array(*items))).alias("h")).select(
        *seq.keys, "session_no", "n", "h.*"
    )


def session_trends(halves: DataFrame, min_n: int = 11, exact: bool = True) -> DataFrame:
    """Wilcoxon: is the first part better than the last?"""
    return hy.wilcoxon(halves, ["split", "measure"], "a", "b", "greater", min_n, exact=exact)


def length_against_change(halves: DataFrame, min_n: int = 5) -> DataFrame:
    rows = halves.filter("split = 'hook'").withColumn("change", F.round(F.col("b") - F.col("a"), 9))
    return hy.spearman(rows, ["measure"], "n", "change", min_n)


# --- time of day -------------------------------------------------------------


def with_hour(seq: Seq, regions: DataFrame) -> DataFrame:
    """Timeline rows with the local hour of the entity (``regions``: entity -> region, tz)."""
    return seq.df.join(regions, "entity", "left").withColumn("hour", local_hour("ts", "tz"))


def time_rows(rows: DataFrame, width: int = 1000) -> DataFrame:
    """Long form by local 6-hour slot and by rating bucket, from one pass over the rows."""
    values = {c: F.col(c) for c in ("metric", "metric2", "level")}
    rated = F.col("rating_before").isNotNull() & (F.col("rating_before") != 0)
    by_rating = F.when(rated, F.struct(F.lit("rating").alias("axis"), bucket("rating_before", width).cast("string").alias("grp")))
    axes = F.array_compact(F.array(F.struct(F.lit("slot").alias("axis"), named_slot("hour").alias("grp")), by_rating))
    keyed = rows.select(*values, F.explode(axes).alias("a")).select(*values, "a.*")
    return measures(keyed, ["axis", "grp"], values).filter("value IS NOT NULL")


def time_stats(rows: DataFrame, min_n: int = 20) -> DataFrame:
    out = rows.groupBy("axis", "measure", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd")
    )
    return out.withColumn("variance", F.col("sd") * F.col("sd")).filter((F.col("axis") == "slot") | (F.col("n") >= min_n))


def _enough(min_n: int) -> Column:
    return F.when(F.col("axis") == "slot", 1).otherwise(min_n)


def time_kruskal(rows: DataFrame, min_n: int = 20) -> DataFrame:
    return hy.kruskal(rows, ["axis", "measure"], "grp", "value", _enough(min_n))


def time_levene(rows: DataFrame, min_n: int = 20) -> DataFrame:
    return hy.levene(rows, ["axis", "measure"], "grp", "value", _enough(min_n))


def metric_against_second(seq: Seq, exact: bool = True) -> DataFrame:
    """Metric with and without levels: means, rank correlation and signed-rank test."""
    rows = seq.df.filter(F.col("mode").isin("Ladder", "Ranked"))
    test = hy.wilcoxon(rows, [], "metric", "metric2", "two-sided", exact=exact)
    rho = hy.spearman(rows, [], "metric", "metric2").select("rho", F.col("p").alias("rho_p"))
    return test.crossJoin(rho)  # one row each


def return_breakdown(seq: Seq, regions: DataFrame, n: int = 3, back: int = 20, min_hour: int = 3) -> DataFrame:
    """First event after a session that ended on ``n`` bad events.

    ``rating_excess``: rating minus its mean over the last ``back`` events;
    ``hour_gain``: the entity's usual second metric at this hour minus that at the last one.
    """
    s = seq
    for k in range(1, n):
        s = sq.next_in(s, ["metric"], k=-k)
    names = ["metric", *[f"prev{'' if k == 1 else k}_metric" for k in range(1, n)]]
    bad = F.lit(True)
    for c in names:
        bad = bad & F.coalesce(F.col(c) < 45, F.lit(False))
    s = s.with_columns({"__bad": bad})
    s = s.near(
        {
            "after_bad": lambda w: F.lag("__bad").over(w) & F.lag("is_last").over(w),
            "stop_ts": lambda w: F.lag("ts").over(w),
            "recent": lambda w: F.avg("rating_before").over(w.rowsBetween(-back, -1)),
        },
        back=back,
    )
    excess = F.when(F.col("rating_before") != 0, F.col("rating_before") - F.col("recent"))
    firsts = s.df.filter("is_start AND after_bad AND metric IS NOT NULL").select(
        "entity", "event_id", "ts", "stop_ts", "metric", "metric2", "level", excess.alias("rating_excess")
    ).join(regions, "entity", "left")
    firsts = firsts.withColumns({"h_stop": local_hour("stop_ts", "tz"), "h_back": local_hour("ts", "tz")})
    usual = (
        with_hour(seq, regions).filter("metric2 IS NOT NULL").groupBy("entity", "hour")
        .agg(F.avg("metric2").alias("usual"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_hour).drop("__n")
    )
    out = firsts.join(usual.select("entity", F.col("hour").alias("h_stop"), F.col("usual").alias("u_stop")), ["entity", "h_stop"], "left")
    out = out.join(usual.select("entity", F.col("hour").alias("h_back"), F.col("usual").alias("u_back")), ["entity", "h_back"], "left")
    return out.select(
        "entity", "event_id", "metric", "metric2", "level", "rating_excess", (F.col("u_back") - F.col("u_stop")).alias("hour_gain")
    )


def return_breakdown_summary(rows: DataFrame, gain: float = 2.0) -> DataFrame:
    full = F.col("level").isNotNull() & F.col("metric2").isNotNull()
    means = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("rating_excess").alias("avg_excess"),
        F.avg(F.when(full, F.col("level"))).alias("avg_level"),
        F.avg(F.when(full, F.col("metric2"))).alias("avg_metric2"),
        F.avg(F.when(full, F.col("metric"))).alias("avg_metric"),
    )
    rho = hy.spearman(rows, [], "rating_excess", "metric").select("rho", "p")
    return means.crossJoin(rho)  # one row each


def return_hour_test(rows: DataFrame, gain: float = 2.0, min_n: int = 6, exact: bool = True) -> DataFrame:
    grp = F.when(F.col("hour_gain") > gain, "better").when(F.col("hour_gain").isNotNull(), "worse")
    return hy.mann_whitney(rows.withColumn("grp", grp), [], "grp", "metric", "better", "worse", "greater", min_n, exact=exact)


# --- slopes over the rating ----------------------------------------------------

# Fixed value: the reported difference between win and loss that the slope is compared with.
OBSERVED_DELTA = -0.08


def climbing_slopes(seq: Seq, width: int = 1000, min_n: int = 100) -> DataFrame:
    """Slope of level over rating per bucket and over all; share of the observed difference
    that 60 rating points explain."""
    rows = seq.df.filter((F.col("mode") == "Ladder") & F.col("rating_before").isNotNull() & F.col("level").isNotNull())
    sections = F.array(bucket("rating_before", width).cast("string"), F.lit("all"))
    rows = rows.withColumn("section", F.explode(sections))
    out = hy.slope(rows, ["section"], "rating_before", "level", min_n)
    return out.withColumn("explained_pct", F.col("slope") * 60 / F.lit(OBSERVED_DELTA) * 100)


def climbing_zscores(seq: Seq, width: int = 100, min_n: int = 20) -> DataFrame:
    """Next second metric after win against loss per rating bucket, against 60 slope points."""
    rows = tl.with_next(seq, ["metric2"]).df.filter("has_next AND mode = 'Ladder' AND rating_before IS NOT NULL")
    line = hy.slope(rows.filter("metric2 IS NOT NULL"), [], "rating_before", "metric2").select("slope")
    v, won = F.col("next_metric2"), F.col("win") == 1
    out = rows.filter("next_metric2 IS NOT NULL").groupBy(bucket("rating_before", width).alias("bucket")).agg(
        F.count_if(won).alias("n_win"),
        F.count_if(~won).alias("n_loss"),
        F.avg(F.when(won, v)).alias("mean_win"),
        F.avg(F.when(~won, v)).alias("mean_loss"),
        F.var_samp(F.when(won, v)).alias("__vw"),
        F.var_samp(F.when(~won, v)).alias("__vl"),
    ).filter((F.col("n_win") >= min_n) & (F.col("n_loss") >= min_n))
    se = F.sqrt(F.col("__vw") / F.col("n_win") + F.col("__vl") / F.col("n_loss"))
    out = out.crossJoin(F.broadcast(line))  # one row
    delta = F.col("mean_win") - F.col("mean_loss")
    out = out.withColumn("z", F.try_divide(delta - F.col("slope") * 60, se)).filter("z IS NOT NULL")
    verdict = F.when(F.col("z") < -2, "lower").when(F.col("z") > 2, "higher").otherwise("as expected")
    return out.select(
        "bucket", "n_win", "n_loss", "mean_win", "mean_loss", "z",
        tails.normal_p(F.col("z"), "two-sided").alias("p"), verdict.alias("verdict"),
    )


def level_saturation(seq: Seq, width: int = 500, min_n: int = 20) -> DataFrame:
    """Mean, variance and share of exact zeros of the level per rating bucket."""
    rows = rated_rows(seq.df).filter("level IS NOT NULL")
    return rows.groupBy(bucket("rating_before", width).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("level").alias("avg"), F.var_samp("level").alias("variance"),
        (F.avg((F.col("level") == 0).cast("double")) * 100).alias("zero_pct"),
    ).filter(F.col("n") >= min_n)


def band_progression(seq: Seq, step: int = 1000, sub: int = 100, min_total: int = 100, min_n: int = 10) -> DataFrame:
    """Mean level per sub-band of each band, with the change from the sub-band before it."""
    rows = rated_rows(seq.df).filter("level IS NOT NULL")
    band = bucket("rating_before", step)
    rows = rows.withColumn("band", band).withColumn("sub", F.floor((F.col("rating_before") - F.col("band")) / sub).cast("long"))
    enough = rows.groupBy("band").count().filter(F.col("count") >= min_total).select("band")
    subs = rows.groupBy("band", "sub").agg(F.count(F.lit(1)).alias("n"), F.avg("level").alias("avg")).filter(F.col("n") >= min_n)
    return bk.increments(subs.join(enough, "band", "left_semi"), "sub", "avg", key="band")


def band_slopes(progression: DataFrame, margin: float = 0.05) -> DataFrame:
    """First against second half of the increments of each band (more than two of them)."""
    steps = progression.filter("increment IS NOT NULL")
    sizes = steps.groupBy("band").agg(F.count(F.lit(1)).alias("steps"), F.sort_array(F.collect_list(F.struct("sub", "increment"))).alias("__s"))
    # At most step / sub increments per band: the array is of fixed length.
    mid = F.floor(F.col("steps") / 2).cast("int")

    def mean(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x["increment"]) / F.size(part)

    first, second = F.slice("__s", F.lit(1), mid), F.slice("__s", mid + 1, F.col("steps").cast("int") - mid)
    out = sizes.filter(F.col("steps") > 2).select("band", "steps", mean(first).alias("first_slope"), mean(second).alias("second_slope"))
    return out.withColumn("flattening", F.col("second_slope") < F.col("first_slope") - margin)


# --- thresholds ----------------------------------------------------------------


def gatekeeping(seq: Seq, reach: int = 150, min_n: int = 10, exact: bool = True) -> DataFrame:
    """Values within ``reach`` under the next threshold against all others."""
    rows = rated_rows(seq.df).withColumn("gate", bk.next_threshold("rating_before")).filter("gate IS NOT NULL")
    grp = F.when(F.col("gate") - F.col("rating_before") <= reach, "danger").otherwise("safe")
    long = measures(rows.withColumn("grp", grp), ["grp"], {c: F.col(c) for c in ("metric", "level", "metric2")})
    return hy.mann_whitney(long, ["measure"], "grp", "value", "danger", "safe", "less", min_n, exact=exact)


# Fixed value: natural growth of the opponents' level per 50 rating points.
NATURAL_GROWTH_50 = 0.0485


def near_threshold_zone(rating: str = "rating_before", width: int = 50, limits: tuple[int, ...] = THRESHOLD_LIMITS) -> Column:
    """``danger`` within ``width`` under a threshold, ``control`` in the width before it.

    The first threshold that fits decides, danger before control.
    """
    v = F.col(rating)
    gate = bk.next_threshold(rating, limits)
    return F.when(gate - v <= width, "danger").when(gate - v <= 2 * width, "control")


def opponent_level_rows(seq: Seq, basket_levels: DataFrame, width: int = 100, min_n: int = 5) -> DataFrame:
    """Ladder events with the mean level of the opponent's basket minus its rating bucket's mean."""
    levels = basket_levels.select(F.col("deck").alias("opp_deck"), F.col("avg_level").alias("opp_level"))
    rows = seq.df.filter("mode = 'Ladder' AND rating_before IS NOT NULL").join(levels, "opp_deck").filter("opp_level > 0")
    rows = rows.withColumn("b", bucket("rating_before", width))
    return bk.residualize(rows, "b", "opp_level", bk.baseline(rows, "b", "opp_level", min_n))


def symmetric_gatekeeping(rows: DataFrame, exact: bool = True) -> DataFrame:
    """Residual opponent level just under a threshold against the zone before it."""
    out = hy.mann_whitney(
        rows.withColumn("zone", near_threshold_zone()), [], "zone", "residual", "danger", "control", "greater", exact=exact
    )
    delta = F.col("mean1") - F.col("mean2")
    return out.withColumn("delta", delta).withColumn("excess_growth", delta - NATURAL_GROWTH_50)


def opponent_level_curve(rows: DataFrame, min_n: int = 10) -> DataFrame:
    """Mean opponent level per rating bucket with the increment from the bucket before it."""
    curve = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.avg("opp_level").alias("avg")).filter(F.col("n") >= min_n)
    return bk.increments(curve, "b", "avg")


GATE_ZONES = ("pre_stable", "pre_early", "post_early", "post_stable")


def gate_zone(offset: Column) -> Column:
    return (
        F.when(offset < -75, GATE_ZONES[0]).when(offset < 0, GATE_ZONES[1]).when(offset < 75, GATE_ZONES[2]).otherwise(GATE_ZONES[3])
    )


def gate_rows(seq: Seq, limits: tuple[int, ...] = THRESHOLD_LIMITS) -> DataFrame:
    """One row per event and threshold within 150, with its zone, the deck switch flag and
    the hostility: the entity's mean second metric minus this one."""
    usual = seq.df.filter("metric2 IS NOT NULL").groupBy("entity").agg(F.avg("metric2").alias("usual"))
    ladder = seq.filter("mode = 'Ladder' AND rating_before IS NOT NULL AND rating_before <> 0 AND metric2 IS NOT NULL")
    s = ladder.near({"switch": lambda w: F.coalesce(F.lag("deck").over(w) != F.col("deck"), F.lit(False))}, back=1)
    rows = bk.threshold_band(s.frame, "rating_before", -150, 150, [x for x in limits if x > 0])
    rows = rows.withColumn("zone", gate_zone(F.col("rating_before") - F.col("threshold")))
    return rows.join(usual, "entity").withColumn("hostility", F.col("usual") - F.col("metric2"))


def gate_zones(rows: DataFrame, min_n: int = 10) -> DataFrame:
    """Per threshold and zone, where all four zones have enough events."""
    out = rows.groupBy("threshold", "zone").agg(
        F.count(F.lit(1)).alias("n"), F.avg("metric2").alias("avg_metric2"), F.avg("hostility").alias("hostility"),
        (F.avg(F.col("switch").cast("double")) * 100).alias("switch_pct"),
    )
    full = out.filter(F.col("n") >= min_n).groupBy("threshold").count().filter(F.col("count") == 4)
    return out.join(full.select("threshold"), "threshold", "left_semi")


def gate_attempts(seq: Seq, limits: tuple[int, ...] = THRESHOLD_LIMITS, min_first: int = 10) -> DataFrame:
    """Hostility by the number of the attempt (1, 2, 3, 4+) to pass each threshold.

    Every entry into the 75 points under a threshold is an attempt. At most one threshold is
    that near, so the zone of an event is one value and the entries are counted per zone.
    """
    usual = seq.df.filter("metric2 IS NOT NULL").groupBy("entity").agg(F.avg("metric2").alias("usual"))
    ladder = seq.filter("mode = 'Ladder' AND rating_before IS NOT NULL AND rating_before <> 0 AND metric2 IS NOT NULL")
    gate = bk.next_threshold("rating_before", [x for x in limits if x > 0])
    near = F.when(gate - F.col("rating_before") <= 75, gate)
    s = sq.runs(ladder.with_columns({"gate": near}), "gate", group=None)
    entries = s.df.filter("run_start AND gate IS NOT NULL").select("entity", "gate", "run_no")
    numbered = ordered(entries, ["entity", "gate"], "run_no", seq.max_rows, slab=1e5).number("attempt").frame
    rows = s.df.filter("gate IS NOT NULL").select("entity", "gate", "run_no", "metric2")
    rows = rows.join(numbered, ["entity", "gate", "run_no"]).join(usual, "entity")
    level = F.when(F.col("attempt") >= 4, "4+").otherwise(F.col("attempt").cast("string"))
    out = rows.groupBy(F.col("gate").alias("threshold"), level.alias("attempt")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("usual") - F.col("metric2")).alias("hostility")
    )
    enough = out.filter((F.col("attempt") == "1") & (F.col("n") >= min_first)).select("threshold")
    return out.join(enough, "threshold", "left_semi")
