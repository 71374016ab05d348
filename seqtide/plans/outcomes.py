"""What follows an event: next values by outcome, risk, zone and streak."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtide.functions.scalar import bucket, outcome_symbol, zone
from seqtide.operators import buckets as bk
from seqtide.operators import hypothesis as hy
from seqtide.operators import sequence as sq
from seqtide.operators.ordered import Seq
from seqtide.plans import timeline as tl

LOW, HIGH = 45.0, 55.0


def measures(df: DataFrame, keep: list[str], values: Mapping[str, Column], name: str = "measure") -> DataFrame:
    """Long form: one row per named value. Feeds several tests in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias(name), v.cast("double").alias("value")) for k, v in values.items()])
    return df.select(*keep, F.explode(pairs).alias("__m")).select(*keep, "__m.*")


def _next3() -> dict[str, Column]:
    return {c: F.col(c) for c in ("next_metric", "next_level", "next_metric2")}


def after_zone(seq: Seq, side: str) -> DataFrame:
    """Events of the low (debt) or high (credit) zone whose next event has all three values."""
    rows = tl.with_next(seq, ["metric", "level", "metric2"]).df
    inside = F.col("metric") < LOW if side == "debt" else F.col("metric") > HIGH
    full = F.col("next_metric").isNotNull() & F.col("next_level").isNotNull() & F.col("next_metric2").isNotNull()
    return rows.filter(inside & full)


def debt_extinction(seq: Seq, min_n: int = 10, exact: bool = True) -> DataFrame:
    """After an unfavourable event: are the next values lower after a win than after a loss?"""
    return hy.mann_whitney(measures(after_zone(seq, "debt"), ["win"], _next3()), ["measure"], "win", "value", 1, 0, "less", min_n, exact=exact)


def zone_controls(seq: Seq, side: str) -> DataFrame:
    """Means of the current values by outcome, for the same events."""
    return after_zone(seq, side).groupBy("win").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("metric").alias("avg_metric"),
        F.avg("level").alias("avg_level"),
        F.avg(F.col("leak_against") - F.col("leak_for")).alias("avg_leak_diff"),
    )


def favorable_outcome(seq: Seq, min_n: int = 10, exact: bool = True) -> DataFrame:
    """After a favourable event: does the next metric differ by outcome?"""
    rows = tl.with_next(seq, ["metric"]).df.filter((F.col("metric") > HIGH) & F.col("next_metric").isNotNull())
    return hy.mann_whitney(rows, [], "win", "next_metric", 1, 0, "two-sided", min_n, exact=exact)


def debt_credit_combined(seq: Seq, exact: bool = True) -> DataFrame:
    """Both zones, three next values: one table over one timeline."""
    debt = debt_extinction(seq).withColumn("section", F.lit("debt"))
    rows = measures(after_zone(seq, "credit"), ["win"], _next3())
    credit = hy.mann_whitney(rows, ["measure"], "win", "value", 1, 0, "two-sided", 10, exact=exact)
    return debt.unionByName(credit.withColumn("section", F.lit("credit")))


def defeat_quality(seq: Seq, min_n: int = 10, exact: bool = True) -> DataFrame:
    """A crushing loss (0 to 3) against a close one (difference of 1): next metric."""
    rows = defeat_rows(seq)
    return hy.mann_whitney(rows, [], "quality", "next_metric", "crushing", "close", "greater", min_n, exact=exact)


def defeat_rows(seq: Seq) -> DataFrame:
    rows = tl.with_next(seq, ["metric"]).df.filter((F.col("win") == 0) & F.col("metric").isNotNull() & F.col("next_metric").isNotNull())
    kind = F.when((F.col("score_for") == 0) & (F.col("score_against") == 3), "crushing").when(
        F.col("score_against") - F.col("score_for") == 1, "close"
    )
    return rows.withColumn("quality", kind).filter(kind.isNotNull())


def state_of(metric: str = "metric") -> Column:
    return zone(metric, LOW, HIGH, ("Debt", "Normal", "Credit"))


def episode_rows(seq: Seq) -> Seq:
    """Events with metric and level, as runs of Debt / Normal / Credit; gaps are skipped."""
    valid = seq.filter(F.col("metric").isNotNull() & F.col("level").isNotNull())
    return valid.with_columns({"state": state_of()})


def episode_durations(seq: Seq) -> DataFrame:
    """Episode lengths per state with level and second metric of their events."""
    runs = sq.episodes(
        episode_rows(seq),
        "state",
        measures={
            "__level": F.sum("level"),
            "__m2": F.sum("metric2"),
            "__m2n": F.count("metric2"),
        },
    )
    return runs.groupBy("state").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg("length").alias("avg_length"),
        F.max("length").alias("max_length"),
        F.sum("length").alias("events"),
        (F.sum("__level") / F.sum("length")).alias("avg_level"),
        F.coalesce(F.try_divide(F.sum("__m2"), F.sum("__m2n")), F.lit(0.0)).alias("avg_metric2"),
    )


def debt_credit_levels(seq: Seq, min_n: int = 11, exact: bool = True) -> DataFrame:
    """Debt against Credit events: lower level difference, lower second metric?"""
    rows = measures(episode_rows(seq).df, ["state"], {"level": F.col("level"), "metric2": F.col("metric2")})
    return hy.mann_whitney(rows, ["measure"], "state", "value", "Debt", "Credit", "less", min_n, exact=exact)


def punishment_tradeoff(seq: Seq, min_n: int = 100) -> DataFrame:
    """Second metric against level: rank correlation, and how often both are bad at once."""
    rows = seq.df.filter(F.col("mode").isin("Ladder", "Ranked") & F.col("metric2").isNotNull() & F.col("level").isNotNull())
    bad_m, bad_l = F.col("metric2") < LOW, F.col("level") < -0.5
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(bad_m).alias("bad_metric"), F.count_if(bad_l).alias("bad_level"), F.count_if(bad_m & bad_l).alias("both_bad")
    )
    expected = F.col("bad_metric").cast("double") * F.col("bad_level") / F.col("total")
    ratio = F.coalesce(F.try_divide(F.col("both_bad"), expected), F.lit(0.0))
    out = counts.withColumn("expected", expected).withColumn("ratio", ratio)
    out = out.withColumn("verdict", F.when(F.col("ratio") < 0.85, "tradeoff").when(F.col("ratio") > 1.15, "double").otherwise("independent"))
    rho = hy.spearman(rows, [], "metric2", "level").select("rho", "p")
    return out.crossJoin(rho).filter(F.col("total") >= min_n)  # one row each


RISKS = ("Loss", "Loss2", "Loss3", "Counter", "Counter2", "Counter3")


def risk_rows(seq: Seq, pity: float = 60.0, bad: float = 40.0) -> DataFrame:
    """One row per event and risk it carries, with the pity group of the next event."""
    s = tl.with_prev(tl.with_next(seq, ["metric"]), ["win", "metric"], 2)
    rows = s.df.filter((F.col("win") == 0) & F.col("next_metric").isNotNull())
    lost1, lost2 = F.coalesce(F.col("prev_win") == 0, F.lit(False)), F.coalesce(F.col("prev2_win") == 0, F.lit(False))
    c0 = F.coalesce(F.col("metric") < bad, F.lit(False))
    c1 = lost1 & F.coalesce(F.col("prev_metric") < bad, F.lit(False))
    c2 = lost2 & F.coalesce(F.col("prev2_metric") < bad, F.lit(False))
    flags = [F.lit(True), lost1, lost1 & lost2, c0, c0 & c1, c0 & c1 & c2]
    risks = F.array_compact(F.array(*[F.when(f, F.lit(name)) for name, f in zip(RISKS, flags)]))
    return rows.select(
        *seq.keys,
        F.explode(risks).alias("risk"),
        F.when(F.col("next_metric") > pity, "pity").otherwise("none").alias("grp"),
        (F.col("n") - F.col("pos")).alias("remaining"),
        "break_s",
    )


def pity_and_session_length(seq: Seq, min_n: int = 10, exact: bool = True) -> DataFrame:
    """After a risk event: does a favourable next event go with more remaining events?"""
    return hy.mann_whitney(risk_rows(seq), ["risk"], "grp", "remaining", "pity", "none", "greater", min_n, exact=exact)


def pity_and_return_time(seq: Seq, min_n: int = 10, exact: bool = True) -> DataFrame:
    """After a risk event: does a favourable next event go with a shorter break (hours)?"""
    rows = risk_rows(seq).filter(F.col("break_s").isNotNull())
    out = hy.mann_whitney(rows, ["risk"], "grp", "break_s", "pity", "none", "less", min_n, exact=exact)
    return out.withColumns({"mean1": F.col("mean1") / 3600, "mean2": F.col("mean2") / 3600})


def cannon_fodder(seq: Seq, low: float = 0.1, high: float = 2.0, exact: bool = True) -> DataFrame:
    """Metric under low and under high stress before the event."""
    rows = tl.with_stress(seq).df.filter(F.col("metric").isNotNull())
    grp = F.when(F.col("stress_before") <= low, "low").when(F.col("stress_before") >= high, "high")
    test = hy.mann_whitney(rows.withColumn("grp", grp), [], "grp", "metric", "low", "high", "less", exact=exact)
    rho = hy.spearman(rows, [], "stress_before", "metric").select(F.col("n").alias("n_all"), "rho", F.col("p").alias("rho_p"))
    return test.crossJoin(rho)  # one row each


def dangerous_sequences(seq: Seq, n: int = 3, min_count: int = 10) -> DataFrame:
    """Triplets of W / L / C: frequency against independence, and quits at the session end."""
    symbol = seq.with_columns({"symbol": outcome_symbol("win", "metric")})
    spelled = sq.next_in(sq.next_in(symbol, ["symbol"], k=1), ["symbol"], k=2)
    rows = spelled.df.filter("next2_symbol IS NOT NULL").select(
        F.concat("symbol", "next_symbol", "next2_symbol").alias("triplet"),
        ((F.col("pos") + n - 1 == F.col("n")) & (F.col("stop_type") != "End")).alias("quit"),
    )
    counts = rows.groupBy("triplet").agg(F.count(F.lit(1)).alias("count"), F.count_if("quit").alias("quits"))
    totals = counts.agg(F.sum("count").alias("triplets"))
    share = symbol.df.agg(
        *[F.avg((F.col("symbol") == s).cast("double")).alias(f"p_{s}") for s in "WLC"]
    )
    out = counts.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(share))  # one row each

    def chance(at: int) -> Column:
        c = F.substring("triplet", at, 1)
        return F.when(c == "W", F.col("p_W")).when(c == "L", F.col("p_L")).otherwise(F.col("p_C"))

    expected = chance(1) * chance(2) * chance(3) * F.col("triplets")
    return (
        out.withColumn("expected", expected)
        .withColumn("ratio", F.col("count") / F.col("expected"))
        .withColumn("quit_rate", F.col("quits") / F.col("count"))
        .filter(F.col("count") >= min_count)
        .select("triplet", "count", "quits", "quit_rate", "expected", "ratio")
    )


def transitions(pairs: DataFrame, keys: list[str], a: str = "from_state", b: str = "to_state") -> DataFrame:
    """Transition matrix: observed and expected probability, marked when they differ by 0.05."""
    cells = hy.contingency(pairs, keys, a, b)
    full = hy.with_margins(cells, keys, a, b)
    observed, expected = F.col("cell") / F.col("row_n"), F.col("col_n") / F.col("total")
    return full.select(
        *keys, a, b, "cell", observed.alias("observed"), expected.alias("expected"), (F.abs(observed - expected) > 0.05).alias("marked")
    )


def markov_pairs(seq: Seq) -> DataFrame:
    """In-session pairs: three same-state chains and three outcome -> next state chains."""
    labels, sides = ("Unfavorable", "Even", "Favorable"), ("Disadvantage", "Even", "Advantage")
    rows = tl.with_next(seq, ["metric", "metric2", "level"]).df.filter("has_next")

    def states(prefix: str) -> dict[str, Column]:
        return {
            "metric": zone(f"{prefix}metric", LOW, HIGH, labels),
            "metric2": zone(f"{prefix}metric2", LOW, HIGH, labels),
            "level": zone(f"{prefix}level", -0.5, 0.5, sides),
        }

    now, then = states(""), states("next_")
    outcome = F.when(F.col("win") == 1, "Win").otherwise("Loss")
    pairs = [F.struct(F.lit(c).alias("chain"), now[c].alias("from_state"), then[c].alias("to_state")) for c in now]
    pairs += [F.struct(F.lit(f"outcome_{c}").alias("chain"), outcome.alias("from_state"), then[c].alias("to_state")) for c in then]
    return rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("from_state IS NOT NULL AND to_state IS NOT NULL")


def markov_chains(seq: Seq) -> DataFrame:
    return transitions(markov_pairs(seq), ["chain"])


def markov_tests(seq: Seq) -> DataFrame:
    """Chi-square of the three same-state chains."""
    pairs = markov_pairs(seq).filter(~F.col("chain").startswith("outcome_"))
    return hy.chi_square(hy.contingency(pairs, ["chain"], "from_state", "to_state"), ["chain"], "from_state", "to_state")


def rated_rows(df: DataFrame, modes: tuple[str, ...] = ("Ladder",)) -> DataFrame:
    """Events of the modes with a rating that is neither missing nor zero."""
    return df.filter(F.col("mode").isin(*modes) & F.col("rating_before").isNotNull() & (F.col("rating_before") != 0))


def return_rows(seq: Seq, width: int = 200, min_n: int = 20, n: int = 2) -> DataFrame:
    """First event after each stop, with the streak that ended the session before it.

    ``residual``: level minus its rating bucket's mean minus the entity's own bias.
    """
    rated = rated_rows(seq.df, ("Ladder", "Ranked")).filter("level IS NOT NULL").withColumn("b", bucket("rating_before", width))
    curve = bk.baseline(rated, "b", "level", min_n)
    bias = bk.entity_bias(bk.residualize(rated, "b", "level", curve), "entity")
    # Tail of the session: this row is the last, the one before it the second last.
    s = sq.next_in(seq, ["metric"], k=-1)
    bad = (F.col("metric") < LOW) & (F.col("prev_metric") < LOW)
    good = (F.col("metric") > HIGH) & (F.col("prev_metric") > HIGH)
    known = F.col("metric").isNotNull() & F.col("prev_metric").isNotNull()
    tail = F.when(F.col("n") < n, "control").when(known, F.when(bad, "bad").when(good, "good").otherwise("control"))
    s = s.with_columns({"__tail": tail})
    s = s.near(
        {"tail": lambda w: F.lag("__tail").over(w), "prev_stop": lambda w: F.lag("stop_type").over(w)}, back=1
    )
    firsts = s.df.filter("is_start AND prev_stop IS NOT NULL AND metric IS NOT NULL AND tail IS NOT NULL")
    firsts = firsts.select("entity", "prev_stop", "tail", "metric", "metric2", "level", bucket("rating_before", width).alias("b"))
    joined = firsts.join(curve, "b", "left").join(bias, "entity", "left")
    return joined.withColumn("residual", F.col("level") - F.col("expected") - F.coalesce(F.col("bias"), F.lit(0.0)))


def return_after_streak(rows: DataFrame, min_control: int = 5) -> DataFrame:
    """Means of the first event by stop tier and tail."""
    out = rows.groupBy("prev_stop", "tail").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("metric", "metric2", "level", "residual")],
    )
    enough = rows.filter("tail = 'control'").groupBy("prev_stop").count().filter(F.col("count") >= min_control)
    return out.join(enough.select("prev_stop"), "prev_stop", "left_semi")


def return_tests(rows: DataFrame, min_n: int = 5, exact: bool = True) -> DataFrame:
    """Residual after a bad tail lower, after a good tail higher than control."""
    kept = rows.filter("residual IS NOT NULL")
    out = [
        hy.mann_whitney(kept, ["prev_stop"], "tail", "residual", side, "control", alt, min_n, exact=exact).withColumn("tail", F.lit(side))
        for side, alt in (("bad", "less"), ("good", "greater"))
    ]
    return out[0].unionByName(out[1])


def return_trend(rows: DataFrame) -> DataFrame:
    """After bad tails: rank correlation of the length of the break with the next values."""
    tier = F.when(F.col("prev_stop") == "Short", 0).when(F.col("prev_stop") == "Long", 1).otherwise(2)
    bad = rows.filter("tail = 'bad' AND metric2 IS NOT NULL AND level IS NOT NULL").withColumn("tier", tier)
    return hy.spearman(measures(bad, ["tier"], {"metric2": F.col("metric2"), "level": F.col("level")}), ["measure"], "tier", "value", 11)


def pity_lift(seq: Seq, n: int = 3, limit: float = 60.0) -> DataFrame:
    """P(metric > limit) after n losses against all events of sessions longer than n."""
    s = sq.last_n_all(seq, {"lost": F.col("win") == 0}, n)
    rows = s.df.filter((F.col("n") > n) & F.col("metric").isNotNull())
    hit = F.col("metric") > limit
    out = rows.agg(
        F.count(F.lit(1)).alias("base_n"), F.count_if(hit).alias("base_hits"), F.count_if("lost").alias("n"), F.count_if(F.col("lost") & hit).alias("hits")
    ).withColumn("baseline", F.col("base_hits") / F.col("base_n"))
    return hy.binomial_lift(out, "hits", "n", "baseline")


def paywall(seq: Seq, width: int = 400, min_total: int = 50, min_n: int = 10, exact: bool = True) -> DataFrame:
    """Level after a win against after a loss (across sessions) per rating bucket."""
    s = seq.near({"before_win": lambda w: F.lag("win").over(w)}, back=1)
    rows = rated_rows(s.df).filter("level IS NOT NULL AND before_win IS NOT NULL").withColumn("bucket", bucket("rating_before", width))
    out = hy.mann_whitney(rows, ["bucket"], "before_win", "level", 1, 0, "less", min_n, exact=exact)
    delta = F.col("mean1") - F.col("mean2")
    return out.filter(F.col("n1") + F.col("n2") >= min_total).withColumn("delta", delta).withColumn(
        "flagged", (F.col("p") < 0.05) & (delta < -0.1)
    )


def rating_at_streaks(seq: Seq, n: int = 3, back: int = 50, min_rows: int = 10) -> DataFrame:
    """Is the rating above (below) its recent mean at the start of bad (good) runs?"""
    rated = seq.filter(
        (F.col("mode") == "Ladder") & F.col("rating_before").isNotNull() & (F.col("rating_before") != 0) & F.col("metric2").isNotNull()
    )
    s = sq.rolling_mean(rated, "rating_before", "recent", back, min_rows)
    s = s.near(
        {
            "full": lambda w: F.lead(F.lit(1), n - 1).over(w).isNotNull(),
            "run_rating": lambda w: F.avg("rating_before").over(w.rowsBetween(0, n - 1)),
            "top": lambda w: F.max("metric2").over(w.rowsBetween(0, n - 1)),
            "low": lambda w: F.min("metric2").over(w.rowsBetween(0, n - 1)),
        },
        ahead=n - 1,
    )
    rows = s.df.filter("recent IS NOT NULL")
    bad, good = F.col("full") & (F.col("top") < LOW), F.col("full") & (F.col("low") > HIGH)
    off = F.col("run_rating") - F.col("recent")
    base = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("rating_before") > F.col("recent")).alias("above"),
        F.count_if(F.col("rating_before") < F.col("recent")).alias("below"),
        F.count_if(bad).alias("bad_n"),
        F.count_if(bad & (off > 0)).alias("bad_hits"),
        F.avg(F.when(bad, off)).alias("bad_delta"),
        F.count_if(good).alias("good_n"),
        F.count_if(good & (off < 0)).alias("good_hits"),
        F.avg(F.when(good, off)).alias("good_delta"),
    )
    kinds = F.array(
        F.struct(F.lit("bad_above").alias("kind"), F.col("bad_n").alias("n"), F.col("bad_hits").alias("hits"), F.col("bad_delta").alias("avg_delta"), (F.col("above") / F.col("total")).alias("baseline")),
        F.struct(F.lit("good_below").alias("kind"), F.col("good_n").alias("n"), F.col("good_hits").alias("hits"), F.col("good_delta").alias("avg_delta"), (F.col("below") / F.col("total")).alias("baseline")),
    )
    return hy.binomial_lift(base.select(F.explode(kinds).alias("k")).select("k.*"), "hits", "n", "baseline")


def meta_ranges(seq: Seq, width: int = 200, min_n: int = 50) -> tuple[DataFrame, DataFrame]:
    """Second metric per rating bucket, and Kruskal-Wallis over the buckets."""
    rows = rated_rows(seq.df).filter("metric2 IS NOT NULL").withColumn("bucket", bucket("rating_before", width))
    stats = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("metric2").alias("avg"), F.stddev_samp("metric2").alias("sd"))
    return stats.filter(F.col("n") >= min_n), hy.kruskal(rows, [], "bucket", "metric2", min_n)


def climbing_impact(seq: Seq, more_than: int = 20) -> DataFrame:
    """Per entity Spearman of rating with each metric; mean and significant counts."""
    rows = measures(
        rated_rows(seq.df), ["entity", "rating_before"], {c: F.col(c) for c in ("metric", "metric2", "level")}
    )
    per = hy.spearman(rows, ["entity", "measure"], "rating_before", "value", more_than + 1).filter("rho IS NOT NULL")
    return per.groupBy("measure").agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("rho").alias("avg_rho"),
        F.count_if((F.col("rho") > 0) & (F.col("p") < 0.05)).alias("sig_pos"),
        F.count_if((F.col("rho") < 0) & (F.col("p") < 0.05)).alias("sig_neg"),
    )


def hook_by_threshold(seq: Seq, first: int = 3, min_sessions: int = 20, width: int | None = None) -> DataFrame:
    """First events of a session against the rest, by the band of the session's first rating.

    The band is the last threshold at or under it, or a fixed-width bucket with ``width``.
    """
    # The first rating travels along the session.
    s = seq.running({"__s": ("max", F.when(F.col("is_start"), F.struct("session_no", "rating_before")))})
    start = F.col("__s")["rating_before"]
    band = bucket(start, width) if width else bk.last_threshold(start)
    rows = s.df.filter((F.col("n") > first) & start.isNotNull() & (start != 0)).withColumn("band", band)
    hook = F.col("pos") <= first

    def pair(name: str, value: Column, scale: float = 1.0) -> list[Column]:
        return [
            (F.coalesce(F.avg(F.when(hook, value)), F.lit(0.0)) * scale).alias(f"hook_{name}"),
            (F.coalesce(F.avg(F.when(~hook, value)), F.lit(0.0)) * scale).alias(f"rest_{name}"),
        ]

    out = rows.groupBy("band").agg(
        F.count_if("is_start").alias("sessions"),
        *pair("win", F.col("win").cast("double"), 100.0),
        *pair("metric", F.col("metric")),
        *pair("level", F.col("level")),
    )
    return out.filter(F.col("sessions") >= min_sessions)


def skill_rows(seq: Seq) -> DataFrame:
    rows = seq.df.filter("metric IS NOT NULL AND leak_for IS NOT NULL AND leak_against IS NOT NULL")
    skill = F.when(F.col("leak_for") < F.col("leak_against"), "Better").when(F.col("leak_for") > F.col("leak_against"), "Worse").otherwise("Equal")
    return rows.withColumn("zone", zone("metric", LOW, HIGH, ("Bad", "Even", "Good"))).withColumn("skill", skill)


def skill_matrix(seq: Seq, min_n: int = 10) -> DataFrame:
    """Win rate per zone and better / worse play."""
    return (
        skill_rows(seq).filter("skill <> 'Equal'").groupBy("zone", "skill")
        .agg(F.count(F.lit(1)).alias("n"), (F.avg("win") * 100).alias("win_pct")).filter(F.col("n") >= min_n)
    )


def leak_pressure(seq: Seq, exact: bool = True) -> DataFrame:
    return hy.mann_whitney(skill_rows(seq), [], "zone", "leak_for", "Bad", "Good", "greater", exact=exact)


def debt_start_pairs(seq: Seq) -> DataFrame:
    """First event of a debt episode and the next event with the same deck: both levels."""
    s = tl.with_prev(tl.with_next(seq, ["level", "deck"]), ["metric"])
    return s.df.filter(
        (F.col("metric") < LOW) & ~F.coalesce(F.col("prev_metric") < LOW, F.lit(False)) & (F.col("deck") == F.col("next_deck"))
        & F.col("level").isNotNull() & F.col("next_level").isNotNull()
    )


def debt_progression(seq: Seq, min_n: int = 20, exact: bool = True) -> DataFrame:
    return hy.wilcoxon(debt_start_pairs(seq), [], "level", "next_level", "two-sided", min_n, exact=exact)


def residual_after_debt(seq: Seq, width: int = 200, min_bucket: int = 50, min_n: int = 10, exact: bool = True) -> DataFrame:
    """Residual level of the event after a debt event, win against loss."""
    rated = rated_rows(seq.df).filter("level IS NOT NULL").withColumn("b", bucket("rating_before", width))
    curve = bk.baseline(rated, "b", "level", min_bucket)
    rows = tl.with_next(seq, ["mode", "rating_before", "level"]).df.filter(
        (F.col("metric") < LOW) & (F.col("next_mode") == "Ladder") & (F.col("next_rating_before") != 0) & F.col("next_level").isNotNull()
    )
    rows = bk.residualize(rows.withColumn("b", bucket("next_rating_before", width)), "b", "next_level", curve)
    return hy.mann_whitney(rows, [], "win", "residual", 1, 0, "less", min_n, exact=exact)


def worsening_rows(seq: Seq) -> DataFrame:
    """Change from an unfavourable event to the next one, in metric and level."""
    rows = tl.with_next(seq, ["metric", "level"]).df.filter((F.col("metric") < LOW) & F.col("next_metric").isNotNull())
    long = measures(
        rows, ["win"], {"metric": F.col("next_metric") - F.col("metric"), "level": F.col("next_level") - F.col("level")}
    )
    return long.filter("value IS NOT NULL").withColumn("value", F.round("value", 9))


def worsening_shares(rows: DataFrame) -> DataFrame:
    return rows.groupBy("measure", "win").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_delta"), (F.avg((F.col("value") < 0).cast("double")) * 100).alias("worse_pct")
    )


def worsening_test(rows: DataFrame, min_n: int = 10, exact: bool = True) -> DataFrame:
    return hy.mann_whitney(rows, ["measure"], "win", "value", 1, 0, "less", min_n, exact=exact)


def speed_rows(seq: Seq, back: int = 5) -> DataFrame:
    """Net wins in the last events of the session, next to the second metric and level."""
    s = seq.near({"net": lambda w: F.sum(2 * F.col("win") - 1).over(w.rowsBetween(-back, -1))}, back=back)
    return s.df.filter((F.col("pos") > back) & F.col("metric2").isNotNull() & F.col("level").isNotNull())


def speed_table(rows: DataFrame, min_n: int = 20) -> DataFrame:
    out = rows.groupBy("net").agg(F.count(F.lit(1)).alias("n"), F.avg("metric2").alias("avg_metric2"), F.avg("level").alias("avg_level"))
    return out.filter(F.col("n") >= min_n)


def speed_correlation(rows: DataFrame, min_n: int = 20, min_all: int = 101) -> DataFrame:
    kept = speed_table(rows, min_n).select("net")
    return hy.spearman(rows.join(kept, "net", "left_semi"), [], "net", "metric2", min_all)


def hot_against_tilt(rows: DataFrame, exact: bool = True) -> DataFrame:
    temper = F.when(F.col("net") >= 3, "hot").when(F.col("net") <= -3, "tilt")
    return hy.mann_whitney(rows.withColumn("temper", temper), [], "temper", "metric2", "hot", "tilt", "less", exact=exact)


def metric_deltas(seq: Seq) -> DataFrame:
    """Change of the metric from event to event, with its direction."""
    s = seq.filter("metric IS NOT NULL").near({"before": lambda w: F.lag("metric").over(w)}, back=1)
    delta = F.col("metric") - F.col("before")
    return s.df.filter("before IS NOT NULL").select(
        "entity", "event_id", delta.alias("delta"), F.when(delta > 0, "up").when(delta < 0, "down").otherwise("same").alias("direction")
    )


def stop_patterns(seq: Seq) -> DataFrame:
    """Last up to three outcomes of a session against its stop tier."""
    s = tl.with_prev(seq, ["win"], 2)
    letter = {c: F.when(F.col(c) == 1, "W").when(F.col(c) == 0, "L") for c in ("win", "prev_win", "prev2_win")}
    pattern = F.concat_ws("", letter["prev2_win"], letter["prev_win"], letter["win"])
    rows = s.df.filter("is_last AND stop_type <> 'End'").withColumn("pattern", pattern)
    return rows.groupBy("pattern").pivot("stop_type", ["Short", "Long", "Quit"]).count().na.fill(0)
