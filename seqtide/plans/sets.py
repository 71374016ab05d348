"""Decks and items: switches, item frequency and lift, archetype fairness, targeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtide.functions.scalar import bucket, day_slot, zone
from seqtide.operators import baskets as bs
from seqtide.operators import buckets as bk
from seqtide.operators import hypothesis as hy
from seqtide.operators import resample as rs
from seqtide.operators import sequence as sq
from seqtide.operators.ordered import Seq
from seqtide.plans import timeline as tl
from seqtide.plans.outcomes import measures, rated_rows
from seqtide.session import cut_lineage

AHEAD = 4


# --- deck switches -----------------------------------------------------------


def switch_pairs(seq: Seq, value: str = "metric2") -> DataFrame:
    """Event-to-event pairs across sessions with zones and the archetype-switch flag."""
    s = seq.near({"n_arch": lambda w: F.lead("arch").over(w), "n_value": lambda w: F.lead(value).over(w)}, ahead=1)
    rows = s.df.filter(F.col(value).isNotNull() & F.col("n_value").isNotNull() & F.col("arch").isNotNull() & F.col("n_arch").isNotNull())
    return rows.select(
        *seq.keys, "event_id", (F.col("arch") != F.col("n_arch")).alias("switch"), zone(value).alias("from_zone"), zone("n_value").alias("to_zone")
    )


def switch_transitions(pairs: DataFrame) -> DataFrame:
    """Share of each next zone, with and without a switch."""
    cells = pairs.groupBy("switch", "from_zone", "to_zone").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("switch", "from_zone").agg(F.sum("n").alias("from_n"))
    return cells.join(rows, ["switch", "from_zone"]).withColumn("pct", F.col("n") * 100.0 / F.col("from_n"))


def _steps(w, column: str) -> Column:
    return F.array(*[F.lead(column, k).over(w) for k in range(1, AHEAD + 1)])


def _same_until(archs: str) -> Column:
    """Number of leading steps whose archetype equals that of the first step."""
    out = F.lit(0)
    for k in range(AHEAD, 0, -1):
        same = F.coalesce(F.element_at(archs, k) == F.element_at(archs, 1), F.lit(False))
        out = F.when(same, 1 + out).otherwise(0)
    return out


def switch_trajectories(seq: Seq) -> DataFrame:
    """After a bad event: means of the next steps until the archetype changes again."""
    s = seq.near(
        {
            "archs": lambda w: _steps(w, "arch"),
            "m2s": lambda w: _steps(w, "metric2"),
            "lvs": lambda w: _steps(w, "level"),
        },
        ahead=AHEAD,
    )
    rows = s.df.filter((F.col("metric2") < 45) & F.col("m2s")[0].isNotNull() & F.col("arch").isNotNull() & F.col("archs")[0].isNotNull())
    rows = rows.withColumn("switch", F.col("arch") != F.col("archs")[0]).withColumn("__k", _same_until("archs"))
    steps = rows.select("switch", F.posexplode(F.slice(F.arrays_zip("m2s", "lvs"), F.lit(1), F.col("__k"))).alias("step", "v"))
    return steps.groupBy("switch", (F.col("step") + 1).alias("step")).agg(
        F.count("v.m2s").alias("n"), F.avg("v.m2s").alias("avg_metric2"), F.avg("v.lvs").alias("avg_level")
    )


def switch_level_rows(seq: Seq, levels: DataFrame) -> DataFrame:
    """Archetype switches with the change of the deck's mean level, the levels of the events
    before (same archetype, newest first) and of the steps after."""
    lv = levels.select("deck", F.col("avg_level").alias("deck_level"))
    # The level goes with the event, so the old and the new deck's level are neighbours.
    joined = seq.subset(seq.frame.join(lv, "deck", "left"))

    def backs(w, column: str) -> Column:
        return F.array(F.col(column), *[F.lag(column, k).over(w) for k in range(1, AHEAD)])

    s = joined.near(
        {
            "archs": lambda w: _steps(w, "arch"),
            "lvs": lambda w: _steps(w, "level"),
            "b_archs": lambda w: backs(w, "arch"),
            "b_lvs": lambda w: backs(w, "level"),
            "n_deck_level": lambda w: F.lead("deck_level").over(w),
        },
        back=AHEAD - 1,
        ahead=AHEAD,
    )
    rows = s.df.filter(
        (F.col("arch") != F.col("archs")[0]) & F.col("deck_level").isNotNull() & F.col("n_deck_level").isNotNull()
    )
    change = F.when(F.col("n_deck_level") < F.col("deck_level") - 0.1, "level_down").when(
        F.col("n_deck_level") > F.col("deck_level") + 0.1, "level_up"
    ).otherwise("no_change")
    rows = rows.select(
        change.alias("category"),
        F.array_compact(F.slice("b_lvs", F.lit(1), _same_until("b_archs"))).alias("pre"),
        F.slice("lvs", F.lit(1), _same_until("archs")).alias("post"),
    )
    return rows.filter((F.size("pre") > 0) & (F.size(F.array_compact("post")) > 0))


def switch_levels(rows: DataFrame) -> DataFrame:
    """Mean level before and after the switch, with and without the first event after it."""

    def total(c: Column) -> Column:
        return F.aggregate(F.array_compact(c), F.lit(0.0), lambda a, x: a + x)

    later = F.slice("post", 2, AHEAD - 1)
    out = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("switches"),
        (F.sum(total(F.col("pre"))) / F.sum(F.size("pre"))).alias("avg_pre"),
        (F.sum(total(F.col("post"))) / F.sum(F.size(F.array_compact("post")))).alias("avg_post"),
        F.try_divide(F.sum(total(later)), F.sum(F.size(F.array_compact(later)))).alias("__later"),
    )
    return out.withColumn("avg_post_later", F.coalesce("__later", "avg_post")).withColumn("delta", F.col("avg_post") - F.col("avg_pre")).drop("__later")


def switch_level_steps(rows: DataFrame) -> DataFrame:
    steps = rows.select("category", F.posexplode("post").alias("step", "level")).filter("level IS NOT NULL")
    return steps.groupBy("category", (F.col("step") + 1).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.avg("level").alias("avg_level"))


def archetype_strength(df: DataFrame, min_n: int = 50) -> DataFrame:
    """Win rate of an archetype and the mean level difference it meets."""
    return df.filter("arch IS NOT NULL AND level IS NOT NULL").groupBy("arch").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("win") * 100).alias("win_pct"), F.avg("level").alias("avg_level")
    ).filter(F.col("n") >= min_n)


def archetype_correlation(df: DataFrame, min_n: int = 50) -> DataFrame:
    rows = archetype_strength(df, min_n).select(F.round("win_pct", 9).alias("win_pct"), F.round("avg_level", 9).alias("avg_level"))
    return hy.spearman(rows, [], "win_pct", "avg_level", 5)


# --- levels after debt, with the rejection funnel -------------------------------


def funnel_rows(seq: Seq) -> DataFrame:
    """In-session pairs with the first reason to reject them."""
    rows = tl.with_next(seq, ["mode", "deck", "opp_deck", "rating_before"]).df.filter("has_next")
    reason = (
        F.when((F.col("mode") != "Ladder") | (F.col("next_mode") != "Ladder"), "no_ladder")
        .when(F.col("metric").isNull(), "no_metric")
        .when(F.col("metric") >= 45, "no_debt")
        .when(F.col("deck") != F.col("next_deck"), "deck_change")
        .when(F.col("win").isNull(), "no_outcome")
        .when(F.col("next_opp_deck").isNull() | F.col("next_rating_before").isNull() | (F.col("next_rating_before") == 0), "incomplete")
        .otherwise("valid")
    )
    return rows.withColumn("reason", reason)


def level_volatility_rows(seq: Seq, levels: DataFrame, width: int = 100) -> DataFrame:
    """Opponent basket level of the event after a debt event, raw and against its bucket's mean."""
    lv = levels.select(F.col("deck").alias("opp_deck"), F.col("avg_level").alias("opp_level")).filter("opp_level > 0")
    rated = rated_rows(seq.df).join(lv, "opp_deck").withColumn("b", bucket("rating_before", width))
    curve = bk.baseline(rated, "b", "opp_level", 1)
    valid = funnel_rows(seq).filter("reason = 'valid'").withColumn("b", bucket("next_rating_before", width))
    rows = valid.join(lv.withColumnRenamed("opp_deck", "next_opp_deck"), "next_opp_deck")
    return bk.residualize(rows, "b", "opp_level", curve)


def level_volatility(rows: DataFrame, min_n: int = 11) -> DataFrame:
    long = measures(rows, ["win"], {"raw": F.col("opp_level"), "residual": F.col("residual")})
    return hy.welch(long, ["measure"], "win", "value", 1, 0, "two-sided", min_n)


# --- items -----------------------------------------------------------------------


def opponent_events(seq: Seq, width: int) -> DataFrame:
    return rated_rows(seq.df).withColumn("bucket", bucket("rating_before", width))


def dominant_items(seq: Seq, lines: DataFrame, width: int = 150, min_events: int = 50, min_buckets: int = 5, above: float = 2.0) -> DataFrame:
    """Items whose share in a rating bucket is far above their share elsewhere."""
    support = bs.item_support(opponent_events(seq, width), lines, "bucket", "opp_deck", min_events)
    return bs.dominance(support, "bucket", min_buckets).filter(F.col("z") > above)


def meta_transitions(seq: Seq, lines: DataFrame, width: int = 150, min_events: int = 50, n: int = 15) -> DataFrame:
    """Jaccard distance of the top items between adjacent rating buckets."""
    support = bs.item_support(opponent_events(seq, width), lines, "bucket", "opp_deck", min_events)
    return bs.topn_change(bs.topn_sets(support, "bucket", n), "bucket").withColumn("size", F.size("items")).drop("items")


def bucket_hostility(seq: Seq, width: int = 150, min_entities: int = 5) -> DataFrame:
    """Per bucket: mean over entities of (own overall mean - own mean in the bucket)."""
    rows = opponent_events(seq, width).filter("metric2 IS NOT NULL")
    cells = rows.groupBy("entity", "bucket").agg(F.sum("metric2").alias("__s"), F.count(F.lit(1)).alias("__n"))
    own = cells.groupBy("entity").agg((F.sum("__s") / F.sum("__n")).alias("__g"))
    out = cells.join(own, "entity").withColumn("h", F.col("__g") - F.col("__s") / F.col("__n"))
    out = out.groupBy("bucket").agg(F.count(F.lit(1)).alias("entities"), F.avg("h").alias("hostility")).filter(F.col("entities") >= min_entities)
    verdict = F.when(F.col("hostility") > 2, "hostile").when(F.col("hostility") < -2, "friendly").otherwise("neutral")
    return out.withColumn("verdict", verdict)


def loss_start_density(seq: Seq, width: int = 150, min_len: int = 3) -> DataFrame:
    """Where in a bucket long losing runs begin: start (30), middle, end (30), per point."""
    ladder = seq.filter("mode = 'Ladder' AND rating_before IS NOT NULL AND rating_before <> 0")
    runs = sq.episodes(ladder, "win", group=None, measures={"start_rating": F.min_by("rating_before", F.struct("ts", "event_id"))})
    off = F.pmod(F.col("start_rating"), F.lit(width))
    starts = runs.filter((F.col("win") == 0) & (F.col("length") >= min_len))
    out = starts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(off < 30).alias("n_start"),
        F.count_if((off >= 30) & (off < width - 30)).alias("n_mid"),
        F.count_if(off >= width - 30).alias("n_end"),
    )
    out = out.withColumns(
        {"d_start": F.col("n_start") / 30, "d_mid": F.col("n_mid") / (width - 60), "d_end": F.col("n_end") / 30}
    )
    verdict = F.when(F.col("d_end") > F.col("d_mid") * 1.2, "end").when(F.col("d_start") > F.col("d_mid") * 1.2, "start").otherwise("even")
    return out.withColumn("verdict", verdict)


def counter_items(seq: Seq, lines: DataFrame, width: int = 1000, n: int = 15, min_events: int = 50, min_item: int = 10) -> DataFrame:
    """Items over-represented in counter events per rating bucket: the top by lift."""
    counter = F.coalesce(F.col("metric2") < 40, F.lit(False))
    lift = bs.item_lift(opponent_events(seq, width), lines, "bucket", "opp_deck", counter, min_events, min_item)
    # Rounded first: places must not depend on the last digit of a quotient.
    top = bs.top_n(lift.withColumn("lift", F.round("lift", 9)), ["bucket"], "lift", "item", n)
    verdict = (
        F.when((F.col("lift") > 1.5) & (F.col("freq") > 0.10), "meta killer").when(F.col("lift") > 2, "sniper").when(F.col("lift") < 0.7, "safe").otherwise("")
    )
    return top.select("bucket", "place", "item", "n", "freq", "freq_hit", "lift", verdict.alias("verdict"))


def gate_meta_shock(rows: DataFrame, lines: DataFrame, n: int = 20) -> DataFrame:
    """Distance between the top items of adjacent zones around each threshold."""
    counts = bs.item_counts(rows, lines, ["threshold", "zone"], "opp_deck")
    top = bs.top_n(counts, ["threshold", "zone"], "n", "item", n)
    sets = top.groupBy("threshold", "zone").agg(F.sort_array(F.collect_set("item")).alias("items"))
    order = F.when(F.col("zone") == "pre_stable", 0).when(F.col("zone") == "pre_early", 1).when(F.col("zone") == "post_early", 2).otherwise(3)
    return bs.topn_change(sets.withColumn("step", order.cast("long")), "step", ["threshold"]).drop("items")


# --- fairness of pairings ----------------------------------------------------------


def fairness_cells(rows: DataFrame, min_key: int = 20, min_arch: int = 3) -> DataFrame:
    """Own against opponent archetype per (8-hour slot, 1500-wide rating bucket), rare ones left out.

    The cells are counted first, so all further steps see categories and not events.
    """
    k = ["slot", "bucket"]
    keyed = rated_rows(rows).withColumns({"slot": day_slot("hour", 8), "bucket": bucket("rating_before", 1500)})
    cells = cut_lineage(
        keyed.filter("arch IS NOT NULL AND opp_arch IS NOT NULL").groupBy(*k, "arch", "opp_arch").agg(F.count(F.lit(1)).alias("cell"))
    )

    def at_least(df: DataFrame, extra: list[str], n: int) -> DataFrame:
        kept = df.groupBy(*k, *extra).agg(F.sum("cell").alias("__n")).filter(F.col("__n") >= n).select(*k, *extra)
        return df.join(kept, [*k, *extra], "left_semi")

    cells = at_least(cells, [], min_key)
    cells = at_least(at_least(cells, ["arch"], min_arch), ["opp_arch"], min_arch)
    # A small table (categories only) that the tests read many times: computed once.
    return cut_lineage(at_least(cells, [], min_key))


def matchmaking_fairness(rows: DataFrame) -> DataFrame:
    return hy.chi_square(fairness_cells(rows), ["slot", "bucket"], "arch", "opp_arch", yates=False)


def matchmaking_fairness_mc(rows: DataFrame, reps: int = 2000) -> DataFrame:
    return rs.chi_square_mc(fairness_cells(rows), ["slot", "bucket"], "arch", "opp_arch", reps)


def players_per_bucket(rows: DataFrame) -> DataFrame:
    keyed = rated_rows(rows).withColumns({"slot": day_slot("hour", 8), "bucket": bucket("rating_before", 1500)})
    return keyed.groupBy("slot", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))


def item_fairness(rows: DataFrame, lines: DataFrame, min_key: int = 50, min_arch: int = 10, share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Ranked events per (6-hour slot, region): does the presence of an opponent item depend on
    the own archetype? Returns the tests and the rate of each archetype and item."""
    k = ["slot", "region"]
    keyed = rows.filter("mode = 'Ranked' AND arch IS NOT NULL AND opp_arch IS NOT NULL").withColumn("slot", day_slot("hour", 6))
    sizes = keyed.groupBy(*k).agg(F.count(F.lit(1)).alias("key_n")).filter(F.col("key_n") >= min_key)
    archs = keyed.groupBy(*k, "arch").agg(F.count(F.lit(1)).alias("arch_n")).filter(F.col("arch_n") >= min_arch)
    counts = bs.item_counts(keyed, lines, [*k, "arch"], "opp_deck")
    common = counts.groupBy(*k, "item").agg(F.sum("n").alias("__n")).join(sizes, k).filter(F.col("__n") > F.col("key_n") * share)
    # Items over 5 percent times archetypes of the key: both lists are short by their limits.
    grid = common.select(*k, "item").join(archs, k)
    full = grid.join(counts, [*k, "arch", "item"], "left").withColumn("has", F.coalesce("n", F.lit(0)))
    cells = full.select(
        *k, "item", "arch",
        F.explode(F.array(F.struct(F.lit("yes").alias("held"), F.col("has").alias("cell")), F.struct(F.lit("no").alias("held"), (F.col("arch_n") - F.col("has")).alias("cell")))).alias("c"),
    ).select(*k, "item", "arch", "c.*")
    tests = hy.chi_square(cells.filter("cell > 0"), [*k, "item"], "arch", "held")
    rates = full.withColumn("rate", F.col("has") * 100.0 / F.col("arch_n"))
    return tests, rates


def item_fairness_top(tests: DataFrame, rates: DataFrame, n: int = 5) -> DataFrame:
    """The items with the smallest p per key, with the archetypes of highest and lowest rate."""
    k = ["slot", "region"]
    ends = rates.groupBy(*k, "item").agg(
        F.max_by("arch", F.struct("rate", "arch")).alias("max_arch"), F.max("rate").alias("max_rate"),
        F.min_by("arch", F.struct("rate", "arch")).alias("min_arch"), F.min("rate").alias("min_rate"),
    )
    found = tests.filter("p < 0.05").withColumn("__by", -F.round("p", 9))
    top = bs.top_n(found, k, "__by", "item", n)
    return top.join(ends, [*k, "item"]).select(*k, "place", "item", "chi2", "p", "max_arch", "max_rate", "min_arch", "min_rate", (F.col("max_rate") - F.col("min_rate")).alias("delta"))


# --- targeting -----------------------------------------------------------------------


def threat_groups(threats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threats (threat, trait) by the traits they have, and how often: (threat, group) and the groups' (group, trait, times).

    Threats of one group have the same answers, so what decks have against them is counted per group and never per threat.
    """
    owned = threats.filter("trait IS NOT NULL").groupBy("threat", "trait").agg(F.count(F.lit(1)).alias("times"))
    signed = owned.groupBy("threat").agg(F.sort_array(F.collect_list(F.struct("trait", "times"))).alias("traits"))
    groups = signed.groupBy("traits").agg(F.min("threat").alias("group"))
    member = signed.join(groups, "traits").select("threat", F.when(F.col("threat").isNotNull(), F.col("group")).alias("group"))
    return member, groups.select("group", F.inline("traits"))


def threat_encounters(events: DataFrame, lines: DataFrame, threats: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Do decks without an answer to an item meet it more often than decks with one?

    ``threats``: (threat, item, kind) with kind hard or soft, of any number; or (threat, trait), with ``answers`` (trait,
    item, kind) that answer every threat of a trait. A deck is safe with one hard or two soft answers. Events are counted
    per pair of decks first; what is summed per threat are the safe decks' events, the events against decks that hold it,
    and those that are both. The rest follows from the total, so no event is repeated for threats that neither side has to
    do with, and no deck for the threats that its items answer: those are told by their group.
    """
    if answers is None:
        own = F.struct("threat").alias("trait")  # not null where the threat is
        answers = threats.select(own, "item", "kind")
        threats = threats.select("threat", own).distinct()
    member, traits = threat_groups(threats.join(answers.select("trait").distinct(), "trait", "left_semi"))
    known = lines.select("deck").distinct()
    pairs = events.groupBy("deck", "opp_deck").agg(F.count(F.lit(1)).alias("uses"))
    pairs = pairs.join(known, "deck", "left_semi").join(known.withColumnRenamed("deck", "opp_deck"), "opp_deck", "left_semi")
    worth = F.when(F.col("kind") == "hard", 2 * F.col("times")).when(F.col("kind") == "soft", F.col("times")).otherwise(0)
    weighed = traits.join(answers, "trait").groupBy("group", "item").agg(F.sum(worth).alias("worth")).filter("worth > 0")
    given = lines.select("deck", "item").distinct().join(weighed, "item").groupBy("deck", "group").agg(F.sum("worth").alias("worth"))
    safe = given.filter("worth >= 2").select("deck", "group")
    held = lines.select(F.col("deck").alias("opp_deck"), F.col("item").alias("threat")).distinct().join(member, "threat")
    total = pairs.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("total"))
    by_deck = pairs.groupBy("deck").agg(F.sum("uses").alias("uses")).join(safe, "deck").groupBy("group").agg(F.sum("uses").alias("safe"))
    by_opponent = pairs.groupBy("opp_deck").agg(F.sum("uses").alias("uses")).join(held, "opp_deck").groupBy("threat").agg(F.sum("uses").alias("met"))
    met = pairs.join(held, "opp_deck").groupBy("deck", "group", "threat").agg(F.sum("uses").alias("uses"))
    both = met.join(safe, ["deck", "group"], "left_semi").groupBy("threat").agg(F.sum("uses").alias("safe_met"))
    # total is one row
    out = member.crossJoin(total).join(by_deck, "group", "left").join(by_opponent, "threat", "left").join(both, "threat", "left").fillna(0, ["safe", "met", "safe_met"])
    out = out.filter("total > 0").select(
        "threat", (F.col("total") - F.col("safe")).alias("vulnerable"), (F.col("met") - F.col("safe_met")).alias("vulnerable_met"), "safe", "safe_met"
    )
    v = F.coalesce(F.try_divide(F.col("vulnerable_met") * 100.0, F.col("vulnerable")), F.lit(0.0))
    s = F.coalesce(F.try_divide(F.col("safe_met") * 100.0, F.col("safe")), F.lit(0.0))
    out = out.withColumn("vulnerable_pct", v).withColumn("safe_pct", s)
    verdict = F.when(F.col("vulnerable_pct") > F.col("safe_pct") * 1.5, "targeted").when(F.col("safe_pct") > F.col("vulnerable_pct"), "inverse").otherwise("neutral")
    return out.withColumn("ratio", F.try_divide(F.col("vulnerable_pct"), F.col("safe_pct"))).withColumn("verdict", verdict)


def sniper_confounding(rows: DataFrame, lines: DataFrame, min_lift: float = 1.8, max_freq: float = 0.15, min_n: int = 5, n: int = 5, width: int = 250) -> DataFrame:
    """Items of high lift in counter events: are they a matter of the hour, of a rating bucket
    or of a few opponents?"""
    counter = F.coalesce(F.col("metric2") < 40, F.lit(False))
    keyed = rows.withColumn("all", F.lit("all"))
    lift = bs.item_lift(keyed, lines, "all", "opp_deck", counter, 1, min_n).withColumn("lift", F.round("lift", 9))
    top = bs.top_n(lift.filter((F.col("lift") > min_lift) & (F.col("freq") < max_freq)), ["all"], "lift", "item", n).select("item", "place", "n", "freq", "lift")
    used = rows.groupBy("opp_deck", "opponent", "hour", bucket("rating_before", width).alias("b")).agg(F.count(F.lit(1)).alias("uses"))
    # ``top`` has at most n rows.
    hits = used.join(lines.select(F.col("deck").alias("opp_deck"), "item").join(F.broadcast(top.select("item")), "item", "left_semi"), "opp_deck")
    cells = hits.groupBy("item", "b").agg(F.sum("uses").alias("__b"))
    peak = cells.groupBy("item").agg((F.max("__b") / F.sum("__b")).alias("bucket_share"))
    facts = hits.groupBy("item").agg(
        (F.sum(F.when(F.col("hour") < 7, F.col("uses")).otherwise(0)) * 100.0 / F.sum("uses")).alias("night_pct"),
        (F.count_distinct("opponent") / F.sum("uses")).alias("opponent_ratio"),
    )
    return top.join(facts, "item").join(peak, "item")


# --- confounding ---------------------------------------------------------------------


def confounding_rows(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Ladder events with the mean and special level of both baskets."""
    own = levels.select("deck", F.col("avg_level").alias("own_level"), F.col("special_level").alias("own_special"))
    other = levels.select(F.col("deck").alias("opp_deck"), F.col("avg_level").alias("opp_level"), F.col("special_level").alias("opp_special"))
    return rated_rows(rows).filter("arch IS NOT NULL").join(own, "deck").join(other, "opp_deck")


def confounding_correlations(rows: DataFrame, min_n: int = 11) -> DataFrame:
    """Spearman web of rating, levels, special levels and second metric."""
    both = (F.col("own_special") > 0) & (F.col("opp_special") > 0)
    pairs = {
        "rating_opp_level": (F.col("rating_before"), F.col("opp_level"), F.lit(True)),
        "rating_own_level": (F.col("rating_before"), F.col("own_level"), F.lit(True)),
        "own_opp_level": (F.col("own_level"), F.col("opp_level"), F.lit(True)),
        "own_special_level": (F.col("own_special"), F.col("own_level"), F.col("own_special") > 0),
        "own_opp_special": (F.col("own_special"), F.col("opp_special"), both),
        "rating_metric2": (F.col("rating_before"), F.col("metric2"), F.col("metric2").isNotNull()),
    }
    long = rows.select(
        F.explode(
            F.array_compact(
                F.array(*[F.when(ok, F.struct(F.lit(k).alias("pair"), x.cast("double").alias("x"), y.cast("double").alias("y"))) for k, (x, y, ok) in pairs.items()])
            )
        ).alias("p")
    ).select("p.*")
    return hy.spearman(long.withColumns({"x": F.round("x", 9), "y": F.round("y", 9)}), ["pair"], "x", "y", min_n)


def confounding_kruskal(rows: DataFrame, width: int = 500, min_bucket: int = 50) -> DataFrame:
    """Within rating buckets: do levels and metric differ by time slot or by archetype?

    One pass makes the cells of all tests, and, as a measure of their own, the rows of each bucket.
    """
    slot = day_slot("hour", 6).cast("string")
    tests = [("slot", slot, c) for c in ("opp_level", "metric2")] + [("arch", F.col("arch"), c) for c in ("opp_level", "metric2", "own_level")]
    one = lambda axis, grp, measure, v: F.struct(F.lit(axis).alias("axis"), grp.alias("grp"), F.lit(measure).alias("measure"), v.cast("double").alias("value"))
    parts = [one("all", F.lit("all"), "rows", F.lit(0)), *[one(axis, grp, c, F.round(F.col(c), 9)) for axis, grp, c in tests]]
    long = rows.select(bucket("rating_before", width).alias("bucket"), F.explode(F.array(*parts)).alias("t")).select("bucket", "t.*")
    cells = hy.cell_table(long, ["bucket", "axis", "measure"], "grp", "value")
    kept = cells.filter("axis = 'all'").groupBy("bucket").agg(F.sum("w").alias("rows")).filter(F.col("rows") >= min_bucket).select("bucket")
    wanted = cells.filter("axis != 'all'").join(kept, "bucket", "left_semi")
    return hy.kruskal_of_cells(wanted, ["bucket", "axis", "measure"], "grp", F.when(F.col("axis") == "slot", 6).otherwise(10))


# --- streaks by time slot and deck (early form) ----------------------------------------


def streak_windows(seq: Seq, n: int = 3, high: float = 80.0, low: float = 40.0) -> DataFrame:
    """Full windows of ``n`` scored events with a metric, and whether all are extreme alike."""
    scored = seq.filter(F.col("mode").isin("Ladder", "Ranked"))
    s = sq.ngrams(scored, {"high": F.col("metric") > high, "low": F.col("metric") < low, "known": F.col("metric").isNotNull()}, n)
    return s.df.filter("known_all").withColumn("streak", F.col("high_all") | F.col("low_all"))


def streaks_by_slot(windows: DataFrame) -> DataFrame:
    """Chi-square of extreme windows by 6-hour slot (UTC)."""
    rows = windows.withColumn("slot", F.floor(F.col("ts") % 86400 / 21600))
    return hy.chi_square(hy.contingency(rows, [], "slot", "streak"), [], "slot", "streak")


def streaks_by_deck(windows: DataFrame, top: int = 3, min_n: int = 10) -> DataFrame:
    """Chi-square per entity over its most used decks."""
    decks = windows.groupBy("entity", "deck").agg(F.count(F.lit(1)).alias("n"), F.count_if("streak").alias("hits"))
    best = bs.top_n(decks, ["entity"], "n", "deck", top).filter(F.col("n") > min_n)
    cells = best.select(
        "entity", "deck",
        F.explode(F.array(F.struct(F.lit("yes").alias("hit"), F.col("hits").alias("cell")), F.struct(F.lit("no").alias("hit"), (F.col("n") - F.col("hits")).alias("cell")))).alias("c"),
    ).select("entity", "deck", "c.*").filter("cell > 0")
    return hy.chi_square(cells, ["entity"], "deck", "hit")


# --- streak null models -----------------------------------------------------------------


def extreme_streaks(seq: Seq, column: str, high: float, low: float, n: int = 3) -> DataFrame:
    valid = seq.filter(F.col("mode").isin("Ladder", "Ranked") & F.col(column).isNotNull())
    return rs.window_nulls(valid, {"high": F.col(column) > high, "low": F.col(column) < low}, n)


def normalized_level_streaks(seq: Seq, width: int = 200, below: float = -2.0, n: int = 3) -> DataFrame:
    """Runs of far-below-normal levels, with the z-score inside the rating bucket."""
    valid = seq.filter(F.col("mode").isin("Ladder", "Ranked") & F.col("level").isNotNull())
    scored = bk.bucket_zscore(valid.frame.withColumn("b", bucket("rating_before", width)), "b", "level")
    return rs.window_nulls(valid.subset(scored), {"low": F.round("z", 9) < below}, n)
