"""Counterfactual pairings: what would another entity's opponents have meant?

Scores come from observed means by archetype pair (or any user table of that shape).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtide.functions.scalar import day_slot, local_hour, utc_timestamp, year_week, zone
from seqtide.operators import hypothesis as hy
from seqtide.operators import matching as mt
from seqtide.operators.ordered import Seq
from seqtide.session import cut_lineage


def scores(seq: Seq):
    return mt.score_table(seq.df, "arch", "opp_arch", "metric2")


def one_deck_sessions(seq: Seq, regions: DataFrame, mode: str = "Ladder", min_n: int = 3) -> DataFrame:
    """Sessions with at least ``min_n`` valid events and one deck, with their strata columns."""
    rows = seq.df.filter((F.col("mode") == mode) & F.col("metric2").isNotNull())
    first = F.min(F.struct("ts", "event_id", "rating_before"))
    out = rows.groupBy("entity", "session_no").agg(
        F.count(F.lit(1)).alias("valid"),
        F.count_distinct("deck").alias("__decks"),
        F.min("deck").alias("deck"),
        F.min("arch").alias("arch"),
        F.avg("metric2").alias("real"),
        first.alias("__f"),
    ).filter((F.col("valid") >= min_n) & (F.col("__decks") == 1) & F.col("__f")["rating_before"].isNotNull())
    out = out.join(regions, "entity", "left").withColumn("ts", F.col("__f")["ts"])
    return out.select(
        "entity", "session_no", "deck", "arch", "real", "region",
        day_slot(local_hour("ts", "tz"), 4).alias("slot"),
        F.floor(F.col("__f")["rating_before"] / 500).cast("long").alias("band"),
        year_week(utc_timestamp("ts")).alias("week"),
    )


def opponents_of(seq: Seq, mode: str = "Ladder") -> DataFrame:
    """Opponent archetypes met per session, counted."""
    rows = seq.df.filter((F.col("mode") == mode) & F.col("metric2").isNotNull() & F.col("opp_arch").isNotNull())
    return rows.groupBy("entity", "session_no", "opp_arch").agg(F.count(F.lit(1)).alias("met"))


def _hypothetical(pairs: DataFrame, seq: Seq, other_entity: str, other_session: str, keep: list[str]) -> DataFrame:
    met = opponents_of(seq).select(F.col("entity").alias(other_entity), F.col("session_no").alias(other_session), "opp_arch", "met")
    rows = mt.score_pairs(pairs.join(met, [other_entity, other_session]), scores(seq), "arch", "opp_arch")
    return rows.groupBy(*keep).agg(F.first("real").alias("real"), (F.sum(F.col("score") * F.col("met")) / F.sum("met")).alias("hypo"))


def session_swap_pairs(seq: Seq, regions: DataFrame, seed: int = 42) -> DataFrame:
    """Each session with a session of another entity in its stratum."""
    return mt.match_other(one_deck_sessions(seq, regions), ["region", "slot", "band"], "entity", ["entity", "session_no"], seed)


def session_swap(seq: Seq, regions: DataFrame, seed: int = 42) -> DataFrame:
    """Real mean against the mean the session's deck would have had against the other's opponents."""
    rows = _hypothetical(session_swap_pairs(seq, regions, seed), seq, "other_entity", "other_session_no", ["entity", "session_no"])
    return hy.paired_t(rows, [], "real", "hypo")


COMPARISONS = (("Neg", "Neg"), ("Pos", "Pos"), ("Neg", "Pos"))


def conditional_swap_pairs(seq: Seq, regions: DataFrame, lines: DataFrame, key_items: DataFrame, max_shared: int = 3, seed: int = 42) -> DataFrame:
    """Negative and positive sessions paired inside (region, week, slot, band) with a session of
    another entity whose deck shares at most ``max_shared`` items and no key item."""
    sets = lines.join(key_items.withColumn("key", F.lit(True)), "item", "left").groupBy("deck").agg(
        F.collect_set("item").alias("items"), F.collect_set(F.when(F.col("key"), F.col("item"))).alias("keys")
    )
    base = one_deck_sessions(seq, regions).withColumn("cat", zone("real", labels=("Neg", "Mid", "Pos"))).join(sets, "deck")
    # What no partner may share: the entity, a deck with more items than may be shared, any key item.
    label = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    same_deck = F.when(F.size("items") > max_shared, label("deck", F.col("deck")))
    labels = F.array_compact(F.concat(F.array(label("entity", F.col("entity")), same_deck), F.transform("keys", lambda k: label("key", k))))
    base = cut_lineage(base.withColumn("labels", labels))  # both sides of the match
    # Both comparisons of a session are strata of their own: the category pair is a key.
    a = base.filter("cat <> 'Mid'").select(
        "*", F.explode(F.array(*[F.struct(F.lit(x).alias("ca"), F.lit(y).alias("cb")) for x, y in COMPARISONS])).alias("c")
    ).filter("cat = c.ca").select("entity", "session_no", "arch", "real", "region", "week", "slot", "band", "items", "keys", "labels", "c.ca", "c.cb")
    b = base.filter("cat <> 'Mid'").select("entity", "session_no", "region", "week", "slot", "band", F.col("cat").alias("cb"), "items", "keys", "labels")

    def different() -> Column:
        shared = F.size(F.array_intersect("items", "b_items"))
        return (F.col("entity") != F.col("b_entity")) & (shared <= max_shared) & ~F.arrays_overlap("keys", "b_keys")

    strata = ["region", "week", "slot", "band", "cb"]
    return mt.match_where(a, b, strata, ["entity", "session_no", "ca", "cb"], ["entity", "session_no"], different, seed, "labels")


def conditional_swap(pairs: DataFrame, seq: Seq) -> DataFrame:
    rows = _hypothetical(pairs, seq, "b_entity", "b_session_no", ["ca", "cb", "entity", "session_no"])
    return hy.paired_t(rows, ["ca", "cb"], "real", "hypo")


def swap_events(seq: Seq, regions: DataFrame, levels: DataFrame, mode: str = "Ladder") -> DataFrame:
    """Events of negative and positive sessions with recent win rate and deck level, written once: both sides of the match
    and what is looked up for its pairs."""
    rows = seq.filter((F.col("mode") == mode) & F.col("metric2").isNotNull())
    mean = rows.df.groupBy("entity", "session_no").agg(F.avg("metric2").alias("__mean"))
    kind = mean.withColumn("kind", zone("__mean", labels=("Neg", "Mid", "Pos"))).filter("kind <> 'Mid'").drop("__mean")
    kept = rows.subset(rows.frame.join(kind, ["entity", "session_no"]).filter("rating_before IS NOT NULL AND metric2 <> 0"))
    s = kept.near({"recent": lambda w: F.coalesce(F.avg("win").over(w.rowsBetween(-5, -1)), F.lit(0.5))}, back=5)
    joined = s.df.join(levels.select("deck", F.col("avg_level").alias("deck_level")), "deck").join(regions, "entity", "left")
    return cut_lineage(
        joined.select(
            "event_id", "kind", "arch", "opp_arch", "metric2", "region", local_hour("ts", "tz").alias("hour"),
            F.floor(F.col("rating_before") / 50).cast("long").alias("band"), F.round("recent", 9).alias("recent"), F.round("deck_level", 9).alias("deck_level"),
        )
    )


def match_swap_pairs(events: DataFrame, caliper: float = 0.3, strata: tuple[str, ...] = ("region", "hour", "band")) -> DataFrame:
    """Each negative event with the nearest positive one of its stratum."""
    return mt.match_nearest(
        events.filter("kind = 'Neg'"), events.filter("kind = 'Pos'"), list(strata), "event_id", "recent", "deck_level", 14.0, caliper
    )


def match_swap(events: DataFrame, pairs: DataFrame, seq: Seq) -> DataFrame:
    own = events.select("event_id", "arch", F.col("metric2").alias("real"))
    other = events.select(F.col("event_id").alias("match"), "opp_arch")
    rows = mt.score_pairs(pairs.join(own, "event_id").join(other, "match"), scores(seq), "arch", "opp_arch", "hypo")
    return hy.paired_t(rows, [], "hypo", "real")


def hypothetical_switches(seq: Seq, back: int = 3) -> DataFrame:
    """Archetype switches: the three events before, the new deck against the same opponents,
    and the three events from the switch on."""
    s = seq.near(
        {
            "n_arch": lambda w: F.lead("arch").over(w),
            "full": lambda w: F.lag(F.lit(1), back).over(w).isNotNull() & F.lead(F.lit(1), back).over(w).isNotNull(),
            "opps": lambda w: F.array(*[F.lag("opp_arch", k).over(w) for k in range(1, back + 1)]),
            "avg_prev": lambda w: F.avg("metric2").over(w.rowsBetween(-back, -1)),
            "avg_next": lambda w: F.avg("metric2").over(w.rowsBetween(0, back - 1)),
        },
        back=back,
        ahead=back,
    )
    rows = s.df.filter("full AND arch <> n_arch AND avg_prev IS NOT NULL AND avg_next IS NOT NULL").select(
        "event_id", F.col("n_arch").alias("arch"), "avg_prev", "avg_next", F.explode("opps").alias("opp_arch")
    ).filter("opp_arch IS NOT NULL")
    scored = mt.score_pairs(rows, scores(seq), "arch", "opp_arch")
    return scored.groupBy("event_id").agg(F.first("avg_prev").alias("avg_prev"), F.avg("score").alias("avg_hypo"), F.first("avg_next").alias("avg_next"))


def switch_summary(rows: DataFrame) -> DataFrame:
    out = rows.agg(F.count(F.lit(1)).alias("switches"), F.avg("avg_prev").alias("avg_prev"), F.avg("avg_hypo").alias("avg_hypo"), F.avg("avg_next").alias("avg_next"))
    return out.withColumn("gap", F.col("avg_next") - F.col("avg_hypo"))
