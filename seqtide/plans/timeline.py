"""The shared timeline: rating history, sessions, streaks, stress and neighbours per event.

Analyses read this one table. It is lazy: a window nobody uses is pruned by Catalyst. On a
cluster, write it once with ``materialize`` (bucketed by entity) and run all analyses on it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqtide.functions.scalar import clean_change
from seqtide.operators import sequence as sq
from seqtide.operators.ordered import Seq, ordered
from seqtide.sources import tables

MODES = {"all": None, "Ladder": ["Ladder"], "Ranked": ["Ranked"], "Ladder_Ranked": ["Ladder", "Ranked"]}


@dataclass(frozen=True)
class SessionRule:
    """Idle gap and stop tiers in seconds."""

    gap_s: int = 1200
    long_s: int = 7200
    quit_s: int = 72000
    split_at_equal: bool = True


# The driver tables are sparse (about 3 percent of gaps are under 20 minutes).
SPARSE = SessionRule(43200, 86400, 172800)


def rated(seq: Seq) -> Seq:
    """Rating before and after each Ladder event, counted back from the current rating."""
    ladder = F.col("mode") == "Ladder"
    step = F.when(ladder, clean_change("win", "change")).otherwise(F.lit(0)).cast("long")
    out = sq.reconstruct_state(seq.with_columns({"variation": step}), "variation", "current_rating")
    return out.with_columns(
        {c: F.when(ladder, F.col(c)) for c in ("rating_before", "rating_after", "variation")}
    )


def mode_filter(seq: Seq, mode: str) -> Seq:
    wanted = MODES[mode]
    return seq if wanted is None else seq.filter(F.col("mode").isin(wanted))


def build(events: DataFrame, mode: str = "all", rule: SessionRule = SPARSE, max_rows: int | None = None) -> Seq:
    """Events -> rated -> mode filter -> sessions. The filter precedes the session cut."""
    seq = ordered(events, "entity", ["ts", "event_id"], max_rows)
    seq = mode_filter(rated(seq), mode)
    return sq.sessionize(seq, "ts", rule.gap_s, rule.long_s, rule.quit_s, rule.split_at_equal)


def timeline(spark: SparkSession, sf_dir: str, mode: str = "all", rule: SessionRule = SPARSE) -> Seq:
    return build(tables.events(spark, sf_dir), mode, rule)


NEIGHBOUR_COLUMNS = ("metric", "metric2", "level", "win", "mode", "rating_before", "deck", "opp_deck")


def with_next(seq: Seq, columns: Iterable[str] = NEIGHBOUR_COLUMNS) -> Seq:
    return sq.next_in(seq, list(columns))


def with_prev(seq: Seq, columns: Iterable[str], depth: int = 1) -> Seq:
    for k in range(1, depth + 1):
        seq = sq.next_in(seq, list(columns), k=-k)
    return seq


def with_streaks(seq: Seq) -> Seq:
    return sq.streaks(seq)


def with_stress(seq: Seq) -> Seq:
    return sq.stress(sq.streaks(seq))


def materialize(seq: Seq, name: str, path: str, buckets: int = 64) -> Seq:
    """Write the timeline once as table ``name`` under ``path``, bucketed and sorted by key, and go on from there.

    The result takes the place of ``seq`` in any analysis: windows by key read the buckets without an exchange.
    """
    spark = seq.df.sparkSession
    seq.frame.write.mode("overwrite").bucketBy(buckets, *seq.keys).sortBy(*seq.keys, *seq.order).option("path", path).saveAsTable(name)
    return ordered(spark.table(name), seq.keys, seq.order, seq.max_rows)
