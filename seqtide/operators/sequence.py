"""Sequence operators on a ``Seq``: sessions, streaks, state, episodes, n-grams.

All of them use entity-wide windows with one order, so a chain of operators shares one
exchange and one sort, and none builds a window per session (a session of a bot can be as
large as its whole log). "Inside the session" is expressed by comparing session numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtide.functions.scalar import stop_tier
from seqtide.operators.ordered import Seq


def sessionize(
    seq: Seq,
    ts: str = "ts",
    gap_s: int = 1200,
    long_s: int = 7200,
    quit_s: int = 72000,
    split_at_equal: bool = True,
    prefix: str = "",
) -> Seq:
    """Cut the timeline at idle gaps.

    Adds ``session_no``, ``pos`` (1-based), ``n``, ``is_start``, ``is_last``, ``prev_gap``
    and, for the whole session, ``break_s`` and ``stop_type``. A gap equal to ``gap_s``
    splits unless ``split_at_equal`` is False.
    """
    p = prefix

    def splits(gap: Column) -> Column:
        return gap.isNull() | (gap >= gap_s if split_at_equal else gap > gap_s)

    out = seq.near(
        {
            f"{p}prev_gap": lambda w: F.col(ts) - F.lag(ts).over(w),
            f"{p}next_gap": lambda w: F.lead(ts).over(w) - F.col(ts),
        },
        back=1,
        ahead=1,
    ).number(f"{p}rn")
    rn = F.col(f"{p}rn")
    out = out.with_columns(
        {f"{p}is_start": splits(F.col(f"{p}prev_gap")), f"{p}is_last": splits(F.col(f"{p}next_gap"))}
    )
    out = out.running(
        {
            f"{p}session_no": ("sum", F.col(f"{p}is_start").cast("long")),
            f"{p}first_rn": ("max", F.when(F.col(f"{p}is_start"), rn)),
        }
    ).running(
        {f"{p}end": ("min", F.when(F.col(f"{p}is_last"), F.struct(rn.alias("rn"), F.col(f"{p}next_gap").alias("gap"))))},
        reverse=True,
    )
    end = F.col(f"{p}end")
    return out.with_columns(
        {
            f"{p}pos": rn - F.col(f"{p}first_rn") + 1,
            f"{p}n": end["rn"] - F.col(f"{p}first_rn") + 1,
            f"{p}break_s": end["gap"],
            f"{p}stop_type": stop_tier(end["gap"], long_s, quit_s),
        }
    ).with_df_drop(f"{p}end", f"{p}first_rn", f"{p}next_gap")


def next_in(seq: Seq, columns: Sequence[str], group: str = "session_no", k: int = 1) -> Seq:
    """Values of the ``k``-th next row of the same group (``k < 0`` looks back).

    ``next_<col>`` / ``prev_<col>`` for k = 1, with the distance appended beyond that;
    ``has_next`` tells an absent row from a NULL value.
    """
    word = "next" if k > 0 else "prev"
    tail = "" if abs(k) == 1 else str(abs(k))

    def pick(column: str):
        def make(w):
            same = F.lead(group, k).over(w) == F.col(group)
            return F.when(same, F.lead(column, k).over(w))

        return make

    specs = {f"{word}{tail}_{c}": pick(c) for c in columns}
    specs[f"has_{word}{tail}"] = lambda w: F.coalesce(F.lead(group, k).over(w) == F.col(group), F.lit(False))
    return seq.near(specs, back=max(0, -k), ahead=max(0, k))


def reconstruct_state(
    seq: Seq, change: str | Column, current: str | Column, before: str = "rating_before", after: str = "rating_after"
) -> Seq:
    """Value before and after each event, counted back from the current value."""
    step = F.col(change) if isinstance(change, str) else change
    now = F.col(current) if isinstance(current, str) else current
    out = seq.with_columns({"__step": step}).running({"__later": ("sum", F.col("__step"))}, reverse=True)
    later = F.coalesce(F.col("__later"), F.lit(0)) - F.coalesce(F.col("__step"), F.lit(0))
    return out.with_columns({after: now - later, before: now - later - F.coalesce(F.col("__step"), F.lit(0))}).with_df_drop(
        "__step", "__later"
    )


def streaks(seq: Seq, win: str = "win", start: str = "is_start", rn: str = "rn", group: str = "session_no") -> Seq:
    """Run lengths of wins and losses after each event, and the signed streak before it."""
    n, first = F.col(rn), F.col(start)
    out = seq.running(
        {
            "__last_loss": ("max", F.when(F.col(win) == 0, n).when(first, n - 1)),
            "__last_win": ("max", F.when(F.col(win) == 1, n).when(first, n - 1)),
        }
    ).with_columns({"win_streak": n - F.col("__last_loss"), "loss_streak": n - F.col("__last_win")})
    out = out.with_columns({"__signed": F.col("win_streak") - F.col("loss_streak")})
    return out.near(
        {
            "streak_before": lambda w: F.when(
                F.lag(group).over(w) == F.col(group), F.lag("__signed").over(w)
            ).otherwise(F.lit(0).cast("long"))
        },
        back=1,
    ).with_df_drop("__last_loss", "__last_win", "__signed")


def counter_streak(
    seq: Seq, win: str = "win", metric: str = "metric", below: float = 45.0, start: str = "is_start", name: str = "counter_streak"
) -> Seq:
    """Consecutive losses with the metric under a limit.

    A win or a loss at or over the limit resets it; a loss without the metric keeps it.
    """
    hit = (F.col(win) == 0) & (F.col(metric) < below)
    reset = (F.col(win) == 1) | (F.col(metric) >= below)
    out = seq.with_columns({"__hit": F.coalesce(hit, F.lit(False)).cast("long")}).running({"__hits": ("sum", F.col("__hit"))})
    base = F.when(F.coalesce(reset, F.lit(False)), F.col("__hits")).when(F.col(start), F.col("__hits") - F.col("__hit"))
    out = out.running({"__base": ("max", base)})
    return out.with_columns({name: F.col("__hits") - F.col("__base")}).with_df_drop("__hit", "__hits", "__base")


def floored_sum(seq: Seq, increment: Column, name: str, group: str = "session_no", start: str = "is_start") -> Seq:
    """Running sum inside the group that is cut at zero after every step.

    Reflection: with S the plain running sum, the value is S minus the lowest S of the group
    so far, counting the level at which the group began.
    """
    out = seq.with_columns({"__inc": increment}).running({"__sum": ("sum", F.col("__inc"))})
    low = F.when(F.col(start), F.least(F.col("__sum"), F.col("__sum") - F.col("__inc"))).otherwise(F.col("__sum"))
    # The group number grows along the order, so the largest (group, -S) is always of the
    # current group and carries its lowest S.
    out = out.running({"__low": ("max", F.struct(F.col(group).alias("g"), (-low).alias("v")))})
    return out.with_columns({name: F.col("__sum") + F.col("__low")["v"]}).with_df_drop("__inc", "__sum", "__low")


def stress(seq: Seq, win: str = "win", metric: str = "metric") -> Seq:
    """Accumulated stress: a loss adds 1 to 2 by metric, the n-th win in a row takes 2n off."""
    loss = (
        F.lit(1.0)
        + F.when(F.col(metric) < 45, 0.5).otherwise(0.0)
        + F.when(F.col(metric) < 35, 0.5).otherwise(0.0)
    )
    step = F.when(F.col(win) == 1, -2.0 * F.col("win_streak")).otherwise(loss)
    out = floored_sum(seq, step, "stress_after")
    return out.near(
        {
            "stress_before": lambda w: F.when(
                F.lag("session_no").over(w) == F.col("session_no"), F.lag("stress_after").over(w)
            ).otherwise(F.lit(0.0))
        },
        back=1,
    )


def runs(seq: Seq, state: str, group: str | None = "session_no", run: str = "run_no") -> Seq:
    """Number the runs of equal state; a new group always begins a new run."""

    def changed(w):
        differs = ~F.lag(state).over(w).eqNullSafe(F.col(state))
        if group:
            differs = differs | ~F.lag(group).over(w).eqNullSafe(F.col(group))
        return F.when(F.col("__n") == 1, F.lit(1)).otherwise(differs.cast("int")).cast("long")

    out = seq.number("__n").near({"__new": changed}, back=1).with_df_drop("__n")
    return out.running({run: ("sum", F.col("__new"))}).with_columns({"run_start": F.col("__new") == 1}).with_df_drop("__new")


def episodes(
    seq: Seq, state: str, group: str | None = "session_no", measures: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per run of equal state: its state, length and first order values."""
    out = runs(seq, state, group)
    keys = [*seq.keys, *([group] if group else []), "run_no"]
    first = F.min(F.struct(*[F.col(c) for c in seq.order]))
    aggs = [
        F.first(state).alias(state),
        F.count(F.lit(1)).alias("length"),
        first.alias("__first"),
        *[c.alias(name) for name, c in (measures or {}).items()],
    ]
    table = out.df.groupBy(*keys).agg(*aggs)
    return table.select(
        *keys,
        state,
        "length",
        *[F.col("__first")[c].alias(f"first_{c}") for c in seq.order],
        *(measures or {}),
    )


def ngrams(seq: Seq, columns: Mapping[str, Column], n: int, group: str = "session_no") -> Seq:
    """Mark the start of each full window of ``n`` rows of one group.

    Adds ``is_window`` and, per flag column, ``<name>_all``: every row of the window has it.
    """
    out = seq.with_columns({f"__f_{k}": F.coalesce(c, F.lit(False)).cast("int") for k, c in columns.items()})
    specs = {"is_window": lambda w: F.coalesce(F.lead(group, n - 1).over(w) == F.col(group), F.lit(False))}
    for k in columns:
        specs[f"{k}_all"] = lambda w, k=k: F.min(f"__f_{k}").over(w.rowsBetween(0, n - 1)) == 1
    out = out.near(specs, ahead=n - 1)
    return out.with_columns({f"{k}_all": F.col("is_window") & F.col(f"{k}_all") for k in columns}).with_df_drop(
        *[f"__f_{k}" for k in columns]
    )


def last_n_all(seq: Seq, columns: Mapping[str, Column], n: int, group: str = "session_no") -> Seq:
    """``<name>``: the ``n`` rows before this one are of the same group and all have the flag."""
    out = seq.with_columns({f"__f_{k}": F.coalesce(c, F.lit(False)).cast("int") for k, c in columns.items()})
    specs = {
        k: lambda w, k=k: F.coalesce(
            (F.lag(group, n).over(w) == F.col(group)) & (F.min(f"__f_{k}").over(w.rowsBetween(-n, -1)) == 1),
            F.lit(False),
        )
        for k in columns
    }
    return out.near(specs, back=n).with_df_drop(*[f"__f_{k}" for k in columns])


def rolling_mean(
    seq: Seq, column: str, name: str, back: int, min_rows: int = 1, from_row: int = -1
) -> Seq:
    """Mean of the rows ``-back .. from_row``; NULL with fewer than ``min_rows`` values."""

    def make(w):
        frame = w.rowsBetween(-back, from_row)
        return F.when(F.count(column).over(frame) >= min_rows, F.avg(column).over(frame))

    return seq.near({name: make}, back=back)


def running_best(seq: Seq, column: str, name: str = "best") -> Seq:
    """Highest value so far."""
    return seq.running({name: ("max", F.col(column))})


def attempts(seq: Seq, inside: Column, name: str = "attempt") -> Seq:
    """Number of the current entry into a zone (1 for the first); counts at every row."""
    out = seq.with_columns({"__in": F.coalesce(inside, F.lit(False))})
    out = out.near(
        {"__entry": lambda w: (F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False))).cast("long")}, back=1
    )
    return out.running({name: ("sum", F.col("__entry"))}).with_df_drop("__in", "__entry")
