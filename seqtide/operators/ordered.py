"""Ordered windows per key that survive one key holding a third of the log.

``Seq`` is a DataFrame with keys and a total order inside each key. Three kinds of
ordered work are offered, and every sequence operator of the library is built on them:

* ``near``    - frames of bounded reach (lag, lead, last-N aggregates);
* ``running`` - sum / max / min from the start (or the end) of the key;
* ``number``  - the row number inside the key.

While no key has more than ``max_rows`` rows these are plain window functions on one
hash exchange by key. A key above the limit is cut into consecutive segments of
``max_rows`` rows, and windows run per (key, segment): bounded frames get copies of the
rows next to the cut, running aggregates get the totals of the earlier segments from a
joined table with one row per segment of a hot key. Only the rows of hot keys are numbered
and checkpointed for this; those of all other keys stay in one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seqtide.session import cut_lineage

MAX_ROWS = 2_000_000
SEG = "__seg"
RN = "__rn"


@dataclass(frozen=True)
class Seq:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    max_rows: int = MAX_ROWS
    slab: float = 3600
    split: bool = False
    hot: DataFrame | None = field(default=None, compare=False)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (SEG, RN)]

    @property
    def frame(self) -> DataFrame:
        """The rows without the bookkeeping columns."""
        return self.df.drop(SEG, RN)

    def with_df(self, df: DataFrame) -> "Seq":
        return replace(self, df=df)

    def with_columns(self, columns: Mapping[str, Column]) -> "Seq":
        return self.with_df(self.df.withColumns(dict(columns)))

    def with_df_drop(self, *names: str) -> "Seq":
        return self.with_df(self.df.drop(*names))

    def filter(self, condition: Column | str) -> "Seq":
        return self.subset(self.df.filter(condition))

    def subset(self, df: DataFrame) -> "Seq":
        """The same keys and order over fewer rows (a filtered log)."""
        if not self.split:
            return self.with_df(df)
        return _cut(df.drop(SEG, RN), self.keys, self.order, self.hot, self.max_rows, self.slab)

    def derive(self, df: DataFrame, order: Sequence[str], slab: float | None = None) -> "Seq":
        """Another table of the same keys with no more rows per key (say, the sessions of a log).

        Keys that are not hot here cannot be hot there, so no new count is needed.
        """
        order, width = tuple(order), slab or self.slab
        if not self.split:
            return Seq(df, self.keys, order, self.max_rows, width)
        return _cut(df, self.keys, order, self.hot, self.max_rows, width)

    def window(self, reverse: bool = False) -> WindowSpec:
        parts = [*self.keys, SEG] if self.split else list(self.keys)
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*parts).orderBy(*order)

    def near(
        self, columns: Mapping[str, Callable[[WindowSpec], Column]], back: int = 0, ahead: int = 0
    ) -> "Seq":
        """Add frame columns that look at most ``back`` rows back and ``ahead`` rows ahead."""
        w = self.window()
        if not self.split:
            return self.with_columns({name: make(w) for name, make in columns.items()})
        offset = (F.col(RN) - 1) % self.max_rows
        first = F.greatest(F.lit(0), F.col(SEG) + F.floor((offset - ahead) / self.max_rows))
        targets = F.sequence(first, F.col(SEG) + F.floor((offset + back) / self.max_rows))
        spread = self.df.withColumn("__home", F.col(SEG)).withColumn(SEG, F.explode(targets))
        out = spread.withColumns({name: make(w) for name, make in columns.items()})
        return self.with_df(out.filter(F.col(SEG) == F.col("__home")).drop("__home"))

    def running(
        self, columns: Mapping[str, tuple[str, Column]], reverse: bool = False
    ) -> "Seq":
        """Add inclusive running aggregates; the kind is ``sum``, ``max`` or ``min``."""
        folds = {"sum": F.sum, "max": F.max, "min": F.min}
        w = self.window(reverse).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inputs = {f"__in_{name}": value for name, (_, value) in columns.items()}
        base = self.df.withColumns(inputs)
        local = {
            name: folds[kind](f"__in_{name}").over(w) for name, (kind, _) in columns.items()
        }
        if not self.split:
            return self.with_df(base.withColumns(local).drop(*inputs))
        cold = base.join(self.hot, list(self.keys), "left_anti").withColumns(local)
        base = cut_lineage(base.join(self.hot, list(self.keys), "left_semi"))
        totals = base.groupBy(*self.keys, SEG).agg(
            *[folds[kind](f"__in_{name}").alias(f"__tot_{name}") for name, (kind, _) in columns.items()]
        )
        order = F.col(SEG).desc() if reverse else F.col(SEG).asc()
        before = Window.partitionBy(*self.keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *self.keys,
            SEG,
            *[folds[kind](f"__tot_{name}").over(before).alias(f"__carry_{name}") for name, (kind, _) in columns.items()],
        )
        out = base.withColumns(local).join(carry, [*self.keys, SEG], "left")
        merged = {}
        for name, (kind, _) in columns.items():
            own, past = F.col(name), F.col(f"__carry_{name}")
            if kind == "sum":
                merged[name] = F.when(own.isNull() & past.isNull(), F.lit(None)).otherwise(
                    F.coalesce(own, F.lit(0)) + F.coalesce(past, F.lit(0))
                )
            else:
                pick = F.greatest if kind == "max" else F.least
                merged[name] = pick(own, past)
        kept = list(dict.fromkeys([*self.df.columns, *columns]))
        return self.with_df(cold.select(*kept).unionByName(out.withColumns(merged).select(*kept)))

    def narrow(self, *more: str) -> "Seq":
        """The same rows and order inside keys with further columns. Keys that are not hot can't be hot there."""
        keys = (*self.keys, *more)
        return ordered(self.frame, keys, self.order, self.max_rows, self.slab) if self.split else replace(self, keys=keys)

    def within(self, columns: Mapping[str, Column], ts: str, seconds: int) -> "Seq":
        """Add the sum of each value over the rows of the key that come before this one and are at most ``seconds`` older.

        A difference of two running sums: that before this row and that before the range. Where the key is cut, a probe
        at the range's start is ordered among the rows and takes the sum reached there, so nothing is copied and a range
        may span any number of segments. Values must be whole numbers or decimals, whose sums don't depend on the cuts.
        ``ts`` is the first column of the order, and the order's last column is unique.
        """
        cums = {name: f"__cum_{name}" for name in columns}
        summed = self.running({cums[name]: ("sum", F.coalesce(value, F.lit(0))) for name, value in columns.items()})
        reached = F.struct(*self.order, *cums.values())
        none = F.lit(0)
        if not self.split:
            old = Window.partitionBy(*self.keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, -seconds - 1)
            found = summed.with_columns({"__old": F.max(reached).over(old)})
        else:
            unique = self.order[-1]
            names = [*self.keys, *self.order]
            marks = summed.frame.select(*names, F.lit(1).alias("__side"), reached.alias("__at"))
            probes = summed.frame.select(
                *[(F.col(c) - seconds).alias(c) if c == ts else F.col(c) for c in names], F.lit(0).alias("__side"), F.lit(None).cast(marks.schema["__at"].dataType).alias("__at")
            )
            merged = ordered(marks.unionByName(probes), self.keys, [ts, "__side", *self.order[1:]], self.max_rows, self.slab)
            merged = merged.running({"__old": ("max", F.col("__at"))}).frame.filter("__side = 0").select(unique, "__old")
            found = summed.with_df(summed.df.join(merged, unique))
        before = {name: F.col(c) - F.coalesce(columns[name], none) - F.coalesce(F.col("__old")[c], none) for name, c in cums.items()}
        return found.with_columns(before).with_df_drop("__old", *cums.values())

    def number(self, name: str = "rn") -> "Seq":
        """Row number inside the key, 1-based."""
        if self.split:
            return self.with_df(self.df.withColumn(name, F.col(RN)))
        return self.with_df(self.df.withColumn(name, F.row_number().over(self.window()).cast("long")))


_KNOWN_HOT: dict[tuple, DataFrame | None] = {}


def small_ordered(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str]) -> Seq:
    """Order a table whose rows per key are bounded by construction (buckets, steps)."""
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    return Seq(df, keys, (order,) if isinstance(order, str) else tuple(order))


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows, or None.

    Runs one map-side-combined count over the key columns only. If there are any, they are written as a table that
    later joins read; they never come to the driver.
    """
    found = df.groupBy(*keys).count().filter(F.col("count") > max_rows).select(*keys)
    # The same plan is counted once per application. Should its files change later, an outdated
    # list only changes how keys are cut, never a result.
    known = (df.sparkSession.sparkContext.applicationId, found.semanticHash(), found.schema.json(), max_rows)
    if known not in _KNOWN_HOT:
        _KNOWN_HOT[known] = cut_lineage(found) if found.head(1) else None
    return _KNOWN_HOT[known]


def ordered(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    max_rows: int | None = None,
    slab: float = 3600,
) -> Seq:
    """Order ``df`` inside ``keys``. ``order`` must be total (end with a unique id).

    The rows of hot keys are numbered in parallel over ranges of the whole order, so many rows with equal or close
    values are still spread; ``slab`` is kept for callers that name a width of the first order column and has no effect.
    """
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    order = (order,) if isinstance(order, str) else tuple(order)
    limit = max_rows or int(df.sparkSession.conf.get("seqtide.maxRowsPerKey", str(MAX_ROWS)))
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return Seq(df, keys, order, limit, slab)
    return _cut(df, keys, order, hot, limit, slab)


def _cut(df, keys, order, hot, max_rows, slab) -> Seq:
    names = [F.col(c) for c in (*keys, *order)]
    cold = df.join(hot, list(keys), "left_anti")
    cold = cold.withColumn(RN, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).withColumn(SEG, F.lit(0).cast("long"))
    # Ranges of (key, order), of which the last column is unique: a task gets one, whatever the values.
    ranged = df.join(hot, list(keys), "left_semi").repartitionByRange(*names).sortWithinPartitions(*names)
    ranged = cut_lineage(ranged.withColumn("__range", F.spark_partition_id().cast("long")))
    sizes = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__skip"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    numbered = (
        ranged.withColumn("__local", F.row_number().over(inside))
        .join(offsets, [*keys, "__range"])
        .withColumn(RN, (F.col("__skip") + F.col("__local")).cast("long"))
        .withColumn(SEG, F.floor((F.col(RN) - 1) / max_rows).cast("long"))
        .drop("__range", "__local", "__skip")
    )
    return Seq(cold.unionByName(cut_lineage(numbered)), tuple(keys), tuple(order), max_rows, slab, True, hot)
