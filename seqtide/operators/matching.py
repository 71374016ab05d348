"""Matched pairs inside strata, without forming all pairs of a stratum."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtide.operators import sequence as sq
from seqtide.operators.ordered import ordered
from seqtide.session import cut_lineage

HASH_RANGE = 2.0**32


def hash_number(seed: int, *columns: str) -> Column:
    """Uniform number from md5(seed | columns): the first eight hex digits."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def circle(df: DataFrame, strata: Sequence[str], unique: Sequence[str], seed: int) -> DataFrame:
    """Random circular order of each stratum: ``place`` (from 0) and ``around`` (its size)."""
    hashed = df.withColumn("__h", hash_number(seed, *unique))
    seq = ordered(hashed, list(strata), ["__h", *unique], slab=HASH_RANGE / 4096).number("place")
    sizes = hashed.groupBy(*strata).agg(F.count(F.lit(1)).alias("around"))
    return seq.frame.withColumn("place", F.col("place") - 1).join(sizes, list(strata)).drop("__h")


def match_other(df: DataFrame, strata: Sequence[str], entity: str, unique: Sequence[str], seed: int = 42) -> DataFrame:
    """Pair each row with the next row of another entity in the stratum's random circle.

    One ordered pass: rows are grouped into runs of one entity, and every row of a run takes
    the first row of the next run. Behind the last run the circle goes on with the first one,
    or with the second when the first is of the same entity.
    """
    hashed = df.withColumn("__h", hash_number(seed, *unique))
    seq = ordered(hashed, list(strata), ["__h", *unique], slab=HASH_RANGE / 4096).number("__no")
    seq = sq.runs(seq, entity, group=None, run="__run")
    pick = F.struct(*[F.col(c).alias(c) for c in unique], F.col(entity).alias("__entity"))
    seq = seq.with_columns({"__pick": pick})
    # First row of each run, carried backwards; the row's own run start is replaced by the one after.
    seq = seq.running({"__at": ("min", F.when(F.col("run_start"), F.struct(F.col("__run").alias("run"), F.col("__pick").alias("pick"))))}, reverse=True)
    seq = seq.near({"__after": lambda w: F.lead("__at").over(w)}, ahead=1)
    heads = seq.df.filter("run_start AND __run <= 2").groupBy(*strata).agg(
        F.max(F.when(F.col("__run") == 1, F.col("__pick"))).alias("__first"),
        F.max(F.when(F.col("__run") == 2, F.col("__pick"))).alias("__second"),
    )
    rows = seq.frame.join(heads, list(strata))
    wrapped = F.when(F.col("__first")["__entity"] != F.col(entity), F.col("__first")).when(
        F.col("__second")["__entity"] != F.col(entity), F.col("__second")
    )
    partner = F.coalesce(F.col("__after")["pick"], wrapped)
    out = rows.withColumn("__partner", partner).filter(F.col("__partner").isNotNull())
    return out.select(*df.columns, *[F.col("__partner")[c].alias(f"other_{c}") for c in unique])


def match_where(
    a: DataFrame,
    b: DataFrame,
    strata: Sequence[str],
    unique: Sequence[str],
    unique_b: Sequence[str],
    accept: Callable[[], Column],
    seed: int = 42,
    labels: str | None = None,
) -> DataFrame:
    """First acceptable row of ``b`` for each row of ``a``, in b's random circle.

    Each row of ``a`` starts at a random place and tries 1, 2, 4, ... further places per round
    until one is accepted or the circle is used up. Only unmatched rows go on, so the rows
    formed stay within twice the tries really needed, and nothing is capped. Columns of ``b``
    come as ``b_<name>``; ``accept`` reads both sides.

    ``labels`` names a column of both sides, an array of strings: rows that share one are never
    acceptable to each other (the same entity, a set that is too large a part of itself, a key
    item). A row of which some label stands on every row of its circle has no partner; that is
    told from counts per label, and such rows try nothing.
    """
    others = circle(b, strata, unique_b, seed)
    others = cut_lineage(others.select(*strata, "place", *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in strata]))
    sizes = others.groupBy(*strata).agg(F.count(F.lit(1)).alias("__around"))
    start = F.pmod(hash_number(seed + 1, *unique), F.col("__around"))
    asking = a.join(sizes, list(strata)).withColumn("__start", start)
    if labels:
        label = F.explode(F.array_distinct(labels)).alias("__label")
        held = b.select(*strata, label).groupBy(*strata, "__label").agg(F.count(F.lit(1)).alias("__held"))
        most = a.select(*strata, *unique, label).join(held, [*strata, "__label"]).groupBy(*unique).agg(F.max("__held").alias("__held"))
        asking = asking.join(most, list(unique), "left").filter(F.coalesce("__held", F.lit(0)) < F.col("__around")).drop("__held")
    waiting = cut_lineage(asking)
    found: list[DataFrame] = []
    tried, width = 0, 1
    while True:
        tries = waiting.filter(F.col("__around") > tried).withColumn(
            "__try", F.explode(F.sequence(F.lit(tried), F.least(F.lit(tried + width), F.col("__around")) - 1))
        )
        tries = tries.withColumn("place", (F.col("__start") + F.col("__try")) % F.col("__around"))
        good = tries.join(others, [*strata, "place"]).filter(accept())
        best = cut_lineage(
            good.groupBy(*unique).agg(F.min_by(F.struct(*[c for c in good.columns if c not in unique]), "__try").alias("__m"))
        )
        found.append(best)
        tried, width = tried + width, width * 2
        waiting = cut_lineage(waiting.filter(F.col("__around") > tried).join(best, list(unique), "left_anti"))
        if waiting.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    names = [c for c in a.columns if c not in unique]
    return out.select(*unique, *[F.col("__m")[c].alias(c) for c in names], *[F.col("__m")[f"b_{c}"].alias(f"b_{c}") for c in b.columns if c not in strata])


def match_nearest(
    a: DataFrame,
    b: DataFrame,
    strata: Sequence[str],
    unique: str,
    coarse: str,
    fine: str,
    fine_scale: float,
    caliper: float,
) -> DataFrame:
    """Nearest row of ``b`` by |coarse difference| + |fine difference| / fine_scale.

    ``coarse`` takes few values (a rate over a handful of events). For each of them in the
    stratum the nearest ``fine`` value is found in one ordered pass over both sides, so the
    work is linear in the rows times the number of coarse values. Ties go to the smaller id.
    """
    keys = [*strata, "__coarse"]
    marks = b.groupBy(*strata, F.col(coarse).alias("__coarse"), F.col(fine).alias("__fine")).agg(F.min(unique).alias("__id"))
    levels = marks.select(*keys).distinct()
    asks = a.join(levels, list(strata)).filter(F.abs(F.col(coarse) - F.col("__coarse")) < caliper)
    asks = asks.select(*keys, F.col(fine).alias("__fine"), F.col(coarse).alias("__own"), F.col(unique).alias("__ask"))
    both = asks.withColumn("__id", F.lit(None).cast("long")).unionByName(
        marks.withColumn("__own", F.lit(None).cast("double")).withColumn("__ask", F.lit(-1).cast("long"))
    )
    # At equal values the mark sorts first, so "at or below" is seen going up.
    seq = ordered(both, keys, ["__fine", "__ask"], slab=0.5)
    mark = F.when(F.col("__id").isNotNull(), F.struct(F.col("__fine").alias("v"), F.col("__id").alias("id")))
    seq = seq.running({"__below": ("max", mark)}).running({"__above": ("min", mark)}, reverse=True)
    rows = seq.frame.filter("__ask >= 0")

    def distance(side: str) -> Column:
        return F.round(
            F.abs(F.col("__own") - F.col("__coarse")) + F.abs(F.col("__fine") - F.col(side)["v"]) / fine_scale, 6
        )

    options = F.array_compact(
        F.array(
            *[
                F.when(F.col(s).isNotNull(), F.struct(distance(s).alias("distance"), F.col(s)["id"].alias("match")))
                for s in ("__below", "__above")
            ]
        )
    )
    best = rows.groupBy(F.col("__ask").alias(unique)).agg(F.min(F.array_min(options)).alias("__best"))
    return best.filter(F.col("__best")["distance"] < caliper).select(unique, F.col("__best")["match"].alias("match"), F.col("__best")["distance"].alias("distance"))


def score_table(events: DataFrame, own: str, other: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observed mean of the value by (own, other), by own, and overall: a back-off chain, from one pass that adds up per (own, other)."""
    rows = events.filter(F.col(value).isNotNull() & F.col(own).isNotNull())
    cells = cut_lineage(rows.groupBy(own, other).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n")))
    mean = F.sum("__sum") / F.sum("__n")
    return cells.filter(F.col(other).isNotNull()).select(own, other, (F.col("__sum") / F.col("__n")).alias("__pair")), cells.groupBy(own).agg(mean.alias("__single")), cells.agg(mean.alias("__overall"))


def score_pairs(pairs: DataFrame, scores: tuple[DataFrame, DataFrame, DataFrame], own: str, other: str, name: str = "score") -> DataFrame:
    """Score each (own, other) pair from the most specific observed mean."""
    pair, single, overall = scores
    out = pairs.join(pair, [own, other], "left").join(single, own, "left").crossJoin(F.broadcast(overall))  # one row
    return out.withColumn(name, F.coalesce("__pair", "__single", "__overall")).drop("__pair", "__single", "__overall")
