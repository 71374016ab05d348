"""Statistical tests as grouped DataFrame operators: one result row per test key.

Samples never leave the executors: a rank test sees counts per (key, value), a moment test
sees sums, and only the one-row-per-key results reach a Python tail function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtide.functions import tails
from seqtide.operators.ranks import add_rank_columns, add_ranks, value_counts
from seqtide.session import cut_lineage

ONE = "__all"


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A test over everything gets one constant key, dropped again at the end."""
    return (df, list(keys)) if keys else (df.withColumn(ONE, F.lit(0)), [ONE])


def mann_whitney(
    df: DataFrame,
    keys: Sequence[str],
    group: str,
    value: str,
    a,
    b,
    alternative: str = "two-sided",
    min_n: int = 1,
    exact: bool = True,
) -> DataFrame:
    """Mann-Whitney U of group ``a`` against ``b``, tie and continuity corrected.

    ``u`` is U of ``a``; ``z`` belongs to the tested direction. Without ties and with a
    sample of at most 8 the p-value is exact.
    """
    df, k = _keyed(df, keys)
    is_a, is_b = F.col(group) == F.lit(a), F.col(group) == F.lit(b)
    counts = value_counts(df.filter(is_a | is_b), k, value, na=is_a, nb=is_b)
    ranked = add_ranks(counts, k, F.col("na") + F.col("nb"))
    t = F.col("ties").cast("double")
    stats = ranked.groupBy(*k).agg(
        F.sum("na").alias("n1"),
        F.sum("nb").alias("n2"),
        (F.sum(F.col("__v") * F.col("na")) / F.sum("na")).alias("mean1"),
        (F.sum(F.col("__v") * F.col("nb")) / F.sum("nb")).alias("mean2"),
        F.sum(F.col("avg_rank") * F.col("na")).alias("__r1"),
        F.sum(t * t * t - t).alias("__t"),
    ).filter((F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = stats.withColumn("u", F.col("__r1") - n1 * (n1 + 1) / 2)
    u1, u2 = F.col("u"), n1 * n2 - F.col("u")
    tested = {"greater": u1, "less": u2}.get(alternative, F.greatest(u1, u2))
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("__t") / (n * (n - 1))))
    out = out.withColumn("z", F.try_divide(tested - n1 * n2 / 2 - 0.5, sigma))
    upper = tails.normal_sf(F.col("z"))
    p = F.least(F.lit(1.0), 2 * upper) if alternative == "two-sided" else upper
    if exact:
        small = (F.least(n1, n2) <= 8) & (F.col("__t") == 0)
        tail = tails.exact_u_p(F.when(small, tested).otherwise(0.0), F.when(small, n1).otherwise(1.0), F.when(small, n2).otherwise(1.0))
        p = F.when(small, F.least(F.lit(1.0), 2 * tail) if alternative == "two-sided" else tail).otherwise(p)
    return out.withColumn("p", p).select(*keys, "n1", "n2", "mean1", "mean2", "u", "z", "p")


def rank_pairs(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Counts of (key, x, y) pairs with the average ranks ``rx`` and ``ry`` of both sides."""
    pairs = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
        .groupBy(*keys, "__x", "__y")
        .agg(F.count(F.lit(1)).alias("w"))
    )

    return add_rank_columns(pairs, keys, {"__x": "rx", "__y": "ry"}, "w")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 2) -> DataFrame:
    """Spearman's rho with the two-sided p of the t approximation; NULL for a constant side."""
    df, k = _keyed(df, keys)
    ranked = rank_pairs(df, k, x, y)
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*k).agg(
        F.sum("w").alias("n"),
        F.sum(w * rx * ry).alias("__xy"),
        F.sum(w * rx * rx).alias("__xx"),
        F.sum(w * ry * ry).alias("__yy"),
    ).filter(F.col("n") >= min_n)
    # Average ranks have the mean (n + 1) / 2 on both sides.
    square = F.col("n") * ((F.col("n") + 1) / 2) ** 2
    stats = sums.withColumns({c: F.col(c) - square for c in ("__xy", "__xx", "__yy")})
    rho = F.try_divide(F.col("__xy"), F.sqrt(F.greatest(F.lit(0.0), F.col("__xx")) * F.greatest(F.lit(0.0), F.col("__yy"))))
    out = stats.withColumn("rho", rho)
    free = F.col("n") - 2
    t = F.when(
        F.abs(F.col("rho")) < 1, F.col("rho") * F.sqrt(free / (1 - F.col("rho") * F.col("rho")))
    ).when(F.col("rho").isNotNull(), F.signum("rho") * F.lit(float("inf")))
    out = out.withColumn("t", t)
    return out.withColumn("p", F.when(free > 0, tails.student_p(F.col("t"), free))).select(*keys, "n", "rho", "p")


def partial_spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Rank correlation of x and y with z held fixed."""
    df, k = _keyed(df, keys)
    triples = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
        .select(*k, *[F.col(c).cast("double").alias(f"__{n}") for c, n in ((x, "x"), (y, "y"), (z, "z"))])
        .groupBy(*k, "__x", "__y", "__z")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    ranked = add_rank_columns(triples, k, {"__x": "rx", "__y": "ry", "__z": "rz"}, "w")
    w = F.col("w")
    sums = ranked.groupBy(*k).agg(
        F.sum(w).alias("n"),
        *[F.sum(w * F.col(f"r{a}") * F.col(f"r{b}")).alias(f"s_{a}{b}") for a in "xyz" for b in "xyz" if a <= b],
    )
    square = F.col("n") * ((F.col("n") + 1) / 2) ** 2
    spread = {a: F.col(f"s_{a}{a}") - square for a in "xyz"}

    def rho(a: str, b: str) -> Column:
        return F.try_divide(F.col(f"s_{a}{b}") - square, F.sqrt(spread[a] * spread[b]))

    out = sums.select(*k, "n", rho("x", "y").alias("r_xy"), rho("x", "z").alias("r_xz"), rho("y", "z").alias("r_yz"))
    denom = F.sqrt((1 - F.col("r_xz") ** 2) * (1 - F.col("r_yz") ** 2))
    partial = F.when(denom != 0, (F.col("r_xy") - F.col("r_xz") * F.col("r_yz")) / denom).otherwise(0.0)
    return out.withColumn("r_partial", partial).drop(*([ONE] if not keys else []))


def cell_table(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Rows per (key, group, value): keys, group, ``__v``, ``w``; written once.

    Ranks, medians, group sizes and sums of a rank test all come from it, so the log behind ``df`` is read once
    however many of them a test joins. It has as many rows as there are distinct values in the groups.
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    return cut_lineage(rows.groupBy(*keys, group, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("w")))


def large_groups(cells: DataFrame, keys: Sequence[str], group: str, min_n: int | Column) -> DataFrame:
    """Cells of the groups with at least ``min_n`` values (a number, or a column over the keys)."""
    if isinstance(min_n, int) and min_n <= 1:
        return cells
    sizes = cells.groupBy(*keys, group).agg(F.sum("w").alias("__gn"))
    return cells.join(sizes.filter(F.col("__gn") >= min_n).drop("__gn"), [*keys, group], "left_semi")


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str, min_n: int | Column = 1) -> DataFrame:
    """Kruskal-Wallis H, tie corrected. Groups under ``min_n`` values are left out."""
    df, k = _keyed(df, keys)
    return kruskal_of_cells(cell_table(df, k, group, value), k, group, min_n).select(*keys, "groups", "n", "h", "p")


def kruskal_of_cells(cells: DataFrame, k: Sequence[str], group: str, min_n: int | Column = 1) -> DataFrame:
    """``kruskal`` from a ``cell_table``."""
    cells = large_groups(cells, k, group, min_n)
    values = add_ranks(cells.groupBy(*k, "__v").agg(F.sum("w").alias("__n")), k, F.col("__n"))
    ranked = cells.join(values.select(*k, "__v", "avg_rank"), [*k, "__v"])
    groups = ranked.groupBy(*k, group).agg(F.sum("w").alias("__gn"), F.sum(F.col("w") * F.col("avg_rank")).alias("__r"))
    t = F.col("ties").cast("double")
    tied = values.groupBy(*k).agg(F.sum(t * t * t - t).alias("__t"))
    out = groups.groupBy(*k).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("__gn").alias("n"), F.sum(F.col("__r") * F.col("__r") / F.col("__gn")).alias("__s")
    ).join(tied, list(k))
    n = F.col("n").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("__s") - 3 * (n + 1)
    out = out.withColumn("h", F.try_divide(h, 1 - F.col("__t") / (n * n * n - n))).filter(F.col("groups") > 1)
    return out.withColumn("p", tails.chi2_p(F.col("h"), F.col("groups") - 1)).select(*k, "groups", "n", "h", "p")


def exact_median(counts: DataFrame, keys: Sequence[str], name: str = "median") -> DataFrame:
    """Exact median per key of values ``__v`` that occur ``w`` times, from cumulative counts (no value list is built)."""
    ranked = add_ranks(counts.withColumnRenamed("w", "__n"), keys, F.col("__n"))
    low = F.col("avg_rank") - (F.col("ties") - 1) / 2
    high = F.col("avg_rank") + (F.col("ties") - 1) / 2
    sizes = counts.groupBy(*keys).agg(F.sum("w").alias("__all_n"))
    left = F.floor((F.col("__all_n") + 1) / 2)
    right = F.floor((F.col("__all_n") + 2) / 2)
    return ranked.join(sizes, list(keys)).groupBy(*keys).agg(
        (
            (
                F.max(F.when((low <= left) & (left <= high), F.col("__v")))
                + F.max(F.when((low <= right) & (right <= high), F.col("__v")))
            )
            / 2
        ).alias(name)
    )


def levene(df: DataFrame, keys: Sequence[str], group: str, value: str, min_n: int | Column = 1) -> DataFrame:
    """Brown-Forsythe form of Levene's test (distance from the group median)."""
    df, k = _keyed(df, keys)
    return levene_of_cells(cell_table(df, k, group, value), k, group, min_n).select(*keys, "groups", "n", "w", "p")


def levene_of_cells(cells: DataFrame, k: Sequence[str], group: str, min_n: int | Column = 1) -> DataFrame:
    """``levene`` from a ``cell_table``."""
    cells = large_groups(cells, k, group, min_n)
    medians = exact_median(cells, [*k, group], "__med")
    z = F.abs(F.col("__v") - F.col("__med"))
    groups = cells.join(medians, [*k, group]).groupBy(*k, group).agg(
        F.sum("w").alias("__gn"), F.sum(F.col("w") * z).alias("__z"), F.sum(F.col("w") * z * z).alias("__zz")
    )
    out = groups.groupBy(*k).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("__gn").alias("n"),
        F.sum("__z").alias("__sz"),
        F.sum(F.col("__z") * F.col("__z") / F.col("__gn")).alias("__bz"),
        F.sum("__zz").alias("__szz"),
    ).filter(F.col("groups") > 1)
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    between = F.col("__bz") - F.col("__sz") * F.col("__sz") / F.col("n")
    within = F.col("__szz") - F.col("__bz")
    out = out.withColumn("w", F.try_divide(d2 * between, d1 * within))
    return out.withColumn("p", tails.f_p(F.col("w"), d1, d2)).select(*k, "groups", "n", "w", "p")


def wilcoxon(
    df: DataFrame, keys: Sequence[str], a: str, b: str, alternative: str = "two-sided", min_n: int = 1, exact: bool = True
) -> DataFrame:
    """Wilcoxon signed-rank test of the pairs (a, b); zero differences are dropped.

    Exact up to 50 pairs when there are neither ties nor zeros, else the normal form.
    """
    df, k = _keyed(df, keys)
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn(
        "__d", F.round(F.col(a).cast("double") - F.col(b).cast("double"), 9)
    )
    counts = d.groupBy(*k, F.abs("__d").alias("__v")).agg(
        F.sum((F.col("__d") > 0).cast("long")).alias("pos"),
        F.sum((F.col("__d") < 0).cast("long")).alias("neg"),
        F.count(F.lit(1)).alias("__all_n"),
        F.sum(a).alias("__sa"),
        F.sum(b).alias("__sb"),
    )
    sizes = counts.groupBy(*k).agg(
        F.sum("__all_n").alias("pairs"),
        (F.sum("__sa") / F.sum("__all_n")).alias("mean_a"),
        (F.sum("__sb") / F.sum("__all_n")).alias("mean_b"),
        F.sum(F.when(F.col("__v") == 0, F.col("__all_n")).otherwise(0)).alias("zeros"),
    ).filter(F.col("pairs") >= min_n)
    ranked = add_ranks(counts.filter(F.col("__v") > 0), k, F.col("pos") + F.col("neg"))
    t = F.col("ties").cast("double")
    stats = ranked.groupBy(*k).agg(
        F.sum("ties").alias("n"),
        F.sum(F.col("avg_rank") * F.col("pos")).alias("w_plus"),
        F.sum(F.col("avg_rank") * F.col("neg")).alias("w_minus"),
        F.sum(t * t * t - t).alias("__t"),
    )
    out = sizes.join(stats, k)
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    se = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__t") / 48)
    out = out.withColumn("z", F.try_divide(F.col("w_plus") - mean, se))
    p = tails.normal_p(F.col("z"), alternative)
    if exact:
        small = (n <= 50) & (F.col("__t") == 0) & (F.col("zeros") == 0)
        w = {"greater": F.col("w_plus"), "less": F.col("w_minus")}.get(alternative, F.greatest("w_plus", "w_minus"))
        tail = tails.exact_w_p(F.when(small, w).otherwise(0.0), F.when(small, n).otherwise(1.0))
        p = F.when(small, F.least(F.lit(1.0), 2 * tail) if alternative == "two-sided" else tail).otherwise(p)
    return out.withColumn("p", p).select(*keys, "pairs", "n", "mean_a", "mean_b", "w_plus", "w_minus", "z", "p")


def welch(
    df: DataFrame, keys: Sequence[str], group: str, value: str, a, b, alternative: str = "two-sided", min_n: int = 2
) -> DataFrame:
    """Welch's t-test of group ``a`` against ``b``."""
    df, k = _keyed(df, keys)
    v = F.col(value).cast("double")
    va, vb = F.when(F.col(group) == F.lit(a), v), F.when(F.col(group) == F.lit(b), v)
    out = df.groupBy(*k).agg(
        F.count(va).alias("n1"),
        F.count(vb).alias("n2"),
        F.avg(va).alias("mean1"),
        F.avg(vb).alias("mean2"),
        F.var_samp(va).alias("var1"),
        F.var_samp(vb).alias("var2"),
    ).filter((F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    s1, s2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    out = out.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(s1 + s2))).withColumn(
        "df", F.try_divide((s1 + s2) * (s1 + s2), s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1))
    )
    return out.withColumn("p", tails.student_p(F.col("t"), F.col("df"), alternative)).select(
        *keys, "n1", "n2", "mean1", "mean2", "t", "df", "p"
    )


def paired_t(df: DataFrame, keys: Sequence[str], a: str, b: str, alternative: str = "two-sided") -> DataFrame:
    """Paired t-test of the differences a - b."""
    df, k = _keyed(df, keys)
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = df.filter(d.isNotNull()).groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.avg(d).alias("mean_d"),
        F.stddev_samp(d).alias("sd_d"),
    ).filter(F.col("n") >= 2)
    out = out.withColumn("t", F.try_divide(F.col("mean_d"), F.col("sd_d") / F.sqrt("n")))
    return out.withColumn("p", tails.student_p(F.col("t"), F.col("n") - 1, alternative)).select(
        *keys, "n", "mean_a", "mean_b", "mean_d", "t", "p"
    )


def fisher_2x2(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Sample odds ratio (Infinity or NaN at zero cells) and one-sided exact p."""
    up, down = F.col(a).cast("double") * F.col(d), F.col(b).cast("double") * F.col(c)
    odds = F.when(down != 0, up / down).when(up != 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return df.withColumn("odds", odds.cast("double")).withColumn("p", tails.fisher_p(F.col(a), F.col(b), F.col(c), F.col(d)))


def contingency(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Long contingency table: (key, a, b, cell)."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("cell"))


def with_margins(cells: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """The observed cells with their margins, the total and the expected count."""
    rows = cells.groupBy(*keys, a).agg(F.sum("cell").alias("row_n"))
    cols = cells.groupBy(*keys, b).agg(F.sum("cell").alias("col_n"))
    totals = rows.groupBy(*keys).agg(F.sum("row_n").alias("total"))
    full = cells.join(rows, [*keys, a]).join(cols, [*keys, b]).join(totals, list(keys))
    return full.withColumn("expected", F.col("row_n").cast("double") * F.col("col_n") / F.col("total"))


def chi_square(cells: DataFrame, keys: Sequence[str], a: str, b: str, yates: bool = True) -> DataFrame:
    """Chi-square independence test of a long contingency table.

    Only observed cells are touched: they add (cell - expected)^2 / expected, and the empty ones
    together what is left of n beside the expected counts of the observed. With one degree of freedom the Yates correction
    applies unless switched off. ``low_expected``: some cell expects fewer than 5.
    """
    cells, k = _keyed(cells, keys)
    full = with_margins(cells, k, a, b)
    square = full.groupBy(*k).agg(
        F.first("total").alias("n"),
        F.sum(F.pow(F.col("cell") - F.col("expected"), 2) / F.col("expected")).alias("__s"),
        F.sum("expected").alias("__e"),
        F.count(F.lit(1)).alias("__cells"),
        F.first(F.abs(F.col("cell") - F.col("expected"))).alias("__d"),
    )

    def margin(column: str, name: str) -> DataFrame:
        totals = cells.groupBy(*k, column).agg(F.sum("cell").alias("__m"))
        return totals.groupBy(*k).agg(
            F.count(F.lit(1)).alias(name), F.min("__m").alias(f"__{name}_min"), F.max("__m").alias(f"__{name}_max")
        )

    out = square.join(margin(a, "rows"), k).join(margin(b, "cols"), k)
    n = F.col("n").cast("double")
    # In a 2x2 table all four cells are equally far from their expected counts.
    product = (
        F.col("__rows_min").cast("double") * F.col("__rows_max") * F.col("__cols_min").cast("double") * F.col("__cols_max")
    )
    short = F.greatest(F.lit(0.0), F.col("__d") - 0.5)
    corrected = short * short * n * n * n / product
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    empty = F.when(F.col("__cells") < F.col("rows") * F.col("cols"), F.greatest(F.lit(0.0), n - F.col("__e"))).otherwise(0.0)
    plain = F.col("__s") + empty
    chi2 = F.when(dof == 1, corrected).otherwise(plain) if yates else plain
    out = out.withColumn("dof", dof).filter("dof > 0").withColumn("chi2", chi2)
    out = out.withColumn("min_expected", F.col("__rows_min").cast("double") * F.col("__cols_min") / n)
    return (
        out.withColumn("p", tails.chi2_p(F.col("chi2"), F.col("dof")))
        .withColumn("low_expected", F.col("min_expected") < 5)
        .select(*keys, "rows", "cols", "n", "dof", "chi2", "min_expected", "low_expected", "p")
    )


def binomial_lift(df: DataFrame, hits: str, n: str, baseline: str) -> DataFrame:
    """Rate, lift over the baseline rate and P(X >= hits)."""
    return (
        df.withColumn("rate", F.try_divide(F.col(hits), F.col(n)))
        .withColumn("lift", F.try_divide(F.try_divide(F.col(hits), F.col(n)), F.col(baseline)))
        .withColumn("p", tails.binomial_p(F.col(hits), F.col(n), F.col(baseline)))
    )


def slope(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 2) -> DataFrame:
    """Least-squares line per key with correlation and two-sided slope p."""
    df, k = _keyed(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys)
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.corr(xc, yc).alias("r"),
    ).filter(F.col("n") >= min_n)
    t = F.when(F.abs(F.col("r")) < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    return out.withColumn("__t", t).withColumn(
        "p", F.when(F.col("n") > 2, tails.student_p(F.col("__t"), F.col("n") - 2))
    ).select(*keys, "n", "slope", "intercept", "r", "p")
