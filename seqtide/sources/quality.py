"""Data-quality expectations: domains, cross-column and cross-table rules, keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expect(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into good rows and violations (one row per broken rule).

    A rule is a condition that must be true; NULL counts as not broken.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    marked = df.withColumn("__broken", broken)
    good = marked.filter(F.size("__broken") == 0).drop("__broken")
    bad = marked.withColumn("rule", F.explode("__broken")).drop("__broken")
    return good, bad


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose reference has no parent; NULL references are allowed."""
    refs = parent.select(F.col(parent_key).alias(key)).distinct()
    return df.filter(F.col(key).isNotNull()).join(refs, key, "left_anti")


def unsupported_flags(holdings: DataFrame, items: DataFrame, flag: str, supports: str) -> DataFrame:
    """Holdings with a flag the item does not support."""
    return holdings.join(items.select("item", F.col(supports).alias("__ok")), "item", "left").filter(
        (F.col(flag) == 1) & (F.coalesce(F.col("__ok"), F.lit(0)) != 1)
    ).drop("__ok")


def funnel(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Counts by the first reason that applies; ``valid`` when none does."""
    out = F.lit("valid")
    for name, test in reversed(list(reasons.items())):
        out = F.when(test, F.lit(name)).otherwise(out)
    return df.groupBy(out.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
