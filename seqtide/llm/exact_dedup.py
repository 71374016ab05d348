"""Exact deduplication: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, fresh, without


def normal(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], Column] = lambda c: F.unhex(F.md5(c))) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 (hex).

    Equal means equal after ``normal``. Only hashes are shuffled for all rows; texts are read again only for rows
    whose hash occurs more than once, and grouping them by hash and text compares the bytes, so a hash collision
    splits into its true groups. A group of any size is reduced before the shuffle to a row per task.

    Nulls: a null text is empty; a null doc_id counts as larger than any id (a group of only such rows has keep_id
    null and keeps all). Repeated rows of the keeping id are one document: kept holds on each of them, and
    ``drop_copies`` leaves one. An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("body"))
    hashed = cut(texts.select("doc_id", content_hash(F.col("body")).alias("h"), F.unhex(F.sha2("body", 256)).alias("sha")))
    several = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    suspects = cut(hashed.join(several, "h", "left_semi").select("doc_id").distinct())
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    listed = some.where("doc_id is not null").join(bounded(suspects), "doc_id", "left_semi").union(some.where("doc_id is null"))
    groups = cut(
        listed.select("doc_id", normal(F.col("text")).alias("body"))
        .groupBy(content_hash(F.col("body")).alias("h"), "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
        .where("group_size > 1")
    )
    out = hashed.join(groups, ["h", "sha"], "left")
    size = F.coalesce("group_size", F.lit(1))
    keep = F.when(size > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows ``exact_dedup`` drops, all columns as they were; one row of repeated rows stays."""
    found = cut(exact_dedup(docs).groupBy("doc_id").agg(F.count_if("kept").alias("rows")).where("doc_id is not null"))
    kept = without(docs.where("doc_id is not null"), cut(found.where("rows = 0").select("doc_id")))
    again = cut(found.where("rows > 1").select(F.col("doc_id").alias(fresh(docs))))
    nameless = docs.where("doc_id is null").dropDuplicates(["text"])
    if again.isEmpty():
        return kept.union(nameless)
    more = kept.join(again, F.col("doc_id").cast("long") == F.col(fresh(docs)), "left_semi")
    return without(kept, again).union(more.dropDuplicates(["doc_id", "text"])).union(nameless)
