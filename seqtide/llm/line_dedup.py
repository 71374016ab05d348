"""Line deduplication over overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut


def line_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per run of ``width`` consecutive lines: doc_id, tk (hash of the text), at (line number from 0), h (128-bit hash)."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    cells = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), lines.alias("lines"))
    runs = F.transform(F.sequence(F.lit(0), F.size("lines") - width), lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, width), "\n"))))
    return cells.where(F.size("lines") >= width).select("doc_id", "tk", F.posexplode(runs).alias("at", "h"))


def later_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """Line numbers to remove per text: doc_id, tk, gone (sorted array of ints).

    A window is a later occurrence if the same lines stand at a smaller (doc_id, line). Its first occurrence is a
    minimum, which Spark reduces before the shuffle however common the window is; only windows that repeat are joined
    back to it, and a window of very many rows is a skewed join that is split.
    """
    runs = line_windows(docs, width).where("doc_id is not null")
    first = runs.groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    later = runs.join(first, "h").where(F.struct("doc_id", "at") > F.col("first"))
    each = later.select("doc_id", "tk", F.explode(F.sequence("at", F.col("at") + width - 1)).alias("line"))
    return each.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def line_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, n_spans (maximal runs removed), text (what is left).

    Lines are what stands between "\\n"; a null or empty text is one empty line. A line goes if a window of ``width``
    lines over it also starts earlier (smaller doc_id, or same document and earlier line). Texts with fewer lines lose
    nothing. Rows with a null doc_id lose nothing and count for nothing; repeated rows of a document stand at the
    same place and don't remove each other. Other columns are not looked at. Only texts that lose lines are shuffled,
    as long as their ids are few enough to be sent to all tasks.
    """
    gone = cut(later_lines(docs, width))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), body.alias("body"))
    lines = F.split("body", "\n", -1)
    none = F.array().cast("array<int>")
    ids = cut(gone.select("doc_id").distinct())
    hit = rows.join(bounded(ids), "doc_id", "left_semi").join(gone, ["doc_id", "tk"], "left").select("doc_id", "body", F.coalesce("gone", none).alias("gone"))
    rows = hit.union(rows.join(bounded(ids), "doc_id", "left_anti").select("doc_id", "body", none.alias("gone")))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    starts = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) != x - 1))
    return rows.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.size(starts).cast("long").alias("n_spans"),
        F.when(F.size("gone") == 0, F.col("body")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).alias("text"),
    )
