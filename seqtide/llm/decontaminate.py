"""Benchmark decontamination: MinHash containment search partitioned by size, verified by exact shingle containment.

Items of up to ``EXACT`` shingles have too few MinHash values for that search: all their shingles are looked up in the
document, which also counts those that are shared. Larger items are searched as follows.

Test items are put into classes by size (powers of two of their number of shingles). For a class with items of up to s
shingles a document is seen as windows of 2s shingles that start every s, so an item that stands in the document lies
within one window, and its Jaccard similarity with that window has a known lower bound; the number of MinHash values
follows from it. A window and an item that share a value are a candidate, and the share of the item's shingles that
occur in the whole document decides. As each class has its own window size, a long document is searched no worse
than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_words, mix, rows_of, shingles, tidy, without, word_list

WORDS = 5
PERCENT = 80
#: Items of up to this many shingles are found by an index of all their shingles.
EXACT = 16
#: MinHash values of a window and an item; for items over ``EXACT`` shingles a pair at the lowest similarity of a class
#: shares none with about one in a million.
BINS = 64
#: The index is asked only for shingles whose low bits some small item has.
FILTER_BITS = 20
#: Test items that are searched for in one pass over the documents; more are searched in further passes.
ITEMS_PER_PASS = 20_000
PAIRS = "doc_id long, item_id long, item_shingles long, shared_shingles long"


def bin_minima(hashes: np.ndarray, group: np.ndarray, groups: int, bins: int = BINS) -> np.ndarray:
    """Smallest hash in each of ``bins`` bins (the low bits say which) of every group: groups x bins, ~0 for an empty bin."""
    out = np.full(groups * bins, ~np.uint64(0), dtype=np.uint64)
    np.minimum.at(out, group * bins + (hashes % np.uint64(bins)).astype(np.int64), hashes)
    return out.reshape(groups, bins)


class Items:
    """The items of one pass: their shingle sets, the shingles of small items with the items that have them, and by size
    class of the larger ones every MinHash value with the items that have it."""

    def __init__(self, rows: list[tuple[int, str | None]], words: int = WORDS):
        found = []
        for item, text in rows:
            tokens = hash_words(word_list(text))
            if item is not None and len(tokens) >= words:
                found.append((item, np.unique(shingles(tokens, words))))
        found.sort(key=lambda x: x[0])
        self.ids, self.sets = [i for i, _ in found], [s for _, s in found]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        small = np.flatnonzero(self.sizes <= EXACT)
        value, who = mix(np.concatenate([np.zeros(0, dtype=np.uint64), *(self.sets[k] for k in small)])), np.repeat(small, self.sizes[small])
        order = np.argsort(value, kind="stable")
        self.value, self.who = value[order], who[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.low_bits(value)] = True
        self.classes = {}
        for k in np.flatnonzero(self.sizes > EXACT).tolist():
            self.classes.setdefault(1 << (len(self.sets[k]) - 1).bit_length(), []).append(k)
        self.minima = {}
        for size, members in self.classes.items():
            sets = [mix(self.sets[k]) for k in members]
            table = bin_minima(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
            value, who = table.ravel(), np.repeat(members, BINS)
            keep = value != ~np.uint64(0)
            order = np.argsort(value[keep], kind="stable")
            self.minima[size] = (value[keep][order], who[keep][order])

    @staticmethod
    def low_bits(x: np.ndarray) -> np.ndarray:
        return (x & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def small_hits(self, hashes: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """(item, shared shingles) of the small items that are contained, from the document's mixed shingles."""
        seen = np.unique(hashes[self.filter[self.low_bits(hashes)]])
        low, high = np.searchsorted(self.value, seen), np.searchsorted(self.value, seen, side="right")
        hits = [self.who[a:b] for a, b in zip(low[high > low], high[high > low], strict=True)]
        if not hits:
            return []
        who, shared = np.unique(np.concatenate(hits), return_counts=True)
        enough = 100 * shared >= percent * self.sizes[who]
        return list(zip(who[enough].tolist(), shared[enough].tolist(), strict=True))

    def search(self, words: np.ndarray, k: int = WORDS, percent: int = PERCENT) -> list[tuple[int, int, int]]:
        """(item_id, shingles of the item, those in the document) of each item that is contained."""
        if len(words) < k or not self.ids:
            return []
        own = shingles(words, k)
        hashes, candidates = mix(own), set()
        out = [(self.ids[c], len(self.sets[c]), shared) for c, shared in self.small_hits(hashes, percent)]
        for size, (value, who) in self.minima.items():
            blocks = bin_minima(hashes, np.arange(len(own)) // size, -(-len(own) // size))
            seen = np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
            seen = seen[seen != ~np.uint64(0)]
            low = np.searchsorted(value, seen)
            high = np.searchsorted(value, seen, side="right")
            for a, b in zip(low[high > low], high[high > low], strict=True):
                candidates.update(who[a:b].tolist())
        if not candidates:
            return out
        have = np.unique(own)
        for c in sorted(candidates):
            shared = int(np.isin(self.sets[c], have, assume_unique=True).sum())
            if 100 * shared >= percent * len(self.sets[c]):
                out.append((self.ids[c], len(self.sets[c]), shared))
        return out


def contaminated_pairs(docs: DataFrame, items: DataFrame, words: int = WORDS, percent: int = PERCENT, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles): items of which ``percent`` / 100 or more of the distinct
    shingles of ``words`` words occur in the document's whole text. A document and item stand in one row.

    The items are the stated query set: they are searched in passes of ``per_pass``, each pass small enough to send to
    every task and gone from the driver before the next, and each reads all documents; documents are never shuffled. Items with fewer than ``words`` words, null
    texts and null item ids match nothing; so do documents with a null id or no text. Items with equal texts each match.
    """
    spark = docs.sparkSession
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "item_shingles", "shared_shingles")])
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    passes = max(1, -(-wanted.count() // per_pass))
    out = spark.createDataFrame([], PAIRS)
    for number in range(passes):
        block = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        found = Items([(r["item_id"], r["text"]) for r in block.collect()], words)

        def run(batches: Iterator[pa.RecordBatch], found: Items = found) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc, *hit)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for hit in found.search(hash_words(word_list(text)), words, percent)
                ]
                yield rows_of(schema, **{f.name: [r[k] for r in rows] for k, f in enumerate(schema)})

        pairs = texts.mapInArrow(tidy(run), PAIRS)
        # Of several passes each is written before the next one's items come to the driver.
        out = out.union(cut(pairs) if passes > 1 else pairs)
    return out.groupBy("doc_id", "item_id").agg(F.max("item_shingles").alias("item_shingles"), F.max("shared_shingles").alias("shared_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a test item; rows with a null doc_id stay."""
    gone = cut(contaminated_pairs(docs, items).select("doc_id").distinct())
    return without(docs, gone)
