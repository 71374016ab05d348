"""Jaccard similarity join of shingle sets by parity sketches.

A set's sketch has ``p`` pieces of 2^16 bits; each shingle flips one bit, chosen by its hash, so two sketches differ in
at most as many pieces as the sets' symmetric difference has members, and their Hamming distance is a lower bound of it.
Sizes fall into bands by powers of two. In a band a similarity of t bounds the symmetric difference of a set with any
partner by d, and by the pigeonhole principle d + 1 pieces that hold something of it include one that is equal in both.
So each set gives d + 1 keys to its band, and to the band below if it can have a partner there.

Which pieces: the first d + 1 with at least two set bits. At most d of them differ, so one is equal in the partner,
holds as many bits there, and stands among the partner's first ones too, or else the argument holds from the partner's
side. A set with too few such pieces gives all its pieces. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, cut, mix, rows_of, shingle_set, signed, tidy, without

PIECE_BITS = 16
#: Keys a task gathers before it reduces them to one row per key.
FLUSH_KEYS = 1_000_000
#: Bits of the dense sketch that candidates are held against before their sets are.
DENSE_BITS = 2048
#: Documents of a bucket whose sketches, and of a cluster whose sets, are compared in one task at a time.
SKETCH_BLOCK, SET_BLOCK = 4096, 512

_FOUND = pa.schema([(c, pa.int64()) for c in ("kind", "a", "b", "c", "d")])
_SETS = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("dense", pa.binary()), ("members", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def apart(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of sets of sizes a and b whose similarity is ``percent`` / 100 or more."""
    return (a + b) * (100 - percent) // (100 + percent)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both) > 0


def sketch(members: np.ndarray, pieces: int) -> np.ndarray:
    """Positions of the sketch's set bits, sorted: those that an odd number of members flip."""
    place = (members % np.uint64(pieces)) << np.uint64(PIECE_BITS) | members >> np.uint64(64 - PIECE_BITS)
    at, times = np.unique(place, return_counts=True)
    return at[times % 2 == 1]


def keys_of(members: np.ndarray, percent: int) -> np.ndarray:
    """The set's keys in its own band, and in the one below if a partner can be there."""
    n, found = len(members), []
    band = (n - 1).bit_length()
    for j in (band, band - 1):
        top = 1 << max(j, 0)
        if j < 0 or j < band and -(-percent * n // 100) > top:
            continue
        most = apart(top, top * 100 // percent, percent)
        pieces = most + most * 3 // 20 + 3
        d = apart(n, n * 100 // percent if j == band else top, percent)
        bits = sketch(members, pieces)
        piece = bits >> np.uint64(PIECE_BITS)
        start = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(bits) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.r_[start, len(bits)])
        content = np.zeros(pieces, dtype=np.uint64)
        if len(bits):
            content[piece[start].astype(np.int64)] = np.add.reduceat(mix(bits + np.uint64(1)), start)
        full = piece[start][count >= 2].astype(np.int64)
        use = full[: d + 1] if len(full) > d else np.arange(pieces)
        found.append(mix(content[use] + mix(use.astype(np.uint64) << np.uint64(8) | np.uint64(j))))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def sketch_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """kind 0: a = doc_id, b = set size, c and d = hash of the set. kind 1: a = key, b = first doc_id with it in a
    task's batch. kind 2: a = key, b = another doc_id with it, c = that first one. Sets equal to one seen before in the
    batch give no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, n_held, seen = [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, n_held, seen
            if held:
                key = np.concatenate(held)
                doc = np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in held])
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.r_[True, key[1:] != key[:-1]]
                first = doc[new][np.cumsum(new) - 1]
                other = ~new & (doc != first)
                zero = np.zeros(len(key), dtype=np.int64)
                for kind, mask in ((1, new), (2, other)):
                    yield rows_of(_FOUND, kind=zero[mask] + kind, a=signed(key)[mask], b=doc[mask], c=first[mask], d=zero[mask])
            held, ids, n_held, seen = [], [], 0, set()

        for batch in batches:
            own = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                members = shingle_set(text, words)
                h, g = (int(signed(np.array([x], dtype=np.uint64))[0]) for x in (np.add.reduce(mix(members)), np.bitwise_xor.reduce(mix(members + np.uint64(7)))))
                own.append((doc, len(members), h, g))
                if doc is not None and len(members) and (h, g) not in seen:
                    seen.add((h, g))
                    held.append(keys_of(members, percent))
                    ids.append(doc)
                    n_held += len(held[-1])
                    if n_held >= FLUSH_KEYS:
                        yield from flush()
            a, b, c, d = (list(x) for x in zip(*own, strict=True)) if own else ([], [], [], [])
            yield rows_of(_FOUND, kind=[0] * len(own), a=a, b=b, c=c, d=d)
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "kind long, a long, b long, c long, d long")


def dense_sketch(members: np.ndarray, bits: int = DENSE_BITS) -> np.ndarray:
    """The parity sketch of one piece of ``bits`` bits, packed into words."""
    return np.packbits(np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def maybe(dense: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Which of the sets with sketches ``dense`` can be similar to a set: sizes and Hamming distance allow it."""
    far = np.bitwise_count(dense ^ one).sum(axis=1, dtype=np.int64)
    return (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)) & (far * (100 + percent) <= (sizes + size) * (100 - percent))


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, size, dense (sketch), members (sorted 64-bit shingle hashes) of the documents in ``ids`` (one column, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield rows_of(_SETS, id=batch.column(0), size=[len(x) for x in sets], dense=[dense_sketch(x).tobytes() for x in sets], members=[x.tobytes() for x in sets])

    some = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(bounded(ids), "id", "left_semi")
    return some.mapInArrow(tidy(run), "id long, size long, dense binary, members binary")


def check_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar: first by sketch, then by intersection."""

    def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(k).to_numpy() for k in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint64).reshape(len(m), -1) for k in (4, 5))
            far = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (far * (100 + percent) <= (m + n) * (100 - percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(m, dtype=np.uint64) for m in batch.column(k).to_pylist()] for k in (2, 3))
            keep = pa.array([similar(p, q, percent) for p, q in zip(x, y, strict=True)], type=pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    a, b = (sets.select(F.col("id").alias(c), F.col("size").alias(c + "_size"), F.col("dense").alias(c + "_dense")) for c in "ab")
    close = pairs.join(a, "a").join(b, "b").select("a", "b", "a_size", "b_size", "a_dense", "b_dense").mapInArrow(tidy(by_sketch), "a long, b long")
    a, b = (sets.select(F.col("id").alias(c), F.col("members").alias(c + "_members")) for c in "ab")
    return cut(close).join(a, "a").join(b, "b").select("a", "b", "a_members", "b_members").mapInArrow(tidy(by_set), "a long, b long")


def in_cells(rows: DataFrame, key: str, sizes: DataFrame, block: int) -> DataFrame:
    """``rows`` of the keys in ``sizes`` (key, n) dealt into cells of at most twice ``block`` rows: each block of a key
    against itself (low = high) and against every other. side is the row's own block."""
    dealt = rows.join(sizes.select(key, F.ceil(F.col("n") / block).cast("int").alias("parts")), key)
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("other", "parts")


def compare_cells(cells: DataFrame, key: str, percent: int, exact: bool) -> DataFrame:
    """Links between different components within each cell, as pairs of component ids.

    Only pairs that sizes and sketches allow are looked at; with ``exact`` their sets are intersected. Components that
    a link joins are one from then on, so a cell gives fewer links than it has components, and when all are one it ends.
    """

    def run(group: pa.Table) -> pa.Table:
        side, own = group["side"].to_numpy(), group["component"].to_numpy()
        comp, sizes = own.copy(), group["size"].to_numpy()
        members = [np.frombuffer(m, dtype=np.uint64) for m in group["members"].to_pylist()] if exact else []
        bits = 1 << max(11, min(17, int(8 * sizes.max()).bit_length()))
        dense = np.stack([dense_sketch(m, bits) for m in members] if exact else [np.frombuffer(d, dtype=np.uint64) for d in group["dense"].to_pylist()])
        two, found = side.min() != side.max(), []
        for i in range(len(comp) - 1):
            rest = np.arange(i + 1, len(comp))
            rest = rest[(comp[rest] != comp[i]) & ((side[rest] != side[i]) | (not two))]
            for j in rest[maybe(dense[rest], sizes[rest], dense[i], int(sizes[i]), percent)] if len(rest) else rest:
                if comp[j] != comp[i] and (not exact or similar(members[i], members[j], percent)):
                    comp[comp == comp[j]] = comp[i]
                    found.append((own[i], own[j]))
            if i % 64 == 0 and (comp == comp[0]).all():
                break
        a, b = (list(x) for x in zip(*found, strict=True)) if found else ([], [])
        return pa.Table.from_batches([rows_of(_LINKS, a=a, b=b)])

    columns = [key, "low", "high", "side", "component", "size", "members" if exact else "dense"]
    return cells.select(*columns).groupBy(key, "low", "high").applyInArrow(run, "a long, b long")


def remaining_links(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that still share a bucket. ``member``: key, id, component.

    Sketches, which are small, are compared in every bucket and tie components into clusters that may be linked; sets
    are then sent once to their cluster and compared there.
    """
    mixed = member.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).where("n > 2 and least != most")
    mixed = cut(mixed.select("key", "n"))
    open_rows = cut(member.join(mixed.select("key"), "key"))
    sketches = sets.select("id", "size", "dense")
    close = cut(compare_cells(in_cells(open_rows, "key", mixed, SKETCH_BLOCK).join(sketches, "id"), "key", percent, exact=False))
    tied = components(close).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    rows = cut(open_rows.select("id", "component").distinct().join(tied, "component"))
    size = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    full = in_cells(rows, "cluster", size, SET_BLOCK).join(sets.select("id", "size", "members"), "id")
    return compare_cells(full, "cluster", percent, exact=True)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are lower-cased (A-Z) runs without ASCII white space; a document's set is its distinct shingles of ``words``
    words (shorter: the whole sequence), and two link at ``percent`` / 100 or more. Equal sets are one class, compared
    once. Each bucket's members are compared with the bucket's smallest document; in buckets that still hold several
    components and three members or more the rest is compared too, in blocks (``remaining_links``), so nothing is capped.

    Nulls and empty texts have n_shingles 0 and link with nothing. A row with a null doc_id has component_id null.
    Rows that share a doc_id are one document, with the links of each of their texts. Other columns are not looked at.
    """
    found = cut(sketch_rows(docs, words, percent))
    own = found.where("kind = 0").selectExpr("a as doc_id", "b as n_shingles", "c", "d")
    classes = own.where("n_shingles > 0 and doc_id is not null").groupBy("c", "d").agg(F.min("doc_id").alias("class"), F.count("*").alias("rows"))
    several = classes.where("rows > 1").select("c", "d", "class")
    equal = cut(own.where("n_shingles > 0 and doc_id is not null").join(several, ["c", "d"]).where("doc_id != class").select("doc_id", "class").distinct())

    seen = found.where("kind = 1").selectExpr("a as key", "b as id", "min(b) over (partition by a) as rep", "max(b) over (partition by a) as last")
    shared = seen.where("rep != last").select("key", "id", "rep")
    local = found.where("kind = 2").selectExpr("a as key", "b as id", "c as rep")
    held = shared.union(local)
    named = equal.select(F.col("doc_id").alias("id"), F.col("class").alias("id_class"))
    held = held.join(named, "id", "left").withColumn("id", F.coalesce("id_class", "id")).drop("id_class")
    named = equal.select(F.col("doc_id").alias("rep"), F.col("class").alias("rep_class"))
    held = cut(held.join(named, "rep", "left").withColumn("rep", F.coalesce("rep_class", "rep")).drop("rep_class").distinct())

    pairs = held.where("id != rep").selectExpr("id as a", "rep as b").distinct()
    ids = cut(held.select("id").union(held.select("rep")).distinct())
    sets = cut(sets_of(docs, ids, words).distinct())
    links = cut(check_pairs(pairs, sets, percent))
    first = cut(components(links))

    member = held.select("key", "id").union(held.select("key", "rep")).distinct()
    member = member.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = remaining_links(cut(member), sets, percent)

    links = links.union(more).union(equal.selectExpr("doc_id as a", "class as b"))
    final = components(links).withColumnRenamed("node", "doc_id")
    joined = own.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, its smallest doc_id; all columns as they were. Rows with a null
    doc_id stay."""
    found = jaccard_components(docs, words, percent)
    gone = cut(found.where("component_id != doc_id").select("doc_id").distinct())
    return without(docs, gone)
