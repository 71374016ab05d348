"""Removal of repeated byte strings: common prefixes by backward extension on Burrows-Wheeler transforms.

Strings of ``LENGTH`` bytes that occur twice are found in three steps, none of which sorts all suffixes of the corpus.

1. Winnowing. Among the ``GRAM``-byte grams of each such string the one with the smallest hash is its anchor, so equal
   strings have equal anchors, and a document has about one anchor per 35 bytes. Anchors are grouped by hash.
2. Equal surroundings. An anchor's context is all bytes of the strings it can be the anchor of. Of anchors with equal
   contexts all but the first (smallest doc_id, then place) are covered, however many there are.
3. Different surroundings of one anchor. The first anchor of each distinct context brings its bytes; those that agree
   with no other on either side of the anchor are left out. Blocks of contexts are suffix-sorted to a bounded depth and transformed. Starting from short prefixes, intervals of suffixes
   with a common prefix are extended backwards by one byte at a time, breadth first; an interval that ends where no
   value is set yet sets the longest common prefix there. Values so come in increasing order, and the search stops at
   ``LENGTH``: neighbours without a value share ``LENGTH`` bytes or more. All but the first of such strings are covered.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, mix, rows_of, signed, tidy

LENGTH = 100
GRAM = 32
#: Anchors a task gathers before it keeps only the first of each context.
FLUSH_ANCHORS = 500_000
#: Bytes of contexts that are transformed at once, of several anchors and of a single one; an anchor with more is dealt
#: to several blocks, and their strings are merged by hash.
BLOCK_BYTES, ANCHOR_BYTES = 1_000_000, 4_000_000
#: Bits of a place in a block of at most ``ANCHOR_BYTES``, and up to which two ranks and a place fit a 64-bit number.
PLACE_BITS, SHORT_BITS = 24, 21

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any substrings of a text, from sums of byte values times powers."""

    up, down = powers(_BASE, 1 << 12), powers(_UNBASE, 1 << 12)

    def __init__(self, raw: bytes):
        n = len(raw)
        if n >= len(Rolling.up):
            size = 1 << (n + 1).bit_length()
            Rolling.up, Rolling.down = powers(_BASE, size), powers(_UNBASE, size)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[np.frombuffer(raw, dtype=np.uint8)] * Rolling.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Rolling.down[start] + (end - start).astype(np.uint64))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, hash of the context with its place in it) of each anchor; ties within a string all count."""
    width = length - gram + 1
    if len(raw) < length:
        return (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    roll = Rolling(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = roll.of(at, at + gram)
    least = sliding(grams, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    place = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), width, np.maximum) == grams)
    start, end = np.maximum(0, place - width + 1), np.minimum(len(raw), place + length)
    context = mix(roll.of(start, end) + (place - start).astype(np.uint64))
    return grams[place], place, context


_ROWS = pa.schema([("kind", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])
_COVER = pa.schema([("first", pa.int64()), ("second", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("end", pa.int64())])


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """kind 1: the first anchor with its context in a task's batch; kind 2: a later one, which is covered.

    ``place`` is the byte position times 2^32 plus 32 bits of the text's hash, so that it sorts by position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held
            if held:
                hashes, context, doc, place = (np.concatenate([h[k] for h in held]) for k in range(4))
                order = np.lexsort((place, doc, context, hashes))
                hashes, context, doc, place = hashes[order], context[order], doc[order], place[order]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (context[1:] != context[:-1])]
                again = np.r_[False, (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])] & ~new
                for kind, mask in ((1, new), (2, ~new & ~again)):
                    yield rows_of(_ROWS, kind=np.full(mask.sum(), kind), anchor=signed(hashes[mask]), context=signed(context[mask]), doc=doc[mask], place=place[mask])
            held, n_held = [], 0

        for batch in batches:
            for doc, tk, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                hashes, place, context = anchors(text.encode("utf-8", "surrogatepass"), length, gram) if text else anchors(b"", length, gram)
                if len(place):
                    held.append((hashes, context, np.full(len(place), doc), place << 32 | tk))
                    n_held += len(place)
                    if n_held >= FLUSH_ANCHORS:
                        yield from flush()
        yield from flush()

    return texts.mapInArrow(tidy(run), "kind long, anchor long, context long, doc long, place long")


#: Symbols (9 bits: a byte plus 1, or 0 between contexts) that a packed key holds.
PACKED = 7


def packed_keys(symbols: np.ndarray) -> np.ndarray:
    """The next ``PACKED`` symbols at each place as one number; zeros follow the end."""
    key = np.zeros(len(symbols), dtype=np.int64)
    for k in range(PACKED):
        key <<= 9
        key[: len(symbols) - k] |= symbols[k:]
    return key


def suffix_array(keys: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` symbols that follow, or more, by doubling from the packed keys' first four.

    Each number that is sorted holds what to sort by and, in its low bits, the place it belongs to; only in a block too
    long for that the places are sorted by reference.
    """
    n, done, at = len(keys), 4, np.arange(len(keys))
    if n >= 1 << PLACE_BITS:
        raise ValueError("a block has more places than its bits can name")
    mixed = np.sort(keys >> 9 * (PACKED - 4) << PLACE_BITS | at)
    order, what = mixed & ((1 << PLACE_BITS) - 1), mixed >> PLACE_BITS
    while True:
        new = np.r_[0, np.cumsum(what[1:] != what[:-1])]
        if done >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        bits = SHORT_BITS if n < 1 << SHORT_BITS else PLACE_BITS
        both = rank << bits
        both[: n - done] |= rank[done:] + 1
        if bits == SHORT_BITS:
            mixed = np.sort(both << bits | at)
            order, what = mixed & ((1 << bits) - 1), mixed >> bits
        else:
            order = np.argsort(both)
            what = both[order]
        done *= 2


def common_prefixes(symbols: np.ndarray, keys: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """Longest common prefix of each suffix in ``order`` with the one before, as far as it is under ``stop``; else -1.

    ``order`` sorts by the first ``stop`` symbols at least. Values under ``PACKED`` show in the packed keys. From there
    on an interval [low, high) holds the suffixes with one prefix; the symbols before them (the transform) say how it
    extends backwards and where the extended intervals lie, and only intervals that set a value are extended again.
    """
    n = len(order)
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = np.arange(n)
    before = symbols[order - 1].astype(np.int64)  # the Burrows-Wheeler transform; before the start stands the end
    to = inverse[order - 1]
    out = np.full(n + 1, -1, dtype=np.int64)
    first = keys[order]
    apart = first[1:] ^ first[:-1]
    differ = np.flatnonzero(apart) + 1
    out[differ] = PACKED - 1 - (np.frexp(apart[differ - 1].astype(np.float64))[1] - 1) // 9
    out[0] = out[n] = 0
    high = np.r_[differ, n]
    low = np.r_[0, differ]
    fresh = np.r_[out[differ] == PACKED - 1, True]
    low, high = low[fresh], high[fresh]
    for value in range(PACKED, stop):
        widths = high - low
        which = np.repeat(np.arange(len(low)), widths)
        members = np.arange(len(which)) - np.repeat(np.cumsum(widths) - widths, widths) + np.repeat(low, widths)
        mixed = np.sort((which << 9 | before[members]) << PLACE_BITS | to[members])
        key = mixed >> PLACE_BITS
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low = mixed[starts] & ((1 << PLACE_BITS) - 1)
        high = low + np.diff(np.r_[starts, len(key)])
        fresh = out[high] < 0
        low, high = low[fresh], high[fresh]
        high, pick = np.unique(high, return_index=True)
        low = low[pick]
        if not len(high):
            break
        out[high] = value
    return out[:n]


def repeated_strings(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, context, offset) of every string of ``length`` bytes that occurs at two places of ``contexts`` or more."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(sizes.sum() + len(sizes), dtype=np.int64)
    inside = np.ones(len(symbols), dtype=bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.int64) + 1
    keys = packed_keys(symbols)
    order = suffix_array(keys, length)
    same = common_prefixes(symbols, keys, order, length) < 0
    if length < PACKED:
        raw = np.stack([np.r_[symbols[k:], np.zeros(k, dtype=np.int64)][order] for k in range(length)])
        same = np.r_[False, (raw[:, 1:] == raw[:, :-1]).all(axis=0)]
    same[0] = False
    label = np.cumsum(~same)
    context = np.searchsorted(ends, order)
    offset = order - (ends - sizes)[context]
    whole = offset + length <= sizes[context]
    member = same.copy()
    member[:-1] |= same[1:]
    member &= whole
    return label[member], context[member], offset[member]


def worth_comparing(contexts: list[tuple[int, int, bytes, int]], length: int, gram: int) -> list[tuple[int, int, bytes, int]]:
    """Contexts of one anchor that can share ``length`` bytes with another: half of what lies outside the gram agrees on
    the left of it, or else on the right."""
    half = (length - gram) // 2
    left = [c[o - half : o] if o >= half else None for _, _, c, o in contexts]
    right = [c[o + gram : o + gram + half] if o + gram + half <= len(c) else None for _, _, c, o in contexts]
    lefts, rights = Counter(left), Counter(right)
    return [x for x, a, b in zip(contexts, left, right, strict=True) if a is not None and lefts[a] > 1 or b is not None and rights[b] > 1]


def compare_contexts(rows: DataFrame, length: int, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """Covered intervals, from ``rows`` (anchor, doc, place of the context's first byte, context, offset of the anchor), sorted by anchor.

    Columns first, second, doc, place, end: end is set for an interval; for an anchor whose contexts fill more than
    ``anchor_bytes`` the first place of each string in a block comes with its hash instead, to be merged.
    """

    def covered_in(held: list) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        docs, places = (np.array([h[k] for h in held], dtype=np.int64) for k in (0, 1))
        label, context, offset = repeated_strings([h[2] for h in held], length)
        doc, place = docs[context], places[context] + (offset << 32)
        order = np.lexsort((place, doc, label))
        label, doc, place = label[order], doc[order], place[order]
        new = np.r_[True, label[1:] != label[:-1]][: len(label)]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = ~new & ((doc != doc[lead]) | (place >> 32 != place[lead] >> 32))
        doc, place = doc[later], place[later]
        order = np.lexsort((place, place & 0xFFFFFFFF, doc))
        doc, place = doc[order], place[order]
        start = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] & 0xFFFFFFFF != place[:-1] & 0xFFFFFFFF) | (place[1:] - place[:-1] > length << 32)][: len(doc)]
        last = np.r_[start[1:], True][: len(doc)]
        zero = np.zeros(start.sum(), dtype=np.int64)
        yield rows_of(_COVER, first=zero, second=zero, doc=doc[start], place=place[start], end=(place[last] >> 32) + length)

    def firsts_of(held: list) -> Iterator[pa.RecordBatch]:
        first = {}
        for d, p, c, _ in held:
            for o in range(len(c) - length + 1):
                h = hashlib.blake2b(c[o : o + length], digest_size=16).digest()
                x = (d, p + (o << 32))
                if h not in first or x < first[h]:
                    first[h] = x
        if first:
            a, b = (np.frombuffer(b"".join(first), dtype=np.int64).reshape(-1, 2)[:, k] for k in (0, 1))
            docs, places = (np.array([x[k] for x in first.values()], dtype=np.int64) for k in (0, 1))
            yield rows_of(_COVER, first=a, second=b, doc=docs, place=places, end=[None] * len(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n_held, own, n_own, is_open = None, [], 0, [], 0, False
        for batch in batches:
            for anchor, doc, place, context, offset in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if anchor != key:
                    if is_open:
                        yield from covered_in(own)
                        yield from firsts_of(own)
                    else:
                        some = worth_comparing(own, length, gram)
                        size = sum(len(c) for _, _, c, _ in some)
                        if n_held + size > block_bytes:
                            yield from covered_in(held)
                            held, n_held = [], 0
                        held += some
                        n_held += size
                    key, own, n_own, is_open = anchor, [], 0, False
                if n_own + len(context) > anchor_bytes:
                    yield from covered_in(own)
                    yield from firsts_of(own)
                    own, n_own, is_open = [], 0, True
                own.append((doc, place, context, offset))
                n_own += len(context)
        if is_open:
            yield from covered_in(own)
            yield from firsts_of(own)
            yield from covered_in(held)
        else:
            some = worth_comparing(own, length, gram)
            if n_held + sum(len(c) for _, _, c, _ in some) > block_bytes:
                yield from covered_in(held)
                held = []
            yield from covered_in(held + some)

    return rows.mapInArrow(tidy(run), "first long, second long, doc long, place long, end long")


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Byte intervals to remove: doc_id, tk, spans (sorted disjoint array of start, end)."""
    texts = keyed(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    found = cut(anchor_rows(texts.selectExpr("doc_id as doc", "tk", "text"), length, gram))
    seen = found.where("kind = 1").selectExpr(
        "anchor", "context", "doc", "place", "row_number() over (partition by anchor, context order by doc, place) as turn",
        "min(context) over (partition by anchor) != max(context) over (partition by anchor) as mixed",
    )
    shared = cut(seen.where("turn > 1 or mixed"))
    width = length - gram
    first_byte = F.greatest(F.lit(0), F.shiftright("place", 32) - width)
    again = shared.where("turn > 1").select("doc", "place").union(found.where("kind = 2").select("doc", "place"))
    again = again.select("doc", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tk"), first_byte.alias("start"), (F.shiftright("place", 32) + length).alias("end"))

    wanted = shared.where("turn = 1 and mixed").select("doc", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tk"), "anchor", F.shiftright("place", 32).alias("at"))
    wanted = wanted.groupBy("doc", "tk").agg(F.collect_list(F.struct("anchor", "at")).alias("wanted"))
    ids = cut(wanted.select(F.col("doc").alias("doc_id")).distinct())
    some = texts.join(bounded(ids), "doc_id", "left_semi").dropDuplicates(["doc_id", "tk"]).selectExpr("doc_id as doc", "tk", "text")
    schema = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("context", pa.binary()), ("offset", pa.int64())])

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tk, text, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                start = [max(0, p["at"] - width) for p in places]
                yield rows_of(
                    schema, anchor=[p["anchor"] for p in places], doc=[doc] * len(places), place=[s << 32 | tk for s in start],
                    context=[raw[s : p["at"] + length] for s, p in zip(start, places, strict=True)], offset=[p["at"] - s for s, p in zip(start, places, strict=True)],
                )

    brought = some.join(wanted, ["doc", "tk"]).select("doc", "tk", "text", "wanted").mapInArrow(tidy(bring), "anchor long, doc long, place long, context binary, offset long")
    compared = cut(compare_contexts(brought.repartition("anchor").sortWithinPartitions("anchor"), length, gram))
    tk = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tk")
    at = F.shiftright("place", 32)
    mixed = compared.where("end is not null").select("doc", tk, at.alias("start"), "end")
    split = compared.where("end is null").selectExpr("*", "min(struct(doc, place)) over (partition by first, second) as least")
    split = split.where("doc != least.doc or shiftright(place, 32) != shiftright(least.place, 32)").select("doc", tk, at.alias("start"), (at + length).alias("end"))
    every = again.union(mixed).union(split)
    grouped = every.groupBy(F.col("doc").alias("doc_id"), "tk").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return grouped.select("doc_id", "tk", F.transform("spans", lambda s: F.array(s["start"], s["end"])).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tk (31 bits of the text's hash, which tells rows of one doc_id with other texts apart), text (never null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).alias("tk"), text.alias("text"))


def remove(raw: bytes, spans: list[list[int]] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    parts, last, runs, gone = [], 0, 0, 0
    for start, end in spans or []:
        end = min(end, len(raw))
        if start > last or not runs and start >= last:
            parts.append(raw[last:start])
            runs += 1
        elif end <= last:
            continue
        gone += end - max(start, last)
        last = end
    return b"".join(parts) + raw[last:], gone, runs


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary, what is left).

    Each byte goes that lies in a string of ``length`` bytes which also starts earlier: in a document with a smaller
    doc_id, or earlier in the same one. Strings are judged on the texts as given; they don't cross documents and may
    start or end inside a character. Texts under ``length`` bytes and null texts (taken as empty) lose nothing. Rows
    with a null doc_id lose nothing and count for nothing. Repeated rows stand at the same place and don't remove each
    other. Other columns are not looked at.
    """
    spans = cut(covered(docs, length, gram))
    ids = cut(spans.select("doc_id").distinct())
    rows = keyed(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            done = [remove(r, s) for r, s in zip(raw, batch.column(2).to_pylist(), strict=True)]
            yield rows_of(schema, doc_id=batch.column(0), n_bytes=[len(r) for r in raw], n_removed=[d[1] for d in done], n_spans=[d[2] for d in done], kept=[d[0] for d in done])

    cut_ones = rows.join(bounded(ids), "doc_id", "left_semi").join(spans, ["doc_id", "tk"], "left").select("doc_id", "text", "spans")
    whole = rows.join(bounded(ids), "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("array<array<long>>").alias("spans"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return cut_ones.mapInArrow(tidy(run), out).union(whole.mapInArrow(tidy(run), out))
