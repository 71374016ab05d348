"""N-gram language model in Elias-Fano tries, trained and queried where the n-grams are.

Documents are tokenised once into blocks (a row each: distinct word hashes, token numbers). Blocks ask for what they
need and get it back, so neither the vocabulary nor the trie has to fit anywhere whole:

* unigram shards (by word) add up the blocks' training counts and answer with counts;
* trie shards (by order and context) add up training n-grams, build a trie and answer with codes of smoothed probabilities;
* each block then scores its documents from the answers.

P(w | u v) = a(u v, w) + b(u v) P(w | v), and so on down to P(w | v) = a(v, w) + b(v) P(w), with a = (c(v w) - D) / c(v),
b = D n(v) / c(v), n the number of different words after v (a = 0 and b = 1 if v wasn't seen), and P the add-0.1 unigram
model, which sums to 1 over the known words and one unknown. Before the start of a document stand end tokens. a and b
are rounded down to 8-bit codes, so the probabilities sum to 1 at most.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_words, mix, rows_of, signed, tidy, word_list

FOLDS = 10
DISCOUNT = 0.75
BLOCK_TOKENS = 2_000_000
#: Entries a shard takes on average; the number of shards follows from the input.
SHARD_ENTRIES = 600_000
#: Contexts with more than this share of a thousand tokens are dealt to many trie shards by the word after them; there
#: are at most a thousand of them of each order. The list decides where the work is done, not its result.
WIDE = 1000
CODES = 255
SUCCESSOR_BITS = 40
END = hash_words([b""])[0]


def packed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def unpacked(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), dtype=dtype)


def least_of(n_train: int) -> float:
    """A power of ten (by its exponent) that no probability or back-off of ``n_train`` training tokens lies under."""
    return -float(max(1, math.ceil(math.log10(max(n_train, 1) / min(DISCOUNT, 1 - DISCOUNT)))))


def coded(x: np.ndarray, least: float) -> np.ndarray:
    """8-bit codes of log10 x over the range from ``least`` to 0, rounded down; 0 is kept for nothing."""
    return np.clip(np.floor((np.log10(x) - least) / -least * (CODES - 1)) + 1, 1, CODES).astype(np.uint8)


def decoded(code: np.ndarray, least: float) -> np.ndarray:
    return np.where(code > 0, 10 ** ((code.astype(float) - 1) / (CODES - 1) * -least + least), 0.0)


def ascending(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers by their gaps, byte by byte of all, compressed: the high bytes of the gaps are mostly zero."""
    return packed(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def ascended(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpacked(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def by_place(x: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """``x`` (numbers under 2^``bits``) sorted, and the places the values had, like ones in order. Values are sorted together
    with their places, which is several times faster than argsort; where both don't fit, the leading bits, if they tell the order."""
    low = len(x).bit_length()
    left = max(0, bits + low - 64)
    key = x.astype(np.uint64) >> np.uint64(left) << np.uint64(low)
    key |= np.arange(len(x), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << low) - 1)).astype(np.int64)
    if not left:
        return (key >> np.uint64(low)).astype(x.dtype), order
    values = x[order]
    if (values[1:] < values[:-1]).any():  # values alike in their leading bits
        order = np.argsort(x, kind="stable")
        values = x[order]
    return values, order


def distinct(x: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of numbers under 2^``bits``, where each of ``x`` stands among them, and how often they occur."""
    values, order = by_place(x, bits)
    new = np.r_[True, values[1:] != values[:-1]][: len(x)]
    at = np.empty(len(x), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return values[first], at, np.diff(np.r_[first, len(x)])


def pair_order(shard: np.ndarray, name: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The order by shard, name and word after it (40 bits): by shard and the name's leading bits, then by that group and
    the word. Pairs alike in all three have one answer, so their order among themselves doesn't matter."""
    if not len(shard):
        return np.zeros(0, dtype=np.int64)
    bits = max(1, int(shard.max()).bit_length())
    key = shard.astype(np.uint64) << np.uint64(64 - bits) | name >> np.uint64(bits)
    first = np.argsort(key)
    key, names = key[first], name[first]
    new = np.r_[True, key[1:] != key[:-1]]
    if len(key) >> (64 - SUCCESSOR_BITS) or (~new[1:] & (names[1:] != names[:-1])).any():  # two names alike in their leading bits
        return np.lexsort((after, name, shard))
    return first[np.argsort((np.cumsum(new) - 1).astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | after[first])]


class Monotone:
    """Elias-Fano code of a non-decreasing sequence: the low bits of each value side by side, the high parts in unary.

    ``find`` is the successor search: the values with a query's high part stand in order between two zeros of the unary
    part, however many they are, and are halved until one is left.
    """

    def __init__(self, raw: memoryview):
        self.n, self.bits, high_bytes = (int(x) for x in np.frombuffer(raw[:24], dtype=np.int64))
        self.high = np.frombuffer(raw[24 : 24 + high_bytes], dtype=np.uint8)
        low = np.frombuffer(raw[24 + high_bytes :], dtype=np.uint8)
        self.low = np.ndarray(len(low) - 7, dtype="<u8", buffer=low, strides=(1,))
        self.zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        bits = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros(n + (universe >> bits) + 2, dtype=np.uint8)
        unary[high + np.arange(n)] = 1
        flat = np.unpackbits(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, count=bits, bitorder="little").ravel()
        body = np.packbits(unary, bitorder="little").tobytes()
        return np.array([n, bits, len(body)], dtype=np.int64).tobytes() + body + np.packbits(flat, bitorder="little").tobytes() + bytes(8)

    def low_of(self, at: np.ndarray) -> np.ndarray:
        place = at * self.bits
        return (self.low[place >> 3] >> (place & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    @functools.cached_property
    def ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.high, bitorder="little"))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.ones[at] - at).astype(np.uint64) << np.uint64(self.bits) | self.low_of(at)

    def find(self, values: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, -1 where it isn't there; with ``start`` and ``stop`` only from one to before the other."""
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        inside = high < len(self.zeros)
        h = np.where(inside, high, 0)
        at = np.where(h > 0, self.zeros[np.maximum(h - 1, 0)] - (h - 1), 0)
        end = np.where(inside, self.zeros[h] - h, 0)
        if start is not None:
            at, end = np.maximum(at, start), np.minimum(end, stop)
        want = values & np.uint64((1 << self.bits) - 1)
        low, high = np.minimum(at, end), end.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            before = self.low_of(middle) < want[todo]
            low[todo] = np.where(before, middle + 1, low[todo])
            high[todo] = np.where(before, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        found = low < end
        out = np.full(len(values), -1)
        out[found] = np.where(self.low_of(low[found]) == want[found], low[found], -1)
        return out


class Trie:
    """Contexts, pointers to their successors, and successors, each level a ``Monotone``, with codes beside them.

    To the successors of a context the last value before them is added, which keeps the sequence in order. Only inside
    the range that the pointers give does a value tell its successor.
    """

    def __init__(self, raw: memoryview):
        sizes = np.frombuffer(raw[:40], dtype=np.int64)
        ends = np.cumsum(sizes) + 40
        part = [raw[e - s : e] for s, e in zip(sizes, ends, strict=True)]
        self.contexts, self.pointers, self.successors = (Monotone(p) for p in part[:3])
        self.backoff, self.codes = (np.frombuffer(p, dtype=np.uint8) for p in part[3:])

    @staticmethod
    def build(context: np.ndarray, successor: np.ndarray, count: np.ndarray, totals: dict[int, int], least: float) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(trie, contexts, successors of each) from sorted distinct pairs. ``totals`` has c(v) of contexts that are dealt to several tries."""
        new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.r_[new, len(context)])
        names = context[new]
        total = np.add.reduceat(count, new).astype(float) if len(new) else np.zeros(0)
        for v, n in totals.items():
            at = np.searchsorted(names, np.uint64(v))
            if at < len(names) and names[at] == np.uint64(v):
                total[at] = n
        rank = np.repeat(np.arange(len(new), dtype=np.uint64), sizes)
        last = successor[new + sizes - 1]
        before = np.cumsum(last, dtype=np.uint64) - last
        value = before[rank.astype(np.int64)] + successor
        parts = [
            Monotone.encode(names, 1 << 64),
            Monotone.encode(np.r_[0, np.cumsum(sizes)].astype(np.uint64), len(context) + 1),
            Monotone.encode(value, int(value[-1]) + 1 if len(value) else 1),
            coded(DISCOUNT * sizes / total, least).tobytes(),
            coded((count - DISCOUNT) / np.repeat(total, sizes), least).tobytes(),
        ]
        return np.array([len(p) for p in parts], dtype=np.int64).tobytes() + b"".join(parts), names, sizes

    def context_ranks(self, contexts: np.ndarray) -> np.ndarray:
        return self.contexts.find(contexts) if self.contexts.n else np.full(len(contexts), -1)

    def successor_codes(self, ranks: np.ndarray, successors: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Codes of a for (context by rank, successor); 0 if the pair wasn't seen. With ``sizes`` each context has so many successors."""
        sizes = np.ones(len(ranks), dtype=np.int64) if sizes is None else sizes
        out = np.zeros(len(successors), dtype=np.uint8)
        seen = ranks >= 0
        if seen.any() and self.successors.n:
            start, stop = (self.pointers.get(ranks[seen] + k).astype(np.int64) for k in (0, 1))
            before = np.where(start > 0, self.successors.get(np.maximum(start - 1, 0)), np.uint64(0))
            known, n = np.flatnonzero(np.repeat(seen, sizes)), sizes[seen]
            at = self.successors.find(np.repeat(before, n) + successors[known], np.repeat(start, n), np.repeat(stop, n))
            out[known] = np.where(at >= 0, self.codes[np.maximum(at, 0)], 0)
        return out


BLOCKS = pa.schema([
    ("block", pa.int64()), ("docs", pa.binary()), ("held", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()),
    ("n_words", pa.int64()), ("n_train", pa.int64()),
])
_ASK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("successors", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("kind", pa.int64()), ("block", pa.int64()), ("shard", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("x", pa.int64()), ("y", pa.int64())])
ASK = "shard long, block long, keys binary, sizes binary, successors binary, counts binary"
ANSWER = "kind long, block long, shard long, a binary, b binary, x long, y long"


def token_blocks(docs: DataFrame, folds: int) -> DataFrame:
    """Blocks of whole documents, about ``BLOCK_TOKENS`` tokens each; words stand by their count in the block, tokens are their numbers.

    A block is named by its partition and its number there, so blocks of the same rows stay apart. The result has to be
    written before it is used: made again from rows in another order, blocks would hold others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, flags, n_held, block = [], [], [], 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, flags, n_held, block
            if held:
                sizes, flat = np.array([len(h) for h in held], dtype=np.int32), np.concatenate(held)
                words, inverse, count = distinct(flat)
                order = np.argsort(-count, kind="stable")
                number = np.empty(len(words), dtype=np.uint32)
                number[order] = np.arange(len(words))
                words, tokens = words[order], number[inverse]
                train = np.bincount(tokens, weights=np.repeat(~np.array(flags), sizes), minlength=len(words)).astype(np.int64)
                planes = np.stack([tokens >> np.uint32(8 * k) & np.uint32(255) for k in range(4)]).astype(np.uint8)
                docs_raw = np.array([0 if i is None else i for i in ids], dtype=np.int64)
                none = np.array([i is None for i in ids])
                yield rows_of(
                    BLOCKS, block=[block], docs=[packed(docs_raw)], held=[packed(np.array(flags, dtype=np.uint8) | none.astype(np.uint8) << 1)], sizes=[packed(sizes)],
                    words=[np.ascontiguousarray(words).tobytes()], counts=[packed(train)], tokens=[packed(planes)], n_words=[len(words)], n_train=[int(train.sum())],
                )
                block += 1
            held, ids, flags, n_held = [], [], [], 0

        for batch in batches:
            for doc, flag, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.append(np.append(hash_words(word_list(text)), END))
                ids.append(doc)
                flags.append(bool(flag))
                n_held += len(held[-1])
                if n_held >= BLOCK_TOKENS:
                    yield from flush()
        yield from flush()

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % folds == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidy(run), "block long, docs binary, held binary, sizes binary, words binary, counts binary, tokens binary, n_words long, n_train long")


def shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(x) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def split_row(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: hashes of its words, tokens by number, tokens of each document, held-out documents, documents without an id."""
    planes, flags = unpacked(block["tokens"], np.uint8).reshape(4, -1), unpacked(block["held"], np.uint8)
    tokens = sum(planes[k].astype(np.int64) << 8 * k for k in range(4))
    return np.frombuffer(block["words"], dtype=np.uint64), tokens, unpacked(block["sizes"], np.int32).astype(np.int64), flags & 1 == 1, flags & 2 == 2


def words_before(tokens: np.ndarray, sizes: np.ndarray, end: int, n: int) -> Iterator[np.ndarray]:
    """The numbers of the first, second ... n-th token before each token; ``end`` before the start of a document."""
    before, starts = tokens, np.cumsum(sizes) - sizes
    for _ in range(n):
        before = np.r_[end, before[:-1]]
        before[starts] = end
        yield before


def longer(name: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Name of a context with one more word before it."""
    return mix(name * np.uint64(0xD6E8FEB86659FD93) + word)


class Grams:
    """A block's distinct (context, token) pairs of one order, ``lengthen``ed to those of the next; the same each time they are made.

    ``inverse`` has the pair of each token, ``context`` and ``word`` what a pair consists of. A context has ``order`` - 1 words
    (``columns``, by number, the furthest first): it is the pair, one order down, of the token before.
    """

    def __init__(self, block: dict):
        self.words, self.tokens, self.sizes, self.held, self.nameless = split_row(block)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.end = self.opening = int(np.flatnonzero(self.words == END)[0])  # the context of end tokens only, before a document
        self.order, self.columns = 2, [np.arange(len(self.words))]
        self.pair(self.tokens)

    def pair(self, last: np.ndarray) -> None:
        """Pairs from the context that each token leaves to the next."""
        before, n = np.r_[self.opening, last[:-1]], len(self.words)
        before[self.starts] = self.opening
        self.key, self.inverse, _ = distinct(before * n + self.tokens, (len(self.columns[0]) * n).bit_length())
        self.context, self.word = np.divmod(self.key, n)

    def lengthen(self) -> None:
        opening = self.opening * len(self.words) + self.end
        columns = [*(c[self.context] for c in self.columns), self.word]
        self.opening = int(np.searchsorted(self.key, opening))
        if self.opening == len(self.key) or self.key[self.opening] != opening:  # no document is empty
            self.opening, columns = len(self.key), [np.append(c, self.end) for c in columns]
        self.order, self.columns = self.order + 1, columns
        self.pair(self.inverse)

    def names(self) -> np.ndarray:
        """Names of the contexts."""
        *far, near = self.columns
        return functools.reduce(lambda name, c: longer(name, self.words[c]), reversed(far), self.words[near])


def grams(block: dict, order: int) -> Grams:
    out = Grams(block)
    while out.order < order:
        out.lengthen()
    return out


class Pairs:
    """Distinct (context, word) pairs by trie shard, context's name and word's number in the block. Each order has ``shards`` tries of its own."""

    def __init__(self, of: Grams, wide: np.ndarray, shards: int):
        names = of.names()
        self.inverse, self.use = of.inverse, np.repeat(~of.held, of.sizes)
        shard = shard_of(names, shards)[of.context]
        broad = np.flatnonzero(np.isin(names, wide)[of.context])
        shard[broad] = shard_of(names[of.context[broad]] ^ mix(of.words[of.word[broad]]), shards)
        rank, bits = np.empty(len(names), dtype=np.int64), len(names).bit_length()
        rank[by_place(names)[1]] = np.arange(len(names))
        key, self.order = by_place(shard << bits | rank[of.context], shards.bit_length() + bits)
        self.shard, self.name = (key >> bits) + (of.order - 2) * shards, names[of.context[self.order]]
        self.after = (of.words >> np.uint64(64 - SUCCESSOR_BITS))[of.word[self.order]]
        self.start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.length = np.diff(np.r_[self.start, len(key)])

    def ask(self, block: int) -> Iterator[pa.RecordBatch]:
        train = np.bincount(self.inverse[self.use], minlength=len(self.order)).astype(np.uint32)[self.order]
        five = np.ascontiguousarray(self.after).view(np.uint8).reshape(-1, 8)[:, : SUCCESSOR_BITS // 8]
        shards, first = np.unique(self.shard[self.start], return_index=True)
        for s, a, b in zip(shards, first, np.r_[first[1:], len(self.start)], strict=True):
            low, high = self.start[a], self.start[b - 1] + self.length[b - 1]
            yield rows_of(
                _ASK, shard=[int(s)], block=[block], keys=[ascending(self.name[self.start[a:b]])], sizes=[packed(self.length[a:b].astype(np.uint32))],
                successors=[np.ascontiguousarray(five[low:high]).tobytes()], counts=[packed(train[low:high])],
            )


def context_counts(blocks: DataFrame, words: np.ndarray, order: int, names: np.ndarray | None = None) -> DataFrame:
    """(word, n): training counts of contexts of ``order`` - 1 words that are all in ``words``; by block those with more
    than a ``WIDE``-th of its training tokens, or with ``names`` all of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, tokens, sizes, held, _ = split_row(row)
                common = np.isin(hashes, words)
                use, name = np.repeat(~held, sizes), None
                n_train = int(use.sum())
                before = list(words_before(tokens, sizes, int(np.flatnonzero(hashes == END)[0]), order - 1))
                for b in before:
                    use &= common[b]
                for b in before:
                    name = hashes[b[use]] if name is None else longer(name, hashes[b[use]])
                found, n = np.unique(name, return_counts=True)
                keep = n * WIDE > n_train if names is None else np.isin(found, names)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found[keep])), pa.array(n[keep])], names=["word", "n"])

    return blocks.select("held", "sizes", "words", "tokens").mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ask_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """A block's words and training counts by unigram shard, in the block's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = np.frombuffer(row["words"], dtype=np.uint64), unpacked(row["counts"], np.int64)
                shard = shard_of(words, shards)
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    yield rows_of(_ASK, shard=[int(shard[part[0]])], block=[row["block"]], keys=[words[part].tobytes()], sizes=[b""], successors=[b""], counts=[packed(counts[part])])

    return blocks.select("block", "words", "counts").mapInArrow(tidy(run), ASK)


def count_words(asked: DataFrame, wide: np.ndarray) -> DataFrame:
    """kind 0: counts for a block (a), kind 2: a shard's number of training words (x), kind 3: a wide word (x) and its count (y)."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [np.frombuffer(r["keys"], dtype=np.uint64) for r in rows]
        words, inverse, _ = distinct(np.concatenate(keys))
        total = np.bincount(inverse, weights=np.concatenate([unpacked(r["counts"], np.int64) for r in rows]), minlength=len(words)).astype(np.int64)
        parts = np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])
        shard = rows[0]["shard"]
        out = [rows_of(_ANSWER, kind=[0], block=[r["block"]], shard=[shard], a=[packed(p)], b=[None], x=[None], y=[None]) for r, p in zip(rows, parts, strict=True)]
        known = np.isin(words, wide)
        n = int(known.sum())
        out.append(rows_of(_ANSWER, kind=[2], block=[None], shard=[shard], a=[None], b=[None], x=[int((total > 0).sum())], y=[None]))
        out.append(rows_of(_ANSWER, kind=[3] * n, block=[None] * n, shard=[shard] * n, a=[None] * n, b=[None] * n, x=signed(words[known]), y=total[known]))
        return pa.Table.from_batches(out)

    return asked.groupBy("shard").applyInArrow(run, ANSWER)


def query_tries(asked: DataFrame, totals: dict[int, int], least: float) -> DataFrame:
    """kind 1: codes of a pair by pair (a) and of b context by context (b); kind 3: a wide context (x) and its number of different words here (y)."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [ascended(r["keys"]) for r in rows]
        sizes = [unpacked(r["sizes"], np.uint32).astype(np.int64) for r in rows]
        after = []
        for r in rows:
            five = np.frombuffer(r["successors"], dtype=np.uint8).reshape(-1, SUCCESSOR_BITS // 8)
            wide = np.zeros((len(five), 8), dtype=np.uint8)
            wide[:, : five.shape[1]] = five
            after.append(wide.view(np.uint64).ravel())
        count = np.concatenate([unpacked(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        name, word = np.repeat(np.concatenate(keys), np.concatenate(sizes)), np.concatenate(after)
        seen = np.flatnonzero(count > 0)
        seen = seen[pair_order(np.zeros(len(seen), dtype=np.int64), name[seen], word[seen])]
        c, w, n = name[seen], word[seen], count[seen]
        new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])][: len(c)])
        raw, contexts, spread = Trie.build(c[new], w[new], np.add.reduceat(n, new) if len(new) else n, totals, least)
        trie, shard, out = Trie(memoryview(raw)), rows[0]["shard"], []
        for r, key, size, x in zip(rows, keys, sizes, after, strict=True):
            ranks = trie.context_ranks(key)
            codes = trie.successor_codes(ranks, x, size)
            back = np.where(ranks >= 0, trie.backoff[np.maximum(ranks, 0)] if len(contexts) else 0, 0).astype(np.uint8)
            out.append(rows_of(_ANSWER, kind=[1], block=[r["block"]], shard=[shard], a=[packed(codes)], b=[packed(back)], x=[None], y=[None]))
        broad = np.isin(contexts, np.array(list(totals), dtype=np.uint64)) if len(contexts) else np.zeros(0, dtype=bool)
        m = int(broad.sum())
        out.append(rows_of(_ANSWER, kind=[3] * m, block=[None] * m, shard=[shard] * m, a=[None] * m, b=[None] * m, x=signed(contexts[broad]), y=spread[broad]))
        return pa.Table.from_batches(out)

    return asked.groupBy("shard").applyInArrow(run, ANSWER)


def lm_scores(docs: DataFrame, folds: int = FOLDS, order: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased (A-Z) words without ASCII white space and one end per document, so a null or empty text has
    one. The model learns from rows whose crc32(doc_id) mod ``folds`` is not 0; with a null doc_id a row is learned
    from. Repeated rows count as often as they stand there. score is the model's log10 probability, base_score that of
    the add-0.1 unigram model. ``order`` is the number of words in the longest n-grams, two or more. An empty table gives no rows. Other columns are not looked at.
    """
    blocks = cut(token_blocks(docs, folds))
    size = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_train").alias("train"), F.sum(F.lit(1)).alias("blocks")).first()
    n_train, blocks_n = size["train"] or 0, size["blocks"] or 0
    shards = max(1, -(-(size["words"] or 0) // SHARD_ENTRIES))

    def common_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = np.frombuffer(row["words"], dtype=np.uint64), unpacked(row["counts"], np.int64)
                many = counts * WIDE > counts.sum()
                yield pa.RecordBatch.from_arrays([pa.array(signed(words[many])), pa.array(counts[many])], names=["word", "n"])

    usual = blocks.select("words", "counts").mapInArrow(tidy(common_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * WIDE > n_train)
    wide = np.array(sorted(r["word"] for r in usual.collect()), dtype=np.int64).view(np.uint64)  # at most WIDE words
    counted = cut(count_words(ask_counts(blocks, shards), wide))
    n_words = counted.where("kind = 2").agg(F.sum("x")).first()[0] or 0
    totals = {r["x"] % (1 << 64): r["y"] for r in counted.where("kind = 3").collect()}
    broad_of = {2: wide}
    for m in range(3, order + 1):  # a context is wide only if all its words are
        usual = context_counts(blocks, wide, m).where(F.col("n") * WIDE > n_train)
        broad_of[m] = np.array(sorted(r["word"] for r in usual.collect()), dtype=np.int64).view(np.uint64)
        if len(broad_of[m]):
            totals |= {r["word"] % (1 << 64): r["n"] for r in context_counts(blocks, wide, m, broad_of[m]).collect()}
    tries = max(1, -(-(n_train + blocks_n) // SHARD_ENTRIES))

    least = least_of(n_train)

    def answers_of(m: int) -> DataFrame:
        """One order's n-grams go out and come back before the next order's, so only one order is shuffled at a time."""

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from Pairs(grams(row, m), broad_of[m], tries).ask(row["block"])

        return cut(query_tries(blocks.mapInArrow(tidy(ask), ASK), totals, least))

    answers = functools.reduce(DataFrame.union, [answers_of(m) for m in range(2, order + 1)])
    spread = {r["x"] % (1 << 64): r["n"] for r in answers.where("kind = 3").groupBy("x").agg(F.sum("y").alias("n")).collect()}
    floor = n_train + 0.1 * (n_words + 1)
    broad = np.array(sorted(spread), dtype=np.uint64)
    broad_back = coded(np.array([DISCOUNT * spread[v] / totals[v] for v in sorted(spread)]), least)
    value_of = decoded(np.arange(CODES + 1, dtype=np.uint8), least)
    back_of = np.r_[1.0, value_of[1:]]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row, replies = left.to_pylist()[0], sorted(right.to_pylist(), key=lambda r: (r["kind"], r["shard"]))
        words = np.frombuffer(row["words"], dtype=np.uint64)
        counts = np.zeros(len(words), dtype=np.int64)
        counts[np.argsort(shard_of(words, shards), kind="stable")] = np.concatenate([unpacked(r["a"], np.int64) for r in replies if r["kind"] == 0])
        alone, of = (counts + 0.1) / floor, Grams(row)
        chance = alone[of.tokens]
        for m in range(2, order + 1):
            if m > 2:
                of.lengthen()
            p = Pairs(of, broad_of[m], tries)
            own = [r for r in replies if r["kind"] == 1 and r["shard"] // tries == m - 2]
            a, b = (np.concatenate([unpacked(r[c], np.uint8) for r in own]) for c in "ab")
            if len(broad):
                name = p.name[p.start]
                at = np.minimum(np.searchsorted(broad, name), len(broad) - 1)
                b = np.where(broad[at] == name, broad_back[at], b)
            pair, pair_back = np.empty(len(p.order), dtype=np.uint8), np.empty(len(p.order), dtype=np.uint8)
            pair[p.order] = a
            pair_back[p.order] = np.repeat(b, p.length)
            chance = value_of[pair[p.inverse]] + back_of[pair_back[p.inverse]] * chance
        logs = np.log10(chance)
        base, total, known = (np.add.reduceat(x, of.starts) for x in (np.log10(alone)[of.tokens], logs, (counts > 0).astype(np.int64)[of.tokens]))
        ids = pa.array(unpacked(row["docs"], np.int64), mask=of.nameless)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([ids, pa.array(of.held), pa.array(of.sizes), pa.array(known), pa.array(np.full(len(of.sizes), n_train, dtype=np.int64)), pa.array(base), pa.array(total)], names=names)

    replies = counted.where("kind = 0").union(answers.where("kind = 1"))
    asked = blocks.select("block", "docs", "held", "sizes", "words", "tokens").groupBy("block")
    return asked.cogroup(replies.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
