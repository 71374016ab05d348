"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix and put together in another order.

Line ends are counted over content-defined chunks. A rolling hash ends chunks where the last sixteen bytes say so, hence
passages that texts share fall into the same chunks. A task remembers the summary of a chunk by its bytes: line ends,
code points, the two bytes at each border, and whether a mark stands in it. The summaries of a text's chunks are added
up to its units, and a cut is found in the chunk in which the running count reaches it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
LEAST, MOST, MASK = 256, 8192, (1 << 10) - 1
#: Bytes of chunks that a task remembers, and bytes of a text hashed at a time.
CACHE_BYTES, BLOCK = 32 << 20, 1 << 20
#: Bytes of output after which a batch is handed on.
OUT_BYTES = 16 << 20
#: What a byte adds to the rolling hash.
GEAR = np.random.RandomState(12).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


@dataclass(frozen=True)
class Summary:
    lines: np.ndarray  # places after each line end
    points: int
    marked: bool
    head: bytes
    tail: bytes


def summary(chunk: bytes, marks: tuple[bytes, ...]) -> Summary:
    raw = np.frombuffer(chunk, dtype=np.uint8)
    keep = max(map(len, marks)) - 1
    return Summary(np.flatnonzero(raw == 10).astype(np.int32) + 1, int(((raw & 0xC0) != 0x80).sum()), any(m in chunk for m in marks), chunk[:keep], chunk[-keep:])


def ends(raw: np.ndarray) -> np.ndarray:
    """Places where the hash of the sixteen bytes before them asks for a chunk's end."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return np.flatnonzero((h >> np.uint32(15)) & np.uint32(MASK) == MASK) + 1


def chunks(text: bytes) -> Iterator[bytes]:
    """``text`` in content-defined chunks of ``LEAST`` to ``MOST`` bytes (the last may be shorter), hashed a block at a time."""
    start, n = 0, len(text)
    for block in range(0, n, BLOCK):
        before = min(block, 15)
        found = ends(np.frombuffer(text, dtype=np.uint8, count=min(BLOCK, n - block) + before, offset=block - before)) + (block - before)
        for end in found[found > block].tolist():
            while end - start > MOST:
                yield text[start : start + MOST]
                start += MOST
            if end - start >= LEAST:
                yield text[start:end]
                start = end
    while start < n:
        yield text[start : start + MOST]
        start += MOST


class Memo:
    """Summaries of the chunks seen last, at most ``limit`` bytes of them. A hit compares the bytes, not only a hash."""

    def __init__(self, marks: tuple[bytes, ...], limit: int = CACHE_BYTES):
        self.known: OrderedDict[bytes, Summary] = OrderedDict()
        self.marks, self.limit, self.bytes, self.hits = marks, limit, 0, 0

    def __call__(self, chunk: bytes) -> Summary:
        known = self.known.get(chunk)
        if known is not None:
            self.known.move_to_end(chunk)
            self.hits += 1
            return known
        made = self.known[chunk] = summary(chunk, self.marks)
        self.bytes += self.cost(chunk, made)
        while self.bytes > self.limit:
            self.bytes -= self.cost(*self.known.popitem(last=False))
        return made

    @staticmethod
    def cost(chunk: bytes, s: Summary) -> int:
        return len(chunk) + s.lines.nbytes + 500


class Units:
    """The units (lines with their ends, and a rest without one) of a text, from its chunks' summaries."""

    def __init__(self, text: bytes, memo: Memo):
        starts, self.parts, self.marked, border = [], [], False, b""
        at, keep = 0, max(map(len, memo.marks)) - 1
        for chunk in chunks(text):
            part = memo(chunk)
            joint = border + part.head
            self.marked = self.marked or part.marked or any(m in joint for m in memo.marks)
            border = (border + part.tail)[-keep:]
            starts.append(at)
            self.parts.append(part)
            at += len(chunk)
        self.text, self.starts = text, starts
        self.lines = np.cumsum([len(p.lines) for p in self.parts], dtype=np.int64) if starts else np.zeros(0, np.int64)
        self.points = np.cumsum([p.points for p in self.parts], dtype=np.int64) if starts else np.zeros(0, np.int64)
        whole = int(self.lines[-1]) if starts else 0
        self.n = whole + bool(text and not text.endswith(b"\n"))
        self.whole = whole

    def place(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` units."""
        if units == 0:
            return 0, 0
        if units > self.whole:
            return len(self.text), int(self.points[-1])
        k = int(np.searchsorted(self.lines, units))
        part, before = self.parts[k], int(self.points[k]) - self.parts[k].points
        end = int(part.lines[units - 1 - (int(self.lines[k]) - len(part.lines))])
        inside = np.frombuffer(self.text, dtype=np.uint8, count=end, offset=self.starts[k])
        return self.starts[k] + end, before + int(((inside & 0xC0) != 0x80).sum())


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight hex digits of the hash of seed and id, as integers; a null id counts as no digits."""
    sha = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(sha[i : i + 4], "big") for i in (0, 4, 8, 12)]


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``percent`` of the texts are cut at two line ends that the hash of seed and id chooses; of these ``spm_percent``
    become suffix, prefix, middle (spm), the others prefix, suffix, middle (psm), each part after its mark. Texts that
    are empty or contain a mark stay as they are (plain; the counts of characters are null). A null text is empty, a
    null id hashes as the seed alone; repeated rows each give a row; an empty table gives none. Texts of any length
    are read whole, a block at a time. Other columns are not looked at. Nothing is shuffled.
    """
    names, raw = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], tuple(m.encode() for m in marks)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def one(doc_id: int | None, text: bytes, memo: Memo) -> tuple:
        units = Units(text, memo)
        h1, h2, h3, h4 = numbers(doc_id, seed)
        if not text or units.marked or h3 % 100 >= percent:
            return doc_id, units.n, "plain", None, None, text
        first, last = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
        (a, a_chars), (b, b_chars) = units.place(first), units.place(last)
        p, s, m = (mark + part for mark, part in zip(raw, (text[:a], text[b:], text[a:b]), strict=True))
        spm = h4 % 100 < spm_percent
        return doc_id, units.n, "spm" if spm else "psm", a_chars, b_chars - a_chars, b"".join((s, p, m) if spm else (p, s, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(raw)
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                rows.append(one(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), memo))
                held += len(rows[-1][5])
                if held > OUT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=names)
                    rows, held = [], 0

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` gave this output and form."""
    p, s, m = marks
    after = lambda whole, part, mark: F.substr(whole, F.length(part) + F.lit(len(mark) + 1))

    def parts(first_mark: str, second_mark: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first_mark) + 1))
        first = F.substring_index(body, second_mark, 1)
        rest = after(body, first, second_mark)
        second = F.substring_index(rest, m, 1)
        return first, second, after(rest, second, m)

    prefix, suffix, middle = parts(p, s)
    suffix_, prefix_, middle_ = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)
