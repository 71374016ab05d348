"""Best-fit packing of tokenised documents, planned on a histogram of lengths."""

from __future__ import annotations

import bisect
import json
import os
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows_of, tidy

SIZE = 2048
#: Bytes of words, and of parts of words, that a task remembers with their ids.
WORD_BYTES, PART_BYTES = 24 << 20, 40 << 20
#: What a remembered string costs besides its characters and ids, and length from which a string is not remembered.
ENTRY_BYTES, LONG_WORD = 200, 1000
#: Bytes of texts whose words are told apart at a time.
TEXT_BYTES = 4 << 20
#: Characters that the tokenizer's normalisation only lower-cases.
PLAIN = regex.compile(r"[!-~\u00C0-\u024F]+")
#: Marks after a word, of which a run is one part.
MARKS = ".,;:!?*&%$#|)\"-"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Memo(dict):
    """Ids by string, made by ``make`` where missing; at most ``limit`` bytes of them by count of characters and ids.

    A full one takes no more, so the frequent strings, which come early, stay; once it has missed twice as often as it
    has entries it starts again.
    """

    def __init__(self, limit: int, make: Callable[[str | bytes], bytes]):
        super().__init__()
        self.limit, self.make, self.held, self.missed = limit, make, 0, 0

    def __missing__(self, key: str | bytes) -> bytes:
        ids = self.make(key)
        cost = len(key) + len(ids) + ENTRY_BYTES
        if self.held + cost > self.limit:
            self.missed += 1
            if self.missed > 2 * len(self):
                self.clear()
                self.held = self.missed = 0
        elif len(key) < LONG_WORD:
            self.held += cost
            self[key] = ids
        return ids


def encoder(path: str, word_bytes: int = WORD_BYTES, part_bytes: int = PART_BYTES):
    """Function from an array of texts to their ids, for one task.

    The tokenizer never joins across white space, so each word between ASCII white space is encoded once and remembered.
    A word of plain characters is lower-cased and split as the tokenizer's own pattern does, and each part goes through
    its byte map and model once, which costs a third of a call for the whole word; any other word takes that call.
    What is remembered is bounded in bytes and goes with the function.
    """
    if sys.byteorder != "little" or array("I").itemsize != 4:
        raise RuntimeError("ids are written as little-endian 32-bit numbers")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    model = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)["pre_tokenizer"].get("pretokenizers", [])
    split = regex.compile(rules[0]["pattern"]["Regex"]) if len(rules) == 2 and rules[0]["type"] == "Split" and rules[1]["type"] == "ByteLevel" else None
    to_bytes, tokens = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), model.model

    def part_ids(part: str) -> bytes:
        shown = part if part.isascii() else to_bytes.pre_tokenize_str(part)[0][0]
        return array("I", [t.id for t in tokens.tokenize(shown)]).tobytes()

    def word_ids(raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        if split is None or "<|" in word or not (word.isascii() and word.isprintable() or PLAIN.fullmatch(word)):
            return array("I", model.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        core = word.rstrip(MARKS)
        if core.isalpha():
            return parts[core] + parts[word[len(core) :]] if len(core) < len(word) else parts[core]
        return b"".join(map(parts.__getitem__, filter(None, split.findall(word))))

    words, parts = Memo(word_bytes, word_ids), Memo(part_bytes, part_ids)

    def encode(texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text. Words are told apart in Arrow, and each distinct word of ``texts`` is looked up once."""
        split_ = pc.ascii_split_whitespace(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
        ends = split_.offsets.to_numpy()
        coded = split_.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        code, ends = coded.indices.to_numpy(), ends - ends[0]
        ids = [words[w] for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), dtype=np.uint32), np.cumsum(size) - size
        for i in range(len(ends) - 1):
            own = code[ends[i] : ends[i + 1]]
            n = size[own]
            yield flat[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    return encode


def small(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of at most ``TEXT_BYTES`` bytes, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT_BYTES, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Each document's ids and a closing id 0, cut into pieces of ``size``: doc_id, piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), b"\0\0\0\0"
        for batch in batches:
            texts = (ids.tobytes() for part in small(batch.column(1)) for ids in encode(part))
            rows = [
                (doc, i // (4 * size), i // 4, len(part) // 4, zlib.crc32(part))
                for doc, ids in zip(batch.column(0).to_pylist(), texts, strict=True)
                for full in [ids + end]
                for i in range(0, len(full), 4 * size)
                for part in [full[i : i + 4 * size]]
            ]
            yield rows_of(schema, **{f.name: [r[k] for r in rows] for k, f in enumerate(schema)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), PIECES)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first: (length, first rank, pieces, first sequence, offset) for each run of slots.

    Open sequences are kept as runs of consecutive numbers with the same room. All pieces of a length are placed
    before the next: into the open run with the least room that fits, else into new sequences that take as many of
    them as go in. A step ends a length or uses up a run, so the plan's size depends on ``size``, not on the counts.
    """
    out, rooms, runs, sequences = [], [], {}, 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[k]
                used = min(n, left)
                put(room, first + used, n - used)
                put(room - length, first, used)
                out.append((length, rank, used, first, size - room))
                rank, left = rank + used, left - used
            else:
                each = size // length
                n, rest = divmod(left, each)
                for j in range(each if n else 0):
                    out.append((length, rank + j * n, n, sequences, j * length))
                put(size - each * length, sequences, n)
                if rest:
                    out.extend((length, rank + each * n + j, 1, sequences + n, j * length) for j in range(rest))
                    put(size - rest * length, sequences + n, 1)
                sequences, left = sequences + n + bool(rest), 0
    return out


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """``found`` (from ``pieces``) with sequence_id and offset.

    Ranks within a length come from counts per (length, part of the rows) and running sums over the parts, so the
    pieces of a common length are numbered in many tasks. The histogram has at most ``size`` rows and the plan a number
    of runs that ``size`` bounds; both are all that the driver sees, and the plan is what is sent to the tasks.
    """
    spark = found.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts * 4)).cast("int"))
    counts = cut(dealt.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = sorted(plan(histogram, size))
    lengths, ranks, firsts, offsets = (np.array([s[i] for s in slots], dtype=np.int64) for i in (0, 1, 3, 4))
    before = counts.selectExpr("length", "part", "sum(n) over (partition by length order by part) - n as before")
    mine = dealt.selectExpr("*", "row_number() over (partition by length, part order by doc_id, piece, ids_crc32) - 1 as own")
    ranked = mine.join(before, ["length", "part"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "before + own as rank")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lengths << 40 | ranks
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            k = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(firsts[k] + rank - ranks[k]), pa.array(offsets[k])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(place), f"{PIECES}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``size`` ids, one row per piece.

    A null or empty text is the closing id alone. Only documents longer than ``size`` are cut. Rows with a null
    doc_id and repeated rows are packed like any other; an empty table gives no rows. Other columns are not looked at.
    """
    return pack(cut(pieces(docs, tokenizer, size)), size)
