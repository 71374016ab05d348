"""Web archives: pages as ARC files, ARC files converted to WARC files, WARC files read back.

Archives are real files in the shared folder. A task writes each as one row of a text table with a row a file, since
Spark's text writer hands on bytes as they are; they are read by Spark's binary reader, so no folder need be local.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtide.session import checkpoint_dir

from .common import cut, meet, release, tidy

#: Bytes of records after which a new archive is begun; a larger record has one of its own.
ARCHIVE_BYTES = 8 << 20
#: Payloads under this many bytes are never stored as revisits.
LEAST_PAYLOAD = 100
#: Bytes of a compressed archive that are decompressed at a time.
PIECE = 4096
#: Fields of a record's header line, by ARC version. Fixed values of the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: The profile of a revisit of equal payload. Fixed value of the format.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = b"X-Page-Id"
NAMES = uuid.UUID(int=0x5E97)
EPOCH = 946_684_800

FACTS = {"archive": pa.string(), "place": pa.int64(), "uri": pa.string(), "fetched": pa.string(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
ARCHIVE = pa.schema([("archive", pa.binary())])


@dataclass(frozen=True)
class ArcRecord:
    place: int  # of the header line in the uncompressed archive
    version: int
    fields: dict[str, str]
    block: bytes


def field(text: str | None) -> str:
    """A header line's field: white space and control characters percent-encoded, ``-`` for nothing."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m.group()):02X}", text or "") or "-"


def arc_line(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(name, "-") for name in ARC_FIELDS[version]) + "\n").encode("utf-8", "surrogatepass")


def arc_start(version: int, name: str, date: str) -> bytes:
    """The record that opens an archive and says which fields its header lines have."""
    block = f"{version} 0 seqtide\n{' '.join(ARC_FIELDS[version])}\n".encode()
    facts = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return arc_line(version, facts) + block + b"\n"


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records of an uncompressed archive. The opening record names the version; the last field of a header line is the
    length of its block, and a URL with spaces takes the fields that are left over on the left."""
    at, version, size = 0, 0, len(raw)
    while at < size:
        if raw[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without an end at {at}")
        line = raw[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if not version:
            first = raw[end + 1 : end + 2]
            if not line.startswith("filedesc:") or first not in (b"1", b"2"):
                raise ValueError("no opening record of version 1 or 2")
            version = int(first)
        names = ARC_FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) < len(names) or not values[-1].isdecimal() or end + 1 + int(values[-1]) > size:
            raise ValueError(f"header line not of version {version} at {at}")
        stop = end + 1 + int(values[-1])
        yield ArcRecord(at, version, dict(zip(names, values, strict=True)), raw[end + 1 : stop])
        at = stop


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Status line and headers with the empty line after them, and the payload; no headers where there is no status line."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def header(head: bytes, name: bytes) -> str | None:
    """A header's value, its name in any case."""
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


def member(raw: bytes) -> bytes:
    """``raw`` as a gzip member of its own, as archives hold their records; the same bytes always give the same member."""
    return gzip.compress(raw, compresslevel=1, mtime=0)


def files(segments: DataFrame, column: str, folder: str) -> DataFrame:
    """Writes each row's bytes as a file in a new folder and reads (path, content) of all back; a zero byte, which is
    padding after compressed members, follows the bytes."""
    spark = segments.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/seqtide-{folder}-{uuid.uuid4().hex}"
    segments.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("path", "content")


def segments(rows: Iterable[dict], begin, one) -> Iterator[pa.RecordBatch]:
    """Rows as bytes by ``one``, each a compressed member, gathered into archives opened by ``begin(number)``, one archive a batch."""
    parts, size, number = [], 0, 0
    whole = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], type=pa.binary())], schema=ARCHIVE)
    for row in rows:
        if not parts:
            parts, size = [member(begin(number))], 0
        parts.append(member(one(row, number)))
        size += len(parts[-1])
        if size >= ARCHIVE_BYTES:
            yield whole()
            parts, number = [], number + 1
    if parts:
        yield whole()


def write_arc(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as ARC files: (path, content). Versions 1 and 2 take turns; a page without a time is dated by its id."""

    def begin(number: int) -> bytes:
        return arc_start(1 + number % 2, f"{number:06d}.arc.gz", "20000101000000")

    def one(row: dict, number: int) -> bytes:
        version, payload, page = 1 + number % 2, row["payload"], row["page_id"]
        mark = b"" if page is None else b"%s: %d\r\n" % (PAGE_HEADER, page)
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n%s" % (len(payload), mark, payload)
        date = datetime.fromtimestamp(EPOCH + (page or 0) % 10**9, UTC).strftime("%Y%m%d%H%M%S")
        facts = {"URL": field(row["url"]), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Filename": f"{number:06d}.arc.gz", "Archive-length": str(len(block))}
        return arc_line(version, facts) + block + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda batch, i: {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
        return segments((row(batch, i) for batch in batches for i in range(batch.num_rows)), begin, one)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return files(rows.mapInArrow(tidy(run), "archive binary"), "archive", "arc")


def opened(content: bytes) -> bytes:
    """What the members of a compressed archive hold, one after the other; an uncompressed one as it is."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, view, at = [], memoryview(content), 0
    while at < len(view):
        if not view[at]:  # padding
            at += 1
            continue
        member_ = zlib.decompressobj(31)
        while not member_.eof:
            if at >= len(view):
                raise ValueError("the last member is cut short")
            piece = view[at : at + PIECE]
            out.append(member_.decompress(piece))
            at += len(piece) - len(member_.unused_data)
    return b"".join(out)


def records(archive: str, raw: bytes) -> Iterator[dict]:
    """Records of an uncompressed ARC file, without the opening one. ``kind`` is response for an HTTP block, else resource."""
    for r in read_arc(raw):
        if r.fields["URL"].startswith("filedesc:"):
            continue
        head, payload = http_parts(r.block)
        page = header(head, PAGE_HEADER)
        yield {
            "archive": archive, "place": r.place, "uri": r.fields["URL"], "ip": r.fields["IP-address"], "fetched": r.fields["Archive-date"], "kind": "response" if head else "resource",
            "type": r.fields["Content-type"], "page_id": int(page) if page else None, "head": head, "payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(),
        }


def arc_records(archives: DataFrame) -> DataFrame:
    """What tells the records of ARC files (path, content) apart: ``FACTS``, no payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [tuple(r[name] for name in FACTS) for r in records(path.as_py(), opened(content.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(FACTS.values())], names=list(FACTS))

    return archives.mapInArrow(tidy(run), "archive string, place long, uri string, fetched string, page_id long, payload_bytes long, payload_digest string")


def packed(archives: DataFrame) -> DataFrame:
    """ARC files (path, content) to be shuffled: (archive, raw), the records of one compressed together, which takes a
    fifth less than member by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = zstandard.compress(opened(content.as_py()), 3)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], type=pa.string()), pa.array([raw], type=pa.binary())], names=["archive", "raw"])

    return archives.mapInArrow(tidy(run), "archive string, raw binary")


def record_id(archive: str, place: int) -> str:
    """The same record of the same archive always gets the same identifier."""
    return f"urn:uuid:{uuid.uuid5(NAMES, f'{archive.rsplit(chr(47), 1)[-1]}#{place}')}"


def warc_date(fetched: str) -> str:
    """ARC's fourteen digits as a WARC time; what is missing or not a time is the earliest it may be."""
    digits = re.sub(r"\D", "", fetched)[:14]
    digits += "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def warc_record(facts: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in [*facts, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))] if v is not None]
    return ("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def payload_rank(rows: DataFrame) -> DataFrame:
    """For each payload of ``LEAST_PAYLOAD`` bytes or more that several records have: the record that keeps it (the
    smallest page_id; none counts as largest) and how many there are."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "archive", "place", "uri", "fetched")).alias("kept")
    return rows.where(F.col("payload_bytes") >= LEAST_PAYLOAD).groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1").select(
        "payload_digest", "n", *[F.col(f"kept.{c}").alias(f"kept_{c}") for c in ("archive", "place", "uri", "fetched")]
    )


def revisits(records: DataFrame) -> DataFrame:
    """(archive, place) of the records whose payload an earlier page keeps, and the keeping record. Only digests travel."""
    small = cut(records.select(*FACTS))
    groups = cut(payload_rank(small))
    kept = meet(small.where(F.col("payload_bytes") >= LEAST_PAYLOAD), groups, "payload_digest", "n")
    same = (F.col("archive") == F.col("kept_archive")) & (F.col("place") == F.col("kept_place"))
    return kept.where(~same).select("archive", "place", "kept_archive", "kept_place", "kept_uri", "kept_fetched")


def write_warc(archives: DataFrame) -> DataFrame:
    """ARC files (path, content) converted to WARC files: (path, content).

    Identifiers come from archive and place, times from ARC's dates, types from the block: an HTTP block is a response,
    another a resource, a payload that an earlier page keeps a revisit, which has the HTTP headers and no payload. An ARC
    file meets the list of its revisits whole, so that its records travel compressed together.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = {r["place"]: r for r in right.to_pylist()}
        found = [(left["archive"][i].as_py(), left["raw"][i].as_py()) for i in range(left.num_rows)]

        def begin(number: int) -> bytes:
            facts = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(found[0][0], -1 - number)}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")]
            return warc_record(facts, b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/\r\n")

        def one(r: dict, number: int) -> bytes:
            again = kept.get(r["place"])
            facts = [
                ("WARC-Type", "revisit" if again else r["kind"]),
                ("WARC-Record-ID", f"<{record_id(r['archive'], r['place'])}>"),
                ("WARC-Date", warc_date(r["fetched"])),
                ("WARC-Target-URI", r["uri"]),
                ("WARC-IP-Address", None if r["ip"] in ("-", "0.0.0.0") else r["ip"]),
                ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"),
                ("Content-Type", "application/http; msgtype=response" if r["kind"] == "response" else r["type"]),
            ]
            if again:
                facts += [
                    ("WARC-Profile", SAME_PAYLOAD),
                    ("WARC-Refers-To", f"<{record_id(again['kept_archive'], again['kept_place'])}>"),
                    ("WARC-Refers-To-Target-URI", again["kept_uri"]),
                    ("WARC-Refers-To-Date", warc_date(again["kept_fetched"])),
                    ("WARC-Truncated", "length"),
                ]
            return warc_record(facts, r["head"] if again else r["head"] + r["payload"])

        rows = (r for archive, raw in found for r in records(archive, zstandard.decompress(raw)))
        out = pa.Table.from_batches(segments(rows, begin, one), schema=ARCHIVE)
        release()
        return out

    asked = revisits(arc_records(archives)).groupBy("archive")
    return files(packed(archives).groupBy("archive").cogroup(asked).applyInArrow(run, "archive binary"), "archive", "warc")


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed archive."""
    at, stream = 0, memoryview(raw)
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        facts = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        stop = end + 4 + int(facts["content-length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is not as long as it says")
        yield facts, bytes(stream[end + 4 : stop])
        at = stop + 4


def warc_records(archives: DataFrame) -> DataFrame:
    """Responses, resources and revisits of WARC files (path, content): record, record_type, target_uri, date, page_id,
    payload_bytes, payload_digest, refers_record. The digest of a stored payload is taken from its bytes, which must
    agree with the header; a revisit's size and digest are those of the payload it stands for."""
    names = ["record", "record_type", "target_uri", "date", "page_id", "payload_bytes", "payload_digest", "refers_record"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(facts: dict[str, str], block: bytes) -> tuple:
        kind, head = facts["warc-type"], http_parts(block)[0]
        payload, told = block[len(head) :], facts.get("warc-payload-digest", "").removeprefix("sha256:")
        page = header(head, PAGE_HEADER)
        if kind == "revisit":
            size, digest = int(header(head, b"Content-Length") or -1), told
        else:
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if digest != told:
                raise ValueError(f"{facts['warc-record-id']}: payload and digest differ")
        refers = facts.get("warc-refers-to")
        return facts["warc-record-id"].strip("<>"), kind, facts.get("warc-target-uri"), facts["warc-date"], int(page) if page else None, size, digest, refers.strip("<>") if refers else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = [row(facts, block) for facts, block in read_warc(opened(content.as_py())) if facts["warc-type"] != "warcinfo"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=names)

    return archives.mapInArrow(tidy(run), "record string, record_type string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_record string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) through ARC files and their conversion to WARC files, read back: page_id,
    payload_bytes, payload_digest, record_type, refers_to (the page_id of a revisit's response), target_uri, date.

    Of equal payloads of ``LEAST_PAYLOAD`` bytes or more that with the smallest page_id is the response and the others
    are revisits. A null html is an empty payload; a null url is written as ``-``, white space in one percent-encoded.
    A null page_id counts as larger than any; repeated rows are records of their own, of which one is the response.
    Pages of any length are read whole. An empty table gives no rows. Other columns are not looked at.
    """
    found = cut(warc_records(write_warc(write_arc(pages))))
    asked = found.where("refers_record is not null")
    kept = asked.groupBy("refers_record").agg(F.count("*").alias("n")).join(found.selectExpr("record as refers_record", "page_id as refers_to"), "refers_record")
    kinds = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    rest = found.where("refers_record is null").select(*kinds, F.lit(None).cast("long").alias("refers_to"), "target_uri", "date")
    return rest.union(meet(asked, cut(kept), "refers_record", "n").select(*kinds, "refers_to", "target_uri", "date"))
