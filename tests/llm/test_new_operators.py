"""Centroid clustering, fill-in-the-middle and web archives against brute force, round trips and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from seqtide.llm import archives, centroids, common, decontaminate, exact_dedup, infilling, jaccard_join, packing
from seqtide.llm.queries import tokenizer_path

from .conftest import LONG


def nearest(x, c):
    gaps = [(sum((int(p) - int(q)) ** 2 for p, q in zip(x, row, strict=True)), j) for j, row in enumerate(c)]
    return min(gaps)[::-1]


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("k", [1, 2, 16, 40])
def test_orchard_finds_the_nearest_and_breaks_ties(k, big):
    rng = np.random.RandomState(k)
    c, x = rng.randint(-3, 4, (k, 5)), rng.randint(-3, 4, (600, 5))
    if big:
        c, x = c.astype(object) * 10**12, x.astype(object) * 10**12
    at, gap, measured = centroids.Orchard(c).search(x)
    assert [(a, g) for a, g in zip(at.tolist(), gap.tolist(), strict=True)] == [nearest(row, c) for row in x]
    assert measured <= 600 * k


def test_orchard_measures_few_of_many_far_centroids():
    rng = np.random.RandomState(0)
    c = rng.randint(-1000, 1000, (200, 2))
    x = c[rng.randint(0, 200, 2000)] + rng.randint(-5, 6, (2000, 2))
    at, _, measured = centroids.Orchard(c).search(x)
    assert at.tolist() == [nearest(row, c)[0] for row in x] and measured < 0.5 * 2000 * 200


def brute_clusters(rows, k, rounds, dims, scale, seed):
    x = [[int(np.floor(v * scale)) if abs(v) < 2**53 else int(v) * scale for v in e] for _, e in rows]
    first = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))[:k]
    c = [x[i] for i in first]
    for _ in range(rounds):
        at = [nearest(v, c)[0] for v in x]
        c = [[sum(x[i][j] for i in range(len(x)) if at[i] == n) // at.count(n) for j in range(dims)] if n in at else c[n] for n in range(len(c))]
    found = [nearest(v, c) for v in x]
    return Counter((rows[i][0], a, g if g < 2**63 else None, hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, (a, g) in enumerate(found))


@pytest.mark.parametrize("factor", [1.0, 1e9, 1e30])
def test_clusters_equal_brute_force_at_any_size_of_number(spark, factor):
    rng = random.Random(3)
    rows = [(i % 70, [rng.gauss(0, 1) * factor for _ in range(3)]) for i in range(80)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = centroids.cluster(docs, k=5, rounds=3, dims=3, scale=64, seed=1).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == brute_clusters(rows, 5, 3, 3, 64, 1)
    per = {c: [r.distance for r in got if r.cluster == c] for c in {r.cluster for r in got}}
    whole = lambda v: sum(v) if None not in v and sum(v) < 2**63 else None
    assert {(r.cluster, r.cluster_inertia, r.inertia) for r in got} == {(c, whole(v), whole([d for x in per.values() for d in x])) for c, v in per.items()}


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 5), (1, [1.0, 2.0], 5), (None, [0.0, -0.02], 1), (2, [1.0], 2), (3, [1.0, None], 3), (4, None, 4), (5, [nan, 0.0], 4), (6, [inf, 1.0], 4), (7, [], 1)]
    docs = spark.createDataFrame([(i, e, n, n, "a") for i, e, n in rows], "vec_id long, embedding array<float>, cluster int, distance int, inertia string")
    got = centroids.cluster(docs, k=16, rounds=2, dims=2).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.inertia) for r in got) == Counter({(1, 0, 0, 0): 2, (None, 2, 0, 0): 1})
    none = centroids.cluster(docs.limit(0), k=16, rounds=2, dims=2)
    assert none.count() == 0 and none.columns == centroids.cluster(docs, k=16, rounds=1, dims=2).columns
    with pytest.raises(ValueError):
        centroids.cluster(docs, k=0, dims=2)


def infill(doc_id, text, seed=7):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in infilling.MARKS):
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_chunks_cover_the_text_and_follow_its_content(monkeypatch):
    rng = np.random.RandomState(5)
    text = bytes(rng.randint(32, 127, 300_000, dtype=np.uint8))
    whole = list(infilling.chunks(text))
    assert b"".join(whole) == text and all(infilling.LEAST <= len(c) <= infilling.MOST for c in whole[:-1])
    shifted = list(infilling.chunks(b"some other beginning " + text))
    assert len(set(whole) & set(shifted)) > 0.9 * len(whole)
    monkeypatch.setattr(infilling, "BLOCK", 1000)
    assert list(infilling.chunks(text)) == whole


def test_summaries_are_remembered_within_a_bound():
    memo = infilling.Memo((b"<P>", b"<S>", b"<M>"), limit=20_000)
    rng = np.random.RandomState(1)
    parts = [bytes(rng.randint(97, 123, 3000, dtype=np.uint8)) for _ in range(40)]
    for p in parts:
        memo(p)
    assert memo.bytes <= 20_000 and len(memo.known) < 8
    assert memo(parts[-1]).points == 3000 and memo.hits == 1


def test_fill_in_middle_equals_brute_force(spark, odd, nothing, monkeypatch):
    rng = random.Random(2)
    texts = ["", "\n", "\n\n", "a", "a\n", "a\nb", "<P>", "x<S\n>", "a\r\n b\x85c\nd", "é\U0001f600\n" * 3, "y" * 255 + "<M>" + "z" * 300, "<" + "q" * 9000 + "\n<", LONG, LONG.replace(" ", "\n"), "w" * 700 + "\n<\nS>"]
    texts += ["".join(rng.choice("ab \n\n<PSM>é😀") for _ in range(rng.randint(0, 4000))) for _ in range(150)]
    texts += [t * 3 for t in texts[-5:]]
    docs = spark.createDataFrame([(i, t, "n", "f") for i, t in enumerate(texts)], "doc_id long, text string, n string, form string")
    got = {r.doc_id: r for r in infilling.fill_in_middle(docs).withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars, got[i].output) == infill(i, t)
        assert got[i].back == t
    rows = Counter((r.doc_id, r.n, r.form, r.output) for r in infilling.fill_in_middle(odd).collect())
    assert rows == Counter((r.doc_id, *infill(r.doc_id, r.text or "")[:2], infill(r.doc_id, r.text or "")[4]) for r in odd.collect())
    assert infilling.fill_in_middle(nothing).count() == 0
    plain = infilling.fill_in_middle(docs, percent=0)
    assert plain.where("form != 'plain'").count() == 0


def test_marks_across_chunk_borders():
    memo = infilling.Memo((b"<P>", b"<S>", b"<M>"))
    for size in range(infilling.MOST - 3, infilling.MOST + 3):
        assert infilling.Units(b"a" * size + b"<P>" + b"b" * 500, memo).marked
        assert not infilling.Units(b"a" * size + b"<P" + b"b" * 500, memo).marked


PAGES = [
    (3, "http://a/x", "p" * 100), (1, "http://a/y z", "p" * 100), (2, None, "p" * 100), (2, None, "p" * 100), (4, "", "p" * 99), (5, "http://b", "p" * 99),
    (6, "http://c", None), (7, "http://c", ""), (None, "http://d", "q\r\n\r\nWARC/1.1\r\n" * 20), (8, "http://e%20", "q\r\n\r\nWARC/1.1\r\n" * 20), (None, None, None),
    (None, "u", "only nameless " * 10), (None, "u", "only nameless " * 10), (9, "http://f", "é\U0001f600\x00\n" * 50), (-1, "http://g", LONG * 12),
]


def told(pages):
    kept = {}
    for i, _, h in pages:
        kept.setdefault(h or "", []).append(i)
    out = Counter()
    for h, ids in kept.items():
        raw = h.encode()
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = len(raw) >= 100 and k > 0
            out[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", ids[0] if again else None] += 1
    return out


@pytest.mark.parametrize("size", [1 << 23, 700])
def test_archives_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", size)
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in PAGES], "page_id long, url string, html string, place string, archive int").repartition(2)
    got = archives.archive_pages(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == told(PAGES)
    assert {r.target_uri for r in got} == {"http://a/x", "http://a/y%20z", "-", "http://b", "http://c", "http://d", "http://e%2520", "u", "http://f", "http://g"}
    assert {r.date for r in got if r.page_id == 9} == {"2000-01-01T00:00:09Z"}
    none = archives.archive_pages(pages.limit(0))
    assert none.count() == 0 and none.columns == archives.archive_pages(pages).columns


def test_both_versions_are_read():
    block = b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\nbody\nwith lines\n"
    for version in (1, 2):
        raw = archives.arc_start(version, "a.arc", "19990101000000")
        raw += archives.arc_line(version, {"URL": "http://x/a b", "Archive-date": "1999", "Content-type": "text/html", "Archive-length": str(len(block))}) + block + b"\n"
        raw += archives.arc_line(version, {"URL": "dns:x", "Archive-date": "1999", "Content-type": "text/dns", "Archive-length": "3"}) + b"1.2"
        first, page, name = archives.read_arc(raw)
        assert first.fields["URL"] == "filedesc://a.arc" and page.version == version
        assert page.fields["URL"] == "http://x/a b" and page.block == block and name.block == b"1.2"
        assert archives.http_parts(page.block) == (block[:25], b"body\nwith lines\n") and archives.http_parts(name.block) == (b"", b"1.2")
    for broken in (b"no archive", archives.arc_start(1, "a", "1999") + b"http://x 0.0.0.0 1999 text/html 900\nshort", archives.arc_start(2, "a", "1999") + b"http://x 0.0.0.0 1999 text/html 2\nab\n"):
        with pytest.raises(ValueError):
            list(archives.read_arc(broken))
    assert archives.warc_date("199912") == "1999-12-01T00:00:00Z" and archives.warc_date("?") == "1970-01-01T00:00:00Z"


def test_resources_keep_their_type(spark):
    raw = archives.arc_start(1, "a.arc", "19990101000000") + b"dns:x 1.2.3.4 19991231235959 text/dns 7\n1.2.3.4\n"
    warcs = archives.write_warc(spark.createDataFrame([("a/b.arc", raw)], "path string, content binary"))
    (row,) = archives.warc_records(warcs).collect()
    assert (row.record_type, row.target_uri, row.date, row.payload_bytes, row.page_id) == ("resource", "dns:x", "1999-12-31T23:59:59Z", 7, None)
    (content,) = [r.content for r in warcs.collect()]
    (_, _), (facts, block) = archives.read_warc(archives.opened(content))
    assert block == b"1.2.3.4" and facts["warc-ip-address"] == "1.2.3.4" and facts["content-type"] == "text/dns"
    place = len(archives.arc_start(1, "a.arc", "19990101000000"))
    assert facts["warc-record-id"] == f"<{archives.record_id('a/b.arc', place)}>" == f"<{row.record}>"


def test_meet_joins_hot_and_rare_keys(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id) as key")
    once = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 or key > 4000").withColumn("v", F.col("key") * 2)
    got = common.meet(rows, once, "key", "n")
    assert got.count() == rows.where("key = 7 or key > 4000").count() and got.where("v != key * 2").count() == 0


def test_stages_with_clashing_columns(spark, odd, nothing):
    items = spark.createDataFrame([(1, "One two three four five six seven eight nine ten.", 3), (2, None, 3)], "item_id long, text string, gone_id long")
    for stage, gone in ((exact_dedup.drop_copies, {3, 5, 6}), (jaccard_join.drop_near_copies, {5, 6}), (lambda d: decontaminate.drop_contaminated(d, items), {1, 6})):
        kept = stage(odd)
        assert kept.columns == odd.columns and stage(nothing).count() == 0
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd.collect()} - gone


def test_packing_remembers_within_a_bound_and_encodes_giant_words(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé&.7") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(50)] + ["w" * 20_000_000, "ab1 " * 1000 + "x" * 5000]
    small, large = packing.encoder(tokenizer_path(), 4000, 4000), packing.encoder(tokenizer_path())
    a = [x.tobytes() for x in small(pa.array(texts))]
    assert a == [x.tobytes() for part in packing.small(pa.array([*texts, None])) for x in large(part)][:-1]
    held = [c.cell_contents for f in (small, large) for c in f.__closure__ if isinstance(c.cell_contents, packing.Memo)]
    assert held and all(m.held <= m.limit and sum(len(k) + len(v) for k, v in m.items()) <= m.limit and all(len(k) < packing.LONG_WORD for k in m) for m in held)


def test_archives_travel_in_fewer_bytes_than_they_take(spark, monkeypatch):
    rng = random.Random(13)
    body = lambda: "<html><head><title>t</title></head><body>" + " ".join(rng.choice(("<p>", "</p>", "<div class=x>", "word", "other")) + str(rng.randrange(500)) for _ in range(300)) + "</body></html>"
    arcs = archives.write_arc(spark.createDataFrame([(i, f"http://x/{i}", body()) for i in range(60)], "page_id long, url string, html string").coalesce(1))
    ((path, content),) = arcs.collect()
    ((archive, raw),) = archives.packed(arcs).collect()
    assert archive == path and zstandard.decompress(raw) == archives.opened(content)
    assert len(raw) < 0.9 * len(content)
    monkeypatch.setattr(archives, "files", lambda segments, column, folder: segments)
    plan = archives.write_warc(arcs)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "payload#" not in plan  # records don't travel one by one


def test_archives_of_copies_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 1000)
    pages = [(i, f"http://x/{i}", f"<p>{'same text ' * 20}{i % 3}</p>") for i in range(40)]
    got = {r.page_id: r for r in archives.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {i: ("response", None) if i < 3 else ("revisit", i % 3) for i in range(40)}
    assert all(got[i].payload_digest == hashlib.sha256(html.encode()).hexdigest() for i, _, html in pages)
