"""Each operator on nulls, empty and long texts, repeated rows, empty tables and clashing names, and against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtide.llm import common, decontaminate, exact_dedup, jaccard_join, language_model, line_dedup, packing, personal_data, quality, substring_dedup
from seqtide.llm.queries import tokenizer_path

from .conftest import LONG


def texts_of(spark, tables):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()}


def test_exact_dedup_odd_rows(odd, nothing):
    rows = [tuple(r)[:4] for r in exact_dedup.exact_dedup(odd).collect()]
    assert Counter(rows) == Counter({(1, 1, 3, True): 2, (2, 2, 3, True): 1, (3, 2, 3, False): 1, (None, None, 1, True): 1, (None, 2, 3, False): 1, (4, 4, 2, True): 1, (5, 4, 2, False): 1, (6, 1, 3, False): 1, (7, 7, 1, True): 1})
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.where("doc_id is not null").collect())) == [1, 2, 4, 7]
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_compares_bytes_when_hashes_collide(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate("a b a c b d".split())], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs, content_hash=lambda c: F.length(c).cast("string")).orderBy("doc_id").collect()
    assert [(r.keep_id, r.group_size) for r in rows] == [(0, 2), (1, 2), (0, 2), (3, 1), (1, 2), (5, 1)]


def test_line_dedup(spark, odd, nothing):
    assert line_dedup.line_dedup(odd).count() == odd.count() and line_dedup.line_dedup(nothing).count() == 0
    docs = spark.createDataFrame([(2, "x\na\nb\nc\nd\ny"), (1, "a\nb\nc\nd"), (3, "a\nb"), (4, "q\nq\nq\nq\nq")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.text) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: (0, 0, "a\nb\nc\nd"), 2: (4, 1, "x\ny"), 3: (0, 0, "a\nb"), 4: (4, 1, "q")}


def pairs_brute(sets, percent):
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((root(a), root(b)))
                parent[b_] = a_
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components_equal_brute_force(spark, tables, words, percent):
    docs = spark.read.parquet(f"{tables}/documents.parquet")

    def of(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    sets = {i: of(t) for i, t in texts_of(spark, tables).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, words, percent).collect()}
    want = pairs_brute(sets, percent)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SKETCH_BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "SET_BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "FLUSH_KEYS", 200)
    rng = np.random.RandomState(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(60, rng.randint(0, 6), replace=False):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    sets = {i: set(t.split()) for i, t in rows}
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).collect()}
    assert got == pairs_brute(sets, 85)


def test_jaccard_odd_rows(odd, nothing):
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(odd).collect())
    assert got == Counter({(1, 1): 2, (2, 2): 1, (3, 3): 1, (None, None): 2, (4, 4): 1, (5, 4): 1, (6, 1): 1, (7, 7): 1})
    assert jaccard_join.jaccard_components(nothing).count() == 0
    assert jaccard_join.drop_near_copies(odd).columns == odd.columns


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 99: 99, 100: 99}


def test_decontamination(spark, tables, odd, nothing):
    items = spark.createDataFrame([(1, "seven eight nine ten. One"), (2, None), (None, "a b c d e f"), (3, "too short"), (4, "ONE two three four five six"), (5, " ".join(LONG.split()[20_000:20_060]))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(odd, items, per_pass=2).collect())
    assert got == [(1, 4), (4, 5), (5, 5), (6, 4)]
    assert decontaminate.contaminated_pairs(nothing, items).count() == 0
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_contaminated(odd, items).collect()) == [0, 0, 2, 3, 7]


def test_decontamination_finds_every_short_item():
    rng = np.random.RandomState(5)
    for size in range(5, 22):
        texts = [[f"w{x}" for x in rng.randint(0, 10**9, size)] for _ in range(400)]
        items = decontaminate.Items([(k, " ".join(t)) for k, t in enumerate(texts)])
        n = size - 4
        less = n - -(-80 * n // 100)
        for k, t in enumerate(texts):
            for cut in {0, less}:
                around = [f"v{x}" for x in rng.randint(0, 10**9, 80)]
                at = rng.randint(0, 81)
                doc = common.hash_words(common.word_list(" ".join([*around[:at], *t[: size - cut], *around[at:]])))
                assert items.search(doc) == [(k, n, n - cut)]
            doc = common.hash_words(common.word_list(" ".join([*around[:at], *t[: size - less - 1], *around[at:]])))
            assert items.search(doc) == []


def test_quality_scores(spark, tables, odd, nothing):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.quality_scores(docs, model).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([rows[i].predicted == q for i, q in known.items()]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    assert quality.quality_scores(odd, model).count() == 10 and quality.quality_scores(nothing, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    blank = quality.train(nothing, labels)
    assert {round(r.score, 6) for r in quality.quality_scores(odd, blank).collect()} == {0.3}


def test_quality_separates_pairs():
    rng = np.random.RandomState(0)
    good, bad = rng.normal(1, 0.3, (300, len(quality.FEATURES))), rng.normal(0, 0.3, (200, len(quality.FEATURES)))
    model = quality.fit(good, bad)
    assert (model.score(good) >= quality.THRESHOLD).mean() > 0.99 and (model.score(bad) < quality.THRESHOLD).mean() > 0.99


def test_packing_plan_is_gapless_and_tight():
    rng = np.random.RandomState(2)
    for size in (7, 64, 2048):
        lengths = Counter(np.minimum(size, rng.geometric(3 / size, 5000)).tolist())
        slots, seen = packing.plan(dict(lengths), size), {}
        for length, _, n, first, offset in slots:
            for s in range(first, first + n):
                seen.setdefault(s, []).append((offset, length))
        for parts in seen.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        assert Counter({k: sum(n for length, _, n, *_ in slots if length == k) for k in lengths}) == lengths
        least = -(-sum(k * n for k, n in lengths.items()) // size)
        assert sorted(seen) == list(range(len(seen))) and len(seen) <= least * 1.02 + 1


def test_packing_round_trip(spark, tables, odd, nothing):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    rows = packing.best_fit_packing(spark.read.parquet(f"{tables}/documents.parquet"), tokenizer_path(), 256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts_of(spark, tables).items():
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in parts] == [(i, len(ids[i : i + 256]), zlib.crc32(ids[i : i + 256].tobytes())) for i in range(0, len(ids), 256)]
    assert all(sum(n for o, n in s[:k]) == s[k][0] for s in map(sorted, by_sequence.values()) for k in range(len(s)))
    odd_rows = packing.best_fit_packing(odd, tokenizer_path()).collect()
    assert Counter(r.doc_id for r in odd_rows if r.piece == 0) == Counter({1: 2, 2: 1, 3: 1, None: 2, 4: 1, 5: 1, 6: 1, 7: 1})
    assert packing.best_fit_packing(nothing, tokenizer_path()).count() == 0


def test_substring_dedup_equals_brute_force(spark, tables, odd, nothing):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.substring_dedup(spark.read.parquet(f"{tables}/documents.parquet")).collect()}
    seen = set()
    for doc, text in sorted(texts_of(spark, tables).items()):
        raw, gone = text.encode(), np.zeros(len(text.encode()) + 1, dtype=bool)
        for i in range(len(raw) - 99):
            gone[i : i + 100] |= raw[i : i + 100] in seen
            seen.add(raw[i : i + 100])
        gone[len(raw)] = False
        left = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        assert got[doc] == (len(raw), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(raw) else 0, left)
    rows = substring_dedup.substring_dedup(odd).collect()
    assert Counter((r.doc_id, r.n_removed == r.n_bytes and r.n_bytes > 0) for r in rows)[(5, True)] == 1 and len(rows) == 10
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_substring_dedup_merges_blocks_of_one_anchor(spark):
    rng = np.random.RandomState(4)
    shared = "".join(rng.choice(list("abcdefgh "), 130))
    rows = [(i, "".join(rng.choice(list("abcdefgh "), 60)) + shared + "".join(rng.choice(list("abcdefgh "), 60))) for i in range(12)]
    contexts = [(7, i, 0, t[:190].encode(), 80) for i, t in rows]
    frame = spark.createDataFrame(contexts, "anchor long, doc long, place long, context binary, offset long").coalesce(1)
    found = substring_dedup.compare_contexts(frame, 100, block_bytes=300, anchor_bytes=500).collect()
    firsts = {}
    for r in found:
        if r.end is None:
            firsts.setdefault((r.first, r.second), set()).add(r.doc)
    assert sum(0 in d and len(d) > 3 for d in firsts.values()) >= 31  # each string within the shared part, from every block
    assert any(r.end is not None for r in found)


@pytest.mark.parametrize("bits", [21, 3])
def test_repeated_strings_on_random_contexts(monkeypatch, bits):
    monkeypatch.setattr(substring_dedup, "SHORT_BITS", bits)
    rng = np.random.RandomState(9)
    for _ in range(60):
        contexts = [bytes(rng.choice(list(b"ab "), rng.randint(1, 40)).tolist()) for _ in range(rng.randint(1, 7))]
        n = int(rng.randint(2, 9))
        label, context, offset = substring_dedup.repeated_strings(contexts, n)
        got, want = {}, {}
        for x, c, o in zip(label, context, offset, strict=True):
            got.setdefault(int(x), set()).add((int(c), int(o)))
        for c, raw in enumerate(contexts):
            for o in range(len(raw) - n + 1):
                want.setdefault(raw[o : o + n], set()).add((c, o))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, (v for v in want.values() if len(v) > 1)))


def test_personal_data(spark, odd, nothing):
    assert personal_data.seeds("a@b@c.d x +1 (237) 555-5660, 1.2.3.999 1.2.3.4, 4012888888881881, 4012888888881882") == [("email", 2, 7), ("ip", 39, 46), ("card", 48, 64), ("phone", 10, 27)]
    rows = personal_data.personal_data(odd).collect()
    assert len(rows) == 10 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert personal_data.personal_data(nothing).count() == 0
    docs = [(i, f"please call me at +1 (237) 555-{i:04d} today") for i in range(30)] + [(99, "please call me at 555-123-4567 today"), (98, "the part 555-123-9999 is new")]
    got = {r.doc_id: r for r in personal_data.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[99].spans == "phone:18:30" and got[99].n_phone == 0 and got[98].spans == "" and got[3].spans == "phone:18:35"


def base_by_expressions(text):
    """The base spans by the contract's expressions, one after the other."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda t: re.sub("[^0-9]", "", t)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and personal_data.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_expressions(spark, tables):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab@..0123456789 -()+%") for _ in range(rng.randint(0, 200))) for _ in range(3000)]
    for text in [*texts, *texts_of(spark, tables).values()]:
        assert personal_data.seeds(text) == base_by_expressions(text)


def test_secrets_are_found_by_their_contexts(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    rows = [(i, f'some words {i} here token = "{h}" and more words') for i, h in enumerate(hexes[:40])]
    rows += [(100 + i, f"the commit {h} was good, as was {h[::-1]}") for i, h in enumerate(hexes[40:])]
    rows += [(None, rows[0][1]), (200, rows[3][1] + f" and {hexes[3]} again"), (201, "w" * 100_000 + f'token = "{hexes[4]}"' + "v" * 100_000)]
    found = personal_data.occurrence_rows(spark.createDataFrame([(i, i or 0, t) for i, t in rows], "doc_id long, tk long, text string"))
    held = {r.instance for r in found.where("kind = '-'").collect()}
    assert 5 < len(held) < 30 and held <= {r.instance for r in personal_data.discover(found).collect()}
    got = personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_id = {r.doc_id: r.spans for r in got}
    for i, text in rows:
        places = [f"secret:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{40}", text)] if i is None or i < 100 or i > 199 else []
        assert [p for p in by_id[i].split(",") if p.startswith("secret")] == places


def test_personal_data_in_groups(spark):
    phones = ["020 7946 0958", "(555) 123-4567", "06 12 34 56 78", "1 800 555 1234"]
    docs = [(i, f"please call me at +1 (237) 555-{i:04d} today") for i in range(30)] + [(100 + k, f"please call me at {x} today") for k, x in enumerate(phones)]
    cards = [f"{4000 + i} 0000 0000 {k:04d}" for i in range(30) for k in range(9999) if personal_data.luhn(f"{4000 + i}00000000{k:04d}") and k > 1000][::900][:20]
    docs += [(200 + k, f"charge it to card {x} now") for k, x in enumerate(cards)] + [(300, "charge it to card 4012 8888 8888 1882 now")]
    docs += [(400, "please call me at 555-123-4567 2 times"), (401, "please call me at 555-123-4567 24 hours"), (402, "the part 020 7946 0999 is new"), (403, "please call me at 020 7946 0958abc today")]
    got = {r.doc_id: r.spans for r in personal_data.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[100 + k] for k in range(len(phones))] == [f"phone:18:{18 + len(x)}" for x in phones]
    assert got[300] == "card:18:37" and got[400] == got[401] == "phone:18:30" and got[402] == got[403] == ""


def test_language_model(spark, tables, odd, nothing, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 20_000)
    monkeypatch.setattr(language_model, "SHARD_ENTRIES", 10_000)
    rows = language_model.lm_scores(spark.read.parquet(f"{tables}/documents.parquet")).collect()
    words = {i: [*t.encode().lower().split(), b""] for i, t in texts_of(spark, tables).items()}
    train, pairs = Counter(), Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update(w)
            pairs.update(zip([b"", *w[:-1]], w, strict=True))
    n, v, total, kinds = sum(train.values()), len(train), Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        kinds[a] += 1
    assert len(rows) == len(words)
    for r in rows:
        w = words[r.doc_id]
        alone = [(train[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        both = [max(pairs[a, x] - 0.75, 0) / total[a] + 0.75 * kinds[a] / total[a] * p if total[a] else p for a, x, p in zip([b"", *w[:-1]], w, alone, strict=True)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
        assert abs(r.base_score - np.log10(alone).sum()) < 1e-6 * len(w)
        assert -0.04 * len(w) < r.score - np.log10(both).sum() < 1e-6 * len(w)
    odd_rows = language_model.lm_scores(odd).collect()
    assert Counter(r.doc_id for r in odd_rows) == Counter(r.doc_id for r in odd.collect())
    assert language_model.lm_scores(nothing).count() == 0


def test_language_model_of_order_three(spark, tables, odd, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 20_000)
    monkeypatch.setattr(language_model, "SHARD_ENTRIES", 10_000)
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, f"of the v{i} of the v{i + 1}") for i in range(800)], "doc_id long, text string"))
    words = {r.doc_id: [b"", b"", *(r.text or "").encode().lower().split(), b""] for r in docs.collect()}
    counts, after = Counter(), {}
    for i, w in words.items():
        for k in range(2, len(w)) if zlib.crc32(str(i).encode()) % 10 else ():
            for c in (tuple(w[k - 2 : k]), tuple(w[k - 1 : k]), ()):
                counts[c, w[k]] += 1
                after.setdefault(c, Counter())[w[k]] += 1
    total = {c: sum(x.values()) for c, x in after.items()}
    n, v = total[()], len(after[()])
    assert total[b"of", b"the"] * 1000 > n  # such a context is dealt to several tries

    def chance(context, word):
        if not context:
            return (counts[(), word] + 0.1) / (n + 0.1 * (v + 1))
        less = chance(context[1:], word)
        return (max(counts[context, word] - 0.75, 0) + 0.75 * len(after[context]) * less) / total[context] if context in total else less

    rows = language_model.lm_scores(docs, order=3).collect()
    assert len(rows) == len(words)
    for r in rows:
        w = words[r.doc_id]
        want = sum(np.log10(chance(tuple(w[k - 2 : k]), w[k])) for k in range(2, len(w)))
        assert -0.08 * len(w) < r.score - want < 1e-6 * len(w)
    assert Counter(r.doc_id for r in language_model.lm_scores(odd, order=3).collect()) == Counter(r.doc_id for r in odd.collect())


def test_trie_finds_successors_only_in_their_range():
    rng = np.random.RandomState(3)
    pairs = np.unique(rng.randint(0, 40, (600, 2)), axis=0).astype(np.uint64)
    raw, names, _ = language_model.Trie.build(pairs[:, 0], pairs[:, 1], np.full(len(pairs), 2), {}, -9.0)
    trie, have = language_model.Trie(memoryview(raw)), set(map(tuple, pairs.tolist()))
    context, word = (x.ravel() for x in np.meshgrid(np.arange(45, dtype=np.uint64), np.arange(90, dtype=np.uint64)))
    found = trie.successor_codes(trie.context_ranks(context), word) > 0
    assert found.tolist() == [pair in have for pair in zip(context.tolist(), word.tolist(), strict=True)]


def test_orders_of_pairs_equal_a_lexical_sort():
    rng = np.random.RandomState(2)
    for n, names in ((0, 1), (1, 1), (5000, 300), (5000, 5000)):
        shard = rng.randint(0, 9, n)
        name = (rng.randint(0, names, n).astype(np.uint64) << np.uint64(40)) + np.uint64(1)
        after = rng.permutation(np.arange(n, dtype=np.uint64))
        for k in (name, name & np.uint64(3) | np.uint64(1 << 63)):  # the second: names alike in their leading bits
            assert (language_model.pair_order(shard, k, after) == np.lexsort((after, k, shard))).all()
        values, at, times = language_model.distinct(name)
        want = np.unique(name, return_inverse=True, return_counts=True)
        assert (values == want[0]).all() and (at == want[1]).all() and (times == want[2]).all()


def test_codes_reach_down_to_the_rarest_pair_of_any_corpus():
    for n in (1, 50, 10**6, 10**12):
        least = language_model.least_of(n)
        rare = np.array([0.25 / n, 0.75 / n, 1.0])
        back = language_model.decoded(language_model.coded(rare, least), least)
        assert (back <= rare * (1 + 1e-12)).all() and (np.log10(rare) - np.log10(back) < 2 * -least / 254).all()
    names = np.unique(np.random.RandomState(1).randint(0, 1 << 62, 5000).astype(np.uint64) * np.uint64(3))
    assert (language_model.ascended(language_model.ascending(names)) == names).all() and len(language_model.ascended(language_model.ascending(names[:0]))) == 0


def test_language_model_of_a_table_that_landed_twice(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(9))) for i in range(1, 30)], "doc_id long, text string").coalesce(1)
    once, twice = (language_model.lm_scores(d).collect() for d in (docs, docs.union(docs)))
    assert Counter(r.doc_id for r in twice) == Counter({r.doc_id: 2 for r in once})
    assert {r.train_tokens for r in twice} == {2 * r.train_tokens for r in once}


def test_elias_fano_finds_values():
    rng = np.random.RandomState(1)
    for universe in (50, 1 << 40, 1 << 64):
        values = np.unique(np.array([int(x) % universe for x in rng.randint(0, 2**62, 500)], dtype=np.uint64))
        code = language_model.Monotone(memoryview(language_model.Monotone.encode(values, universe)))
        assert (code.get(np.arange(len(values))) == values).all() and (code.find(values) == np.arange(len(values))).all()
        other = np.array([int(x) % universe for x in rng.randint(0, 2**62, 500)], dtype=np.uint64)
        assert ((code.find(other) >= 0) == np.isin(other, values)).all()


def test_numbers_sorted_with_their_places():
    rng = np.random.RandomState(4)
    for n, bits in ((0, 64), (1, 64), (5000, 12), (5000, 51), (5000, 52), (5000, 64)):
        some = np.array([int(x) % (1 << bits) for x in rng.randint(0, 2**62, n)], dtype=np.uint64) * np.uint64(3) % np.uint64((1 << bits) - 1)
        near = rng.randint(0, 4, n).astype(np.uint64)  # alike in their leading bits
        for x in (some, near, some % np.uint64(7)):
            values, order = language_model.by_place(x, bits)
            assert (order == np.argsort(x, kind="stable")).all() and (values == np.sort(x)).all() and values.dtype == x.dtype


def test_pairs_are_the_n_grams_of_the_documents():
    docs = [[1, 2, 1, 2, 3], [], [2], [1, 2, 3, 1, 2], [3, 3, 3, 3]]
    hashes = {k: int(language_model.hash_words([b"w%d" % k])[0]) for k in (1, 2, 3)} | {0: int(language_model.END)}
    for texts in (docs, [d for d in docs if d]):  # with and without an empty document
        words = np.array([hashes[k] for k in (2, 0, 3, 1)], dtype=np.uint64)
        number = {h: i for i, h in enumerate(words.tolist())}
        tokens = np.array([number[hashes[k]] for d in texts for k in [*d, 0]])
        planes = np.stack([tokens >> 8 * k & 255 for k in range(4)]).astype(np.uint8)
        pack = language_model.packed
        block = {"words": words.tobytes(), "tokens": pack(planes), "held": pack(np.zeros(len(texts), dtype=np.uint8)), "sizes": pack(np.array([len(d) + 1 for d in texts], dtype=np.int32))}
        for order in (2, 3, 4):
            want, flat = Counter(), []
            for d in texts:
                whole = [0] * (order - 1) + d + [0]
                for i in range(len(d) + 1):
                    *context, word = (np.uint64(hashes[k]) for k in whole[i : i + order])
                    name = np.array([context[-1]])
                    for w in context[-2::-1]:
                        name = language_model.longer(name, w)
                    flat.append((int(name[0]), int(word) >> 24))
            want = Counter(flat)
            for wide in (np.zeros(0, dtype=np.uint64), np.array(sorted({n for n, _ in want})[:2], dtype=np.uint64)):
                p = language_model.Pairs(language_model.grams(block, order), wide, 3)
                have = list(zip(p.name.tolist(), p.after.tolist(), strict=True))
                assert len(have) == len(set(have)) and set(have) == set(want)
                assert [have[i] for i in np.argsort(p.order)[p.inverse]] == flat
                asked = [r for batch in p.ask(0) for r in batch.to_pylist()]
                assert [r["shard"] for r in asked] == sorted({*p.shard.tolist()}) and all(r["shard"] // 3 == order - 2 for r in asked)
                counts = np.concatenate([language_model.unpacked(r["counts"], np.uint32) for r in asked])
                assert dict(zip(have, counts.tolist(), strict=True)) == want
                names = [language_model.ascended(r["keys"]) for r in asked]
                assert all((n[1:] > n[:-1]).all() for n in names)


def test_elias_fano_is_made_in_little_memory():
    values = np.sort(np.random.RandomState(5).randint(0, 2**62, 100_000).astype(np.uint64))
    language_model.Monotone.encode(values[:10], 1 << 62)
    tracemalloc.start()
    language_model.Monotone.encode(values, 1 << 62)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * len(values)  # eight bytes a bit before
