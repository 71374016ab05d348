"""Textbook values, brute-force checks and properties of the test operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtide.functions import tails
from seqtide.operators import hypothesis as hy
from seqtide.operators import permutation as pm
from seqtide.operators import resample as rs
from seqtide.operators.ordered import Seq, ordered
from seqtide.operators.ranks import add_rank_columns


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def groups(spark, a, b):
    return spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, v double")


def test_tails_against_known_values():
    assert tails.student_sf(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    assert tails.student_sf(-2.0, 10) == pytest.approx(1 - 0.036694, abs=1e-6)
    assert tails.gamma_q(1.0, 3.0) == pytest.approx(math.exp(-3.0), rel=1e-12)
    assert tails.gamma_q(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert tails.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert tails.binomial_sf(3, 3, 0.5) == pytest.approx(0.125)
    assert tails.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)
    assert tails.fisher_greater(0, 5, 0, 5) == 1.0


def test_binomial_tail_is_a_sum():
    for n, k, p in ((20, 7, 0.3), (50, 10, 0.1), (5, 0, 0.4)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert tails.binomial_sf(k, n, p) == pytest.approx(want, abs=1e-12)


def test_exact_rank_distributions():
    # Brute force over all arrangements.
    n1, n2 = 3, 4
    us = [sum(1 for i in c for j in set(range(7)) - set(c) if i > j) for c in itertools.combinations(range(7), n1)]
    for u in range(13):
        assert tails.exact_u_sf(u, n1, n2) == pytest.approx(sum(x >= u for x in us) / len(us))
    ws = [sum(r for r, s in zip(range(1, 6), signs) if s) for signs in itertools.product((0, 1), repeat=5)]
    for w in range(16):
        assert tails.exact_w_sf(w, 5) == pytest.approx(sum(x >= w for x in ws) / len(ws))


def test_mann_whitney(spark):
    r = one(hy.mann_whitney(groups(spark, [1, 2, 4], [3, 5, 6]), [], "g", "v", "a", "b", "less"))
    assert (r["n1"], r["n2"], r["u"]) == (3, 3, 1.0)
    assert r["p"] == pytest.approx(2 / 20)  # exact: U <= 1 has two of twenty arrangements
    r = one(hy.mann_whitney(groups(spark, [1, 2, 2], [2, 3]), [], "g", "v", "a", "b"))
    assert r["u"] == 1.0
    a, b = one(hy.mann_whitney(groups(spark, [1, 2, 4], [3, 5, 6]), [], "g", "v", "b", "a")), 9
    assert a["u"] == b - 1.0


def test_spearman_kruskal_wilcoxon(spark):
    xy = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "x double, y double")
    r = one(hy.spearman(xy, [], "x", "y"))
    assert r["rho"] == pytest.approx(0.8) and r["n"] == 4
    assert r["p"] == pytest.approx(0.2, abs=1e-9)
    k = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("c", 5.0), ("c", 6.0)], "g string, v double")
    r = one(hy.kruskal(k, [], "g", "v"))
    assert r["h"] == pytest.approx(4.571428571)
    assert r["p"] == pytest.approx(math.exp(-4.571428571 / 2), rel=1e-9)
    d = spark.createDataFrame([(1.0, 0.0), (0.0, 2.0), (3.0, 0.0), (5.0, 5.0)], "a double, b double")
    r = one(hy.wilcoxon(d, [], "a", "b"))
    assert (r["n"], r["w_plus"], r["w_minus"]) == (3, 4.0, 2.0)


def test_chi_square_fisher_and_t(spark):
    rows = [("x", "u")] * 10 + [("x", "v")] * 20 + [("y", "u")] * 20 + [("y", "v")] * 10
    cells = hy.contingency(spark.createDataFrame(rows, "a string, b string"), [], "a", "b")
    assert one(hy.chi_square(cells, [], "a", "b"))["chi2"] == pytest.approx(5.4)
    plain = one(hy.chi_square(cells, [], "a", "b", yates=False))
    assert plain["chi2"] == pytest.approx(20 / 3) and plain["dof"] == 1 and plain["min_expected"] == 15.0
    r = one(hy.fisher_2x2(spark.createDataFrame([(3, 1, 1, 3)], "a long, b long, c long, d long"), "a", "b", "c", "d"))
    assert r["odds"] == 9.0 and r["p"] == pytest.approx(17 / 70)
    zero = one(hy.fisher_2x2(spark.createDataFrame([(3, 0, 1, 3)], "a long, b long, c long, d long"), "a", "b", "c", "d"))
    assert math.isinf(zero["odds"])
    w = one(hy.welch(groups(spark, [1, 2, 3], [2, 4, 6]), [], "g", "v", "a", "b"))
    assert w["t"] == pytest.approx(-1.549193, abs=1e-6)
    pair = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double")
    assert one(hy.paired_t(pair, [], "a", "b"))["t"] == pytest.approx(-3.464102, abs=1e-6)
    line = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "x double, y double")
    r = one(hy.slope(line, [], "x", "y"))
    assert r["slope"] == pytest.approx(2.5) and r["intercept"] == pytest.approx(-2 / 3)


def test_chi_square_counts_empty_cells(spark):
    """The statistic from observed cells only equals the one over the full table."""
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), rng.choice("uvwxyz")) for _ in range(40)]
    got = one(hy.chi_square(hy.contingency(spark.createDataFrame(rows, "a string, b string"), [], "a", "b"), [], "a", "b"))
    table = np.array([[sum(r == (a, b) for r in rows) for b in sorted({y for _, y in rows})] for a in sorted({x for x, _ in rows})], float)
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    assert got["chi2"] == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert got["min_expected"] == pytest.approx(expected.min())


def test_ranks_over_octaves_signs_and_ties(spark):
    values = [-1e9, -3.5, -3.5, -1.0, -0.0, 0.0, 1e-12, 0.5, 1.0, 1.0, 1.0000001, 2.0, 3.999999, 4.0, 1e18]
    rng = random.Random(1)
    values += [rng.uniform(-100, 100) for _ in range(300)] + [2.0**k for k in range(-20, 20)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").withColumn("k", F.lit(1))
    got = {r["i"]: r["r"] for r in add_rank_columns(df, ["k"], {"v": "r"}).collect()}
    for i, v in enumerate(values):
        less, same = sum(x < v for x in values), sum(x == v for x in values)
        assert got[i] == less + (same + 1) / 2
    assert sum(got.values()) == len(values) * (len(values) + 1) / 2


def test_window_nulls_are_the_shuffle_means(spark):
    """Closed-form expectations against a Monte-Carlo shuffle."""
    rng = np.random.default_rng(5)
    sessions = [(e, s, rng.random(n) < 0.5) for e, sizes in ((1, (5, 8, 2)), (2, (4, 3))) for s, n in enumerate(sizes)]
    rows, t = [], 0
    for e, s, flags in sessions:
        for f in flags:
            rows.append((e, s, t, bool(f)))
            t += 1
    df = spark.createDataFrame(rows, "entity int, session_no int, ts long, f boolean")
    got = one(rs.window_nulls(ordered(df, "entity", ["ts"]), {"f": F.col("f")}, 3))

    def hits(parts):
        return sum(sum(all(p[i : i + 3]) for i in range(len(p) - 2)) for p in parts)

    assert got["observed"] == hits([list(f) for _, _, f in sessions])
    total_g, total_s, reps = 0, 0, 4000
    for _ in range(reps):
        total_s += hits([list(rng.permutation(f)) for _, _, f in sessions])
        for e in (1, 2):
            own = [f for x, _, f in sessions if x == e]
            mixed = list(rng.permutation(np.concatenate(own)))
            parts, at = [], 0
            for f in own:
                parts.append(mixed[at : at + len(f)])
                at += len(f)
            total_g += hits(parts)
    assert got["session_null"] == pytest.approx(total_s / reps, abs=0.15)
    assert got["global_null"] == pytest.approx(total_g / reps, abs=0.15)


def test_monte_carlo_chi_square(spark):
    """Tables drawn from the margins give the p of shuffled labels."""
    rng = random.Random(11)
    rows = [(rng.choice("aab"), rng.choice("uvw")) for _ in range(18)]
    cells = hy.contingency(spark.createDataFrame(rows, "a string, b string"), [], "a", "b")
    got = one(rs.chi_square_mc(cells, [], "a", "b", reps=4000))
    assert got["monte_carlo"]
    xs, ys = [a for a, _ in rows], [b for _, b in rows]

    def stat(ys_):
        total = 0.0
        for a in set(xs):
            for b in set(ys_):
                o = sum(1 for p in zip(xs, ys_) if p == (a, b))
                e = xs.count(a) * ys_.count(b) / len(xs)
                total += (o - e) ** 2 / e
        return total

    base, reach = stat(ys), 0
    for _ in range(2000):
        rng.shuffle(ys)
        reach += stat(ys) >= base - 1e-9
    assert got["p"] == pytest.approx((reach + 1) / 2001, abs=0.05)


def test_keyed_bijections_are_permutations_and_spread_evenly():
    for n in (1, 2, 3, 5, 16, 17, 100, 101, 997):
        keys = pm.round_keys(7, range(60))
        at = pm.images(np.arange(n), n, keys)
        assert (np.sort(at, axis=1) == np.arange(n)).all()
    n, reps = 13, 6000
    at = pm.images(np.arange(n), n, pm.round_keys(3, range(reps)))
    for pair in (at[:, 0] * n + at[:, 1], at[:, 5] * n + at[:, 12]):
        seen = np.bincount(pair, minlength=n * n).reshape(n, n)
        off = seen[~np.eye(n, dtype=bool)]
        assert np.trace(seen) == 0 and ((off - reps / (n * (n - 1))) ** 2 / (reps / (n * (n - 1)))).sum() < 230  # 155 degrees of freedom


def permuted_brute(x, y, reps, seed=7):
    n = len(x)
    rank = lambda v: np.array([2 * (sum(b < a for b in v) + 1) + sum(b == a for b in v) - 1 - (n + 1) for a in v], dtype=object)
    rx, ry = rank(x), rank(y)
    at = pm.images(np.arange(n), n, pm.round_keys(seed, range(1, reps + 1)))
    return sum(abs((rx * ry[a]).sum()) >= abs((rx * ry).sum()) for a in at)


def test_permutation_p_per_key_in_blocks_of_any_size(spark, monkeypatch):
    rng = np.random.RandomState(5)
    rows = [(k, i, float(rng.randint(9)), float(rng.randint(9)) + 0.05 * k * i) for k in (0, 1) for i in range(70 - 40 * k)] + [(2, 0, 1.0, 1.0), (2, 1, 1.0, 2.0), (0, 99, None, 1.0), (None, 1, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, id int, x double, y double").filter("k is not null")
    whole = {r.k: r for r in pm.permutation_spearman(df, ["k"], "x", "y", "id", 1000).collect()}
    for k in (0, 1):
        x, y = zip(*[(r[2], r[3]) for r in rows if r[0] == k and r[2] is not None], strict=True)
        assert (whole[k].n, whole[k].reps, whole[k].extreme) == (len(x), 1000, permuted_brute(x, y, 1000))
        assert abs(whole[k].rho - scipy_free_rho(x, y)) < 1e-12
    assert whole[2].rho is None and whole[2].p == 1.0
    monkeypatch.setattr(pm, "X_BLOCK", 16)
    monkeypatch.setattr(pm, "Y_BLOCK", 23)
    monkeypatch.setattr(pm, "STEP", 100)
    assert {r.k: r for r in pm.permutation_spearman(df, ["k"], "x", "y", "id", 1000).collect()} == whole


def scipy_free_rho(x, y):
    rank = lambda v: np.array([sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v])
    return np.corrcoef(rank(x), rank(y))[0, 1]


def test_permutation_of_equal_and_unrelated_columns(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 97 as double) as x", "cast(id * 7 % 1009 as double) as y")
    far, same = one(pm.permutation_spearman(df, [], "x", "y", "id", 2000)), one(pm.permutation_spearman(df, [], "x", "x", "id", 500))
    assert far["n"] == 3000 and far["reps"] == 2000 and far["p"] > 0.01
    assert same["rho"] == pytest.approx(1.0) and same["extreme"] == 0

def test_seq_is_a_value():
    assert Seq.__dataclass_params__.frozen


def test_fisher_and_binomial_at_any_size():
    from math import comb, erfc, sqrt

    from seqtide.functions import tails

    for a, b, c, d in ((3, 5, 6, 1), (0, 4, 4, 0), (9, 1, 2, 8), (1, 0, 30, 30), (12, 12, 12, 12)):
        r1, r2, c1 = a + b, c + d, a + c
        want = sum(comb(r1, x) * comb(r2, c1 - x) for x in range(a, min(r1, c1) + 1)) / comb(r1 + r2, c1)
        assert tails.fisher_greater(a, b, c, d) == pytest.approx(want, rel=1e-9)
    for n in (10**4, 10**8, 10**12):
        assert tails.fisher_greater(n // 5, 3 * n // 10, 3 * n // 10, n // 5) == pytest.approx(1.0)
        assert tails.fisher_greater(3 * n // 10, n // 5, n // 5, 3 * n // 10) == pytest.approx(0.0, abs=1e-12)
        step = int(sqrt(n) / 2)
        far = tails.fisher_greater(n // 4 + step, n // 4 - step, n // 4 - step, n // 4 + step)
        assert far == pytest.approx(0.5 * erfc(2 / sqrt(2)), rel=0.1)
        assert tails.binomial_sf(n // 2 + step, n, 0.5) == pytest.approx(0.5 * erfc(1 / sqrt(2)), rel=0.05)


def test_exact_u_for_a_small_and_a_large_sample():
    from itertools import combinations
    from math import comb

    from seqtide.functions import tails

    counts = {}
    for chosen in combinations(range(9), 4):
        u = sum(chosen) - 6
        counts[u] = counts.get(u, 0) + 1
    for u in range(22):
        assert tails.exact_u_sf(u, 4, 5) == pytest.approx(sum(v for k, v in counts.items() if k >= u) / comb(9, 4), abs=1e-12)
    assert tails.exact_u_sf(8 * 100_000 / 2, 8, 100_000) == pytest.approx(0.5, abs=1e-3)


def test_contingency_statistics_at_large_cells(spark):
    n = 4 * 10**9
    cells = spark.createDataFrame([("a", "x", n), ("a", "y", n + 10**6), ("b", "x", n + 10**6), ("b", "y", n)], "a string, b string, cell long")
    row = hy.chi_square(cells, [], "a", "b").first()
    assert row["dof"] == 1 and row["chi2"] > 100 and row["p"] < 1e-9
    wide = spark.createDataFrame([(n, n, n, n)], "a long, b long, c long, d long")
    row = hy.fisher_2x2(wide, "a", "b", "c", "d").first()
    assert row["odds"] == pytest.approx(1.0) and row["p"] == pytest.approx(0.5, abs=1e-3)
    drawn = rs._draw(np.random.default_rng(1), np.full(2000, 3 * 10**9), np.full(2000, 5 * 10**9), np.full(2000, 2 * 10**9))
    assert abs(drawn.mean() - 0.75e9) < 5000 and 10_000 < drawn.std() < 30_000
