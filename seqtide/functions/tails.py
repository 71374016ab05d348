"""Tail probabilities for the one-row-per-test result tables.

The normal tail is a Column expression. Student, F, chi-square, binomial and
hypergeometric tails are Arrow-batched functions over the (small) result tables; they
use numpy and the standard library only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_sf(z: Column) -> Column:
    """P(Z > z), Abramowitz and Stegun 26.2.17 (absolute error below 7.5e-8)."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.lit(0.3989422804014327) * F.exp(-x * x / 2) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def normal_p(z: Column, alternative: str) -> Column:
    if alternative == "greater":
        return normal_sf(z)
    if alternative == "less":
        return 1 - normal_sf(z)
    return F.least(F.lit(1.0), 2 * normal_sf(F.abs(z)))


#: From here on Student's and the gamma tails take their asymptotic forms, which are exact to nine digits or more.
LARGE = 1e6


def _beta_fraction(a: float, b: float, x: float) -> float:
    # Modified Lentz evaluation of the continued fraction of the incomplete beta.
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    # Converges within a few times the root of the larger parameter.
    steps = 2000 + int(20 * math.sqrt(max(a, b)))
    for m in range(1, steps):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"incomplete beta at {a}, {b}, {x} did not converge")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if a > LARGE:
        # Uniform expansion for a large parameter (first two terms; the next is of order 1/a).
        part = x / a
        eta = math.copysign(math.sqrt(max(0.0, 2 * (part - 1 - math.log(part)))), part - 1)
        rest = 1 / (part - 1) - 1 / eta if abs(part - 1) > 1e-4 else -1 / 3 + (part - 1) / 12
        return min(1.0, max(0.0, 0.5 * math.erfc(eta * math.sqrt(a / 2)) + math.exp(-a * eta * eta / 2) / math.sqrt(2 * math.pi * a) * rest))
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny, b = 1e-300, x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000 + int(20 * math.sqrt(a))):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * h
    raise ArithmeticError(f"incomplete gamma at {a}, {x} did not converge")


def _bad(*values) -> bool:
    return any(v is None or math.isnan(v) for v in values)


def student_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if _bad(t, df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    if df > LARGE:
        return 0.5 * math.erfc((1 - 1 / (4 * df)) * t / math.sqrt(1 + t * t / (2 * df)) / math.sqrt(2))
    half = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def _walk(log_ratio: Callable[[np.ndarray], np.ndarray], start: int, stop: int, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, log weight relative to ``start``) from ``start`` to ``stop`` in growing chunks, until weights vanish beyond ``far``."""
    step = 1 if stop >= start else -1
    x, log_w, size, least = start, 0.0, 256, None
    while True:
        n = min(size, abs(stop - x) + 1)
        at = x + step * np.arange(n, dtype=np.float64)
        logs = log_w + np.r_[0.0, np.cumsum(log_ratio(at[:-1]) if step > 0 else -log_ratio(at[1:]))]
        yield at, logs
        if n < size or at[-1] == stop:
            return
        if step * (at[-1] - far) >= 0:
            least = logs[0] if least is None else least
            if logs[-1] < least - 45:
                return
        follow = log_ratio(at[-1:])[0] if step > 0 else -log_ratio(at[-1:] - 1)[0]
        x, log_w, size = int(at[-1]) + step, logs[-1] + follow, min(2 * size, 1 << 20)


def _upper_share(log_ratio: Callable[[np.ndarray], np.ndarray], low: int, high: int, mode: int, a: int) -> float:
    """Share of the weights on a .. high in those on low .. high, for a unimodal law given by log(w(x + 1) / w(x)).

    The sums start at the mode, where weights are largest, so none of them underflows, and go on until terms vanish.
    """
    if a <= low:
        return 1.0
    if a > high:
        return 0.0
    total = upper = 0.0
    for stop, far in ((high, max(a, mode)), (low, min(a - 1, mode))):
        for x, logs in _walk(log_ratio, mode, stop, far):
            w = np.exp(logs)
            if stop == low:
                w = w[x < mode]
                x = x[x < mode]
            total += float(w.sum())
            upper += float(w[x >= a].sum())
    return min(1.0, upper / total)


def binomial_sf(k: float, n: float, p: float) -> float:
    """P(X >= k)."""
    if _bad(k, n, p):
        return math.nan
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    n, odds, mean, spread = int(n), math.log(p) - math.log1p(-p), n * p, math.sqrt(n * p * (1 - p))
    if spread > 0 and abs(k - mean) > 60 * spread + 1000:
        return 1.0 if k < mean else 0.0
    return _upper_share(lambda x: np.log(n - x) - np.log(x + 1) + odds, 0, n, min(n, int((n + 1) * p)), math.ceil(k))


def fisher_greater(a: float, b: float, c: float, d: float) -> float:
    """P(X >= a) with the margins of the 2x2 table fixed."""
    if _bad(a, b, c, d):
        return math.nan
    a, b, c, d = (int(v) for v in (a, b, c, d))
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2
    if min(r1, r2, c1, b + d) == 0:
        return 1.0
    mean = r1 * c1 / n
    spread = math.sqrt(max(mean * (r2 / n) * ((n - c1) / max(1, n - 1)), 0.0))
    if abs(a - mean) > 60 * spread + 1000:
        return 1.0 if a < mean else 0.0
    shift = r2 - c1 + 1
    ratio = lambda x: np.log(r1 - x) + np.log(c1 - x) - np.log(x + 1) - np.log(x + shift)
    return _upper_share(ratio, max(0, c1 - r2), min(r1, c1), (r1 + 1) * (c1 + 1) // (n + 2), a)


@lru_cache(maxsize=64)
def _u_counts(n1: int, n2: int) -> np.ndarray:
    # Share of orders with U = u, from the generating function of Gaussian binomials: for each of the n1 rows multiply by
    # (1 - q^(n2 + j)) / (1 - q^j). Only as many terms as the lower half has are needed, and the law is symmetric.
    half = n1 * n2 // 2 + 1
    counts = np.zeros(half)
    counts[0] = 1.0
    for j in range(1, n1 + 1):
        step = n2 + j
        if step < half:
            counts[step:] -= counts[:-step].copy()
        rows = -(-half // j)
        grid = np.zeros(rows * j)
        grid[:half] = counts
        counts = np.cumsum(grid.reshape(rows, j), axis=0).ravel()[:half] * (j / step)
    return counts


def exact_u_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, for samples of which one is small."""
    counts, top = _u_counts(min(n1, n2), max(n1, n2)), n1 * n2
    k = max(0, math.ceil(u))
    upper = top - k  # P(U >= k) = P(U <= top - k)
    if upper < 0:
        return 0.0
    if upper < len(counts):
        return float(min(1.0, counts[: upper + 1].sum()))
    return float(min(1.0, 1.0 - counts[:k].sum()))


@lru_cache(maxsize=512)
def _w_counts(n: int) -> tuple[int, ...]:
    size = n * (n + 1) // 2 + 1
    counts = [0] * size
    counts[0] = 1
    for r in range(1, n + 1):
        for w in range(size - 1, r - 1, -1):
            counts[w] += counts[w - r]
    return tuple(counts)


def exact_w_sf(w: float, n: int) -> float:
    """P(W+ >= w) without ties or zeros, for small samples."""
    counts = _w_counts(n)
    return sum(counts[max(0, math.ceil(w)):]) / 2.0**n


@F.pandas_udf(DoubleType())
def _student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([2 * student_sf(abs(a), b) if not _bad(a, b) else math.nan for a, b in zip(t, df)])


@F.pandas_udf(DoubleType())
def _student_greater(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_sf(a, b) for a, b in zip(t, df)])


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([gamma_q(b / 2, a / 2) if not _bad(a, b) and b > 0 else math.nan for a, b in zip(x, df)])


@F.pandas_udf(DoubleType())
def _f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(
        [
            beta_inc(n / 2, m / 2, n / (n + m * x)) if not _bad(x, m, n) and m > 0 and n > 0 and x >= 0 else math.nan
            for x, m, n in zip(f, d1, d2)
        ]
    )


@F.pandas_udf(DoubleType())
def _binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_sf(a, b, c) for a, b, c in zip(k, n, p)])


@F.pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_greater(*row) for row in zip(a, b, c, d)])


@F.pandas_udf(DoubleType())
def _exact_u(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([exact_u_sf(x, int(a), int(b)) for x, a, b in zip(u, n1, n2)])


@F.pandas_udf(DoubleType())
def _exact_w(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([exact_w_sf(x, int(a)) for x, a in zip(w, n)])


def _d(c: Column) -> Column:
    return c.cast("double")


def _nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def student_p(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    if alternative == "two-sided":
        return _nan_to_null(_student_two_sided(_d(t), _d(df)))
    return _nan_to_null(_student_greater(_d(t) if alternative == "greater" else -_d(t), _d(df)))


def chi2_p(x: Column, df: Column) -> Column:
    return _nan_to_null(_chi2(_d(x), _d(df)))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _nan_to_null(_f_upper(_d(f), _d(d1), _d(d2)))


def binomial_p(k: Column, n: Column, p: Column) -> Column:
    """One-sided P(X >= k)."""
    return _nan_to_null(_binomial(_d(k), _d(n), _d(p)))


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided (greater) exact p of a 2x2 table."""
    return _nan_to_null(_fisher(_d(a), _d(b), _d(c), _d(d)))


def exact_u_p(u: Column, n1: Column, n2: Column) -> Column:
    return _exact_u(_d(u), _d(n1), _d(n2))


def exact_w_p(w: Column, n: Column) -> Column:
    return _exact_w(_d(w), _d(n))
