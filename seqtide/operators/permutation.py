"""Permutation tests of rank correlations by keyed bijections.

A replicate is a bijection of the places 0 .. n - 1 that is computed from its number: a Feistel network over a grid of
about sqrt(n) by sqrt(n) cells, walked on while it leads outside (at most one row of cells is outside). So nothing is
shuffled, sorted or stored per replicate; a task holds a block of each rank column and adds up products.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtide.operators.ordered import ordered
from seqtide.operators.ranks import add_rank_columns
from seqtide.session import cut_lineage

#: Round function: fifth powers modulo this prime, a bijection of its residues.
PRIME = 2_147_483_647
ROUNDS = 6
#: Places of a block on the permuted and on the fixed side, replicates of a unit of work, cells looked at in one step.
X_BLOCK, Y_BLOCK, REPS, STEP = 1 << 16, 1 << 20, 500, 1 << 20


def round_keys(seed: int, reps: Sequence[int]) -> np.ndarray:
    """(replicates, rounds): the first eight hex digits of md5(seed | replicate | round)."""
    text = [[hashlib.md5(f"{seed}|{r}|{j}".encode()).hexdigest()[:8] for j in range(ROUNDS)] for r in reps]
    return np.array([[int(h, 16) % PRIME for h in row] for row in text], dtype=np.int64).reshape(len(reps), ROUNDS)


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    u = (x + key) % PRIME
    square = u * u % PRIME
    return square * square % PRIME * u % PRIME


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with n cells or more."""
    a = max(1, math.isqrt(n - 1) + 1) if n else 1
    return a, max(1, -(-n // a))


def images(places: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """(replicates, places): where each replicate's bijection of 0 .. n - 1 sends each place."""
    a, b = grid(n)

    def once(at: np.ndarray, k: np.ndarray) -> np.ndarray:
        left, right = at // b, at % b
        for j in range(0, ROUNDS, 2):
            left = (left + _mixed(right, k[..., j])) % a
            right = (right + _mixed(left, k[..., j + 1])) % b
        return left * b + right

    out = once(places[None, :], keys[:, None, :])
    rep, column = np.nonzero(out >= n)
    while len(rep):
        out[rep, column] = once(out[rep, column], keys[rep])
        still = out[rep, column] >= n
        rep, column = rep[still], column[still]
    return out


def _unit_sums(x: np.ndarray, first_x: int, y: np.ndarray, first_y: int, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per replicate the sum of x[i] * y[image of i] over the images inside y's block, as high and low 32-bit parts."""
    high, low = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    step = max(1, STEP // max(1, len(x)))
    places = np.arange(first_x, first_x + len(x), dtype=np.int64)
    for r in range(0, len(keys), step):
        at = images(places, n, keys[r : r + step]) - first_y
        inside = (at >= 0) & (at < len(y))
        product = np.where(inside, x[None, :] * y[np.where(inside, at, 0)], 0)
        high[r : r + step], low[r : r + step] = (product >> 32).sum(axis=1), (product & 0xFFFFFFFF).sum(axis=1)
    return high, low


def centred_ranks(df: DataFrame, keys: Sequence[str], x: str, y: str, unique: str) -> DataFrame:
    """keys, __place (from 0, by ``unique``), __n, and both ranks as the integers 2 * rank - (n + 1), whose mean is 0."""
    k = list(keys)
    pairs = df.select(*k, unique, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).filter("__x is not null and __y is not null")
    ranked = add_rank_columns(pairs, k, {"__x": "__rx", "__y": "__ry"})
    sizes = pairs.groupBy(*k).agg(F.count(F.lit(1)).alias("__n"))
    placed = ordered(ranked, k, unique).number("__place").frame.join(sizes, k)
    whole = lambda c: (2 * F.col(c) - (F.col("__n") + 1)).cast("long")
    return placed.select(*k, (F.col("__place") - 1).alias("__place"), "__n", whole("__rx").alias("__x"), whole("__ry").alias("__y"))


def _blocks(ranks: DataFrame, keys: Sequence[str], column: str, size: int, name: str) -> DataFrame:
    """Arrays of ``size`` values in the order of their places: keys, ``name`` (number of the block), column."""
    cells = F.array_sort(F.collect_list(F.struct("__place", column)))
    rows = ranks.groupBy(*keys, F.floor(F.col("__place") / size).cast("long").alias(name)).agg(F.first("__n").alias("__n"), cells.alias("__c"))
    return rows.select(*keys, name, "__n", F.transform("__c", lambda c: c[column]).alias(column))


def permutation_spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, unique: str, reps: int = 10_000, seed: int = 7, min_n: int = 2) -> DataFrame:
    """Per key Spearman's rho and the share of ``reps`` random pairings whose |rho| reaches it: keys, n, reps, rho,
    extreme, p. Rows with a null are left out; ``unique`` must be unique inside a key; rho is null for a constant side.

    Work units are (block of x, block of y, 500 replicates). Ranks travel once per unit and a unit gives back one sum
    per replicate, so what is exchanged for a replicate is a number per pair of blocks, never its rows. Sums are
    integers and exact. Keys of over ``Y_BLOCK`` rows compute each image once per block of y.
    """
    if reps % REPS:
        raise ValueError(f"reps must be a multiple of {REPS}")
    if not keys:
        return permutation_spearman(df.withColumn("__all", F.lit(0)), ["__all"], x, y, unique, reps, seed, min_n).drop("__all")
    k = list(keys)
    ranks = cut_lineage(centred_ranks(df, k, x, y, unique).filter(F.col("__n") >= min_n))
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    observed = ranks.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), exact(F.col("__x") * F.col("__y")).alias("__obs"), exact(F.col("__x") * F.col("__x")).alias("__xx"), exact(F.col("__y") * F.col("__y")).alias("__yy")
    )
    chunks = F.explode(F.sequence(F.lit(0), F.lit(reps // REPS - 1)))
    ys = _blocks(ranks, k, "__y", Y_BLOCK, "__yb").drop("__n").withColumn("__chunk", chunks)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / Y_BLOCK).cast("long")))
    xs = _blocks(ranks, k, "__x", X_BLOCK, "__xb").withColumn("__yb", every).withColumn("__chunk", chunks)
    units = xs.join(ys.hint("shuffle_merge"), [*k, "__yb", "__chunk"]).select(*k, "__n", "__xb", "__yb", "__chunk", "__x", "__y")
    out = T.StructType([*[df.schema[c] for c in k], T.StructField("rep", T.IntegerType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, xb, yb, chunk = (batch.column(c)[i].as_py() for c in ("__n", "__xb", "__yb", "__chunk"))
                x_, y_ = (batch.column(c)[i].values.to_numpy() for c in ("__x", "__y"))
                numbers = range(chunk * REPS + 1, (chunk + 1) * REPS + 1)
                high, low = _unit_sums(x_, xb * X_BLOCK, y_, yb * Y_BLOCK, n, round_keys(seed, numbers))
                own = batch.select(k).take(pa.array([i] * REPS))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(numbers, pa.int32()), pa.array(high), pa.array(low)], names=names)

    sums = units.mapInArrow(run, out).groupBy(*k, "rep").agg((exact(F.col("high")) * F.lit(1 << 32).cast("decimal(38,0)") + exact(F.col("low"))).alias("__s"))
    rho = F.try_divide(F.col("__obs").cast("double"), F.sqrt(F.col("__xx").cast("double") * F.col("__yy").cast("double")))
    counted = sums.join(observed, k).groupBy(*k, "n", "__obs", "__xx", "__yy").agg(
        F.count(F.lit(1)).alias("reps"), F.count_if(F.abs(F.col("__s")) >= F.abs(F.col("__obs"))).alias("extreme")
    )
    return counted.withColumn("rho", rho).select(*keys, "n", "reps", "rho", "extreme", (F.col("extreme") / F.col("reps")).alias("p"))
