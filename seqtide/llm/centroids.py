"""Clustering of vectors around centroids with exact integer arithmetic; nearest centroids are found by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

#: Centroids at most: a task holds their k x k neighbour lists (4096: 200 MB).
MOST_CENTROIDS = 4096
#: Components up to here keep a squared distance of 64 components inside 64 bits; larger ones are counted as Python integers.
SMALL = 1 << 27
#: Sums leave a task in digits of this many bits.
LIMB = 60
ROWS = 4096


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, x: array of double) of the rows whose vector has exactly ``dims`` components, none null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where((F.size("embedding") == dims) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where all are small, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    exact = lambda v: int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale))
    return np.array([[exact(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def squares(diff: np.ndarray) -> np.ndarray:
    return (diff * diff).sum(axis=-1)


class Orchard:
    """The nearest of ``centroids``; of equally near ones the smallest number.

    Each centroid has the list of the others by growing distance. A search at centroid c with distance d goes down
    c's list, measures what it hasn't visited yet, and jumps to the list of a centroid that is closer (or as close and
    of a smaller number). It ends where the list's next entry is strictly further from c than 2d: by the triangle
    inequality that entry and all after it are further from the vector than c. All vectors of a block step together.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        self.gaps = np.array([squares(centroids - c) for c in centroids], dtype=centroids.dtype).reshape(k, k)
        self.lists = np.array([[j for j in np.lexsort((np.arange(k), row)) if j != i] for i, row in enumerate(self.ranks())], dtype=np.int64).reshape(k, max(0, k - 1))

    def ranks(self) -> np.ndarray:
        """Gaps, or their order where they are Python integers."""
        return self.gaps if self.gaps.dtype != object else np.array([[sorted(row).index(v) for v in row] for row in self.gaps.tolist()], dtype=np.int64).reshape(self.gaps.shape)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance, distances measured) for the rows of ``x``."""
        n, k = len(x), len(self.centroids)
        at, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if not n:
            return at, place, 0
        best = squares(x - self.centroids[0])
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        live, measured = np.arange(n), n
        while len(live):
            live = live[place[live] < k - 1]
            here = self.lists[at[live], place[live]] if k > 1 else live
            stay = ~(self.gaps[at[live], here] > 4 * best[live]).astype(bool)
            live, here = live[stay], here[stay]
            place[live] += 1
            fresh = ~seen[live, here]
            rows, to = live[fresh], here[fresh]
            seen[rows, to] = True
            gap = squares(x[rows] - self.centroids[to])
            measured += len(rows)
            closer = ((gap < best[rows]) | ((gap == best[rows]) & (to < at[rows]))).astype(bool)
            rows, to, gap = rows[closer], to[closer], gap[closer]
            at[rows], best[rows], place[rows] = to, gap, 0
        return at, best, measured


def blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and integer vectors, ``ROWS`` at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part.column(0).to_pylist(), integers(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)


def limbs(total: int) -> Iterator[tuple[int, int]]:
    """``total`` as digits of ``LIMB`` bits, the last one signed; zeros are left out."""
    place = 0
    while total:
        low = total if -(1 << LIMB) < total < 1 << LIMB else total & ((1 << LIMB) - 1)
        if low:
            yield place, low
        total, place = (total - low) >> LIMB, place + 1


def move(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """Centroids after one round. Each task adds up its vectors per centroid, so k x dims sums leave it, and the driver
    gets one such set; a sum of any size is exact."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard, count = Orchard(centroids), np.zeros(k, dtype=np.int64)
        sums = np.zeros((k, dims), dtype=object)
        for _, x in blocks(batches, dims, scale):
            at = orchard.search(x)[0]
            for c in np.unique(at).tolist():
                mine = x[at == c]
                count[c] += len(mine)
                sums[c] += mine.sum(axis=0).astype(object)
        rows = [(c, -1, 0, int(count[c])) for c in np.flatnonzero(count).tolist()]
        rows += [(c, j, p, v) for c in np.flatnonzero(count).tolist() for j in range(dims) for p, v in limbs(int(sums[c, j]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["c", "j", "place", "v"])

    found = vectors.mapInArrow(tidy(run), "c int, j int, place int, v long").groupBy("c", "j", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    count = {r["c"]: int(r["v"]) for r in found if r["j"] < 0}
    sums: dict = {}
    for r in found:
        if r["j"] >= 0:
            sums[r["c"], r["j"]] = sums.get((r["c"], r["j"]), 0) + (int(r["v"]) << (LIMB * r["place"]))
    moved = [[sums.get((c, j), 0) // count[c] for j in range(dims)] if c in count else [int(v) for v in centroids[c]] for c in range(k)]
    return stacked(moved, dims)


def stacked(rows: list[list[int]], dims: int) -> np.ndarray:
    """Centroids as 64-bit integers where all components are small, else as Python integers."""
    small = all(abs(v) < SMALL for row in rows for v in row)
    return np.array(rows, dtype=np.int64 if small else object).reshape(len(rows), dims)


def seeds(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of seed and id, in that order; ids that are null come last, and rows of one id by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), dims)
    return stacked([[int(v) for v in row] for row in integers(x, scale)], dims)


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of each vector; a distance beyond 64 bits is null."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids)
        for ids, x in blocks(batches, dims, scale):
            at, gap, _ = orchard.search(x)
            gaps = [v if v < 1 << 63 else None for v in gap.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(gaps, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(tidy(run), "vec_id long, cluster int, distance long")


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> np.ndarray:
    """Centroids (k x dims integers) after ``rounds`` rounds over all of ``vectors`` (from ``kept``)."""
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"between 1 and {MOST_CENTROIDS} centroids")
    centroids = seeds(vectors, k, dims, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = move(vectors, centroids, scale)
    return centroids


def total(distance: Column, rows: Column) -> Column:
    """Exact sum as a long; null if it, or a distance, doesn't fit."""
    exact = F.sum(distance.cast("decimal(38,0)"))
    return F.when((F.count(distance) == rows) & (exact <= F.lit((1 << 63) - 1)), exact.cast("long"))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """One row per kept vector of ``vectors`` (vec_id, embedding): vec_id, cluster, distance (squared), cluster_inertia,
    inertia, centroid_sha256.

    Vectors with another number of components, or with a null or non-finite one, are left out. Components count as
    floor(scale * x), exactly, however large; distances and inertias beyond 64 bits are null. Null ids: kept, but
    seeds only after all others. Repeated rows count as often as they stand there; with fewer vectors than ``k`` there
    are as many centroids as vectors, and of centroids alike the smaller number gets all. An empty table gives no rows.
    Other columns are not looked at. Vectors are read once per round and never shuffled; centroids travel with the
    tasks, and what tasks return is bounded by k x dims.
    """
    spark, points = vectors.sparkSession, kept(vectors, dims)
    centroids = fit(points, k, rounds, dims, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = cut(assign(points, centroids, scale))
    shas = [(c, hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for c, row in enumerate(centroids)]
    names = spark.createDataFrame(shas, "cluster int, centroid_sha256 string")
    per = found.groupBy("cluster").agg(total(F.col("distance"), F.count("*")).alias("cluster_inertia"))
    whole = found.agg(total(F.col("distance"), F.count("*")).alias("inertia"))
    facts = F.broadcast(names.join(per, "cluster", "left").crossJoin(F.broadcast(whole)))  # at most k rows, of one row each
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(table: str = "embeddings", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same rows in DuckDB SQL, all distances written out."""
    steps = [
        f"""v AS (SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM {table}
             WHERE len(embedding) = {dims} AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x::DOUBLE)]) = {dims}),
        r AS (SELECT row_number() OVER () AS row, * FROM v),
        p AS (SELECT row, unnest(range(1, {dims + 1})) AS j, unnest(x) AS x FROM r),
        s AS (SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS c FROM v),
        c0 AS (SELECT c, unnest(range(1, {dims + 1})) AS j, unnest(x) AS x FROM s WHERE c < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""d{i} AS (SELECT row, c, sum((p.x - c{i}.x) * (p.x - c{i}.x)) AS distance FROM p JOIN c{i} USING (j) GROUP BY row, c),
        a{i} AS (SELECT row, min(c) AS c, min(distance) AS distance FROM (SELECT *, min(distance) OVER (PARTITION BY row) AS least FROM d{i}) WHERE distance = least GROUP BY row)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT c, j, sum(p.x)::HUGEINT AS total, count(*)::HUGEINT AS n FROM a{i} JOIN p USING (row) GROUP BY c, j),
        c{i + 1} AS (SELECT o.c, o.j, coalesce((total - ((total % n) + n) % n) // n, o.x)::BIGINT AS x FROM c{i} o LEFT JOIN m{i} USING (c, j))"""
            )
    return f"""WITH {", ".join(steps)},
        h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN r USING (row) JOIN h USING (c)"""
