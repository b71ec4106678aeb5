"""Centroid clustering whose assignment step searches the centroids in the Walsh-Hadamard domain.

Vectors become integers and are transformed by the 64 x 64 Hadamard matrix, its rows ordered from coarse to fine (by their number of sign
changes). The transform is exact in integers and multiplies squared distances by 64. Differences of coefficients are added up level by level. After the first
level the centroid in front is finished, which bounds the distance from above; the others have at least what is added up, and the square of the difference of the two
norms that remain. A centroid whose least possible distance is above the bound is strictly worse and leaves; those left are finished over all 64 coefficients, so
results equal those of a full search.

Each round is one pass: tasks add up coefficients per centroid, Spark adds up the tasks' sums, and the driver sees one row per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

DIMS = 64
SCALE = 1024
LEVELS = (0, 2, 8, 24, DIMS)
LIMIT = 1 << 23
FAR = np.iinfo(np.int64).max


def transform_matrix(dims: int = DIMS) -> np.ndarray:
    """The Hadamard matrix of a power of two, rows in order of their sign changes."""
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < dims:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    changes = (matrix[:, 1:] != matrix[:, :-1]).sum(1)
    return matrix[np.argsort(changes)]


def transform(vectors: np.ndarray) -> np.ndarray:
    """Coefficients of integer vectors: products in double precision, exact as every partial sum stays far below 2^53."""
    return (vectors.astype(np.float64) @ transform_matrix().T.astype(np.float64)).astype(np.int64)


def _root_bounds(energy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers at most and at least the square root."""
    root = np.sqrt(energy.astype(np.float64)).astype(np.int64)
    return np.maximum(root - 1, 0), root + 2


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per vector the nearest centroid (of equal ones the first) and the squared distance, both from coefficients; and the number of differences taken."""
    done = np.zeros((len(vectors), len(centroids)), np.int64)
    alive = np.ones(done.shape, bool)
    left, right = (vectors * vectors).sum(1), (centroids * centroids).sum(1)
    taken, every = 0, np.arange(len(vectors))
    bound = np.full(len(vectors), FAR)
    for first, last in zip(LEVELS, LEVELS[1:], strict=False):
        row, column = np.nonzero(alive)
        apart = vectors[row, first:last] - centroids[column, first:last]
        done[row, column] += (apart * apart).sum(1)
        taken += apart.size
        if last == DIMS:
            break
        if not first:
            front = done.argmin(1)
            rest = vectors[:, last:] - centroids[front, last:]
            bound = done[every, front] + (rest * rest).sum(1)
            taken += rest.size
        left = left - (vectors[:, first:last] ** 2).sum(1)
        right = right - (centroids[:, first:last] ** 2).sum(1)
        (low, high), (low_c, high_c) = _root_bounds(left), _root_bounds(right)
        gap = np.maximum(0, np.maximum(low[:, None] - high_c, low_c - high[:, None]))
        alive &= done + gap * gap <= bound[:, None]
    done[~alive] = FAR
    best = done.argmin(1)
    return best, done[every, best] // DIMS, taken


def _coefficients(batch: pa.RecordBatch) -> np.ndarray:
    return transform(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS))


def _adder(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of coefficients and counts per centroid over a whole task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in filter(len, batches):
            vectors = _coefficients(batch)
            best, _, _ = nearest(vectors, centroids)
            for k in np.unique(best):
                sums[k] += vectors[best == k].sum(0)
            counts += np.bincount(best, minlength=len(centroids))
        met = np.flatnonzero(counts)
        columns = [pa.array(met, pa.int32()), pa.array(counts[met], pa.int64()), pa.array([sums[k] for k in met], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "total"])

    return add


def _assigner(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            best, distance, _ = nearest(_coefficients(batch), centroids)
            columns = [batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return assign


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<int>) of the rows whose embedding has 64 finite components."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", "embedding").filter((F.size("embedding") == DIMS) & whole)
    large = F.exists("embedding", lambda x: F.abs(x.cast("double")) >= LIMIT / SCALE)
    checked = F.when(large, F.raise_error(F.lit(f"walsh: a component of {LIMIT // SCALE} or more, whose distances a long may not hold"))).otherwise(scaled)
    return kept.select(F.col("vec_id").cast("long"), checked.cast("array<int>").alias("v"))


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every row of `vectors` (vec_id, embedding) with 64 finite components.

    Other rows (null, shorter, longer, with a null or non-finite component) take no part. Components become floor(1024 x). The first centroids are the vectors with
    the smallest sha256 of `seed`, a colon and vec_id (nothing after the colon where that is null; ties, as under a repeated id: the smaller vector); fewer vectors
    than clusters give as many centroids as there are. Rows that repeat count each time. Each round replaces non-empty centroids by the floor of their mean; a round that
    changes none is the last, as all later ones would repeat it. A component of 8192 or more (in size) is an error, since squared distances would leave a long.
    Other columns are not read; an empty table gives no rows.
    """
    held = materialize(integer_vectors(vectors))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = held.select("v", digest.alias("digest")).orderBy("digest", "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, DIMS)
    matrix = transform_matrix()
    for _ in range(rounds if len(centroids) else 0):
        sums = held.select("v").mapInArrow(_adder(transform(centroids)), "cluster int, n long, total array<long>")
        sums = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[k]) for k in range(DIMS)]).alias("total"))
        after = centroids.copy()
        for r in sums.collect():
            total = [sum(int(h) * t for h, t in zip(column, r["total"], strict=True)) // DIMS for column in matrix.T]  # back from coefficients, exactly
            after[r["cluster"]] = [t // r["n"] for t in total]
        if (after == centroids).all():
            break
        centroids = after
    assigned = materialize(held.mapInArrow(_assigner(transform(centroids)), "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.array(*[F.lit(inertia.get(k, 0)).cast("long") for k in range(len(names))]) if names else F.array().cast("array<long>")
    name = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return assigned.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(name, F.col("cluster")).alias("centroid_sha256"),
    )
