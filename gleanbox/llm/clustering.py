"""Cluster vectors around centroids, each found by Orchard's search.

Every centroid has a list of the others, nearest first. A vector starts at a centroid and
walks its list; at a centroid that is closer (or as close, with a smaller number) it goes over
to that one's list. Centroids met before are marked and passed. The walk ends strictly beyond
twice the vector's distance: by the triangle inequality nothing after that is as close.

A task walks a batch of vectors at a time with numpy and adds up, for each centroid, what
Spark then sums: a round sends at most k rows a task. Vectors are read where they are in each
round and never shuffled; the driver holds the k centroids.

Defined cases: vectors of another length, null ones, and those with a null or non-finite
component are left out; repeated rows are vectors of their own; a null vec_id is kept and
comes last in the choice of the first centroids; equal hashes are in order of the components;
with fewer than k vectors there are as many centroids; empty tables give an empty result;
other columns play no part. A component of over 2^26 in size raises an error, since four
times a squared distance might not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbox.llm.common import materialize

K = 16
SIZE = 64
SCALE = 64
ROUNDS = 3
SEED = "1"
MOST = 1 << 26


def whole_numbers(column: pa.Array, size: int = SIZE, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their components as whole numbers) of an Arrow array of lists of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    fits = np.nan_to_num(lengths.astype(float), nan=-1) == size
    flat = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    finite = np.isfinite(flat).all(axis=1)
    kept = np.flatnonzero(fits)[finite]
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * flat[finite])
    if scaled.size and np.abs(scaled).max() > MOST:
        raise ValueError(f"a vector's component times {scale} is beyond 2^26")
    return kept, scaled.astype(np.int64)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the other centroids, nearest first, squared distances to them) for each centroid."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    others = np.argsort(between, axis=1, kind="stable")
    others = np.array([row[row != k] for k, row in enumerate(others)], dtype=np.int64).reshape(len(centroids), max(len(centroids) - 1, 0))
    return others, np.take_along_axis(between, others, axis=1)


def orchard(vectors: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; of equals the smaller number."""
    others, apart = lists
    n, k = len(vectors), len(centroids)
    best = np.zeros(n, dtype=np.int64)
    nearest = ((vectors - centroids[:1]) ** 2).sum(axis=1)  # without centroids there are no vectors
    place, seen = np.zeros(n, dtype=np.int64), np.zeros((n, k), dtype=bool)
    seen[:, :1] = True
    walking = np.arange(n) if k > 1 else np.arange(0)
    while len(walking):
        at = best[walking], place[walking]
        walking = walking[apart[at] <= 4 * nearest[walking]]
        other = others[best[walking], place[walking]]
        place[walking] += 1
        new = ~seen[walking, other]
        met, other = walking[new], other[new]
        seen[met, other] = True
        far = ((vectors[met] - centroids[other]) ** 2).sum(axis=1)
        closer = (far < nearest[met]) | ((far == nearest[met]) & (other < best[met]))
        gone, there = met[closer], other[closer]
        best[gone], nearest[gone], place[gone] = there, far[closer], 0
        walking = walking[place[walking] < k - 1]
    return best, nearest


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED, size: int = SIZE, scale: int = SCALE) -> np.ndarray:
    """The k kept vectors with the smallest SHA-256 of ``seed:vec_id``, in that order."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, numbers = whole_numbers(batch.column("v"), size, scale)
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(kept)), pa.array(list(numbers), pa.list_(pa.int64()))], ["h", "v"])

    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), F.col("embedding").cast("array<double>").alias("v"))
    rows = hashed.mapInArrow(whole, "h string, v array<long>").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(-1, size)


def moved_centroids(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays."""
    k, size = centroids.shape
    lists = neighbour_lists(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            _, numbers = whole_numbers(batch.column("v"), size, scale)
            best, _ = orchard(numbers, centroids, lists)
            counts += np.bincount(best, minlength=k)
            for c in np.flatnonzero(np.bincount(best, minlength=k)):
                totals[c] += numbers[best == c].sum(axis=0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(totals[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    partial = vectors.select(F.col("embedding").cast("array<double>").alias("v")).mapInArrow(sums, "cluster int, n long, total array<long>")
    each = [F.sum(F.col("total")[j].cast("decimal(20,0)")).alias(f"t{j}") for j in range(size)]
    out = centroids.copy()
    for r in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():  # k rows
        out[r["cluster"]] = [int(r[f"t{j}"]) // r["n"] for j in range(size)]
    return out


def nearest_centroids(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster and squared distance of every kept vector."""
    size, lists = centroids.shape[1], neighbour_lists(centroids)
    ids = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, numbers = whole_numbers(batch.column("v"), size, scale)
            best, far = orchard(numbers, centroids, lists)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), pa.array(best.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    kind = ids.schema["vec_id"].dataType.simpleString()
    return ids.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved_centroids(vectors, centroids)
    found = materialize(nearest_centroids(vectors, centroids), "clusters")
    inertia = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("x")).collect()}  # k rows
    told = [(c, own, sum(inertia.values()), centroid_digest(centroids[c])) for c, own in sorted(inertia.items())]
    figures = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
