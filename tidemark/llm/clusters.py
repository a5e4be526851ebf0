"""Centroid clustering by sort-means: each vector scans centroids in order of their distance from its previous one.

By the triangle inequality a centroid further from the previous centroid than twice the vector's distance to it can't be
nearer.  The scan stops strictly beyond that, so a centroid at the same distance with a smaller number is still found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep, keep_at
from .vectors import add_rows, chunks, matrix, sha_text, whole_vectors

SCALE = 256
DIMS = 64
CENTROIDS = 40
ROUNDS = 5


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from ``c`` (a row, or one for each).

    Both come as float64 where every partial sum is a whole number below 2^53, as int64 otherwise."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap).astype(np.int64)


class Centroids:
    """Centroids with, for each, the others by distance (ties by number)."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows.astype(np.int64)
        k = len(rows)
        between = np.array([squares(self.rows, c) for c in self.rows], dtype=np.int64).reshape(k, k)
        away = between.copy()
        np.fill_diagonal(away, -1)  # itself comes first and is left out
        self.others = np.argsort(away, axis=1, kind="stable")[:, 1:]
        self.far = np.take_along_axis(between, self.others, axis=1)

    def sha256(self, number: int) -> str:
        return hashlib.sha256(sha_text(self.rows[number]).encode()).hexdigest()

    def moved(self, sums: dict[tuple[int, int], int]) -> Centroids:
        """Every non-empty centroid replaced by floor(sum / count); ``sums`` is by (number, place), place 0 the count."""
        new = self.rows.copy()
        for (number, place), s in sums.items():
            if place:
                new[number, place - 1] = s // sums[number, 0]
        return Centroids(new)

    def assign(self, x: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of every row (ties: the smaller number) and its squared distance, scanned from
        ``previous``."""
        largest = max(int(np.abs(x).max(initial=0)), int(np.abs(self.rows).max(initial=0)))
        kind = np.float64 if 4 * x.shape[1] * largest * largest < 2**53 else np.int64
        x, rows = x.astype(kind), self.rows.astype(kind)
        start = squares(x, rows[previous])
        reach = np.zeros(len(x), dtype=np.int64)  # how many of the others are not strictly beyond twice the distance
        for a in np.unique(previous):
            of = previous == a
            reach[of] = np.searchsorted(self.far[a], 4 * start[of], side="right")
        order = np.lexsort((-reach, previous))
        x, reach = x[order], reach[order]
        best, least = previous[order].astype(np.int64), start[order]
        groups, first = np.unique(previous[order], return_index=True)
        for a, begin, end in zip(groups, first, np.append(first[1:], len(x))):
            for p in range(int(reach[begin])):
                stop = begin + int(np.searchsorted(-reach[begin:end], -p, side="left"))  # those that reach past p
                j = self.others[a][p]
                d = squares(x[begin:stop], rows[j])
                better = (d < least[begin:stop]) | ((d == least[begin:stop]) & (j < best[begin:stop]))
                least[begin:stop][better] = d[better]
                best[begin:stop][better] = j
        cluster, distance = np.empty_like(best), np.empty_like(least)
        cluster[order], distance[order] = best, least
        return cluster, distance


def _first(vectors: DataFrame) -> np.ndarray:
    """The CENTROIDS vectors with the smallest hash of their id; equal ids by their vectors, a null id as the empty text."""
    digest = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.where("v is not null").orderBy(digest, "v").select("v").limit(CENTROIDS).collect()
    return matrix(pa.array([r.v for r in rows], pa.binary()), DIMS)


def _pass(vectors: DataFrame, centroids: Centroids, last: bool) -> DataFrame:
    """(vec_id, v, cluster, distance, sums): every vector with its new cluster, and a row of sums for each task and cluster:
    the count and the vectors' sum, in the last pass the count and the distances' sum."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        k = len(c.rows)
        sums, counts = np.zeros((k, 1 if last else DIMS), dtype=np.int64), np.zeros(k, dtype=np.int64)
        names = ["vec_id", "v", "cluster", "distance", "sums"]
        nothing = lambda n, kind: pa.nulls(n, kind)
        id_kind = None
        for part in chunks(batches, DIMS * 16):
            ids, v, before = part.column(0), part.column(1), part.column(2)
            id_kind = ids.type
            inside = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            x = matrix(v.take(pa.array(inside)), DIMS)
            new, distance = c.assign(x, before.take(pa.array(inside)).to_numpy(zero_copy_only=False).astype(np.int64))
            add_rows(sums, counts, distance[:, None] if last else x, new)
            at = np.full(len(v), -1)
            at[inside] = np.arange(len(inside))
            place = pa.array(at, mask=at < 0)
            out = [ids, nothing(len(v), pa.binary()) if last else v, pa.array(new.astype(np.int32)).take(place), pa.array(distance).take(place), nothing(len(v), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=names)
        used = np.flatnonzero(counts)
        if len(used):
            block = pa.array(np.hstack([counts[used, None], sums[used]]).tolist(), type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([nothing(len(used), id_kind), nothing(len(used), pa.binary()), pa.array(used.astype(np.int32)), nothing(len(used), pa.int64()), block], names=names)

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind}, v binary, cluster int, distance long, sums array<long>")


def _totals(passed: DataFrame) -> dict[tuple[int, int], int]:
    """The tasks' sums added up: CENTROIDS * (DIMS + 1) numbers at most."""
    rows = passed.where("sums is not null").select("cluster", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return {(r.cluster, r.place): int(r.s) for r in rows.collect()}


class Clustering(NamedTuple):
    """Vectors with their clusters, a written table (vec_id, cluster, distance), the centroids, and each cluster's inertia."""

    rows: DataFrame
    centroids: Centroids
    inertia: dict[int, int]


def fit(embeddings: DataFrame, column: str = "embedding") -> Clustering:
    """Clusters of every vector of DIMS components without a null or a non-finite one.

    * Repeated rows count each; equal ids are ordered by their vectors; a null vec_id hashes as the empty text.  Fewer
      vectors than CENTROIDS give as many centroids.  An empty table gives no rows; other columns are not read.
    * A vector with a component too large for exact distances (``vectors.most``) takes no part and has nulls.
    * Each round writes the vectors with their cluster, from which the next round scans, beside the sums of each task, and
      removes the round before; only centroids reach the driver and the broadcast.
    """
    spark = embeddings.sparkSession
    kept = whole_vectors(embeddings, SCALE, ["vec_id"], column, DIMS).withColumn("cluster", F.lit(0))
    vectors, path = keep_at(kept)
    centroids = Centroids(_first(vectors))
    for _ in range(ROUNDS if len(centroids.rows) else 0):
        passed, new_path = keep_at(_pass(vectors, centroids, False))
        centroids = centroids.moved(_totals(passed))
        drop_kept(spark, path)
        vectors, path = passed.where("sums is null").select("vec_id", "v", "cluster"), new_path
    passed = keep(_pass(vectors, centroids, True))
    drop_kept(spark, path)
    totals = _totals(passed)
    return Clustering(passed.where("sums is null").select("vec_id", "cluster", "distance"), centroids, {number: s for (number, place), s in totals.items() if place})


def nearest_centroids(embeddings: DataFrame, centroids: Centroids, column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance) of vectors that were not there when the centroids were fitted; rows as in ``fit``."""
    vectors = whole_vectors(embeddings, SCALE, ["vec_id"], column, DIMS).withColumn("cluster", F.lit(0))
    return _pass(vectors, centroids, True).where("sums is null").select("vec_id", "cluster", "distance")


def cluster(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that ``fit`` takes; of one that
    took no part only inertia is not null."""
    rows, centroids, inertia = fit(embeddings, column)
    told = embeddings.sparkSession.createDataFrame([(n, inertia.get(n), centroids.sha256(n)) for n in range(len(centroids.rows))], "cluster int, cluster_inertia long, centroid_sha256 string")
    whole = F.lit(sum(inertia.values())).cast("long").alias("inertia")
    return rows.join(F.broadcast(told), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", whole, "centroid_sha256")  # CENTROIDS rows
