"""Exact centroid clustering by Orchard's search.

Every centroid keeps the others in order of their distance from it. A vector starts at
some centroid and walks that list; as soon as a nearer centroid turns up it goes on in
that one's list. Centroids already measured are marked and not measured again. A
centroid that is as near as the current one lies within twice the current distance of
it, so the walk ends at the first one strictly beyond. All comparisons are between
squared integers, so ties are exact and go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlift.llm.vectors import matrix, moved, whole_vectors
from seedlift.runtime import pin


class Orchard:
    """Centroids with, for each, the others by rising distance (ties by number)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        gap = centroids[:, None] - centroids[None]
        between = np.einsum("ijk,ijk->ij", gap, gap)
        order = np.argsort(between, axis=1, kind="stable")
        # A centroid's own place in its list goes, wherever copies of it put that place.
        self.others = np.array([row[row != i] for i, row in enumerate(order)]).reshape(len(centroids), -1)
        self.between = np.take_along_axis(between, self.others, axis=1)

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest centroid, the squared distance, and how many distances were measured."""
        n, k = len(rows), len(self.centroids)
        at, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        best, measured = self._squared(rows, at), n
        walking = np.arange(n if k > 1 else 0)
        while len(walking):
            here, step = at[walking], place[walking]
            # The inner distance exceeds twice the outer one just when its square exceeds four times the square.
            walking = walking[self.between[here, step] <= 4 * best[walking]]
            nxt = self.others[at[walking], place[walking]]
            place[walking] += 1
            fresh = ~seen[walking, nxt]
            who, to = walking[fresh], nxt[fresh]
            seen[who, to] = True
            gap = self._squared(rows[who], to)
            measured += len(who)
            nearer = (gap < best[who]) | ((gap == best[who]) & (to < at[who]))
            jump = who[nearer]
            at[jump], best[jump], place[jump] = to[nearer], gap[nearer], 0
            walking = walking[place[walking] < k - 1]
        return at, best, measured

    def _squared(self, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        gap = rows - self.centroids[numbers]
        return np.einsum("ij,ij->i", gap, gap)


def assigner(books: np.ndarray):
    index = Orchard(books[0])

    def run(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, best, _ = index.search(np.ascontiguousarray(rows[:, 0]))
        return at[:, None], best[:, None]
    return run


def _labeller(assign):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, best = assign(matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(at[:, 0].astype(np.int32)), pa.array(best[:, 0])],
                    names=["vec_id", "cluster", "distance"])
    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: str = "1",
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), final centroids), one row for each kept vector.

    Kept are vectors of exactly `width` components, none null or non-finite; components become floor(scale * x).
    The first centroids are the `k` kept vectors with the smallest SHA-256 of `<seed>:<id>`, fewer if there are
    fewer; null ids come last and equal ids are taken by their components. Rows that repeat an id stay rows of
    their own. Distances are squared. Empty clusters keep their centroid and have no rows. Tables without a
    vector give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale, width, vector_col, vec_id=F.col(id_col))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(drawn.asc_nulls_last(), "v").limit(k).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(1, len(first), width)
    if first:
        for _ in range(rounds):
            books = moved(rows, assigner(books), books)
    kind = dict(rows.dtypes)["vec_id"]
    labelled = rows.mapInArrow(_labeller(assigner(books)), f"vec_id {kind}, cluster int, distance bigint") if first else (
        rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")))
    labelled = pin(labelled, "clusters")
    sums = {r["cluster"]: r["s"] for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, books[0, c].tolist())).encode()).hexdigest())
             for c, s in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return labelled.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), books[0]
