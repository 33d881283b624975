"""Vectors compressed to one code for each of their parts, by codebooks that are searched through GNATs.

A geometric near-neighbour access tree picks a few split points far apart, gives every
other entry to its nearest split point, and keeps for each pair the least and the largest
distance from one split point to the other's entries. A query's distance to a split
point then rules out whole subtrees: those whose range lies strictly outside the query's
distance plus or minus the best distance so far. Ranges and distances are rounded so
that no entry as near as the best is ever ruled out; the choice itself is made on
integers, ties going to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlift.llm.vectors import common_width, matrix, moved, whole_vectors
from seedlift.operators.joins import attach
from seedlift.runtime import pin

#: Split points of a node, and how much distances are widened before they rule anything out.
DEGREE, SLACK = 5, 1e-12


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between integer vectors, broadcast over all but the last axis."""
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


class Gnat:
    """A tree over integer `points`; `numbers` are their indexes in the codebook."""

    def __init__(self, points: np.ndarray, numbers: np.ndarray, degree: int = DEGREE):
        chosen = self._far_apart(points, min(degree, len(points)))
        self.splits, self.numbers = points[chosen], numbers[chosen]
        apart = squared(points[:, None], self.splits[None])
        others = np.setdiff1d(np.arange(len(points)), chosen)
        home = apart[others].argmin(axis=1)
        self.low, self.high, self.children = *np.empty((2, len(chosen), len(chosen))), []
        for j, split in enumerate(chosen):
            own = others[home == j]
            reach = np.sqrt(apart[np.append(own, split)])
            self.low[:, j], self.high[:, j] = reach.min(axis=0) * (1 - SLACK), reach.max(axis=0) * (1 + SLACK)
            self.children.append(Gnat(points[own], numbers[own], degree) if len(own) else None)

    @staticmethod
    def _far_apart(points: np.ndarray, count: int) -> np.ndarray:
        """The first point, then always the one farthest from those chosen."""
        chosen = [0]
        gap = squared(points, points[0])
        while len(chosen) < count:
            gap[chosen] = -1  # copies of a chosen point are at 0 and may still be chosen
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, squared(points, points[chosen[-1]]))
        return np.array(chosen)

    def search(self, queries: np.ndarray, who: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        """Improve `best` (squared distance) and `found` (number) of the queries `who`, in place."""
        alive = np.ones((len(who), len(self.splits)), bool)
        for i, split in enumerate(self.splits):
            at = np.flatnonzero(alive[:, i])
            asked = who[at]
            gap = squared(queries[asked], split)
            better = (gap < best[asked]) | ((gap == best[asked]) & (self.numbers[i] < found[asked]))
            best[asked[better]], found[asked[better]] = gap[better], self.numbers[i]
            distance, radius = np.sqrt(gap), np.sqrt(best[asked]) * (1 + SLACK)
            alive[at] &= ((distance * (1 - SLACK) - radius)[:, None] <= self.high[i]) & (
                (distance * (1 + SLACK) + radius)[:, None] >= self.low[i])
        for j, child in enumerate(self.children):
            if child is not None:
                left = who[alive[:, j]]
                if len(left):
                    child.search(queries, left, best, found)


def nearest(tree: Gnat, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each query's nearest entry, ties to the lower number."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    found = np.full(len(queries), np.iinfo(np.int64).max)
    tree.search(queries, np.arange(len(queries)), best, found)
    return found, best


def assigner(books: np.ndarray, degree: int = DEGREE):
    """Nearest entries of all parts, by one tree for each part's codebook."""
    trees = [Gnat(book, np.arange(len(book)), degree) for book in books]

    def run(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = [nearest(tree, np.ascontiguousarray(rows[:, p])) for p, tree in enumerate(trees)]
        return np.stack([b[0] for b in both], axis=1), np.stack([b[1] for b in both], axis=1)
    return run


def _coder(assign, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, gaps = assign(matrix(batch.column("v"), parts))
            text = [row.astype(np.uint8).tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(gaps.sum(axis=1))],
                names=["vec_id", "label", "code", "error"])
    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error, codebooks_sha256), final codebooks): one row for each kept vector.

    Components become floor(scale * x). The first codebooks are the parts of the vectors with the `entries`
    (at most 256) smallest ids, fewer if there are fewer; null ids come last and equal ids are taken by their
    components. Rows that repeat an id stay rows of their own. Left out are vectors that are null, hold a null
    or non-finite component, or do not have the table's commonest length among the multiples of `parts` (no
    other can be cut into the same parts). Equal labels share `label_error`, nulls among themselves. Tables
    without a vector give no rows. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so 1 to 256 entries")
    spark, width = vectors.sparkSession, common_width(vectors, vector_col, parts)
    rows = whole_vectors(vectors, scale, width, vector_col, vec_id=F.col(id_col), label=F.col(label_col))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1 if first else 0).transpose(1, 0, 2)
    if not first:
        empty = spark.createDataFrame([], rows.select("vec_id", "label").schema)
        return empty.select("vec_id", "label", F.lit("").alias("code"), *[F.lit(0).cast("bigint").alias(c) for c in (
            "error", "label_error")], F.lit(digest(books)).alias("codebooks_sha256")), books
    for _ in range(rounds):
        books = moved(rows, assigner(books), books)
    kinds = dict(rows.dtypes)
    coded = pin(rows.mapInArrow(_coder(assigner(books), parts),
                                f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "codes")
    keyed = coded.select("*", F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label"))
    sums = pin(keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error")), "label_errors")
    return attach(keyed, sums, ["_none", "_label"]).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books
