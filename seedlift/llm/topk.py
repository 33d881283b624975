"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are dealt to blocks and queries to batches; every pair of a block and a batch is
one bounded tile. A block's index keeps, for each dimension, its rows in segments by
quantised value. For one query a segment's impact is the most that its rows can gain in
that dimension over the dimension's worst segment. Segments are added to the scores by
falling impact. What is still unread bounds how much any row can rise, so the scan stops
once few rows can reach the k-th best exact score seen; all of those are rescored
exactly. Rows are only ever left out on that proof.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedlift.runtime import pin

LEVELS = 16
#: Times that a scan asks whether it may stop.
CHECKS = 8
#: Rows of a block and queries of a batch, about.
BLOCK_ROWS, BATCH_ROWS = 8192, 512


class Index:
    """Rows of one block, by dimension and quantised value: `levels` segments of equally many rows in each dimension."""

    def __init__(self, rows: np.ndarray, levels: int = LEVELS):
        self.rows = rows
        n = len(rows)
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.cuts = np.unique(np.linspace(0, n, min(levels, n) + 1).astype(np.int64))
        values = np.take_along_axis(rows.T, self.order, axis=1)
        self.least, self.most = values[:, self.cuts[:-1]], values[:, self.cuts[1:] - 1]

    def segments(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
        """(dimension, level) of the segments by falling impact, their impacts, the sum of the dimensions'
        lowest bounds, and how much an unread row can still gain after each segment."""
        up = (query > 0)[:, None]
        bound = query[:, None] * np.where(up, self.most, self.least)
        # By falling impact inside a dimension: from the highest level down for a positive weight, else upwards.
        bound = np.where(up, bound[:, ::-1], bound)
        gain = bound - bound[:, -1:]
        fall = gain.copy()
        fall[:, :-1] -= gain[:, 1:]
        order = np.argsort(-gain, axis=None, kind="stable")
        order = order[:int((gain > 0).sum())]
        dimension, step = np.divmod(order, gain.shape[1])
        level = np.where(query[dimension] > 0, gain.shape[1] - 1 - step, step)
        fall = fall.ravel()[order]
        return dimension, level, gain.ravel()[order], int(bound[:, -1].sum()), int(fall.sum()) - np.cumsum(fall)

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of the k best rows but `own`, ties to the smaller id."""
        n = len(self.rows)
        dimension, level, impact, floor, slack = self.segments(query)
        low, high = self.cuts[level].tolist(), self.cuts[level + 1].tolist()
        dimension, impact = dimension.tolist(), impact.tolist()
        gained = np.zeros(n, np.int64)
        if 0 <= own < n:
            gained[own] = -(1 << 62)
        few, step, done = max(4 * k, n // 64), max(1, -(-len(impact) // CHECKS)), 0
        possible = np.arange(n)
        while True:
            for i in range(done, min(done + step, len(impact))):
                gained[self.order[dimension[i], low[i]:high[i]]] += impact[i]
            done = min(done + step, len(impact))
            rest = int(slack[done - 1]) if done else 0
            if n > k + 1:
                lead = np.argpartition(gained, n - k)[n - k:]
                least = int((self.rows[lead] @ query).min())
                possible = np.flatnonzero(gained + (floor + rest) >= least)
            if len(possible) <= few or done == len(impact):
                break
        possible = possible[possible != own]
        exact = self.rows[possible] @ query
        best = np.lexsort((ids[possible], -exact))[:k]
        return possible[best], exact[best]


def _tile(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        out: list[list] = [[] for _ in names]
        if vectors.num_rows and queries.num_rows:
            width = max(max(len(v) for v in t.column("v").to_pylist()) for t in (vectors, queries))
            rows, asked = (_matrix(t, width) for t in (vectors, queries))
            index, ids, own = Index(rows), vectors.column("id").to_numpy(), vectors.column("row").to_numpy()
            place = {r: i for i, r in enumerate(own.tolist())}
            for q, row, query_id in zip(asked, queries.column("row").to_pylist(), queries.column("id").to_pylist()):
                found, scores = index.search(q, ids, place.get(row, -1), k)
                for column, values in zip(out, ([row] * len(found), [query_id] * len(found), ids[found].tolist(), scores.tolist())):
                    column.extend(values)
        return pa.table({name: pa.array(values, pa.int64()) for name, values in zip(names, out)})
    return run


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """Shorter vectors end in zeros."""
    lists = table.column("v").to_pylist()
    out = np.zeros((len(lists), width), np.int64)
    for i, values in enumerate(lists):
        out[i, :len(values)] = values
    return out


def quantised(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Pinned (row, id, v): floor(scale * x) of every component; rows with a null id, vector or component, or a
    component that is not finite, are left out."""
    value = F.col(vector_col).cast("array<double>")
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return pin(vectors.filter(F.col(id_col).isNotNull() & value.isNotNull()).filter(whole).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
        F.transform(value, lambda x: F.floor(x * scale)).alias("v")), "vectors")


def top_k(vectors: DataFrame, asks: Column, k: int = 10, block_rows: int = BLOCK_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the quantised rows where `asks` (on `id`) holds.

    Candidates are all rows but the query's own; ties go to the smaller id; fewer than
    `k` candidates give fewer rows. A row that repeats another's id is a row of its own.
    Shorter vectors count as ending in zeros. No vectors or no queries give no rows.
    """
    n, asked = vectors.count(), vectors.filter(asks).count()
    blocks, batches = max(1, -(-n // block_rows)), max(1, -(-asked // batch_rows))
    deal = F.xxhash64("row")
    rows = vectors.withColumn("block", F.pmod(deal, F.lit(blocks))).withColumn(
        "batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    queries = vectors.filter(asks).withColumn("batch", F.pmod(deal, F.lit(batches)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    found = rows.groupBy("block", "batch").cogroup(queries.groupBy("block", "batch")).applyInArrow(
        _tile(k), "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
