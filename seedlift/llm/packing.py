"""Token ids packed into rows of fixed length by best-fit decreasing.

A document's ids are cut into full rows and one remainder; nothing is dropped. The
remainders are packed best-fit decreasing, longest first, each into the row with the
least free space that holds it. Equal lengths and equal rows behave alike, so the plan
is made on the histogram of lengths: a segment tree over free space finds the tightest
row, and one step places a whole run of equal pieces. The plan's size depends on the row
length alone. Pieces are numbered within their length, look up their row in the plan,
and meet there in one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlift.operators.order import number_rows, running
from seedlift.runtime import pin

#: Ids in a row.
LENGTH = 4096


class Capacities:
    """Which amounts of free space occur: a segment tree that finds the least one that is large enough."""

    def __init__(self, most: int):
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.tree = np.zeros(2 * self.size, bool)

    def set(self, space: int, there: bool) -> None:
        at = space + self.size
        self.tree[at] = there
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def tightest(self, needed: int) -> int | None:
        """The least space of at least `needed`, or None."""
        at = needed + self.size
        if self.tree[at]:
            return needed
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], length: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over {piece length: count}: the steps, and the number of rows used.

    A step (piece, first, count, per_row, row, offset) places the pieces of one length
    numbered `first` to `first + count - 1`, `per_row` to a row, from `row` on, each row's
    first at `offset`.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # space -> runs of rows (first, count)
    found, steps, rows = Capacities(length), [], 0

    def give(space: int, first: int, count: int) -> None:
        if count and space:
            free.setdefault(space, []).append((first, count))
            found.set(space, True)

    for piece in sorted(histogram, reverse=True):
        first, left = 0, histogram[piece]
        while left:
            space = found.tightest(piece)
            if space is None:
                space, run = length, (rows, -(-left // (length // piece)))
                rows += run[1]
            else:
                run = free[space].pop()
                if not free[space]:
                    found.set(space, False)
            per = space // piece
            whole = min(run[1], left // per)
            if whole:
                steps.append((piece, first, whole * per, per, run[0], length - space))
                give(space - per * piece, run[0], whole)
                first, left = first + whole * per, left - whole * per
            rest = run[1] - whole
            if rest and left and left < per:
                steps.append((piece, first, left, left, run[0] + whole, length - space))
                give(space - left * piece, run[0] + whole, 1)
                left, whole, rest = 0, whole + 1, rest - 1
            give(space, run[0] + whole, rest)
    return steps, rows


def _placer(steps: np.ndarray):
    key = steps[:, 0] * (1 << 40) + steps[:, 1]
    order = np.argsort(key)
    key, steps = key[order], steps[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, number = batch.column("piece").to_numpy().astype(np.int64), batch.column("number").to_numpy()
            step = steps[np.searchsorted(key, piece * (1 << 40) + number, side="right") - 1]
            place = number - step[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("n"), pa.array(step[:, 4] + place // step[:, 3]),
                 pa.array((step[:, 5] + place % step[:, 3] * piece).astype(np.int32))],
                names=["doc", "n", "row", "offset"])
    return run


def as_bytes(docs: DataFrame, ids_col: str, wide: int = 4) -> DataFrame:
    """`docs` with an array of ids as little-endian binary of `wide` bytes for each; null stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [None if ids is None else np.asarray(ids, f"<u{wide}").tobytes() for ids in batch.column(ids_col).to_pylist()]
            at = batch.schema.names.index(ids_col)
            yield batch.set_column(at, pa.field(ids_col, pa.binary()), pa.array(blobs, pa.binary()))
    return docs.mapInArrow(run, ", ".join(f"`{c}` {'binary' if c == ids_col else kind}" for c, kind in docs.dtypes))


def pack(docs: DataFrame, length: int = LENGTH, wide: int = 1, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per packed row: pack_id, ids, n_ids, cu_seqlens, resets, doc_ids, starts.

    `ids` is the matrix row of `length` ids of `wide` bytes, zeros after the first
    `n_ids`. `cu_seqlens` are the cumulative lengths of its segments from 0, `resets` the
    places where positions start again, `doc_ids` the segments' documents and `starts`
    where in its document each segment begins. Documents without ids, or null, are in no
    row; rows that repeat an id and ids are packed each; ids may be null. No documents
    give no rows.
    """
    sized = docs.select(
        F.struct(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(ids_col, F.lit(b"")))).alias("key")).alias("doc"),
        F.floor(F.octet_length(F.coalesce(ids_col, F.lit(b""))) / wide).alias("n")).filter("n > 0")
    sized = pin(sized, "sized")
    tails = sized.withColumn("piece", F.col("n") % length)
    histogram = {r["piece"]: r["c"] for r in tails.filter("piece > 0").groupBy("piece").agg(F.count("*").alias("c")).collect()}
    steps, used = plan(histogram, length)  # at most `length` entries, whatever the data
    parts = []
    if steps:
        numbered = number_rows(tails.filter("piece > 0"), ["doc"], "number", keys=["piece"])
        placed = numbered.select("doc", "n", "piece", (F.col("number") - 1).alias("number")).mapInArrow(
            _placer(np.array(steps, np.int64)), "doc struct<id:" + dict(docs.dtypes)[id_col] + ",key:binary>, n bigint, row bigint, offset int")
        parts.append(placed.select("doc", "row", "offset", (F.col("n") - F.col("n") % length).alias("start"),
                                   (F.col("n") % length).alias("size")))
    full = running(tails.filter(F.col("n") >= length), ["doc"], {"upto": F.floor(F.col("n") / length)})
    count = F.floor(F.col("n") / length)
    parts.append(full.select("doc", (F.lit(used) + F.col("upto") - count).alias("_row"), F.posexplode(
        F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("_i", "_j")).select(
        "doc", (F.col("_row") + F.col("_j")).alias("row"), F.lit(0).alias("offset"), (F.col("_j") * length).alias("start"),
        F.lit(length).cast("bigint").alias("size")))
    segments = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # The segments of one document are as many as its ids make them; repeats of a document share the list.
    lists = segments.groupBy("doc").agg(F.collect_list(F.struct("row", "offset", "start", "size")).alias("_segments"))
    key = F.unhex(F.md5(F.col("ids")))
    content = docs.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).filter(F.octet_length("ids") >= wide)
    if sized.groupBy("doc").count().filter("count > 1").limit(1).count():
        content = content.dropDuplicates(["id", "ids"])
    lists = lists.select(F.col("doc.id").alias("_id"), F.col("doc.key").alias("_key"), "_segments")
    cut = content.join(lists, F.col("id").eqNullSafe(F.col("_id")) & (key == F.col("_key"))).select(
        "id", "ids", F.explode("_segments").alias("s")).select(
        F.col("s.row").alias("row"), F.struct(
            F.col("s.offset").alias("offset"), F.col("id").alias("id"), F.col("s.start").alias("start"), F.col("s.size").alias("size"),
            F.expr(f"substring(ids, cast(s.start * {wide} + 1 AS int), cast(s.size * {wide} AS int))").alias("part")).alias("s"))
    # A row's segments hold at most `length` ids together.
    rows = cut.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("s"))
    whole = F.aggregate("s", F.lit(b""), lambda have, s: F.concat(have, s["part"]))
    ends = F.transform("s", lambda s: (s["offset"] + s["size"]).cast("int"))
    return rows.select(
        F.col("row").alias("pack_id"), F.rpad(whole, length * wide, F.lit(b"\0")).alias("ids"),
        F.element_at(ends, -1).cast("bigint").alias("n_ids"),
        F.concat(F.array(F.lit(0)), ends).alias("cu_seqlens"), F.col("s.offset").alias("resets"),
        F.col("s.id").alias("doc_ids"), F.col("s.start").alias("starts"))


def write_matrix(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet in the order of `pack_id`, one binary matrix row each."""
    packed.repartitionByRange("pack_id").sortWithinPartitions("pack_id").write.mode("error").parquet(path)
