"""Embedding vectors as exact integers, and one round of moving the entries that they are nearest to."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlift.runtime import pin

#: Reads (rows, parts, width) and returns each part's entry and its squared distance, both (rows, parts).
Assign = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def largest(width: int) -> int:
    """How large components may be, so that four times a squared distance of two vectors still fits 64 bits."""
    return int(math.sqrt(2.0 ** 61 / width) / 2)


def _wholes(scale: int, width: int, others: list[str]):
    most = largest(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            fits = pc.fill_null(pc.equal(pc.list_value_length(lists), width), False)
            batch = batch.filter(fits)
            flat = pc.list_flatten(batch.column("v"))
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # null becomes nan
            finite = np.isfinite(values).all(axis=1)
            whole = np.floor(values[finite] * scale)
            if len(whole) and np.abs(whole).max() > most:
                raise ValueError(f"a component beyond {most} after scaling: squared distances would not fit 64 bits")
            batch = batch.filter(pa.array(finite))
            offsets = np.arange(0, (len(whole) + 1) * width, width, dtype=np.int32)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], rows], names=[*others, "v"])
    return run


def common_width(vectors: DataFrame, vector_col: str, multiple: int = 1) -> int:
    """The commonest length that is a positive multiple of `multiple`, of two as common the longer; 0 if there is none."""
    size = F.size(vector_col)
    found = vectors.filter((size > 0) & (size % multiple == 0)).groupBy(size.alias("size")).count().orderBy(
        F.desc("count"), F.desc("size")).limit(1).collect()
    return found[0]["size"] if found else 0


def whole_vectors(vectors: DataFrame, scale: int, width: int, vector_col: str, **others: Column) -> DataFrame:
    """Pinned (others..., v array<int>): floor(scale * x) of every component of the vectors of `width` components.

    Null vectors and those with a null or non-finite component or another length are left out. A component
    beyond `largest(width)` after scaling raises, since its distances could not be told exactly.
    """
    rows = vectors.select(*[c.alias(name) for name, c in others.items()], F.col(vector_col).cast("array<double>").alias("v"))
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes[:-1])
    return pin(rows.mapInArrow(_wholes(scale, max(width, 1), list(others)), f"{kinds}, v array<int>"), "vectors")


def matrix(column: pa.Array, parts: int = 1) -> np.ndarray:
    """(rows, parts, width) of a column of equally long integer lists."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _totals(assign: Assign, parts: int, entries: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            rows = matrix(batch.column("v"), parts)
            slot = (assign(rows)[0] + np.arange(parts) * entries).ravel()
            counts += np.bincount(slot, minlength=len(counts))
            flat = rows.reshape(-1, width)
            for i in range(width):  # a batch's sums stay far below 2**53
                sums[:, i] += np.bincount(slot, flat[:, i], len(counts)).astype(np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), *[pa.array(sums[used, i]) for i in range(width)]],
            names=["slot", "n", *[f"s{i}" for i in range(width)]])
    return run


def moved(rows: DataFrame, assign: Assign, books: np.ndarray) -> np.ndarray:
    """`books` (parts, entries, width) after one round: each entry is the floor of the mean of its parts, if it has any.

    A task adds up its own rows, so only one row for each task and entry is shuffled and one for each entry
    reaches the driver.
    """
    parts, entries, width = books.shape
    if not entries:
        return books
    names = [f"s{i}" for i in range(width)]
    found = rows.select("v").mapInArrow(
        _totals(assign, parts, entries, width), ", ".join(f"{c} bigint" for c in ["slot", "n", *names]))
    after = books.copy().reshape(-1, width)
    for r in found.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).collect():
        after[r["slot"]] = [r[c] // r["n"] for c in names]
    return after.reshape(books.shape)
