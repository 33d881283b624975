"""Texts dealt to blocks of a few megabytes, compressed while they are shuffled.

A block lists its distinct keys (words, byte strings, n-grams), the lists meet in
shards by key, and the shards' answers go back to the blocks. The texts themselves are
shuffled once: both readers of `packed` need it grouped by block, so Spark reuses the
exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlift.llm.common import bounded_batches, text_key, whole_text
from seedlift.llm.words import in_slices, mix, text_bytes
from seedlift.runtime import pieces

#: Bytes of input, as Spark estimates it, for each block.
BLOCK_BYTES = 8 << 20


def block_count(docs: DataFrame, text_col: str, size: int = BLOCK_BYTES) -> int:
    """Blocks for these texts, at least one for each shuffle partition.

    The size is that of the tables they are read from: Spark's own estimate multiplies
    the sides of a join. Where a source has no size, the texts are measured.
    """
    leaves = docs.select(text_col)._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    if total >= 1 << 60:
        total = docs.agg(F.sum(F.octet_length(whole_text(text_col)))).first()[0] or 0
    return max(pieces(docs.sparkSession), total // size)


def _compress(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            sizes = pc.binary_length(batch.column("text")).cast(pa.int64())
            blobs = [squeeze(t.as_buffer()) if n else b"" for t, n in zip(batch.column("text"), sizes.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], sizes, pa.array(blobs, pa.binary())], names=[*kept, "size", "blob"])
    return run


def packed(docs: DataFrame, blocks: int, id_col: str, text_col: str, **extra: Column) -> DataFrame:
    """(block, doc_id, extra..., size, blob): texts, null as empty, dealt by id and text together.

    So neither a frequent text nor a frequent id fills a block.
    """
    bounded_batches(docs.sparkSession)
    block = F.pmod(F.xxhash64(F.col(id_col), text_key(text_col)), F.lit(blocks)).cast("bigint")
    rows = docs.select(block.alias("block"), F.col(id_col).alias("doc_id"),
                       *[c.alias(name) for name, c in extra.items()], whole_text(text_col).alias("text"))
    kinds = [f"{name} {kind}" for name, kind in rows.dtypes if name != "text"]
    return rows.mapInArrow(_compress(rows.columns[:-1]), ", ".join(kinds) + ", size bigint, blob binary")


def unpacked(table: pa.Table) -> list[bytes]:
    return [swell(b, size) if size else b"" for b, size in zip(table.column("blob").to_pylist(), table.column("size").to_pylist())]


def squeeze(data: bytes | pa.Buffer) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def swell(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True)


def squeezed_array(values: np.ndarray) -> bytes:
    """An array's bytes, the first of every number, then the second and so on, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return squeeze(planes.tobytes()) if len(values) else b""


def swollen_array(data: bytes, size: int, kind: type) -> np.ndarray:
    """The array of `size` numbers that `squeezed_array` made the bytes from."""
    if not size:
        return np.zeros(0, kind)
    wide = np.dtype(kind).itemsize
    planes = np.frombuffer(swell(data, size * wide), np.uint8).reshape(wide, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


#: Reads (bytes, bounds of texts) and returns (64-bit keys, bounds of texts).
Keyer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
LIST_SCHEMA = "block bigint, shard bigint, kind int, n bigint, keys binary, counts binary"


def text_runs(texts: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    low, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield low, i
            low, total = i, 0
        total += len(text)
    if low < len(texts):
        yield low, len(texts)


def keyed(texts: list[bytes], keyer: Keyer) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, keys, bounds) for runs of texts, so that few positions are in memory at once."""
    for low, high in text_runs(texts):
        yield low, *keyer(*text_bytes(pa.array(texts[low:high], pa.large_binary()).cast(pa.large_string())))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys) % np.uint64(shards)).astype(np.int64)


def lister(keyers: dict[int, Keyer], shards: int):
    """A block's distinct keys of every kind, by shard, with their counts in the texts that train."""
    def run(table: pa.Table) -> pa.Table:
        texts, trains = unpacked(table), table.column("trains").to_numpy()
        rows = []
        for kind, keyer in keyers.items():
            parts = []
            for low, keys, bounds in keyed(texts, keyer):
                own, inverse = np.unique(keys, return_inverse=True)
                learnt = np.repeat(trains[low:low + len(bounds) - 1], np.diff(bounds))
                parts.append((own, np.bincount(inverse, learnt, len(own))))
            if not parts:
                continue
            distinct, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(distinct)).astype(np.uint32)
            shard = shard_of(distinct, shards)
            for s in np.unique(shard).tolist():
                mine = shard == s
                rows.append((s, kind, int(mine.sum()), squeezed_array(distinct[mine]), squeezed_array(counts[mine])))
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int64()),
            **{name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(
                (("shard", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())))}})
    return run


def key_lists(table: pa.Table) -> list[np.ndarray]:
    return [swollen_array(k, n, np.uint64) for k, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist())]


def merged(table: pa.Table, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys of the blocks' lists, and their summed counts."""
    counts = [swollen_array(c, n, np.uint32) for c, n in zip(table.column("counts").to_pylist(), table.column("n").to_pylist())]
    distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    return distinct, np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)
