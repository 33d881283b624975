"""Contiguous shards of near-equal bytes, by global prefix sums.

Documents are laid out once in doc_id order (narrow rows, no texts). Each range's
byte total and row count give the range's base; inside a range a window adds the
running sum. A row goes to the shard in which the middle of its bytes falls, so no
shard misses its target by more than one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedlift.operators.order import AT, RANGE, lay_out


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): bytes of the text plus 1; a null text has no bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): balanced contiguous shards, slots gapless from 0.

    Order: doc_id (null first), then checksum and size; rows equal in all three are
    interchangeable. Empty input gives no rows; with fewer rows than shards some
    shards stay empty. Other columns of `docs`, whatever their names, play no part.
    """
    rows = sized(docs, id_col, text_col).withColumn("_tie", F.monotonically_increasing_id())
    # The last key only lets a doc_id that fills a third of the table span ranges.
    laid = lay_out(rows, ["doc_id", "text_crc32", "size", "_tie"]).drop("_tie")
    totals = laid.groupBy(RANGE).agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(  # one row per range
        RANGE,
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_base"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    before = Window.partitionBy(RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        laid.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(F.broadcast(bases), RANGE)
        .withColumn("_place", F.col("_first") + F.col(AT))
        .withColumn("_middle", (2 * (F.col("_base") + F.col("_before")) + F.col("size")).cast("decimal(38,0)"))
        .withColumn("shard", F.floor(F.col("_middle") * shards / (2 * F.col("_total"))).cast("int"))
    )
    starts = placed.groupBy("shard").agg(F.min("_place").alias("_start"))  # one row per shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_start")).alias("slot"))
