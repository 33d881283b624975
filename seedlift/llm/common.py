"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlift.runtime import at_most, pin, scratch

#: A table of up to this many narrow rows may be copied to every executor.
NARROW_ROWS = 300_000


#: Bytes of an Arrow batch. Rows here are whole texts, so Spark's bound by rows alone would let batches grow.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python in batches of at most `BATCH_BYTES` (a longer text is a batch of its own)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def give_back() -> None:
    """Return free memory of this process to the system.

    Python workers live on from task to task, and what they have freed in pieces stays with them otherwise.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def whole_text(text: str | Column) -> Column:
    """The text, empty for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def text_key(text: str | Column) -> Column:
    """16 bytes that stand for a text; equal texts, and only those, share them."""
    return F.unhex(F.md5(whole_text(text)))


def unused(table: DataFrame, name: str) -> str:
    """`name`, lengthened until `table` has no column of that name."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checked(small: DataFrame, most: int = NARROW_ROWS) -> DataFrame:
    """`small`, marked for broadcast if counting proves it has at most `most` rows; else left to a shuffled join."""
    return F.broadcast(small) if at_most(small, most) else small


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every linked node: the least node of its connected component. `links` are read again and again.

    Each round a node takes the least label among itself, its neighbours and its
    label's own label, so labels jump and the rounds grow with the logarithm of a
    chain's length. Every round is written, so a lost executor costs one round. Labels
    of few edges are copied to every executor, so that a round is one shuffle.
    """
    with scratch(links.sparkSession):
        edges = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(
            links.select(F.col(b).alias("node"), F.col(a).alias("other")))
        few = at_most(edges, NARROW_ROWS)

        def named(labels: DataFrame, node: str, label: str) -> DataFrame:
            table = labels.select(F.col("node").alias(node), F.col("label").alias(label))
            return F.broadcast(table) if few else table

        after = pin(edges.groupBy("node").agg(F.min("other").alias("_o")).select(
            "node", F.least("node", "_o").alias("label"), F.lit(True).alias("_moved")), "labels", keep=True)
        while True:
            labels = after.select("node", "label")
            if few:  # labels are final once no edge has two
                open_ = edges.join(named(labels, "node", "_l"), "node").join(named(labels, "other", "_m"), "other").filter("_l != _m")
            else:
                open_ = after.filter("_moved")
            if not open_.limit(1).count():
                return labels
            own = F.lit(None).cast(dict(labels.dtypes)["label"]).alias("_own")
            near = edges.join(named(labels, "other", "_l"), "other").select("node", "_l", own)
            jump = labels.join(named(labels, "label", "_l"), "label").select("node", "_l", own)
            same = labels.select("node", F.col("label").alias("_l"), F.col("label").alias("_own"))
            after = pin(near.union(jump).union(same).groupBy("node").agg(F.min("_l").alias("label"), F.min("_own").alias("_own")).select(
                "node", "label", (F.col("label") < F.col("_own")).alias("_moved")), "labels", keep=True)


def grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` of `components` after further `links` (a, b): only what these links join is labelled anew."""
    with scratch(labels.sparkSession):
        known = checked(labels)
        for end in ("a", "b"):
            links = links.join(known.select(F.col("node").alias(end), F.col("label").alias("_l")), end, "left").withColumn(
                end, F.coalesce("_l", end)).drop("_l")
        merged = components(pin(links.filter("a != b"), "joined"))
        fresh = merged.select("node", F.col("node").alias("label")).join(known.select("node"), "node", "left_anti")
        now = checked(merged.select(F.col("node").alias("label"), F.col("label").alias("_l")))
        return pin(labels.unionByName(fresh).join(now, "label", "left").select("node", F.coalesce("_l", "label").alias("label")), "labels", keep=True)
