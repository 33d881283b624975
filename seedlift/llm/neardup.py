"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification.

Equal texts are merged first, whatever their number. Every distinct text gets a
signature of its word shingles; texts that agree in all coordinates of a band share a
bucket. A bucket is joined to a pivot, the member that shares most buckets with others
and so stands nearest to the middle of a group of copies. Pairs with the pivot are
verified on the full shingle sets. While a round finds links, each bucket that still
holds several components gets a further pivot from a component without one. Texts that
no pivot settled are then compared by prefixes: two sets as alike as the threshold share
one of their rarest shingles, near enough to the front of both. That bound is exact, so
no link between members of a bucket is lost, and pairs that only share what many texts
share are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedlift.llm.common import NARROW_ROWS, bounded_batches, checked, components, grown, text_key, unused, whole_text
from seedlift.llm.dartminhash import band_hashes, signatures
from seedlift.llm.words import hashed_shingles, hashed_words, in_slices
from seedlift.runtime import at_most, pin, scratch


def _bands(k: int, rows: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            elements, bounds = hashed_shingles(*hashed_words(batch.column("text")), shingle)
            bands = band_hashes(signatures(elements, bounds, k), rows)
            sizes = np.diff(bounds)
            lists = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands.shape[1], 0))]).astype(np.int32),
                pa.array(bands[sizes > 0].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), lists], names=["doc_id", "key", "bands"])
    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            elements, bounds = hashed_shingles(*hashed_words(batch.column("text")), shingle)
            sets = [np.unique(elements[low:high]).tobytes() for low, high in zip(bounds[:-1], bounds[1:])]
            sizes = pa.array([len(s) // 8 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), sizes, pa.array(sets, pa.binary())], names=["key", "n", "elements"])
    return run


def _linked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= threshold * (len(one) + len(two) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def signed(docs: DataFrame, k: int, rows: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, bands): band hashes of every document; a text without words has none."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), whole_text(text_col).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(_bands(k, rows, shingle), f"doc_id {kind}, key binary, bands array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those (a, b) whose sets have at least the given Jaccard similarity."""
    one = sets.select(F.col("key").alias("a"), F.col("elements").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("elements").alias("y"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(_linked(threshold), "a binary, b binary")


def classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, k: int = 96, rows: int = 4,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, key, class_id, keep.

    A class is what links of Jaccard similarity `threshold` or more over sets of word
    shingles connect, with equal texts merged. `class_id` is the least doc_id in it;
    `keep` marks the rows of that doc_id and text, so exactly one text of each class
    (repeats of that very row all carry it). Texts of fewer words than a shingle are
    one shingle; texts without words are alike only if equal; null counts as empty;
    null ids stay and lose to others as class_id.

    With 24 bands of 4 a pair at 0.8 shares no bucket once in 300,000 times.
    """
    bounded_batches(docs.sparkSession)
    every = pin(signed(docs, k, rows, shingle, id_col, text_col), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id")))
    texts = pin(every.groupBy("key").agg(first.alias("_first"), F.first("bands").alias("bands")), "texts")
    labels = _labels(docs, texts, threshold, shingle, id_col, text_col)
    best = F.min(F.struct("_first", "key"))
    known = texts.select("key", "_first").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    chosen = known.groupBy("label").agg(best.alias("_best"))
    joined = known.join(chosen, "label").select(
        "key", F.col("_best._first.doc_id").alias("class_id"), (F.col("_best.key") == F.col("key")).alias("_main"))
    return every.select("doc_id", "key").join(joined, "key").select(
        "doc_id", "key", "class_id", (F.col("_main") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("keep"))


def _labels(docs: DataFrame, texts: DataFrame, threshold: float, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(key, label) of the texts that are linked to another."""
    with scratch(docs.sparkSession):
        spread = texts.select("key", F.col("_first.doc_id").alias("_id"), F.explode("bands").alias("bucket"))
        shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        members = pin(spread.join(checked(pin(shared, "shared")), "bucket"), "members")
        degrees = members.groupBy("key").agg(F.sum(F.col("size") - 1).alias("degree"), F.first("_id").alias("_id"))
        degrees = checked(pin(degrees, "degrees"))
        members = pin(members.select("bucket", "key").join(degrees.drop("_id"), "key"), "members")

        wanted = degrees.select(F.col("key").alias("_key"), F.col("_id").alias("_doc"))
        rows = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("key"), whole_text(text_col).alias("text"))
        rows = rows.join(wanted, (F.col("key") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_doc")), "left_semi")
        sets = pin(rows.select("key", "text").mapInArrow(_sets(shingle), "key binary, n bigint, elements binary")
                   .dropDuplicates(["key"]), "sets")

        middle = F.max_by("key", F.struct("degree", "key"))
        pivots = pin(members.groupBy("bucket").agg(middle.alias("pivot")), "pivots")
        pairs = members.join(checked(pivots), "bucket").filter(F.col("key") != F.col("pivot"))
        pairs = pairs.select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
        labels = components(pin(_verified(pairs, sets, threshold), "links"))
        while True:
            # Buckets of several components: the next pivot comes from a component that had none in the bucket.
            known = checked(labels.withColumnRenamed("node", "key"))
            marked = members.join(known, "key", "left").withColumn("label", F.coalesce("label", "key"))
            led = pivots.withColumnRenamed("pivot", "key").join(known, "key", "left").select(
                "bucket", F.coalesce("label", "key").alias("label"))
            led = F.broadcast(led) if at_most(pivots, NARROW_ROWS) else led.distinct()
            fresh = pin(marked.join(led, ["bucket", "label"], "left_anti").groupBy("bucket").agg(
                F.max_by(F.struct("key", "label"), F.struct("degree", "key")).alias("_p")), "fresh")
            pairs = marked.join(checked(fresh), "bucket").filter(F.col("label") != F.col("_p.label")).select(
                F.col("_p.key").alias("a"), F.col("key").alias("b")).distinct()
            found = pin(_verified(pairs, sets, threshold), "links")
            pivots = pivots.unionByName(fresh.select("bucket", F.col("_p.key").alias("pivot")))
            if not found.limit(1).count():
                break
            labels = grown(labels, found)

        # Pairs with a pivot are done, so a bucket is once all its other members are of one component.
        led = pivots.select("bucket", F.col("pivot").alias("key"))
        rest = pin(marked.join(checked(led), ["bucket", "key"], "left_anti").select("bucket", "key", "label"), "rest")
        several = rest.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("_several")).filter("_several").select("bucket")
        several = checked(pin(several, "several"))
        unsettled = pin(rest.join(several, "bucket", "left_semi").select("key", "label").distinct(), "unsettled")
        if unsettled.limit(1).count():
            found = pin(_verified(_close_pairs(unsettled, sets, threshold), sets, threshold), "links")
            if found.limit(1).count():
                labels = grown(labels, found)
        return pin(labels.withColumnRenamed("node", "key"), "labels", keep=True)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            elements = np.frombuffer(batch.column("elements")[row].as_buffer(), np.int64)
            at = pa.array(np.full(len(elements), row))
            kept = [batch.column(c).take(at) for c in ("key", "label", "n")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(elements)], names=["key", "label", "n", "element"])


def _close_pairs(texts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different labels among `texts` (key, label), every pair of at least the given similarity included.

    Elements stand in order of how many of these texts hold them. Two sets of n and m elements that are alike share
    at least `threshold / (1 + threshold) * (n + m)`, so the first one they share has as many from it to the end of both.
    """
    rows = sets.join(checked(texts), "key").mapInArrow(_elements, "key binary, label binary, n bigint, element bigint")
    rows = pin(rows, "elements")
    held = rows.groupBy("element").agg(F.count("*").alias("_held"), F.min("label").alias("_l"), F.max("label").alias("_m")).filter("_held > 1")
    held = checked(pin(held, "held"))
    own = Window.partitionBy("key")
    left = F.count("*").over(own) - F.row_number().over(own.orderBy("_held", "element")) + 1  # from here to the end
    placed = rows.join(held, "element").select("*", left.alias("left"))
    # A partner has at least `threshold` as many elements, so both share at least as many of these.
    front = pin(placed.filter((F.col("left") >= F.lit(threshold) * F.col("n") - 1e-6) & (F.col("_l") != F.col("_m"))).select(
        "element", "key", "label", "n", "left"), "front")
    # Of each element's labels one may hold many texts: its own pairs are no candidates and are not formed.
    main = front.groupBy("element", "label").count().groupBy("element").agg(
        F.max_by("label", F.struct("count", "label")).alias("_main"), F.sum("count").alias("_held")).filter("_held > 1")
    one = front.join(main.drop("_held"), "element").filter(F.col("label") != F.col("_main")).drop("_main")
    two = front.withColumnsRenamed({"key": "_key", "label": "_label", "n": "_n", "left": "_left"})
    alike = F.least("left", "_left") >= F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("_n")) - 1e-6
    return one.join(two, "element").filter((F.col("label") != F.col("_label")) & alike).select(
        F.least("key", "_key").alias("a"), F.greatest("key", "_key").alias("b")).distinct()


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5,
                            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each class, all columns kept.

    Rows that repeat the kept id and text are one document; the first of them stays.
    """
    with scratch(docs.sparkSession):
        found = pin(classes(docs, threshold, shingle, id_col=id_col, text_col=text_col), "classes", keep=True)
    k, d = unused(docs, "_key"), unused(docs, "_doc")
    marks = [F.col("key").alias(k), F.col("doc_id").alias(d)]
    out = checked(pin(found.filter(~F.col("keep")).select(*marks).distinct(), "out"))
    again = pin(found.filter("keep").groupBy("key", "doc_id").count().filter("count > 1").select(*marks), "again")
    here = (text_key(text_col) == F.col(k)) & F.col(id_col).eqNullSafe(F.col(d))
    kept = docs.join(out, here, "left_anti")
    if not again.limit(1).count():
        return kept
    repeats = docs.join(checked(again), here, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(checked(again), here, "left_anti").unionByName(repeats)
