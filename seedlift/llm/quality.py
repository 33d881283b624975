"""Text quality: an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

Strings of up to `order` bytes are counted in trusted texts. Every order is a pair of
tables spread over the cluster: the probability of each seen string, with all shorter
orders mixed in, and the weight that each seen context leaves to the shorter ones.
Texts are dealt to blocks; the blocks' distinct strings meet the tables in joins, one
order after the other, and the log probabilities go back to be added up. A document's
perplexity is judged by a quantile of the trusted documents of its own language.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlift.llm.blocks import (LIST_SCHEMA, block_count, key_lists, keyed, lister, merged, packed, shard_of, squeezed_array,
                                 swollen_array, unpacked)
from seedlift.llm.common import checked, whole_text
from seedlift.llm.ctw import byte_strings
from seedlift.runtime import pieces, pin

ORDER = 5
#: Documents above this quantile of the trusted ones that the model has not seen are rejected.
QUANTILE = 0.98
#: Rows that the quantile of all languages counts for next to a language's own.
PRIOR = 200


def trusted_rows(labels: DataFrame, most: int | None = None, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Pinned (_id, _seen) of all rows labelled 1 and never 0; null ids and labels are left out.

    `_seen` marks those for the model: three in four by hash of all, or with `most` of that many lowest hashes.
    """
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_q")).filter("_q = 1")
    good = good.select("_id", F.xxhash64("_id").alias("_h"))
    taught = F.pmod("_h", F.lit(4)) != 0
    if most is None:
        return pin(good.select("_id", taught.alias("_seen")), "trusted")
    good = pin(good, "good")
    first = good.orderBy("_h", "_id").limit(most).agg(F.max(F.struct("_h", "_id")).alias("_last"))
    within = F.struct("_h", "_id") <= F.col("_last")
    return pin(good.crossJoin(F.broadcast(first)).select("_id", (within & taught).alias("_seen")), "trusted")


def _flat(table: pa.Table) -> pa.Table:
    keys, counts = merged(table, key_lists(table))
    return pa.table({"key": keys.view(np.int64), "c": counts})


def _keyer(order: int):
    return {0: partial(byte_strings, depth=order - 1, fold=False)}


def string_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, c): strings of `order` bytes, the last one possibly the end, and their counts."""
    blocks = block_count(texts, "text")
    shards = max(pieces(texts.sparkSession), blocks // 2)
    rows = packed(texts.withColumn("_id", F.monotonically_increasing_id()), blocks, "_id", "text", trains=F.lit(True))
    lists = rows.groupBy("block").applyInArrow(lister(_keyer(order), shards), LIST_SCHEMA)
    return lists.groupBy("shard").applyInArrow(_flat, "key bigint, c bigint")


def _tail(key: str, size: int) -> Column:
    """The last `size` bytes of a string."""
    return F.col(key).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of one order, from its counts of counts."""
    n = {r["c"]: r["n"] for r in counts.filter("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = [n.get(i, 0) for i in (1, 2, 3, 4)]
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


def train(texts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (key, p) of the seen strings and (context, left) of the seen contexts, pinned.

    The highest order uses counts, every other the number of distinct bytes seen before
    the string. Order 1 is mixed with the even distribution over 256 bytes.
    """
    counts = [pin(string_counts(texts, order), "counts")]
    for size in range(order - 1, 0, -1):
        counts.append(pin(counts[-1].groupBy(_tail("key", size).alias("key")).agg(F.count("*").alias("c")), "counts"))
    model: list[tuple[DataFrame, DataFrame]] = []
    for size, table in zip(range(1, order + 1), reversed(counts)):
        one, two, more = _discounts(table)
        taken = F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)
        rows = table.withColumn("context", F.shiftright("key", 8))
        contexts = pin(rows.groupBy("context").agg(
            F.sum("c").alias("total"), (F.sum(taken) / F.sum("c")).alias("left")), "contexts")
        seen = rows.join(contexts, "context").withColumn("own", (F.col("c") - taken) / F.col("total"))
        if model:
            shorter = model[-1][0].select(F.col("key").alias("_tail"), F.col("p").alias("_p"))
            seen = seen.withColumn("_tail", _tail("key", size - 1)).join(shorter, "_tail")
            p = F.col("own") + F.col("left") * F.col("_p")
        else:
            p = F.col("own") + F.col("left") / 256
        model.append((pin(seen.select("key", p.alias("p")), "seen"), contexts.select("context", "left")))
    return model


def chances(wanted: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """`wanted` (key, ...) with `p`: each string's probability after its context, backing off order by order."""
    out = wanted.withColumn("_left", F.lit(1.0)).withColumn("p", F.lit(None).cast("double"))
    for size in range(len(model), 0, -1):
        seen, contexts = model[size - 1]
        out = out.withColumn("_k", _tail("key", size)).withColumn("_c", F.shiftright(_tail("key", size), 8))
        out = out.join(checked(seen.select(F.col("key").alias("_k"), F.col("p").alias("_p"))), "_k", "left")
        out = out.withColumn("p", F.coalesce("p", F.col("_left") * F.col("_p"))).drop("_k", "_p")
        out = out.join(checked(contexts.select(F.col("context").alias("_c"), F.col("left").alias("_l"))), "_c", "left")
        out = out.withColumn("_left", F.col("_left") * F.coalesce("_l", F.lit(1.0))).drop("_c", "_l")
    return out.withColumn("p", F.coalesce("p", F.col("_left") / 256)).drop("_left")


def _wanted(shards: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(key_lists(table)))
        return pa.table({"shard": shard_of(keys, shards), "key": keys.view(np.int64)})
    return run


def _answers(lists: pa.Table, found: pa.Table) -> pa.Table:
    keys = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, values = keys[order], np.log10(found.column("p").to_numpy()[order]).astype(np.float32)
    blobs = [squeezed_array(values[np.searchsorted(keys, k)]) for k in key_lists(lists)]
    return pa.table({c: lists.column(c) for c in ("block", "shard", "n")} | {"values": pa.array(blobs, pa.binary())})


def _adder(order: int, shards: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        content = unpacked(texts)
        got = {s: swollen_array(v, n, np.float32) for s, n, v in zip(*[answers.column(c).to_pylist() for c in ("shard", "n", "values")])}
        total = np.zeros(len(content))
        parts = []
        for low, keys, bounds in keyed(content, _keyer(order)[0]):
            own, inverse = np.unique(keys, return_inverse=True)
            parts.append((low, own, inverse.astype(np.int32), bounds))
        distinct = np.unique(np.concatenate([p[1] for p in parts]))
        shard, values = shard_of(distinct, shards), np.zeros(len(distinct))
        for s in np.unique(shard).tolist():
            values[shard == s] = got[s]
        for low, own, inverse, bounds in parts:
            n = len(bounds) - 1
            here = values[np.searchsorted(distinct, own)][inverse]
            total[low:low + n] = np.bincount(np.repeat(np.arange(n), np.diff(bounds)), here, n)
        sizes = np.array([len(t) + 1 for t in content], np.int64)
        return pa.table({"doc_id": texts.column("doc_id"), "lang": texts.column("lang"), "trusted": texts.column("trains"),
                         "n_bytes": sizes, "perplexity": 10 ** (-total / sizes)})
    return run


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], trusted: Column,
                 id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, trusted, n_bytes, perplexity) of every document, per byte, the end counted as one."""
    blocks = block_count(docs, text_col)
    shards = max(1, blocks // 2)
    rows = packed(docs, blocks, id_col, text_col, lang=F.col(lang_col).cast("string"), trains=trusted)
    lists = rows.groupBy("block").applyInArrow(lister(_keyer(len(model)), shards), LIST_SCHEMA)
    found = chances(lists.groupBy("shard").applyInArrow(_wanted(shards), "shard bigint, key bigint"), model)
    answers = lists.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(
        _answers, "block bigint, shard bigint, n bigint, values binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _adder(len(model), shards),
        f"doc_id {dict(docs.dtypes)[id_col]}, lang string, trusted boolean, n_bytes bigint, perplexity double")


def thresholds(scored: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(_lang, _q) of every language with trusted rows, and the quantile of all trusted rows.

    A language's own quantile over its median is drawn to that of all rows over the medians
    of their languages, with the weight of `PRIOR` rows, so that no few rows set it alone.
    """
    rows = scored.filter("trusted").select(F.col("lang").alias("_lang"), F.log("perplexity").alias("_v"))
    middle = rows.groupBy("_lang").agg(F.percentile_approx("_v", 0.5, 10_000).alias("_m"), F.count("*").alias("_n"),
                                       F.percentile_approx("_v", quantile, 10_000).alias("_own"))
    middle = pin(middle, "middle")
    small = checked(middle.withColumnRenamed("_lang", "_l"))
    above = rows.join(small, F.col("_lang").eqNullSafe(F.col("_l"))).agg(
        F.percentile_approx(F.col("_v") - F.col("_m"), quantile, 10_000).alias("q"), F.percentile_approx("_v", quantile, 10_000).alias("all")).first()
    own = (F.col("_n") * (F.col("_own") - F.col("_m")) + F.lit(PRIOR) * F.lit(above["q"]).cast("double")) / (F.col("_n") + F.lit(PRIOR))
    by_lang = middle.select("_lang", F.exp(F.col("_m") + own).alias("_q"))
    return by_lang, None if above["all"] is None else math.exp(above["all"])


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, most: int | None = None, quantile: float = QUANTILE,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, perplexity, threshold, keep.

    The model sees three in four of the trusted rows, or of the first `most` by hash; `threshold` is
    the quantile of all other trusted rows' perplexities in the same language (null is a
    language), for few rows drawn to that of all languages; a language without any takes that of all. Null and empty texts are an end alone.
    Without trusted text every byte has an even chance and everything is kept; repeated
    rows are judged alike.
    """
    trusted = checked(trusted_rows(labels, most, id_col))
    marked = docs.select(id_col, text_col, lang_col).join(trusted, F.col(id_col) == F.col("_id"), "left")
    texts = marked.filter("_seen").select(whole_text(text_col).alias("text"))
    model = train(pin(texts, "texts"), order)
    scored = pin(perplexities(marked, model, F.coalesce(~F.col("_seen"), F.lit(False)), id_col, text_col, lang_col), "scored")
    by_lang, whole = thresholds(scored, quantile)
    threshold = F.coalesce("_q", F.lit(whole).cast("double"))
    return scored.join(checked(by_lang), F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        "doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("keep"))
