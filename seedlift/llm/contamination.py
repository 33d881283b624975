"""Benchmark decontamination by a positional inverted index, in SQL functions only.

Every test item is cut into windows of `n` words. A first pass counts the corpus
frequency of the test terms, which gives each window its rarest term. A second pass
stores the postings of those terms: text key, position and the words around it. A
window's candidates are the offset-adjusted postings of its rarest term; each is kept
if the words around it hold the whole window at those offsets (phrase), or within a
given distance (proximity). Frequent terms are never posted, shuffled or intersected.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlift.llm.common import checked, unused
from seedlift.runtime import at_most, pin

#: Fixed value: what stands between words once A-Z count as letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A table of test terms up to this long is broadcast; a longer one is cut into slices, one scan each.
TERMS = 50_000


def raw_words(text: Column) -> Column:
    """Words in their own case; null gives none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN, -1), "")


def folded(word: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def test_windows(items: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item_id, terms): each run of `n` words; a shorter item is one window, an empty one none."""
    words = items.select(
        F.col(id_col).alias("item_id"),
        F.transform(raw_words(F.col(text_col)), folded).alias("_words"),
    ).filter(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - n + 1, F.lit(1)))
    return (
        words.withColumn("_at", F.explode(starts))
        .select("item_id", F.slice("_words", F.col("_at"), F.lit(n)).alias("terms"))
        .withColumn("window", F.md5(F.array_join("terms", " ")))
        .select("window", "item_id", "terms").distinct()
    )


def _slices(table: DataFrame, key: str, most: int) -> Iterator[DataFrame]:
    """`table`, or bounded parts of it by hash of `key`, each fit for a broadcast."""
    if at_most(table, most):
        yield F.broadcast(table)
        return
    parts = 2 * table.count() // most + 1
    for i in range(parts):
        yield F.broadcast(table.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text", most: int = TERMS) -> DataFrame:
    """(term, n): occurrences in the corpus of each test term that occurs."""
    found = docs.select(F.explode(raw_words(F.col(text_col))).alias("_raw")).select(folded(F.col("_raw")).alias("term"))
    return _union([found.join(part, "term").groupBy("term").agg(F.count("*").alias("n"))
                   for part in _slices(terms, "term", most)])


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, terms, term, offset): where the window's rarest term stands first in it.

    Windows with a term that the corpus lacks cannot occur and are left out.
    """
    spread = windows.select("window", "terms").distinct().select(
        "window", "terms", F.posexplode("terms").alias("offset", "term"))
    rated = spread.join(counts, "term", "left")
    best = rated.groupBy("window", "terms").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")).alias("_best"))
    return best.filter("_best.n > 0").select("window", "terms", F.col("_best.term").alias("term"),
                                             F.col("_best.offset").alias("offset"))


def postings(docs: DataFrame, terms: DataFrame, reach: int, text_col: str = "text", most: int = TERMS) -> DataFrame:
    """Pinned index (term, key, pos, first, around) of the given terms.

    `key` stands for the text, so equal texts share postings; `around` holds the words
    from position `first` to `pos + reach`.
    """
    found = docs.select(
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"),
        raw_words(F.col(text_col)).alias("_words"),
    ).select("key", "_words", F.posexplode("_words").alias("pos", "_raw")).withColumn("term", folded(F.col("_raw")))
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    return pin(_union([
        found.join(part, "term").select(
            "term", "key", "pos", first.alias("first"),
            F.slice("_words", first + 1, F.col("pos") - first + reach + 1).alias("around"))
        for part in _slices(terms, "term", most)]), "postings")


def matches(index: DataFrame, anchors: DataFrame, slop: int = 0) -> DataFrame:
    """(key, window, start, end): occurrences of each window; positions are word numbers, end exclusive.

    With `slop` 0 the words must follow each other exactly. Otherwise all of the
    window's terms must stand, in any order, at most the window's length less 1 plus
    `slop` words before or after the posting of its rarest term; the match is that stretch.
    """
    rows = index.join(anchors, "term").withColumn("_n", F.size("terms"))
    start = F.col("pos") - F.col("offset")
    around = F.transform("around", folded)
    if slop == 0:
        whole = F.slice(around, F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("_n")) == F.col("terms")
        kept = rows.filter(start >= F.col("first")).filter(whole)
        return kept.select("key", "window", start.alias("start"), (start + F.col("_n")).alias("end")).distinct()
    reach = F.col("_n") - 1 + slop
    low = F.greatest(F.col("pos") - reach, F.col("first"))
    near = F.slice(around, low - F.col("first") + 1, F.col("pos") + reach + 1 - low)
    kept = rows.withColumn("_near", near).filter(F.size(F.array_except("terms", F.col("_near"))) == 0)
    return kept.select("key", "window", low.alias("start"), (low + F.size("_near")).alias("end")).distinct()


def find_windows(docs: DataFrame, items: DataFrame, n: int = 13, slop: int = 0, text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", most: int = TERMS) -> DataFrame:
    """(key, start, end, item_id): all occurrences of test windows, one row for each item that has the window."""
    windows = pin(test_windows(items, n, item_id, item_text), "windows")
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    counts = pin(term_counts(docs, terms, text_col, most), "terms")
    anchors = pin(rarest_terms(windows, counts), "anchors")
    index = postings(docs, anchors.select("term").distinct(), n - 1 + slop, text_col, most)
    return matches(index, anchors, slop).join(windows.select("window", "item_id"), "window").drop("window")


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", most: int = TERMS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any window occurrence is hit. Contaminated: some word is hit, and
    hits are at least a twentieth of the words. Null and empty texts have no words and
    are clean; repeated rows are judged alike; an empty test set finds nothing.
    """
    found = pin(find_windows(docs, items, n, 0, text_col, item_id, item_text, most), "found")
    hit = (
        found.select("key", "start", "end").distinct()
        .select("key", F.explode(F.sequence("start", F.col("end") - 1)).alias("_pos")).distinct()
        .groupBy("key").agg(F.count("*").alias("n_hit"))
    )
    # At most one entry per test item.
    named = found.select("key", F.col("item_id").cast("string").alias("_item")).distinct().groupBy("key").agg(
        F.sort_array(F.collect_list("_item")).alias("_items"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.size(raw_words(F.col(text_col))).cast("bigint").alias("n_words"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"),
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items_of = F.coalesce("_items", F.array().cast("array<string>"))
    return rows.join(hit.join(named, "key"), "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text",
                         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` without the contaminated documents; a text is judged alike wherever it stands."""
    own = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    name = unused(docs, "_key")
    keyed = docs.select(own.alias("key"), F.col(text_col).alias("text"))
    bad = contamination(keyed, items, n, "key", "text", item_id, item_text).filter("contaminated").select(
        F.col("doc_id").alias(name)).distinct()
    return docs.join(checked(pin(bad, "contaminated")), own == F.col(name), "left_anti")
