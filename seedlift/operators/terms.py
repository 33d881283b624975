"""Choosing rows, columns and seeds by search terms."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlift.functions.text import matches_any, term_pattern
from seedlift.operators.order import shuffled_positions

# Common English words left out of term counts; an own choice.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his",
    "if", "in", "into", "is", "it", "its", "no", "nor", "not", "of", "off", "on", "or", "our", "she", "so", "than",
    "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "too", "very", "was",
    "we", "were", "which", "who", "will", "with", "you", "your",
)


def term_filter(df: DataFrame, column: str, include: Sequence[str], exclude: Sequence[str] = (),
                regex: bool = False) -> DataFrame:
    """Rows matching an include term and no exclude term, ignoring case."""
    exclude = [t for t in exclude if t]
    if exclude:
        df = df.filter(~matches_any(column, exclude, regex))
    return df.filter(matches_any(column, include, regex))


def term_columns(columns: Sequence[str], include: Sequence[str], exclude: Sequence[str] = (),
                 regex: bool = False) -> list[str]:
    """Column names matching an include term and no exclude term, in table order."""
    exclude = [t for t in exclude if t]
    wanted, unwanted = re.compile(term_pattern(include, regex)), re.compile(term_pattern(exclude, regex))
    return [c for c in columns if wanted.search(c) and not (exclude and unwanted.search(c))]


def common_columns(*tables: DataFrame) -> list[str]:
    """Columns every table has, in the first table's order; raises when there are none."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    if not shared:
        raise ValueError("the tables have no column in common")
    return shared


def seeds_from_terms(associations: DataFrame, entity: str, phrase: str, include: Sequence[str],
                     exclude: Sequence[str] = (), regex: bool = False) -> tuple[DataFrame, DataFrame]:
    """Seeds with label 1 and the distinct phrases that chose them."""
    hits = term_filter(associations, phrase, include, exclude, regex)
    seeds = hits.select(F.col(entity).cast("string").alias("entity_id")).distinct()
    return seeds.withColumn("label", F.lit(1)), hits.select(phrase).distinct()


def seeds_from_list(listed: DataFrame) -> DataFrame:
    """Label 1 for every distinct listed entity."""
    return listed.select("entity_id").distinct().withColumn("label", F.lit(1))


def hide_seeds(seeds: DataFrame, fraction: float, salt: str = "hide") -> tuple[DataFrame, DataFrame]:
    """Split seeds at random into (kept, hidden), hiding int(fraction * seeds)."""
    placed = shuffled_positions(seeds, "entity_id", salt, name="_rn", total="_n")
    hidden = F.col("_rn") <= F.floor(F.col("_n") * F.lit(float(fraction)))
    return placed.filter(~hidden).drop("_rn", "_n"), placed.filter(hidden).drop("_rn", "_n")


def random_seeds(entities: DataFrame, label: str = "label", salt: str = "random") -> DataFrame:
    """As many seeds as there are, drawn at random from all entities (a negative control)."""
    count = entities.filter(F.col(label) == 1).count()
    placed = shuffled_positions(entities, "entity_id", salt, name="_rn")
    return placed.withColumn(label, F.when(F.col("_rn") <= count, 1).otherwise(0)).drop("_rn")


def term_counts(df: DataFrame, column: str, stopwords: Sequence[str] = STOPWORDS, more_than: int = 1,
                digits: bool = False) -> DataFrame:
    """Occurrences of each token outside `stopwords`; all-digit tokens only count with `digits`."""
    tokens = df.select(F.explode(F.split(F.lower(column), r"\s+")).alias("token"))
    kept = tokens.filter(~F.col("token").isin("", *stopwords))
    if not digits:
        kept = kept.filter(~F.col("token").rlike("^[0-9]+$"))
    return kept.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > more_than)


def matched_phrases(df: DataFrame, column: str, include: Sequence[str], sep: str = r"\|",
                    regex: bool = False) -> DataFrame:
    """Distinct lower-cased phrases of a delimited column that match an include term."""
    phrases = df.select(F.explode(F.split(F.lower(column), sep, -1)).alias("phrase")).distinct()
    return phrases.filter(matches_any("phrase", include, regex))


def source_profile(df: DataFrame, column: str, include: Sequence[str], exclude: Sequence[str] = (),
                   regex: bool = False) -> DataFrame:
    """Every distinct value of a source with its row count and whether the terms choose it."""
    values = df.groupBy(column).agg(F.count("*").alias("n_rows"))
    chosen = matches_any(column, include, regex)
    if exclude:
        chosen = chosen & ~matches_any(column, exclude, regex)
    return values.select(F.col(column).alias("value"), "n_rows",
                         F.coalesce(chosen, F.lit(False)).cast("int").alias("selected"))
