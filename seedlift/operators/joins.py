"""Joins on the entity key: merging tables, universes, lookups and labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlift.operators.order import join_alike
from seedlift.runtime import SMALL_VALUES, at_most, pieces


def _list(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def merge_tables(tables: Sequence[DataFrame], on: str = "entity_id", fill: float | None = None) -> DataFrame:
    """Full outer merge of tables with one row per key; optionally fill the gaps.

    Every table is left-joined to the union of the keys, so the growing table keeps its
    partitioning; null is a key like any other.
    """
    if len(tables) == 1:
        return tables[0] if fill is None else tables[0].fillna(fill)
    keys = reduce(DataFrame.unionByName, [t.select(on) for t in tables]).distinct()
    merged = reduce(lambda a, b: join_alike(a, b, [on], "left"), tables, keys)
    return merged if fill is None else merged.fillna(fill)


def left_chain(spine: DataFrame, tables: Sequence[DataFrame], on: str = "entity_id") -> DataFrame:
    """Left join every table onto the spine; all share one key, hence one partitioning."""
    return reduce(lambda a, b: a.join(b, on, "left"), tables, spine)


def reindex(df: DataFrame, universe: DataFrame, on: str = "entity_id", fill: float | None = 0) -> DataFrame:
    """Exactly the universe's keys, gaps filled."""
    out = universe.select(on).join(df, on, "left")
    return out if fill is None else out.fillna(fill)


def merge_onto_universe(tables: Sequence[DataFrame], universe: DataFrame, on: str = "entity_id") -> DataFrame:
    """Full outer merge with the universe; keys outside it stay, every gap becomes 0."""
    return merge_tables([universe.select(on), *tables], on, fill=0)


def label_known(df: DataFrame, seeds: DataFrame, on: str = "entity_id", name: str = "label") -> DataFrame:
    """Attach 1 for seeds and 0 for the rest."""
    marks = seeds.select(on).distinct().withColumn(name, F.lit(1))
    return df.join(marks, on, "left").fillna(0, subset=[name])


def keep_listed(df: DataFrame, listed: DataFrame, on: str | Sequence[str] = "entity_id") -> DataFrame:
    return df.join(listed.select(*_list(on)), _list(on), "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, on: str | Sequence[str] = "entity_id") -> DataFrame:
    return df.join(listed.select(*_list(on)), _list(on), "left_anti")


def merge_reports(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Full outer join of two reports whose keys carry different names; both are kept."""
    return left.join(right, left[left_key] == right[right_key], "full")


def attach(rows: DataFrame, lookup: DataFrame, on: str | Sequence[str],
           small_values: int = SMALL_VALUES) -> DataFrame:
    """Left join onto a lookup with one row per key, whatever the key's skew in `rows`.

    A small lookup (counted, not guessed) is broadcast. Otherwise keys holding more
    than 1/pieces of the rows, of which there are fewer than `pieces`, get their
    lookup rows by broadcast and are salted away from the shuffled join.
    """
    on = _list(on)
    values = [c for c in lookup.columns if c not in on]
    if at_most(lookup, small_values // len(lookup.columns)):
        return rows.join(F.broadcast(lookup), on, "left").select(*rows.columns, *values)
    n = pieces(rows.sparkSession)
    limit = max(1, rows.count() // n)
    hot_keys = rows.groupBy(*on).count().filter(F.col("count") > limit).select(*on)
    hot = hot_keys.join(lookup, on, "left").select(
        *on, F.lit(True).alias("_hot"), F.struct(*values).alias("_hot_row"))
    # A null key matches nothing, so its rows are spread too.
    loose = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on], F.coalesce(F.col("_hot"), F.lit(False)))
    spread = F.when(loose, 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(n))).otherwise(F.lit(0))
    marked = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", spread.cast("bigint"))
    cold = lookup.select(*on, F.struct(*values).alias("_cold_row")).withColumn("_salt", F.lit(0).cast("bigint"))
    joined = marked.join(cold, [*on, "_salt"], "left")
    return joined.select(
        *rows.columns,
        *[F.when(F.col("_hot"), F.col(f"_hot_row.{v}")).otherwise(F.col(f"_cold_row.{v}")).alias(v) for v in values])


def lookup_list(df: DataFrame, row_id: str, ids: str, lookup: DataFrame, key: str, name: str,
                sep: str = " ", joiner: str = "|", out: str = "names") -> DataFrame:
    """Replace a delimited id list by the looked-up names, joined in lookup-key order.

    Ids without a name are skipped; rows without any keep a null. Repeats go within a row before
    anything is joined; what is left of them meets when the names are collected, so that is the only shuffle of ids.
    """
    pairs = df.select(row_id, F.explode(F.array_distinct(F.split(ids, sep, -1))).alias(key))
    named = attach(pairs, lookup.select(key, name), key).filter(F.col(name).isNotNull())
    # One group is one row's own id list, which already fitted in that row.
    joined = named.groupBy(row_id).agg(F.sort_array(F.collect_set(F.struct(key, name))).alias("_l"))
    joined = joined.select(row_id, F.concat_ws(joiner, F.col(f"_l.{name}")).alias(out))
    return df.join(joined, row_id, "left")


def map_ids(df: DataFrame, mapping: DataFrame, supplement: DataFrame, on: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """Map ids (one target each) with a manual supplement added; returns (mapped, unmapped keys).

    Where both name an id the supplement wins, and of several targets the least.
    """
    targets = [c for c in mapping.columns if c != on]
    ordered = [mapping.withColumn("_later", F.lit(1)), supplement.withColumn("_later", F.lit(0))]
    best = reduce(DataFrame.unionByName, ordered).groupBy(on).agg(F.min(F.struct("_later", *targets)).alias("_t"))
    whole = best.select(on, *[F.col(f"_t.{c}").alias(c) for c in targets], F.lit(1).alias("_found"))
    mapped = attach(df, whole, on).filter("_found = 1").drop("_found")
    return mapped, df.select(on).distinct().join(whole.select(on), on, "left_anti")


def require_unique(df: DataFrame, key: str = "entity_id") -> DataFrame:
    """Return `df` unchanged, or raise if a key occurs twice."""
    repeated = df.groupBy(key).count().filter("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"duplicate {key}: {[r[0] for r in repeated]}")
    return df
