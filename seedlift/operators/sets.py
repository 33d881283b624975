"""Operations on named lists of entities, kept long as `(set_name, entity_id)`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_sets(named: dict[str, DataFrame], key: str = "entity_id") -> DataFrame:
    """Long table of named lists."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(n).alias("set_name"), F.col(key).alias("entity_id")) for n, df in named.items()])


def shared_by_all(sets: DataFrame, n_sets: int) -> DataFrame:
    """Entities in all of the `n_sets` lists."""
    return sets.groupBy("entity_id").agg(F.count_distinct("set_name").alias("n")).filter(
        F.col("n") == n_sets).select("entity_id")


def in_any(sets: DataFrame) -> DataFrame:
    return sets.select("entity_id").distinct()


def only_in(sets: DataFrame, name: str) -> DataFrame:
    mine, other = F.max((F.col("set_name") == name).cast("int")), F.max((F.col("set_name") != name).cast("int"))
    return sets.groupBy("entity_id").agg(mine.alias("m"), other.alias("o")).filter("m = 1 and o = 0").select("entity_id")


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.distinct().groupBy("set_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "set_name")


def combinations(sets: DataFrame, sep: str = "&") -> DataFrame:
    """Each entity with the exact combination of sets it is in, and how many."""
    tagged = sets.groupBy("entity_id").agg(F.sort_array(F.collect_set("set_name")).alias("_s"))
    return tagged.select("entity_id", F.array_join("_s", sep).alias("combination"), F.size("_s").alias("degree"))


def exclusive_intersections(sets: DataFrame, size: tuple[int, int | None] = (1, None),
                            degree: tuple[int, int | None] = (1, None), sort_by: str = "size") -> DataFrame:
    """Size of every exclusive intersection within the bounds: one pass instead of one per combination."""
    counts = combinations(sets).groupBy("combination", "degree").agg(F.count("*").alias("n"))
    for column, (low, high) in (("n", size), ("degree", degree)):
        counts = counts.filter(F.col(column) >= low)
        if high is not None:
            counts = counts.filter(F.col(column) <= high)
    return counts.orderBy(F.desc("n" if sort_by == "size" else "degree"), "combination")


def intersection_values(sets: DataFrame, values: DataFrame, wanted: Sequence[str], sep: str = "&") -> DataFrame:
    """Entity values tagged with their intersection when wanted, else `others`."""
    tagged = combinations(sets, sep)
    name = F.when(F.col("combination").isin(*wanted), F.col("combination")).otherwise("others")
    return tagged.select("entity_id", name.alias("intersection")).join(values, "entity_id")
