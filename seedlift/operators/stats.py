"""Tests and areas that judge lists and curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlift.functions.tails import normal_log10, pearson_p
from seedlift.operators.order import value_steps


def mann_whitney(values: DataFrame, lists: Sequence[str], by: str = "list", value: str = "value") -> DataFrame:
    """Mann-Whitney U of every pair of lists: one-sided p, tie and continuity corrected.

    Values are counted per distinct value before pairs are formed, so the rows that
    meet a pair are at most the distinct values of its two lists.
    """
    named = [(a, b) for i, a in enumerate(lists) for b in lists[i + 1:]]
    counted = values.groupBy(by, value).agg(F.count("*").alias("c"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in named])).alias("pr")
    joined = counted.select(by, value, "c", pairs).select(by, value, "c", "pr.*").filter(
        (F.col(by) == F.col("a")) | (F.col(by) == F.col("b")))
    n1 = F.when(F.col(by) == F.col("a"), F.col("c")).otherwise(0)
    n2 = F.when(F.col(by) == F.col("b"), F.col("c")).otherwise(0)
    steps = value_steps(joined, value, {"n1": n1, "n2": n2}, ["a", "b"])
    t = (F.col("n1_here") + F.col("n2_here")).cast("double")
    won = F.col("n1_here") * (F.col("n2") - F.col("n2_here") + F.col("n2_here") / F.lit(2.0))
    sums = steps.groupBy("a", "b").agg(
        F.max("n1_total").alias("n1"), F.max("n2_total").alias("n2"), F.sum(won).alias("u"),
        F.sum(t * t * t - t).alias("ties"))
    n = (F.col("n1") + F.col("n2")).cast("double")
    product = F.col("n1").cast("double") * F.col("n2")
    sd = F.sqrt(product / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    far = F.greatest(F.col("u"), product - F.col("u"))
    z = F.try_divide(far - 0.5 - product / 2, sd)
    log10_p = normal_log10("z")
    return sums.withColumn("z", z).withColumn("log10_p", log10_p).withColumn("p", F.pow(F.lit(10.0), "log10_p")).drop("ties")


def share_above(curves: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    return curves.groupBy(*keys).agg(F.avg((F.col(value) > threshold).cast("double")).alias("share_above"))


def _simpson_weight(step: Column, n: Column) -> Column:
    """Weight of 0-based `step` of n unit-spaced points (averaged end corrections for even n)."""
    odd_step = step % 2 == 1

    def odd_count(i: Column, m: Column) -> Column:
        return (F.when((i < 0) | (i >= m) | (m < 3), 0.0).when((i == 0) | (i == m - 1), 1.0 / 3)
                .when(i % 2 == 1, 4.0 / 3).otherwise(2.0 / 3))

    first = odd_count(step, n - 1) + F.when(step >= n - 2, 0.5).otherwise(0.0)
    last = odd_count(step - 1, n - 1) + F.when(step <= 1, 0.5).otherwise(0.0)
    odd_n = F.when((step == 0) | (step == n - 1), 1.0 / 3).when(odd_step, 4.0 / 3).otherwise(2.0 / 3)
    return F.when(n == 1, 0.0).when(n % 2 == 1, odd_n).otherwise((first + last) / 2)


def simpson_area(curves: DataFrame, keys: Sequence[str], step: str, value: str,
                 above: float | None = None) -> DataFrame:
    """Area under unit-spaced points per key by Simpson's rule; `above` cuts the curve at a base line."""
    keys = list(keys)
    sizes = curves.groupBy(*keys).agg(F.count("*").alias("_n"))
    y = F.col(value) if above is None else F.greatest(F.col(value) - above, F.lit(0.0))
    # One row per curve on the right: adaptive execution broadcasts it.
    return curves.join(sizes, keys).groupBy(*keys).agg(
        F.sum(y * _simpson_weight(F.col(step), F.col("_n"))).alias("area"))


def area_ratios(areas: DataFrame, primary: str, others: Sequence[str], by: str = "list") -> DataFrame:
    """Primary area over each other area, two places; null for an area of 0."""
    wide = areas.agg(*[F.max(F.when(F.col(by) == x, F.round("area", 2))).alias(x) for x in [primary, *others]])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(o).alias("other"), F.round(F.try_divide(F.col(primary), F.nullif(F.col(o), F.lit(0.0))), 2).alias("ratio"))
        for o in others])).alias("r")).select("r.*")


def feature_correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson r and two-sided p of every feature against one column, missing values as 0."""
    y = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        x = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"r{i}"))
    row = df.agg(*aggs)
    out = row.select("n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(columns)])).alias("f"))
    return out.select("f.feature", "f.r", "n").withColumn("p", pearson_p("r", "n")).drop("n").orderBy("p", "feature")


def list_correlation(left: DataFrame, right: DataFrame, value: str = "p") -> DataFrame:
    """r between two lists' values over the left list's entities; pairs without both are skipped."""
    both = left.select("entity_id", F.col(value).alias("x")).join(
        right.select("entity_id", F.col(value).alias("y")), "entity_id", "left").filter("x is not null and y is not null")
    return both.agg(F.count("*").alias("n"), F.try_divide(
        F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) over all rows; the extremes are one scalar row."""
    ends = df.agg(F.struct(*[e for i, c in enumerate(columns) for e in (
        F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))]).alias("e")).scalar()
    place = {c: i for i, c in enumerate(columns)}
    return df.select(*[
        F.try_divide(F.col(c) - ends[f"a{place[c]}"], ends[f"b{place[c]}"] - ends[f"a{place[c]}"]).alias(c)
        if c in place else F.col(c) for c in df.columns])


def importance_summary(importance: DataFrame, keys: Sequence[str] = ("clf", "feature"), value: str = "value",
                       tiebreak: Sequence[str] = ("iter", "block", "fold")) -> DataFrame:
    """Mean and exact median importance per feature over all fits."""
    from seedlift.operators.order import exact_quantiles

    keys = list(keys)
    middle = exact_quantiles(importance, value, [0.5], tiebreak, keys).select(*keys, F.col("quantile").alias("median"))
    return importance.groupBy(*keys).agg(F.avg(value).alias("mean")).join(middle, keys)
