"""One-feature logistic models of named classes against one negative set, all fitted together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlift.operators.joins import SMALL_VALUES
from seedlift.operators.order import shuffled_positions
from seedlift.operators.scores import auc
from seedlift.runtime import at_most, pin

KEYS = ["class", "feature"]


def class_members(classes: DataFrame, negatives: DataFrame) -> DataFrame:
    """`(class, entity_id, label)`: every class's own entities as 1, and the negative set as 0 in each class.

    An entity of both counts as positive in its class.
    """
    mine = classes.select("class", "entity_id").distinct()
    names = mine.select("class").distinct()
    others = negatives.select("entity_id").distinct().join(F.broadcast(names) if at_most(names, 10_000) else names, how="cross")
    both = mine.withColumn("label", F.lit(1)).unionByName(others.withColumn("label", F.lit(0)))
    return both.groupBy("class", "entity_id").agg(F.max("label").alias("label"))


def one_feature_models(members: DataFrame, table: DataFrame, columns: Sequence[str], steps: int = 8, test_size: float = 0.2,
                       salt: str = "split") -> DataFrame:
    """`(class, feature, n_train, intercept, slope, n_test, auc)` of a logistic model of each class by each single feature.

    `members` is (class, entity_id, label), `table` has the features. `test_size` of each class and label, drawn
    by hash, are held out for the AUC. Fitting is `steps` of Newton's method from zero on values scaled by their
    training mean and deviation; a step is one aggregate over all models. Missing values take no part. A
    feature that tells a class apart without error has no finite optimum: its slope is the one reached.
    """
    placed = shuffled_positions(members, "entity_id", salt, ["class", "label"], [], "_rn", "_n")
    parted = placed.select("class", "entity_id", "label", (F.col("_rn") <= F.floor(F.col("_n") * F.lit(float(test_size)))).alias("test"))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns]))
    long = parted.join(table.select("entity_id", values.alias("v")), "entity_id").select(
        "class", "v.feature", "label", "test", "v.x").filter("x IS NOT NULL")
    long = pin(long, "long")
    train = long.filter("NOT test")
    scale = train.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    models = pin(scale.select(*KEYS, "n", "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd"),
                              F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), "models")
    small = at_most(models, SMALL_VALUES // len(models.columns))

    def with_models(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(models) if small else models, KEYS).withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))

    for _ in range(steps):
        odds = F.greatest(F.least(F.col("a") + F.col("b") * F.col("z"), F.lit(700.0)), F.lit(-700.0))
        rows = with_models(train).withColumn("p", 1 / (1 + F.exp(-odds)))
        w, rest = F.col("p") * (1 - F.col("p")), F.col("label") - F.col("p")
        sums = rows.groupBy(*KEYS, "n", "mean", "sd", "a", "b").agg(
            F.sum(rest).alias("g0"), F.sum(rest * F.col("z")).alias("g1"), (F.sum(w) + 1e-9).alias("h0"),
            F.sum(w * F.col("z")).alias("h1"), (F.sum(w * F.col("z") * F.col("z")) + 1e-9).alias("h2"))
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        models = pin(sums.select(
            *KEYS, "n", "mean", "sd", (F.col("a") + (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det).alias("a"),
            (F.col("b") + (F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det).alias("b")), "models")
    scored = with_models(long.filter("test")).withColumn("odds", F.col("a") + F.col("b") * F.col("z"))
    judged = auc(scored, KEYS, "odds").join(scored.groupBy(*KEYS).agg(F.count("*").alias("n_test")), KEYS)
    return models.join(judged.select(*KEYS, "n_test", "auc"), KEYS, "left").select(
        *KEYS, F.col("n").alias("n_train"), (F.col("a") - F.col("b") * F.col("mean") / F.col("sd")).alias("intercept"),
        (F.col("b") / F.col("sd")).alias("slope"), F.coalesce("n_test", F.lit(0)).cast("bigint").alias("n_test"), "auc")
