"""The baseline learner: Gaussian naive Bayes for every (iteration, block, fold) at once.

The sums a model needs are those of its block less those of its own fold, so all
models come out of one aggregate and score their held-out rows in one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlift.runtime import at_most, pin

MODEL_KEYS = ["iter", "block", "fold"]
# Seeds are in every block: copied to all executors up to this many values (64 MB of doubles).
SEED_VALUES = 8_000_000
VARIANCE_FLOOR = 1e-6


def with_features(membership: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Membership rows with their features.

    Each unlabelled entity occurs once per iteration; a seed occurs once per block too,
    and blocks are many exactly when seeds are few. Few seeds are therefore broadcast.
    """
    narrow = features.select("entity_id", *columns)
    seeds = membership.filter("label = 1")
    others = membership.filter("label = 0")
    seed_rows = features.filter("label = 1").select("entity_id", *columns)
    if at_most(seed_rows.select("entity_id"), SEED_VALUES // (len(columns) + 4)):
        seed_rows = F.broadcast(seed_rows)
    return others.join(narrow, "entity_id").unionByName(seeds.join(seed_rows, "entity_id"))


def fit_models(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per model: class sizes, means and variances over the other folds of its block.

    Written as SQL text: the terms are many and alike.
    """
    sums = ["CAST(count(*) AS DOUBLE) AS n"]
    for i, c in enumerate(columns):
        sums += [f"sum(CAST(`{c}` AS DOUBLE)) AS s{i}", f"sum(CAST(`{c}` AS DOUBLE) * `{c}`) AS q{i}"]
    per_fold = rows.groupBy(*MODEL_KEYS, "label").agg(*[F.expr(e) for e in sums])
    names = ["n"] + [f"{k}{i}" for i in range(len(columns)) for k in "sq"]
    # One row per fold and class in each window group: k rows.
    rest = per_fold.selectExpr(*MODEL_KEYS, "label", *[
        f"sum({x}) OVER (PARTITION BY iter, block, label) - {x} AS {x}" for x in names])
    wide = rest.groupBy(*MODEL_KEYS).agg(*[
        F.expr(f"max({x}) FILTER (WHERE label = {y}) AS {x}_{y}") for x in names for y in (0, 1)])
    means = [f"s{i}_{y} / nullif(n_{y}, 0D) AS m{i}_{y}" for i in range(len(columns)) for y in (0, 1)]
    variances = [
        f"greatest(q{i}_{y} / nullif(n_{y}, 0D) - m{i}_{y} * m{i}_{y}, 0D) + {VARIANCE_FLOOR} AS v{i}_{y}"
        for i in range(len(columns)) for y in (0, 1)]
    return wide.selectExpr("*", *means).selectExpr(
        *MODEL_KEYS, "n_0", "n_1", *[f"m{i}_{y}" for i in range(len(columns)) for y in (0, 1)], *variances)


def score_rows(rows: DataFrame, columns: Sequence[str], clf: str = "NaiveBayes") -> DataFrame:
    """Out-of-fold `(clf, iter, block, fold, entity_id, label, proba)`; null where a class has no training rows.

    The models (iterations x blocks x folds rows) are written first: with their size
    known, Spark broadcasts them up to its threshold and leaves `rows` unshuffled. Beyond
    it there are so many models that the shuffled join has many small, even groups.
    """
    models = pin(fit_models(rows, columns), "models")
    odds = "ln(nullif(n_1, 0D) / nullif(n_0, 0D))" + "".join(
        f" + (`{c}` - m{i}_0) * (`{c}` - m{i}_0) / (2 * v{i}_0) - (`{c}` - m{i}_1) * (`{c}` - m{i}_1) / (2 * v{i}_1)"
        f" + 0.5D * ln(v{i}_0 / v{i}_1)" for i, c in enumerate(columns))
    scored = rows.join(models, MODEL_KEYS).selectExpr(*MODEL_KEYS, "entity_id", "label", f"{odds} AS odds")
    return scored.selectExpr(
        f"'{clf}' AS clf", *MODEL_KEYS, "entity_id", "label",
        "CASE WHEN odds IS NOT NULL THEN 1D / (1D + exp(-greatest(least(odds, 700D), -700D))) END AS proba")


def naive_bayes_scores(membership: DataFrame, features: DataFrame, columns: Sequence[str],
                       clf: str = "NaiveBayes") -> DataFrame:
    """Scores of every membership row; rows and features are joined once and read twice."""
    return score_rows(pin(with_features(membership, features, columns), "rows"), columns, clf)
