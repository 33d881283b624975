"""From out-of-fold scores to votes, rankings, summaries and consensus."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedlift.functions.numbers import share
from seedlift.operators.order import (
    exact_quantiles, join_alike, number_rows, percentile_ranks, value_steps)
from seedlift.runtime import SMALL_VALUES, at_most, pin

FOLD_KEYS = ["clf", "iter", "block", "fold"]


def predicted(proba: str = "proba") -> Column:
    """A tie of both classes counts as positive."""
    return F.col(proba) >= 1 - F.col(proba)


def votes(scores: DataFrame, keys: Sequence[str] = ("clf", "entity_id")) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count_if(predicted()).alias("positive_votes"), F.count_if(~predicted()).alias("negative_votes"),
        F.max("label").alias("label"))


def positive_ratio(voted: DataFrame) -> DataFrame:
    positive, negative = F.col("positive_votes"), F.col("negative_votes")
    return voted.withColumn("positive_ratio", share(positive, positive + negative))


def predicted_entities(voted: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Entities at or above the ratio, marked known or novel."""
    kept = positive_ratio(voted).filter(F.col("positive_ratio") >= threshold)
    return kept.withColumn("kind", F.when(F.col("label") == 1, "known").otherwise("novel"))


def attach_labels(voted: DataFrame, seeds: DataFrame) -> DataFrame:
    """Full outer label join: seeds without votes stay, with null counts."""
    return voted.drop("label").join(seeds.select("entity_id", "label"), "entity_id", "full")


def above_mean(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return mean_scores(scores).filter(F.col("mean_score") > threshold)


def confusion(scores: DataFrame, keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    """TP, FP, TN, FN, accuracy per fold."""
    positive, label = predicted(), F.col("label") == 1
    return scores.groupBy(*keys).agg(
        F.count_if(positive & label).alias("tp"), F.count_if(positive & ~label).alias("fp"),
        F.count_if(~positive & ~label).alias("tn"), F.count_if(~positive & label).alias("fn"),
        F.avg((positive == label).cast("double")).alias("accuracy"))


def mean_scores(scores: DataFrame, keys: Sequence[str] = ("clf", "entity_id")) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("proba").alias("mean_score"), F.max("label").alias("label"))


def median_scores(scores: DataFrame, keys: Sequence[str] = ("clf", "entity_id")) -> DataFrame:
    """Exact medians; a key has at most one score for each fit."""
    return scores.groupBy(*keys).agg(F.median("proba").alias("median_score"))


def rankings(means: DataFrame, decimals: int | None = None) -> DataFrame:
    """Adds `percentile` within each classifier (ties share their mean rank)."""
    if decimals is not None:
        means = means.withColumn("mean_score", F.round("mean_score", decimals))
    return percentile_ranks(means, "mean_score", ["clf"])


def ranked_predictions(scores: DataFrame, decimals: int | None = None) -> DataFrame:
    """Mean score, percentile, votes and label of every entity, from one pass over the scores."""
    keys = ["clf", "entity_id"]
    both = scores.groupBy(*keys).agg(
        F.avg("proba").alias("mean_score"), F.count_if(predicted()).alias("positive_votes"),
        F.count_if(~predicted()).alias("negative_votes"), F.max("label").alias("label"))
    return rankings(both, decimals)


def rankings_by_kind(means: DataFrame) -> DataFrame:
    """`position` (highest mean first, ties by entity, null scores last) among all, known and unlabelled entities, as rows `kind`."""
    kinds = F.explode(F.array(F.lit("all"), F.when(F.col("label") == 1, "known").otherwise("unlabelled"))).alias("kind")
    rows = means.select("clf", kinds, "entity_id", "mean_score", "label")
    return number_rows(rows, [F.desc_nulls_last("mean_score"), F.col("entity_id")], "position", ["clf", "kind"])


# ---- quality of scores ---------------------------------------------------------

def roc_steps(scores: DataFrame, keys: Sequence[str] = FOLD_KEYS, score: str = "proba") -> DataFrame:
    """One ROC point per distinct score (highest first), with the counts behind it."""
    hits = {"tp": (F.col("label") == 1).cast("bigint"), "fp": (F.col("label") == 0).cast("bigint")}
    steps = value_steps(scores.filter(F.col(score).isNotNull()), score, hits, keys, descending=True)
    return steps.withColumn("tpr", share(F.col("tp"), F.col("tp_total"))).withColumn(
        "fpr", share(F.col("fp"), F.col("fp_total")))


def auc(scores: DataFrame, keys: Sequence[str] = FOLD_KEYS, score: str = "proba") -> DataFrame:
    """Rank-based AUC per key; ties count half. Null with a class missing."""
    steps = roc_steps(scores, keys, score)
    # A positive beats every negative ranked below it and half of those tied with it.
    won = F.col("tp_here").cast("double") * (F.col("fp_total") - F.col("fp") + F.col("fp_here") / F.lit(2.0))
    pairs = F.max("tp_total").cast("double") * F.max("fp_total")
    return steps.groupBy(*keys).agg(
        F.try_divide(F.sum(won), pairs).alias("auc"),
        F.max("tp_total").alias("n_positive"), F.max("fp_total").alias("n_negative"))


def auc_summary(aucs: DataFrame) -> DataFrame:
    """Mean and exact median AUC per classifier, best mean first; `top` marks the best median."""
    means = aucs.groupBy("clf").agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("n"))
    middle = exact_quantiles(aucs, "auc", [0.5], ["iter", "block", "fold"], ["clf"]).select(
        "clf", F.col("quantile").alias("median_auc"))
    both = means.join(middle, "clf")  # one row per classifier
    first = F.row_number().over(Window.orderBy(F.desc("median_auc"), "clf"))
    return both.withColumn("top", (first == 1).cast("int")).orderBy(F.desc("mean_auc"), "clf")


def mean_roc(scores: DataFrame, points: int = 100, keys: Sequence[str] = FOLD_KEYS,
             by: Sequence[str] = ("clf",)) -> DataFrame:
    """Mean and deviation of TPR on an even FPR grid, each fold interpolated linearly.

    Steps are merged per grid cell first, so the work is steps + folds x points.
    """
    keys, by = list(keys), list(by)
    # Vertical runs keep both ends: lines arrive at the lower one and leave from the upper.
    steps = roc_steps(scores, keys).filter(F.col("fpr").isNotNull() & F.col("tpr").isNotNull())
    starts = steps.select(*keys).distinct().select(*keys, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    at = steps.select(*keys, "fpr", "tpr").unionByName(starts).groupBy(*keys, "fpr").agg(
        F.min("tpr").alias("low"), F.max("tpr").alias("high"))
    # Only the last step before and the first step at or after each grid point matter.
    before = at.groupBy(*keys, F.floor(F.col("fpr") * (points - 1)).cast("int").alias("cell")).agg(
        F.max(F.struct("fpr", "high")).alias("last"), F.min(F.struct("fpr", "low", "high")).alias("first"))
    cells = before.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("cell"))
    filled = cells.join(before, [*keys, "cell"], "left")
    upto = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("cell").rowsBetween(0, Window.unboundedFollowing)
    ends = filled.select(  # `points` rows per fold in each window group
        *keys, "cell", F.last("last", True).over(upto).alias("lo"), F.first("first", True).over(after).alias("hi"),
        (F.col("cell") / F.lit(float(points - 1))).alias("x"))
    slope = F.try_divide(F.col("hi.low") - F.col("lo.high"), F.col("hi.fpr") - F.col("lo.fpr"))
    y = (F.when(F.col("cell") == 0, 0.0)
         .when(F.col("hi.fpr") == F.col("x"), F.col("hi.high"))
         .otherwise(F.col("lo.high") + slope * (F.col("x") - F.col("lo.fpr"))))
    folds = ends.withColumn("tpr", y)
    mean = F.when(F.col("cell") == points - 1, 1.0).otherwise(F.col("mean_tpr"))
    return folds.groupBy(*by, "cell").agg(
        F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("sd_tpr")).select(
        *by, F.col("cell").alias("point"), (F.col("cell") / F.lit(float(points - 1))).alias("fpr"),
        mean.alias("mean_tpr"), "sd_tpr",
        F.least(F.col("mean_tpr") + F.col("sd_tpr"), F.lit(1.0)).alias("upper"),
        F.greatest(F.col("mean_tpr") - F.col("sd_tpr"), F.lit(0.0)).alias("lower"))


# ---- tables behind plots ---------------------------------------------------------

def ecdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of values at or below each distinct value; starts at (0, 0) and ends at (1, 1)."""
    keys = list(keys)
    steps = value_steps(df.filter(F.col(value).isNotNull()), value, {"n": F.lit(1).cast("bigint")}, keys)
    curve = steps.select(*keys, F.col(value).cast("double").alias("value"), share(F.col("n"), F.col("n_total")).alias("cdf"))
    ends = curve.select(*keys).distinct().select(*keys, F.explode(F.array(
        F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("cdf")),
        F.struct(F.lit(1.0).alias("value"), F.lit(1.0).alias("cdf")))).alias("e")).select(*keys, "e.*")
    return curve.unionByName(ends)


def five_numbers(df: DataFrame, value: str, keys: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """Minimum, quartiles and maximum per key: the data of a box plot."""
    keys = list(keys)
    names = {0.0: "q0", 0.25: "q25", 0.5: "q50", 0.75: "q75", 1.0: "q100"}
    found = exact_quantiles(df, value, list(names), tiebreak, keys)
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()],
        F.max("n").alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: Sequence[str] = ("label",),
              log: bool = False) -> DataFrame:
    """Counts per equal-width bin (1..bins; the top edge belongs to the last) and key."""
    x = F.log1p(F.col(value)) if log else F.col(value)
    bucket = F.least(F.floor((x - low) / F.lit((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    inside = df.filter(x.between(low, high))
    return inside.groupBy(*keys, bucket.alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, value: str, keys: Sequence[str] = ("label",), points: int = 101, fine: int = 400) -> DataFrame:
    """Gaussian kernel density `(keys..., point, x, density)` of each key's values at `points` even places.

    The band width is the deviation times n^(-1/5); places reach three of it beyond the least and largest value.
    Values are dealt to the two nearest of `fine` + 1 even places, in proportion, so that what meets the places
    is of fixed size for each key. Null values take no part; a key whose values are all alike has no density.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).select(*keys, v.alias("_v"))
    facts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.stddev("_v").alias("_sd"))
    width = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    facts = pin(facts.filter("_sd > 0").select(
        *keys, "_n", width.alias("_h"), (F.col("_a") - 3 * width).alias("_low"), ((F.col("_b") - F.col("_a") + 6 * width) / fine).alias("_step")), "facts")
    small = at_most(facts, SMALL_VALUES // len(facts.columns))
    placed = join_alike(rows, F.broadcast(facts) if small else facts, keys, "inner").withColumn("_at", (F.col("_v") - F.col("_low")) / F.col("_step"))
    left = F.floor("_at")
    share = F.col("_at") - left
    dealt = placed.select(*keys, F.explode(F.array(
        F.struct(left.alias("bin"), (1 - share).alias("w")), F.struct((left + 1).alias("bin"), share.alias("w")))).alias("d"))
    bins = dealt.groupBy(*keys, "d.bin").agg(F.sum("d.w").alias("_w"))
    grid = facts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_low") + F.col("point") * F.col("_step") * F.lit(fine / (points - 1))
    away = (x - F.col("_low") - F.col("bin") * F.col("_step")) / F.col("_h")
    kernel = F.exp(-0.5 * away * away) / (F.col("_h") * F.lit(math.sqrt(2 * math.pi)) * F.col("_n"))
    met = join_alike(bins, grid, keys, "inner")  # at most fine + 1 bins and `points` places for each key
    return met.withColumn("x", x).groupBy(*keys, "point", "x").agg(F.sum(F.col("_w") * kernel).alias("density"))


def class_counts(df: DataFrame, category: str, label: str = "label") -> DataFrame:
    return df.groupBy(category, label).agg(F.count("*").alias("n"))


def known_novel_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("clf").agg(
        F.count_if(F.col("kind") == "known").alias("known"), F.count_if(F.col("kind") == "novel").alias("novel"))


# ---- choosing from a ranking --------------------------------------------------

def top_fraction(df: DataFrame, score: str, ratio: float, tiebreak: str = "entity_id",
                 keys: Sequence[str] = ()) -> DataFrame:
    """First int(ratio * rows) by score, with 1-based `rank`."""
    placed = number_rows(df, [F.col(score).desc(), F.col(tiebreak)], "rank", keys, "_n")
    return placed.filter(F.col("rank") <= F.floor(F.col("_n") * F.lit(float(ratio)))).drop("_n")


def top_rows(df: DataFrame, score: str, n: int, tiebreak: str = "entity_id") -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(tiebreak)).limit(n)


# ---- classifiers together ------------------------------------------------------

def consensus(predictions: DataFrame, classifiers: int, slack: int = 1) -> DataFrame:
    """Entities listed by at least `classifiers - slack` classifiers."""
    return predictions.groupBy("entity_id").agg(F.count_distinct("clf").alias("n_clf")).filter(
        F.col("n_clf") >= classifiers - slack)


def consensus_sweep(listed: DataFrame, classifiers: Sequence[str]) -> DataFrame:
    """Consensus membership for every slack 0 .. classifiers - 2, from one count."""
    own = listed.filter(F.col("clf").isin(*classifiers))
    hits = own.groupBy("entity_id").agg(F.count_distinct("clf").alias("hits"))
    slack = F.explode(F.sequence(F.lit(0), F.lit(max(len(classifiers) - 2, 0)))).alias("relaxation")
    return hits.select("entity_id", "hits", slack).filter(F.col("hits") >= len(classifiers) - F.col("relaxation"))


def consensus_matrix(listed: DataFrame, ranked: DataFrame, classifiers: Sequence[str], slack: int = 0,
                     count_all: bool = False) -> DataFrame:
    """Entities hit by enough of `classifiers`, with hits and each one's percentile, best classifier first.

    `count_all` counts hits over every classifier present, not just the chosen ones.
    """
    own = listed if count_all else listed.filter(F.col("clf").isin(*classifiers))
    hits = own.groupBy("entity_id").agg(F.count_distinct("clf").alias("hits"))
    kept = hits.filter(F.col("hits") >= len(classifiers) - slack)
    wide = ranked.filter(F.col("clf").isin(*classifiers)).groupBy("entity_id").agg(
        *[F.max(F.when(F.col("clf") == c, F.col("percentile"))).alias(c) for c in classifiers])
    return kept.join(wide, "entity_id", "left").orderBy(F.desc(classifiers[0]), "entity_id")


def merged_scores(scores: DataFrame) -> DataFrame:
    """Mean over all classifiers' raw scores, highest first."""
    return scores.groupBy("entity_id").agg(
        F.avg("proba").alias("mean_score"), F.count("proba").alias("n_scores")).orderBy(
        F.desc("mean_score"), "entity_id")


def score_correlations(means: DataFrame, names: Sequence[str], by: str = "clf", score: str = "mean_score") -> DataFrame:
    """Pairwise r between classifiers (or iteration counts) over their shared entities."""
    wide = means.groupBy("entity_id").agg(*[F.max(F.when(F.col(by) == n, F.col(score))).alias(f"x{i}")
                                            for i, n in enumerate(names)])
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
    aggs = []
    for a, b in pairs:
        both = F.col(f"x{a}").isNotNull() & F.col(f"x{b}").isNotNull()
        x, y = F.when(both, F.col(f"x{a}")), F.when(both, F.col(f"x{b}"))
        aggs.append(F.struct(F.lit(str(names[a])).alias("i"), F.lit(str(names[b])).alias("j"), F.try_divide(
            F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r")).alias(f"p{a}_{b}"))
    row = wide.agg(*aggs)
    return row.select(F.explode(F.array(*row.columns)).alias("p")).select("p.*")


def iteration_stability(scores: DataFrame, counts: Sequence[int], threshold: float = 0.5) -> DataFrame:
    """Known and novel predictions after the first 1, 2, ... iterations, from one pass."""
    per = scores.groupBy("entity_id").agg(
        F.max("label").alias("label"),
        *[F.count_if(predicted() & (F.col("iter") <= c)).alias(f"p{c}") for c in counts],
        *[F.count_if(F.col("proba").isNotNull() & (F.col("iter") <= c)).alias(f"n{c}") for c in counts])
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("iterations"), F.try_divide(F.col(f"p{c}").cast("double"), F.col(f"n{c}")).alias("ratio"))
        for c in counts])).alias("r")
    return per.select("label", rows).select("label", "r.*").groupBy("iterations").agg(
        F.count_if((F.col("ratio") >= threshold) & (F.col("label") == 1)).alias("known"),
        F.count_if((F.col("ratio") >= threshold) & (F.col("label") == 0)).alias("novel"))


def means_by_iterations(scores: DataFrame, counts: Sequence[int]) -> DataFrame:
    """Mean score of each entity over the first c iterations, for each c."""
    per = scores.groupBy("entity_id").agg(
        *[F.avg(F.when(F.col("iter") <= c, F.col("proba"))).alias(f"m{c}") for c in counts])
    return per.select("entity_id", F.explode(F.array(*[F.struct(
        F.lit(c).alias("iterations"), F.col(f"m{c}").alias("mean_score")) for c in counts])).alias("r")).select(
        "entity_id", "r.*")


