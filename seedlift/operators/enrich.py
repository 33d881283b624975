"""Does a ranking agree with an external ranked list? Stepwise hypergeometric enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlift.functions.tails import hypergeom_log10
from seedlift.operators.joins import attach, drop_listed, keep_listed, label_known
from seedlift.operators.order import number_rows, shuffled_positions
from seedlift.operators.scores import top_fraction
from seedlift.runtime import pin


def require_probabilities(df: DataFrame, p: str = "p") -> DataFrame:
    """Return `df`, or raise if a p lies outside [0, 1]."""
    bad = df.agg(F.count_if((F.col(p) < 0) | (F.col(p) > 1) | F.isnan(p))).first()[0]
    if bad:
        raise ValueError(f"{bad} values of {p} outside [0, 1]")
    return df


def external_ranking(df: DataFrame, order: Column, p: Column | None = None, p_from_rank: bool = False) -> DataFrame:
    """`(entity_id, p, external_rank)` in `order`, ties by entity; `p_from_rank` takes rank / rows as p."""
    narrow = df.select("entity_id", order.alias("_o"), (F.lit(None).cast("double") if p is None else p).alias("p"))
    ranked = number_rows(narrow, [F.col("_o"), F.col("entity_id")], "external_rank", total="_n")
    if p_from_rank:
        ranked = ranked.withColumn("p", F.col("external_rank") / F.col("_n").cast("double"))
    return ranked.select("entity_id", "p", "external_rank")


def load_ranking(external: DataFrame, pvalue: float | None = 0.05, top_ratio: float | None = None,
                 without: DataFrame | None = None) -> DataFrame:
    """Cut a ranked list by p (inclusive) or by its first int(ratio * n) + 1 rows, then drop named entities."""
    if top_ratio is not None:
        size = external.agg(F.floor(F.count("*") * F.lit(float(top_ratio)))).scalar()
        external = external.filter(F.col("external_rank") - 1 <= size)
    elif pvalue is not None:
        external = external.filter(F.col("p") <= pvalue)
    return external if without is None else drop_listed(external, without)


def ties_at_random(external: DataFrame, salt: str) -> DataFrame:
    """New ranks with entities of equal p in random order."""
    mixed = external.withColumn("_h", F.md5(F.concat_ws(":", F.lit(salt), "entity_id"))).drop("external_rank")
    return number_rows(mixed, [F.col("p"), F.col("_h"), F.col("entity_id")], "external_rank").drop("_h")


def shuffled_ranking(external: DataFrame, salt: str) -> DataFrame:
    """The same entities in random order: the null model."""
    return shuffled_positions(external.drop("external_rank"), "entity_id", salt, name="external_rank")


def restrict_to_shared(ranking: DataFrame, external: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists cut to the entities they share; external ranks are numbered anew within them."""
    shared = keep_listed(external, ranking).withColumnRenamed("external_rank", "_old")
    return keep_listed(ranking, external), number_rows(shared, [F.col("_old")], "external_rank").drop("_old")


def hypergeom_steps(
    ranking: DataFrame,
    external: DataFrame,
    ratio: float = 0.05,
    remove: DataFrame | None = None,
    score: str = "mean_score",
    strict: bool = False,
    max_overlap: int = 50,
    has_p: bool = True,
    significance: float = 0.05,
    keys: Sequence[str] = (),
    lists: Sequence[str] = (),
) -> DataFrame:
    """One row per external entity among the ranking's top fraction, in external order.

    `x` counts hits before the row (so the first p is 1); `strict` counts the row too.
    p = P(X >= x), X ~ Hypergeometric(external rows, overlap, external rank).
    `before_cutoff` marks rows before the first with p-value above `significance`, or
    the first `max_overlap` rows when the list has no p-values.
    `keys` name several rankings in one table (`clf`), `lists` several external lists;
    every combination is stepped through in the same pass.
    """
    keys, lists = list(keys), list(lists)
    by = keys + lists
    if remove is not None:
        ranking = drop_listed(ranking, remove)
    top = top_fraction(ranking.select(*keys, "entity_id", score), score, ratio, keys=keys)
    kept = external.select(*lists, "entity_id", "p", "external_rank").join(top, "entity_id")
    placed = number_rows(kept, [F.col("external_rank")], "_nth", by, total="successes")
    if lists:
        placed = attach(placed, pin(external.groupBy(*lists).agg(F.count("*").alias("population")), "sizes"), lists)
    else:
        placed = placed.withColumn("population", external.agg(F.count("*")).scalar().cast("bigint"))
    if not has_p:
        before = F.col("_nth") <= max_overlap
    else:
        weak = placed.filter(F.col("p") > significance)
        if by:
            placed = attach(placed, pin(weak.groupBy(*by).agg(F.min("_nth").alias("_weak")), "cutoffs"), by)
            first_weak = F.col("_weak")
        else:
            first_weak = weak.agg(F.min("_nth")).scalar()
        before = F.coalesce(F.col("_nth") < first_weak, F.lit(True))
    placed = placed.withColumn("x", F.col("_nth") - (0 if strict else 1)).withColumn("step", F.col("_nth") - 1)
    placed = placed.withColumn("before_cutoff", before.cast("int"))
    steps = placed.withColumn("log10_p", hypergeom_log10("x", "population", "successes", "external_rank"))
    # p itself is 0 below the smallest double; its logarithm and the Phred score are not.
    return steps.withColumn("hyper_p", F.pow(F.lit(10.0), F.col("log10_p"))).withColumn("phred", F.abs(-10 * F.col("log10_p"))).select(
        *by, "entity_id", "p", "external_rank", score, "rank", "successes", "population", "x", "step", "before_cutoff",
        "hyper_p", "phred")


def best_enrichment(steps: DataFrame) -> DataFrame:
    """Smallest p and its Phred score before the cutoff."""
    low = F.min(F.when(F.col("before_cutoff") == 1, F.col("hyper_p")))
    best = F.max(F.when(F.col("before_cutoff") == 1, F.col("phred")))
    return steps.agg(low.alias("min_p"), best.alias("max_phred"), F.count("*").alias("overlap"),
                     F.sum("before_cutoff").alias("n_before_cutoff"))


def overlap_table(steps: DataFrame, percentiles: DataFrame, seeds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Overlap rows before the cutoff with rank, score, percentile, external rank and known flag."""
    on = [*keys, "entity_id"]
    rows = steps.filter("before_cutoff = 1").join(percentiles.select(*on, "percentile"), on, "left")
    return label_known(rows, seeds, name="known").fillna(0, subset=["percentile", "p"])


def novel_and_known(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return table.filter("known = 0").select("entity_id"), table.filter("known = 1").select("entity_id")
