"""The whole jobs: profile the sources, compile the feature table, rank the entities, compare with an external list and with random seeds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlift.operators import enrich as E
from seedlift.operators import learners as L
from seedlift.operators import prep as P
from seedlift.operators import scores as S
from seedlift.operators import stats as ST
from seedlift.operators.bagging import check_conserved, plan_blocks, pu_membership
from seedlift.operators.bayes import score_rows, with_features
from seedlift.operators.features import assemble
from seedlift.operators.joins import keep_listed
from seedlift.operators.shadow import ShadowRounds, final_decisions, run_decisions, shadow_rounds
from seedlift.operators.terms import random_seeds, seeds_from_terms, source_profile
from seedlift.runtime import pin


@dataclass(frozen=True)
class Source:
    """A text column of an annotation table and the terms that choose from it."""

    table: DataFrame
    column: str
    include: Sequence[str]
    exclude: Sequence[str] = ()
    regex: bool = False


def profile_sources(sources: Mapping[str, Source]) -> DataFrame:
    """`(source, value, n_rows, selected)`: what the terms choose, and from what, in every source."""
    return reduce(DataFrame.unionByName, [
        source_profile(s.table, s.column, s.include, s.exclude, s.regex).withColumn("source", F.lit(name))
        for name, s in sources.items()])


@dataclass(frozen=True)
class Context:
    """What a part of the feature table is built for."""

    universe: DataFrame
    seeds: DataFrame
    include: Sequence[str]
    exclude: Sequence[str]


@dataclass(frozen=True)
class FeatureTable:
    """What the way from sources to features leaves behind."""

    seeds: DataFrame
    profile: DataFrame  # missing values of every column before they are filled
    complete: DataFrame  # every entity, its label, all features, nothing missing
    unfiltered: DataFrame  # scaled and coded
    filtered: DataFrame  # without highly correlated features


def compile_features(universe: DataFrame, associations: Source, entity: str, parts: Mapping[str, Callable[[Context], DataFrame]],
                     more_terms: Sequence[str] = (), random: bool = False, sparse: float = 0.99, correlation: float = 0.85,
                     unknown: str = "median") -> FeatureTable:
    """From raw sources to the feature table that `rank_entities` takes.

    The terms of `associations` choose the seeds among its `entity` values. Each of `parts` makes a table with one
    row for each entity out of its own source (see `operators.features`); it is given the same terms and
    `more_terms`. Parts without rows are left out. All are joined to the universe, whose key must be unique, as
    must theirs; with `random`, as many random entities as there are seeds take their place. Columns with more than
    a share `sparse` of missing values go; missing flags and counts become 0, other missing values the median of
    their column (see `prep.fill_zero`, `prep.fill_unknown`); any other gap raises. The end is `prep.prepare`.
    """
    seeds, _ = seeds_from_terms(associations.table, entity, associations.column, associations.include, associations.exclude,
                                associations.regex)
    seeds = pin(keep_listed(seeds, universe), "seeds")
    if not seeds.limit(1).count():
        raise ValueError(f"no seeds for {list(associations.include)}")
    context = Context(universe, seeds, [*associations.include, *more_terms], list(associations.exclude))
    tables = [pin(make(context), name) for name, make in parts.items()]
    table = assemble(universe, seeds, [t for t in tables if t.limit(1).count()])
    if random:
        table = pin(random_seeds(table), "features")
    profile = P.null_profile(table)
    complete = pin(P.fill_unknown(P.fill_zero(P.drop_sparse(table, sparse)), mode=unknown), "complete")
    unfiltered, filtered = P.prepare(P.require_complete(complete), correlation)
    return FeatureTable(seeds, profile, complete, unfiltered, filtered)


@dataclass(frozen=True)
class Ranking:
    """Everything a ranking run leaves behind; all tables but `decisions` are long, with a `clf` column.

    `positions` numbers all, known and unlabelled entities by score; `decisions` are those on the features, if
    any were selected, and `columns` the features that the fits used.
    """

    scores: DataFrame
    importance: DataFrame | None
    aucs: DataFrame
    ranked: DataFrame
    positions: DataFrame
    predicted: DataFrame
    consensus: DataFrame
    decisions: DataFrame | None
    columns: tuple[str, ...]

    def classifiers(self) -> list[str]:
        """Names, best mean AUC first."""
        return [r["clf"] for r in S.auc_summary(self.aucs).select("clf").collect()]


def rank_entities(
    table: DataFrame,
    columns: Sequence[str],
    learners: Mapping[str, L.Maker] | None = None,
    iterations: int = 10,
    ratio: float = 1.5,
    k: int = 10,
    threshold: float = 0.5,
    decimals: int | None = None,
    select: ShadowRounds | None = None,
    select_iterations: int = 1,
    round_scores: int | None = None,
    keep: str | None = None,
) -> Ranking:
    """Score `(entity_id, label, columns...)` out of fold with `learners`, or the baseline without any.

    With `select`, the blocks of the first `select_iterations` iterations are runs of shadow selection, and only
    the features that are confirmed in the end take part; if there are none, all do. `round_scores` rounds single
    scores, `decimals` mean ones. `keep` is a folder where fits are left for a run that is started again.
    """
    entities = table.select("entity_id", "label")
    plan = plan_blocks(entities, ratio)
    members = check_conserved(pin(pu_membership(entities, iterations, ratio, k, plan=plan), "membership"), plan, iterations)
    rows = pin(with_features(members, table, columns), "rows")
    decisions = None
    if select is not None:
        rounds = shadow_rounds(rows.filter(F.col("iter") <= select_iterations), columns, select)
        decisions = pin(final_decisions(run_decisions(rounds)), "decisions")
        confirmed = {r["feature"] for r in decisions.filter("final = 'Confirmed'").select("feature").collect()}  # a row a feature
        columns = [c for c in columns if c in confirmed] or columns
    if learners:
        scores, importance = L.fit_folds(rows, columns, learners, keep=keep)
    else:
        scores, importance = pin(score_rows(rows, columns), "scores"), None
    if round_scores is not None:
        scores = scores.withColumn("proba", F.round("proba", round_scores))
    n = len(learners) if learners else 1
    predicted = S.predicted_entities(S.votes(scores), threshold)
    ranked = pin(S.ranked_predictions(scores, decimals), "ranked")
    return Ranking(scores, importance, pin(S.auc(scores), "aucs"), ranked, S.rankings_by_kind(ranked), predicted,
                   S.consensus(predicted, n), decisions, tuple(columns))


@dataclass(frozen=True)
class Overlap:
    """Steps and overlap rows per classifier, and consensus per kind (`known` 0/1) and relaxation."""

    steps: DataFrame
    table: DataFrame
    consensus: DataFrame


def compare_with_external(ranked: DataFrame, external: DataFrame, seeds: DataFrame, classifiers: Sequence[str],
                          ratio: float = 0.05, has_p: bool = True, max_overlap: int = 50,
                          remove_seeds: bool = False) -> Overlap:
    """Enrichment of every classifier's ranking (`clf, entity_id, mean_score, percentile`) in an external list."""
    if has_p:
        external = E.require_probabilities(external)
    mine = ranked.filter(F.col("clf").isin(*classifiers)).select("clf", "entity_id", "mean_score", "percentile")
    steps = E.hypergeom_steps(mine, external, ratio, seeds if remove_seeds else None, has_p=has_p,
                              max_overlap=max_overlap, keys=["clf"])
    table = pin(E.overlap_table(steps, mine, seeds, ["clf"]), "overlap")
    consensus = [S.consensus_sweep(table.filter(F.col("known") == known), classifiers).withColumn("known", F.lit(known))
                 for known in (0, 1)]
    return Overlap(steps, table, reduce(DataFrame.unionByName, consensus))


def compare_with_random(table: DataFrame, random: DataFrame, columns: Sequence[str], learners: Mapping[str, L.Maker] | None = None,
                        score_decimals: int | None = None, **run) -> DataFrame:
    """A negative control: Mann-Whitney test of the real seeds' percentiles in their run against those of random seeds in a
    run of their own.

    `random` is (entity_id, label) with as many seeds drawn at random; both runs take the same learners and
    arguments. With several learners each run's best by mean AUC counts. Lists are `random` and `real`.
    """
    fake = table.drop("label").join(random.select("entity_id", "label"), "entity_id")
    lists = []
    for name, rows in (("random", fake), ("real", table)):
        found = rank_entities(rows, columns, learners, round_scores=score_decimals, **run)
        best = found.classifiers()[0] if learners else None
        ranked = found.ranked if best is None else found.ranked.filter(F.col("clf") == best)
        lists.append(ranked.filter("label = 1").select(F.lit(name).alias("list"), F.col("percentile").alias("value")))
    return ST.mann_whitney(pin(lists[0].unionByName(lists[1]), "control"), ["random", "real"])
