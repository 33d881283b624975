"""Learners over blocks: every held-out row scored once, signal found."""

import pytest
from pyspark.sql import functions as F

from seedlift.jobs import Source, compare_with_external, compare_with_random, compile_features, rank_entities
from seedlift.operators import embed
from seedlift.operators import learners as L
from seedlift.operators import scores as S
from seedlift.operators.bagging import pu_membership
from seedlift.operators.bayes import with_features
from seedlift.operators.enrich import best_enrichment, ties_at_random
from seedlift.operators.nets import Net
from seedlift.operators.shadow import ShadowRounds
from seedlift.operators.trees import Forest
from seedlift.runtime import pin


@pytest.fixture(scope="module")
def rows(spark):
    table = pin(spark.range(240).select(
        F.concat(F.lit("e"), "id").alias("entity_id"), (F.col("id") < 40).cast("int").alias("label"),
        (F.randn(1) + (F.col("id") < 40).cast("int") * 2).alias("a"), F.randn(2).alias("b")))
    members = pin(pu_membership(table.select("entity_id", "label"), 1, 2.0, 3))
    return with_features(members, table, ["a", "b"])


def test_every_row_scored_once(spark, rows):
    scores, importance = L.fit_folds(rows, ["a", "b"], {"RF": L.random_forest(10, 4), "LR": L.logistic()})
    keys = ["iter", "block", "fold", "entity_id"]
    for clf in ("RF", "LR"):
        one = scores.filter(F.col("clf") == clf).select(*keys)
        assert one.count() == rows.count() and one.exceptAll(rows.select(*keys)).count() == 0
    # No learner can be far from the informative feature ranked on its own.
    best = S.auc(rows.withColumn("clf", F.lit("raw")), score="a").agg(F.avg("auc")).first()[0]
    for r in S.auc(scores).groupBy("clf").agg(F.avg("auc").alias("a")).collect():
        assert best - 0.1 < r.a <= best + 0.05
    assert importance.filter("clf = 'RF'").groupBy("feature").agg(F.avg("value").alias("v")).orderBy(F.desc("v")).first().feature == "a"


def test_stacking(spark, rows):
    bases = {"LR": L.logistic(), "RF": Forest(trees=5, depth=3)}
    meta = L.stacked_features(rows, ["a", "b"], bases)
    # Each row is test once and training data for the other folds.
    assert meta.filter("is_test = 1").count() == rows.count() and meta.filter("is_test = 0").count() == 2 * rows.count()
    assert meta.filter("LR is null or RF is null").count() == 0
    for final in (L.logistic(), Net(hidden=(8,), epochs=20)):
        scores = L.stacking_scores(rows, ["a", "b"], bases, final, add_original=True)
        keys = ["iter", "block", "fold", "entity_id"]
        assert scores.count() == rows.count() and scores.select(*keys).exceptAll(rows.select(*keys)).count() == 0
        assert S.auc(scores).agg(F.avg("auc")).first()[0] > 0.7


def test_margin_classifier_probabilities(rows):
    scores, importance = L.fit_folds(rows.filter("block = 0"), ["a", "b"], {"SVC": L.LEARNERS["SVC"]})
    assert importance.count() == 0
    best = S.auc(rows.filter("block = 0").withColumn("clf", F.lit("raw")), score="a").agg(F.avg("auc")).first()[0]
    assert S.auc(scores).agg(F.avg("auc")).first()[0] > best - 0.1
    assert scores.filter("proba < 0 or proba > 1").count() == 0


def test_components_are_centred(spark):
    df = spark.range(100).select("id", F.array(F.randn(1) + 50, F.randn(2) * 3 - 9, F.randn(3)).alias("v"))
    points, shares = embed.principal_components(embed.as_vectors(df, array="v"), 20)
    assert shares.count() == 2
    means = points.select(*[F.avg(F.col("pcs")[i]) for i in range(2)]).first()
    assert all(abs(m) < 1e-9 for m in means)
    assert embed.cluster(points, 4).select("cluster").distinct().count() == 4


def test_whole_ranking_and_comparison(spark):
    table = pin(spark.range(300).select(
        F.concat(F.lit("e"), "id").alias("entity_id"), (F.col("id") < 30).cast("int").alias("label"),
        (F.randn(1) + (F.col("id") < 60).cast("int") * 3).alias("a"), F.randn(2).alias("b")))
    baseline = rank_entities(table, ["a", "b"], iterations=2, k=3)
    assert baseline.ranked.count() == 300 and baseline.importance is None
    run = rank_entities(table, ["a", "b"], {"LR": L.logistic(), "RF": L.random_forest(5, 3)}, iterations=1, ratio=4.0, k=2)
    names = run.classifiers()
    assert sorted(names) == ["LR", "RF"] and run.ranked.count() == 600
    kinds = {(r.clf, r.kind): r.n for r in run.positions.groupBy("clf", "kind").agg(F.max("position").alias("n")).collect()}
    assert kinds == {(c, k): n for c in names for k, n in (("all", 300), ("known", 30), ("unlabelled", 270))}
    assert run.decisions is None and run.columns == ("a", "b")
    # Entities 30..59 look like seeds without being marked: the external list names them first.
    external = spark.range(300).select(
        F.concat(F.lit("e"), F.col("id")).alias("entity_id"), (F.abs(F.col("id") - 45) / 300.0).alias("p"),
        F.lit(0).alias("external_rank"))
    listed = ties_at_random(external, "x")
    seeds = table.filter("label = 1").select("entity_id")
    found = compare_with_external(run.ranked, listed, seeds, names, 0.2)
    assert best_enrichment(found.steps.filter("clf = 'LR'")).first()["min_p"] < 1e-3
    kinds = {r.known: r.n for r in found.consensus.groupBy("known").agg(F.count("*").alias("n")).collect()}
    assert kinds[0] > kinds.get(1, 0)
    novel = compare_with_external(run.ranked, listed, seeds, names, 0.2, remove_seeds=True)
    assert novel.table.filter("known = 1").count() == 0


def test_ranking_on_confirmed_features(spark):
    table = pin(spark.range(400).select(
        F.concat(F.lit("e"), "id").alias("entity_id"), (F.col("id") < 80).cast("int").alias("label"),
        (F.randn(1) + (F.col("id") < 80).cast("int") * 2).alias("a"), *[F.randn(i).alias(f"n{i}") for i in range(2, 7)]))
    columns = ["a", "n2", "n3", "n4", "n5", "n6"]
    select = ShadowRounds(Forest(trees=20, depth=6), rounds=30)
    run = rank_entities(table, columns, {"RF": Forest(trees=10, depth=5)}, iterations=1, ratio=1.5, k=3, select=select)
    assert "a" in run.columns and len(run.columns) < len(columns)
    assert {r.feature for r in run.decisions.filter("final = 'Confirmed'").collect()} == set(run.columns)
    assert {r.feature for r in run.importance.select("feature").distinct().collect()} == set(run.columns)


def test_from_sources_to_a_ranking(spark):
    named = pin(spark.range(200).select(
        F.concat(F.lit("e"), "id").alias("entity_id"), F.when(F.col("id") < 40, "kidney stone").when(F.col("id") < 45, "no kidney").otherwise("x").alias("phrase"),
        (F.randn(1) + (F.col("id") < 40).cast("int") * 2).alias("v")))
    universe = named.select("entity_id")
    parts = {
        "score": lambda c: named.select("entity_id", F.when(F.col("v") > -1.5, F.col("v")).alias("GnomAD_v")),
        "noise": lambda c: named.select("entity_id", F.randn(7).alias("u"), F.lit(0).alias("GO_never")),
        "seeds": lambda c: c.seeds.select("entity_id", F.lit(len(c.include)).alias("GWAS_terms")).limit(20),
        "empty": lambda c: named.limit(0).select("entity_id", F.lit(1).alias("GO_gone")),
    }
    terms = Source(named, "phrase", ["kidney"], ["no"])
    made = compile_features(universe, terms, "entity_id", parts, more_terms=["renal"])
    assert made.seeds.count() == 40 and made.complete.count() == 200 and made.complete.filter("label = 1").count() == 40
    assert made.complete.columns == ["entity_id", "label", "GnomAD_v", "u", "GO_never", "GWAS_terms"]
    assert made.complete.filter("GnomAD_v IS NULL OR GWAS_terms IS NULL").count() == 0 and made.complete.agg(F.max("GWAS_terms")).first()[0] == 2
    assert {r.feature: r.n_null for r in made.profile.collect()}["GWAS_terms"] == 180
    assert "GO_never" not in made.filtered.columns and made.filtered.count() == 200
    control = compile_features(universe, terms, "entity_id", parts, random=True)
    assert control.complete.filter("label = 1").count() == 40
    assert control.complete.filter("label = 1").join(made.seeds, "entity_id", "left_semi").count() < 40
    columns = [c for c in made.filtered.columns if c not in ("entity_id", "label")]
    run = rank_entities(made.filtered, columns, iterations=1, k=3)
    assert run.ranked.count() == 200
    test = compare_with_random(made.filtered, control.complete.select("entity_id", "label"), columns, iterations=1, k=3).first()
    assert test["n1"] == test["n2"] == 40 and test["p"] < 0.01
    with pytest.raises(ValueError, match="no seeds"):
        compile_features(universe, Source(named, "phrase", ["liver"]), "entity_id", parts)
    twice = {"twice": lambda c: named.select("entity_id", F.lit(1).alias("GO_a")).union(named.limit(1).select("entity_id", F.lit(2)))}
    with pytest.raises(ValueError, match="duplicate"):
        compile_features(universe, terms, "entity_id", twice)
