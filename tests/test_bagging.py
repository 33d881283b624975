"""Balanced blocks and folds: sizes, conservation and the closed form."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedlift.operators import bagging as G
from seedlift.operators.bayes import naive_bayes_scores
from seedlift.operators import scores as S
from seedlift.operators.terms import hide_seeds, random_seeds


def dealt(plan):
    """Block sizes by dealing rows out, block after block, leftovers chunk by chunk."""
    sizes, left = [], plan.unlabelled
    while left >= plan.take:
        sizes.append(plan.take)
        left -= plan.take
    chunk, at = round(left / len(sizes)) + 1, -1
    while left > chunk:
        at += 1
        sizes[at] += chunk
        left -= chunk
    sizes[at] += left
    return sizes


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(1, 3000), st.sampled_from([0.5, 1.0, 1.5, 2.5]))
def test_plan_matches_dealing(seeds, unlabelled, ratio):
    if not 0 < round(seeds * ratio) <= unlabelled:
        with pytest.raises(ValueError):
            G.BlockPlan(seeds, unlabelled, ratio)
        return
    plan, sizes = G.BlockPlan(seeds, unlabelled, ratio), None
    sizes = dealt(plan)
    assert plan.blocks == len(sizes) and sum(sizes) == unlabelled
    m = plan.full_chunks
    mine = [plan.take] * plan.blocks
    for j in range(plan.left):
        mine[plan.blocks - 1 if m == 0 else min(j // plan.chunk, m - 1)] += 1
    assert mine == sizes


def test_published_block_count():
    assert G.BlockPlan(590, 17635, 1.5).blocks == 19


@pytest.mark.parametrize("unlabelled", [300, 301, 337, 359])
def test_membership(spark, unlabelled):
    rows = [(f"s{i}", 1) for i in range(20)] + [(f"u{i}", 0) for i in range(unlabelled)]
    entities = spark.createDataFrame(rows, "entity_id string, label int")
    plan = G.plan_blocks(entities, 1.5)
    members = G.pu_membership(entities, 2, 1.5, 4, plan=plan)
    G.check_conserved(members, plan, 2)
    pdf = members.toPandas()
    assert (pdf[pdf.label == 0].groupby(["iter", "entity_id"]).size() == 1).all()
    assert (pdf[pdf.label == 1].groupby(["iter", "entity_id"]).size() == plan.blocks).all()
    for _, one in pdf[pdf.label == 0].groupby("iter"):
        assert one.groupby("block").size().sort_index().tolist() == dealt(plan)
    sizes = pdf.groupby(["iter", "block", "label", "fold"]).size().unstack(fill_value=0)
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
    assert (sizes.diff(axis=1).iloc[:, 1:] <= 0).all().all()  # longer folds come first


def test_draws_and_sample(spark):
    entities = spark.createDataFrame([(f"e{i}", int(i < 10)) for i in range(100)], "entity_id string, label int")
    members = G.pu_membership(entities, 2, 2.0, 5).cache()
    draws = G.random_draws(members, 3, 0.25).toPandas()
    by = draws.groupby(["iter", "block", "draw", "label"]).is_test
    assert (by.sum() == (by.size() * 0.25).astype(int)).all()
    assert G.sample_blocks(members, 3).select("iter", "block").distinct().count() == 3


def test_scores_beat_random_seeds(spark):
    """Seeds with shifted features are found; as many random seeds are not."""
    rows = spark.range(600).select(
        F.concat(F.lit("e"), "id").alias("entity_id"), (F.col("id") < 60).cast("int").alias("label"),
        (F.randn(1) + (F.col("id") < 60).cast("int") * 1.5).alias("a"), F.randn(2).alias("b")).cache()

    def auc(table):
        members = G.pu_membership(table.select("entity_id", "label"), 1, 1.5, 5)
        return S.auc(naive_bayes_scores(members, table, ["a", "b"])).agg(F.avg("auc")).first()[0]

    control = random_seeds(rows, salt="control")
    assert control.filter("label = 1").count() == 60
    assert auc(rows) > 0.75 and abs(auc(control) - 0.5) < 0.15
    kept, hidden = hide_seeds(rows.filter("label = 1").select("entity_id"), 0.25)
    assert (kept.count(), hidden.count()) == (45, 15)


def test_votes_are_exact(spark):
    rows = spark.createDataFrame([("c", 1, 0, 0, "a", 1, 0.5), ("c", 1, 1, 0, "a", 1, 0.2), ("c", 1, 0, 0, "b", 0, 0.49)],
                                 "clf string, iter int, block int, fold int, entity_id string, label int, proba double")
    got = {r.entity_id: r for r in S.positive_ratio(S.votes(rows)).collect()}
    assert (got["a"].positive_votes, got["a"].negative_votes, got["a"].positive_ratio) == (1, 1, 0.5)
    assert got["b"].positive_votes == 0
    seeds = spark.createDataFrame([("a", 1), ("z", 1)], "entity_id string, label int")
    joined = {r.entity_id: r for r in S.attach_labels(S.votes(rows), seeds).collect()}
    assert joined["z"].positive_votes is None and joined["b"].label is None
