"""Tails, tests and areas against exact arithmetic or brute force."""

import math
from fractions import Fraction
from itertools import product

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedlift.functions import tails
from seedlift.functions.numbers import phred, phred_capped
from seedlift.operators import enrich as E
from seedlift.operators import scores as S
from seedlift.operators import single
from seedlift.operators import stats as ST


def exact_tail(x, population, successes, draws):
    hits = range(max(x, draws - (population - successes), 0), min(successes, draws) + 1)
    return float(sum(Fraction(math.comb(successes, i) * math.comb(population - successes, draws - i),
                              math.comb(population, draws)) for i in hits))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.data())
def test_hypergeometric_tail(population, data):
    successes = data.draw(st.integers(0, population))
    draws = data.draw(st.integers(0, population))
    x = data.draw(st.integers(0, min(successes, draws)))
    want = exact_tail(x, population, successes, draws)
    assert tails.hypergeom_upper(x, population, successes, draws) == pytest.approx(want, rel=1e-9, abs=1e-14)


def test_hypergeometric_tail_far_out():
    assert tails.hypergeom_upper(0, 1000, 50, 10) == 1.0
    assert tails.hypergeom_upper(900, 18000, 900, 900) == pytest.approx(1 / math.comb(18000, 900) if False else
                                                                         math.exp(-(math.lgamma(18001) - math.lgamma(901) - math.lgamma(17101))), rel=1e-6, abs=0)
    assert math.isnan(tails.hypergeom_upper(1, 10, 5, 11))


def test_binomial_and_t():
    for hits, runs in product(range(0, 12), [11, 12]):
        want = sum(math.comb(runs, i) for i in range(hits, runs + 1)) / 2 ** runs
        assert tails.binomial_upper(hits, runs) == pytest.approx(want, rel=1e-10)
    # With 4 pairs t has 2 degrees of freedom and a closed form: p = 1 - |r|.
    for r in (0.0, 0.3, 0.9):
        assert tails.beta_share(1.0, 0.5, 1 - r * r) == pytest.approx(1 - r, rel=1e-10)


def brute_u(a, b):
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n1, n2 = len(a), len(b)
    n = n1 + n2
    t = pd.Series(list(a) + list(b)).value_counts()
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t ** 3 - t).sum() / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - 0.5 - n1 * n2 / 2) / sd
    return u, z, 0.5 * math.erfc(z / math.sqrt(2))


def test_mann_whitney(spark):
    rng = np.random.default_rng(1)
    lists = {"a": rng.integers(0, 9, 40), "b": rng.integers(2, 11, 25), "c": rng.integers(0, 30, 60)}
    rows = pd.DataFrame([(n, float(v)) for n, vs in lists.items() for v in vs], columns=["list", "value"])
    got = ST.mann_whitney(spark.createDataFrame(rows), list(lists)).toPandas().set_index(["a", "b"])
    assert len(got) == 3
    for (a, b), row in got.iterrows():
        u, z, p = brute_u(lists[a], lists[b])
        assert (row.u, row.n1, row.n2) == (u, len(lists[a]), len(lists[b]))
        assert row.z == pytest.approx(z) and row.p == pytest.approx(p)


def simpson(y):
    n = len(y)
    if n == 1:
        return 0.0
    if n == 2:
        return (y[0] + y[1]) / 2
    whole = lambda part: sum(part[i] + 4 * part[i + 1] + part[i + 2] for i in range(0, len(part) - 2, 2)) / 3
    if n % 2 == 1:
        return whole(y)
    return (whole(y[:-1]) + (y[-2] + y[-1]) / 2 + whole(y[1:]) + (y[0] + y[1]) / 2) / 2


def test_simpson(spark):
    rng = np.random.default_rng(2)
    curves = {f"c{n}": rng.random(n) * 10 for n in range(1, 12)}
    rows = pd.DataFrame([(c, i, float(v)) for c, ys in curves.items() for i, v in enumerate(ys)], columns=["list", "step", "y"])
    got = ST.simpson_area(spark.createDataFrame(rows), ["list"], "step", "y").toPandas().set_index("list").area
    for c, ys in curves.items():
        assert got[c] == pytest.approx(simpson(list(ys))), c
    above = ST.simpson_area(spark.createDataFrame(rows), ["list"], "step", "y", above=4.0).toPandas().set_index("list").area
    assert above["c9"] == pytest.approx(simpson([max(v - 4, 0) for v in curves["c9"]]))


def test_auc_and_mean_roc(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"clf": "x", "iter": 1, "block": 0, "fold": rng.integers(0, 2, 300), "entity_id": [str(i) for i in range(300)],
                         "label": rng.integers(0, 2, 300), "proba": np.round(rng.random(300), 1)})
    df = spark.createDataFrame(rows)
    got = S.auc(df).toPandas().set_index("fold").auc
    for fold, part in rows.groupby("fold"):
        u, _, _ = brute_u(part[part.label == 1].proba.to_numpy(), part[part.label == 0].proba.to_numpy())
        assert got[fold] == pytest.approx(u / ((part.label == 1).sum() * (part.label == 0).sum()))
    curve = S.mean_roc(df).orderBy("point").toPandas()
    grid, lines = np.linspace(0, 1, 100), []
    for _, part in rows.groupby("fold"):
        cuts = sorted(part.proba.unique(), reverse=True)
        tpr = [0.0] + [((part.proba >= c) & (part.label == 1)).sum() / (part.label == 1).sum() for c in cuts]
        fpr = [0.0] + [((part.proba >= c) & (part.label == 0)).sum() / (part.label == 0).sum() for c in cuts]
        line = np.interp(grid, fpr, tpr)
        line[0] = 0.0
        lines.append(line)
    want = np.mean(lines, axis=0)
    want[-1] = 1.0
    assert np.allclose(curve.mean_tpr, want) and np.allclose(curve.sd_tpr, np.std(lines, axis=0))


def test_enrichment_steps(spark):
    ranking = pd.DataFrame({"entity_id": [f"e{i:03d}" for i in range(200)], "mean_score": [1 - i / 200 for i in range(200)]})
    order = np.random.default_rng(4).permutation(200)
    external = pd.DataFrame({"entity_id": [f"e{i:03d}" for i in order], "p": np.linspace(0, 0.2, 200), "external_rank": range(1, 201)})
    steps = E.hypergeom_steps(spark.createDataFrame(ranking), spark.createDataFrame(external), 0.1).toPandas().sort_values("step")
    top = external[external.entity_id < "e020"].reset_index(drop=True)
    assert steps.entity_id.tolist() == top.entity_id.tolist() and steps.hyper_p.iloc[0] == 1.0
    want = [exact_tail(x, 200, 20, int(r)) for x, r in enumerate(top.external_rank)]
    assert np.allclose(steps.hyper_p, want) and np.allclose(steps.phred, -10 * np.log10(want))
    assert steps.before_cutoff.tolist() == (top.p <= 0.05).astype(int).tolist()
    strict = E.hypergeom_steps(spark.createDataFrame(ranking), spark.createDataFrame(external), 0.1, strict=True, has_p=False,
                               max_overlap=3, remove=spark.createDataFrame([("e000",)], "entity_id string")).toPandas()
    assert sorted(strict.x) == list(range(1, 20)) and strict.before_cutoff.sum() == 3


def test_list_without_overlap_and_loading(spark):
    external = spark.createDataFrame([(f"x{i}", i / 10, i) for i in range(1, 11)], "entity_id string, p double, external_rank bigint")
    ranking = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "entity_id string, mean_score double")
    steps = E.hypergeom_steps(ranking, external, 0.5)
    assert steps.count() == 0 and E.best_enrichment(steps).first()["overlap"] == 0
    assert E.load_ranking(external, 0.3).count() == 3
    assert E.load_ranking(external, None, 0.3).count() == 4  # the cut includes its last row
    drop = spark.createDataFrame([("x1",)], "entity_id string")
    assert E.load_ranking(external, 0.3, without=drop).count() == 2
    with pytest.raises(ValueError):
        E.require_probabilities(external.withColumn("p", F.col("p") + 1))


def test_phred(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (5e-8,), (1e-12,), (None,)], "p double")
    got = rows.select(phred("p").alias("a"), phred_capped("p").alias("b")).collect()
    assert [r.a for r in got][1:4] == [0.0, pytest.approx(73.0103), 120.0] and got[0].a is None and got[4].a is None
    assert [r.b for r in got] == [80.0, 0.0, pytest.approx(73.0103), 80.0, 0.0]


def test_one_feature_models_reach_the_optimum(spark):
    rng = np.random.default_rng(3)
    n = 900
    kind = rng.integers(0, 3, n)  # two named classes and the negative set
    x = rng.normal(size=(n, 3)) + np.outer(kind, [1.0, 0.0, -0.5])
    x[:, 2] *= 1e4
    rows = [(f"e{i}", *map(float, x[i]), None if i % 50 == 0 else 1.0) for i in range(n)]
    table = spark.createDataFrame(rows, "entity_id string, a double, b double, c double, flat double")
    classes = spark.createDataFrame([(f"k{k}", f"e{i}") for i, k in enumerate(kind) if k] + [("k1", "gone"), ("k1", "e0")], "class string, entity_id string")
    negatives = spark.createDataFrame([(f"e{i}",) for i, k in enumerate(kind) if not k] * 2, "entity_id string")
    members = single.class_members(classes, negatives)
    assert members.groupBy("class", "entity_id").count().filter("count > 1").count() == 0
    got = {(r["class"], r["feature"]): r for r in single.one_feature_models(members, table, ["a", "b", "c", "flat"]).collect()}
    assert len(got) == 8
    parted = {(r["class"], r["entity_id"]): (r["label"], r["test"]) for r in single.shuffled_positions(
        members, "entity_id", "split", ["class", "label"], [], "_rn", "_n").selectExpr("class", "entity_id", "label", "_rn <= floor(_n * 0.2D) AS test").collect()}
    for (name, feature), r in got.items():
        own = [(i, *parted[name, f"e{i}"]) for i in range(n) if (name, f"e{i}") in parted]
        if feature == "flat":
            assert r["slope"] == 0 and r["auc"] == 0.5 and r["n_train"] + r["n_test"] == sum(i % 50 > 0 for i, _, _ in own)
            continue
        v = np.array([x[i, "abc".index(feature)] for i, _, _ in own])
        y, test = np.array([lab for _, lab, _ in own]), np.array([t for _, _, t in own])
        p = 1 / (1 + np.exp(-(r["intercept"] + r["slope"] * v[~test])))
        assert abs((y[~test] - p).sum()) < 1e-6 and abs(((y[~test] - p) * v[~test]).sum()) < 1e-6 * np.abs(v).max()
        s = r["slope"] * v[test]
        wins = (s[y[test] == 1][:, None] > s[y[test] == 0]).mean() + 0.5 * (s[y[test] == 1][:, None] == s[y[test] == 0]).mean()
        assert r["auc"] == pytest.approx(wins) and r["n_test"] == test.sum()


def test_density_against_the_sum_of_kernels(spark):
    rng = np.random.default_rng(5)
    values = {None: rng.normal(size=300), "a": rng.exponential(size=500), "one": np.ones(4)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)]
    got = S.density(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).toPandas()
    assert set(got.k.where(got.k.notna(), "none")) == {"none", "a"} and len(got) == 2 * 101
    for name, own in got.groupby(got.k.where(got.k.notna(), "none")):
        v = values[None if name == "none" else name]
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((own.x.to_numpy()[:, None] - v) / h) ** 2).sum(axis=1) / (h * np.sqrt(2 * np.pi) * len(v))
        assert np.abs(own.density - want).max() < 2e-3 * want.max()
        assert own.x.min() == pytest.approx(v.min() - 3 * h) and own.x.max() == pytest.approx(v.max() + 3 * h)
