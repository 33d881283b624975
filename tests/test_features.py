"""Cleaning, joining and preparing on small tables with the awkward cases in them."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seedlift.functions.text import INHERITANCE_TAGS, clean_column_name, tag_text, term_pattern
from seedlift.operators import features as X
from seedlift.operators import joins as J
from seedlift.operators import learners as L
from seedlift.operators import prep as P
from seedlift.operators import sets as U
from seedlift.operators import shadow
from seedlift.operators import terms as T


def test_attach_salts_hot_keys(spark):
    n = 3000
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 1, F.concat(
        F.lit("k"), F.col("id") % 50)).alias("k"))
    lookup = spark.createDataFrame([("hot", 1, "H")] + [(f"k{i}", i, None) for i in range(40)], "k string, a int, b string")
    small = J.attach(rows, lookup, "k").orderBy("id").toPandas()
    large = J.attach(rows, lookup, "k", small_values=0).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(small[["id", "k", "a", "b"]], large[["id", "k", "a", "b"]])
    assert len(large) == n and (large[large.k == "hot"].a == 1).all() and large[large.k == "k45"].a.isna().all()


def test_explode_keeps_whole_and_trims(spark):
    df = spark.createDataFrame([(1, "A, B"), (2, None), (3, "C"), (4, "")], "id int, g string")
    assert sorted(r.g for r in X.explode_delimited(df, "g", ",").collect()) == ["", "A", "B", "C"]
    assert sorted(r.g for r in X.explode_delimited(df, "g", ",", trim=False).collect()) == ["", " B", "A", "C"]
    assert sorted(r.g for r in X.explode_delimited(df, "g", ",", keep=True).collect()) == ["", "A", "A, B", "B", "C"]


def test_association_hits(spark):
    df = spark.createDataFrame([("A, B", "1e-9", 2.0, "kidney"), ("A", "5e-8", 9.0, "kidney"), ("A", "1e-12", 4.0, "heart kidney"),
                                ("C", "1e-20", None, "kidney"), ("Z", "1e-20", 1.0, "kidney")],
                               "names string, p string, effect double, trait string")
    universe = spark.createDataFrame([(e,) for e in "ABCD"], "entity_id string")
    got = {r.entity_id: r for r in X.association_hits(df, "names", "p", "effect", universe, phrase="trait", include=["KIDNEY"],
                                                      exclude=["heart"], prefix="Kidney_GWAS").collect()}
    assert sorted(got) == ["A", "B", "C", "D"]
    assert [got[e].Kidney_GWAS_hits for e in "ABCD"] == [1, 1, 1, 0]
    assert [got[e].Kidney_GWAS_flag for e in "ABCD"] == [1, 1, 1, 0]
    assert got["C"].Kidney_GWAS_max_E == 2.0 and got["D"].Kidney_GWAS_min_P == 1e-9


def test_best_rows_levels_and_sets(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("b", 9, None)], "k string, t int, v int")
    assert {(r.k, r.t) for r in X.best_rows(df, "k", F.col("v"), ["t"]).collect()} == {("a", 1), ("b", 9)}
    levels = spark.createDataFrame([("a", "Low"), ("a", "High"), ("b", "nan"), ("c", "Not detected"), ("c", "odd")], "g string, l string")
    assert {(r.entity_id, r.level) for r in X.ordinal_max(levels, "g", "l").collect()} == {
        ("a", "High"), ("b", None), ("c", "Not_detected")}
    sets = spark.createDataFrame([("GO kidney", "a"), ("GO kidney", "a"), ("GO kidney", "b"), ("GO other", "c")], "set_name string, entity_id string")
    assert X.large_sets(sets, 2).select("set_name").distinct().count() == 1
    flags = {r.entity_id: r.GO_kidney for r in X.set_flags(sets, ["kidney"]).collect()}
    assert flags == {"a": 1, "b": 1, "c": 0}


def test_neighbours(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "c"), ("d", "a")], "left string, right string")
    both = X.both_ways(edges)
    seeds = spark.createDataFrame([("c",), ("d",)], "entity_id string")
    got = {r.entity_id: r.seed_share for r in X.seed_share(both, seeds).collect()}
    assert got == {"a": 0.5, "b": 0.0, "c": 0.0, "d": 0.0}
    got = [tuple(r) for r in X.neighbour_lists(both).orderBy("entity_id", "pos").collect()]
    assert got[:3] == [("a", 1, "b", 1), ("a", 2, "c", 2), ("a", 3, "d", 1)]
    hub = spark.range(5000).select(F.lit("h").alias("entity_id"), F.lit("n").alias("neighbour"))
    assert [tuple(r) for r in X.neighbour_lists(hub).collect()] == [("h", 1, "n", 5000)]


def test_collapse_keeps_long_form(spark):
    rows = spark.createDataFrame([(1, "{z (3)", "misc", "q"), (1, "b (3)", "AD", "q"), (1, "b (3)", "AD", "r"), (1, "?a (3)", "other", "s"),
                                  (2, "x (3)", "AR", None)], "id int, phrase string, tag string, sym string")
    long = X.collapse_by_id(rows, "id", "phrase", "tag", ["sym"])
    first = [(r.value, r.tag, r.n) for r in long.filter("id = 1 AND field = 'phrase'").orderBy("pos").collect()]
    assert first == [("b (3)", "AD", 2), ("?a (3)", "other", 1), ("{z (3)", "misc", 1)]
    got = {r.id: r for r in X.joined_texts(long, "id", "phrase", "tag", ["sym"]).collect()}
    assert got[1].phrase == "b (3)|b (3)|?a (3)|{z (3)" and got[1].tag == "AD|AD|other|misc"
    assert got[1].sym == "q|r|s" and got[2].sym is None


def test_annotated_map(spark):
    df = spark.createDataFrame([(7, "S1", "{Odd}, Autosomal dominant (3); mapped (2)"), (7, "S2", "Rare, Autosomal recessive, somatic (3)"),
                                (8, None, "x (3)"), (9, "S9", None)], "mim int, sym string, ph string")
    rows = X.annotated_map(df, "mim", "ph", ["sym"], INHERITANCE_TAGS, required=["sym"])
    got = {r.mim: r for r in X.joined_texts(rows, "mim", "ph", "annotation", ["sym"]).collect()}
    assert sorted(got) == [7] and got[7].sym == "S1|S2" and got[7].annotation == "AR;som|AD;misc"


def test_names_and_terms(spark):
    assert clean_column_name("Brain - Cortex (BA9)") == "Brain_Cortex_BA9"
    assert term_pattern(["a.b", "c"]) == r"(?i)(?:a\.b|c)" and term_pattern(["a.b"], regex=True) == "(?i)(?:a.b)"
    assert T.term_columns(["Kidney_Cortex", "Liver", "kidney_tumor"], ["kidney"], ["tumor"]) == ["Kidney_Cortex"]
    with pytest.raises(ValueError):
        T.common_columns(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int"))
    tags = spark.createDataFrame([("Autosomal dominant [x]",), ("none",)], "p string").select(tag_text("p", INHERITANCE_TAGS).alias("t"))
    assert [r.t for r in tags.collect()] == ["AD;misc", "other"]
    assert X.add_on_for("Chronic kidney disease", {"cardi": 1, "kidney|renal": 2}) == 2
    features = spark.createDataFrame([("GTEx_Kidney_TPM_expression", 1.0), ("GTEx_Brain_TPM_expression", 3.0), ("Renal_GWAS_hits", 2.0),
                                      ("RVIS", 4.0)], "f string, v double")
    assert {(r.f, r.v) for r in X.homogenise(features, "f", ["v"]).collect()} == {
        ("GTEx_tissue_specific_TPM_expression", 3.0), ("Tissue_specific_GWAS_hits", 2.0), ("RVIS", 4.0)}


def test_lookup_list_and_joins(spark):
    rows = spark.createDataFrame([(1, "c a x"), (2, "x"), (3, None)], "id int, ids string")
    names = spark.createDataFrame([("a", "Aa"), ("c", "Cc")], "code string, name string")
    assert {(r.id, r.names) for r in J.lookup_list(rows, "id", "ids", names, "code", "name").collect()} == {
        (1, "Aa|Cc"), (2, None), (3, None)}
    dup = spark.createDataFrame([("a",), ("a",)], "entity_id string")
    with pytest.raises(ValueError):
        J.require_unique(dup)
    universe = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    one = spark.createDataFrame([("a", 2.0), ("q", 3.0)], "entity_id string, v double")
    assert {(r.entity_id, r.v) for r in J.reindex(one, universe).collect()} == {("a", 2.0), ("b", 0.0)}
    assert J.merge_onto_universe([one], universe).count() == 3


def test_lookup_list_names_ids_before_it_shuffles_them(spark):
    names = spark.createDataFrame([("a", "Aa"), ("c", "Cc")], "code string, name string")
    twice = spark.createDataFrame([(1, "c a c"), (1, "a b"), (None, "b")], "id int, ids string")
    listed = J.lookup_list(twice, "id", "ids", names, "code", "name")
    assert sorted((r.ids, r.names) for r in listed.collect()) == [("a b", "Aa|Cc"), ("b", None), ("c a c", "Aa|Cc")]
    keyed = re.findall(r"hashpartitioning\((.*?), \d+\)", listed._jdf.queryExecution().executedPlan().toString())
    assert keyed and not any("code" in k for k in keyed)


def test_assemble_keeps_every_seed(spark):
    universe = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    seeds = spark.createDataFrame([("a",), ("c",)], "entity_id string")
    table = spark.createDataFrame([("b", 1.0)], "entity_id string, x double")
    got = {r.entity_id: (r.label, r.x) for r in X.assemble(universe, seeds, [table], ["x"]).collect()}
    assert got == {"a": (1, 0.0), "b": (0, 1.0), "c": (1, 0.0)}


def test_preparation(spark):
    rng = np.random.default_rng(0)
    n = 60
    pdf = pd.DataFrame({"entity_id": [str(i) for i in range(n)], "label": (np.arange(n) < 9).astype(int), "a": rng.random(n)})
    pdf["same"], pdf["flat"], pdf["zero"], pdf["near"] = pdf.a * 2 + 1, 3.0, 0.0, pdf.a + rng.random(n) / 20
    pdf["b"], pdf["kind"], pdf["GeneSize"] = rng.random(n), rng.choice(["x", "y"], n), rng.random(n)
    df = spark.createDataFrame(pdf)
    full, kept = P.prepare(df)
    assert full.columns == ["entity_id", "label", "a", "flat", "near", "b", "kind_x", "kind_y"]
    assert kept.columns == ["entity_id", "label", "a", "flat", "b", "kind_x", "kind_y"]
    scaled = full.toPandas()
    assert np.allclose(scaled.a, (pdf.a - pdf.a.mean()) / pdf.a.std(ddof=0)) and np.allclose(scaled.flat, 0)
    narrow = {(r.i, r.j): r.r for r in P.correlations(df, ["a", "same", "near", "b"]).collect()}
    assert narrow[("a", "same")] == pytest.approx(1) and narrow[("a", "b")] == pytest.approx(np.corrcoef(pdf.a, pdf.b)[0, 1])
    assert {r.r for r in P.correlations(df, ["a", "flat"]).collect()} == {None}
    old, P.TILE = P.TILE, 2
    try:
        wide = {(r.i, r.j): r.r for r in P.correlations(df, ["a", "same", "near", "b"]).collect()}
    finally:
        P.TILE = old
    assert set(wide) == set(narrow) and all(wide[k] == pytest.approx(narrow[k]) for k in narrow)


def test_correlations_take_the_rows_that_have_both(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, None, 6], "b": [2.0, None, 6, 8, 10, 12], "c": [None, 1.0, None, 1, 1, 7], "d": [None] * 6})
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)],
                               "a double, b double, c double, d double")
    got = {(r.i, r.j): r.r for r in P.correlations(df, list("abcd")).collect()}
    want = pdf.astype(float).corr()
    for (i, j), r in got.items():
        assert (r is None) if np.isnan(want.loc[i, j]) else r == pytest.approx(want.loc[i, j]), (i, j)


def test_attach_has_one_schema(spark):
    from seedlift.operators.joins import attach

    rows = spark.createDataFrame([(i, i % 3, "g") for i in range(30)] + [(99, None, "h")], "id int, k int, g string")
    lookup = spark.createDataFrame([(0, "x"), (1, "y")], "k int, v string")
    small, large = attach(rows, lookup, "k"), attach(rows, lookup, "k", small_values=1)
    assert small.columns == large.columns == ["id", "k", "g", "v"]
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)


def test_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0, None, None), ("b", None, 4.0, None), ("c", 5.0, float("nan"), None), ("d", 2.0, 6.0, 1.0)],
                               "entity_id string, GnomAD_x double, GWAS_y double, rare double")
    clean = P.nan_to_null(df)
    profile = {r.feature: (r.n_null, r.pct_null) for r in P.null_profile(clean).collect()}
    assert profile == {"entity_id": (0, 0.0), "GnomAD_x": (1, 25.0), "GWAS_y": (2, 50.0), "rare": (3, 75.0)}
    assert P.drop_sparse(clean, 0.7).columns == ["entity_id", "GnomAD_x", "GWAS_y"]
    with pytest.raises(ValueError, match="GnomAD_x"):
        P.require_complete(clean)
    filled = P.fill_unknown(P.fill_zero(clean))
    assert [r.GnomAD_x for r in filled.orderBy("entity_id").collect()] == [1.0, 2.0, 5.0, 2.0]
    assert [r.GWAS_y for r in filled.orderBy("entity_id").collect()] == [0.0, 4.0, 0.0, 6.0]
    assert P.fill_unknown(clean, mode="zero").filter("GnomAD_x = 0").count() == 1
    level = spark.createDataFrame([("a", None), ("b", "High")], "entity_id string, ProteinAtlas_gene_expr_levels string")
    assert [r[1] for r in P.fill_zero(level).orderBy("entity_id").collect()] == ["Not_detected", "High"]


def test_sets(spark):
    a, b, c = set(range(0, 30)), set(range(20, 50)), set(range(25, 28)) | {90}
    sets = spark.createDataFrame([(n, str(e)) for n, s in zip("abc", (a, b, c)) for e in s], "set_name string, entity_id string")
    got = {r.combination: r.n for r in U.exclusive_intersections(sets).collect()}
    assert got == {"a": 20, "b": 20, "a&b": 7, "a&b&c": 3, "c": 1} and sum(got.values()) == U.in_any(sets).count()
    assert {r.combination for r in U.exclusive_intersections(sets, size=(3, 10), degree=(2, 2)).collect()} == {"a&b"}
    assert U.only_in(sets, "c").count() == 1 and U.shared_by_all(sets, 3).count() == 3
    assert [r.n for r in U.set_sizes(sets).collect()] == [30, 30, 4]


def test_shadow_decisions(spark):
    rows = spark.createDataFrame([(r, "f", "Confirmed") for r in range(6)] + [(0, "g", "Tentative")], "run int, feature string, decision string")
    got = {r.feature: (r.confirmed, r.rejected, r.final) for r in shadow.final_decisions(rows, 10).collect()}
    assert got == {"f": (60.0, 40.0, "Confirmed"), "g": (0.0, 90.0, "Rejected")}


def test_medians_are_exact(spark):
    rng = np.random.default_rng(8)
    n = 6001
    pdf = pd.DataFrame({"entity_id": [f"e{i}" for i in range(n)], "a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float),
                        "c": np.where(rng.random(n) < 0.4, np.nan, rng.exponential(size=n)), "e": np.nan})
    df = P.nan_to_null(spark.createDataFrame(pdf))
    got = X.medians(df, ["a", "b", "c", "e"])
    for c in "abc":
        assert got[c] == pytest.approx(pdf[c].median(), rel=1e-12), c
    assert got["e"] is None
    few = X.medians(df.limit(0), ["a"])
    assert few == {"a": None}
    two = X.medians(spark.createDataFrame([("x", 1.0), ("y", 4.0)], "entity_id string, a double"), ["a"])
    assert two == {"a": 2.5}


def test_vectors_of_very_many_values(spark):
    """50,000 values make vectors of 50,001 places and two entries, which MLlib's learners take as they are."""
    df = spark.range(100_000).select(
        F.col("id").cast("string").alias("entity_id"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 1000 > 0, F.concat(F.lit("v"), F.col("id") % 50_000)).alias("kind"), (F.col("id") % 7).cast("double").alias("x"))
    out = P.coded_vectors(df, ["kind"], ["x"], "coded")
    assert out.columns == [*df.columns, "coded"]
    places = df.select("kind").dropna().distinct().count() + 1
    for r in out.limit(50).collect():
        assert r["coded"].size == places
        assert r["coded"].numNonzeros() == (r["x"] > 0) + (r["kind"] is not None)
    same = out.filter("kind = 'v17'").select("coded").distinct().count()
    assert same == out.filter("kind = 'v17'").select("x").distinct().count()
    blocks = out.withColumns({"iter": F.lit(1), "block": F.lit(0), "fold": (F.col("entity_id").cast("int") % 2)}).limit(4000)
    scores, _ = L.fit_folds(blocks, ["coded"], {"LR": L.logistic()})
    assert scores.count() == 4000


def test_supplement_wins_and_ties_are_settled(spark):
    mapping = spark.createDataFrame([("a", "z"), ("a", "y"), ("b", "m")], "entity_id string, target string")
    extra = spark.createDataFrame([("b", "s"), ("c", "q")], "entity_id string, target string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "entity_id string")
    mapped, missing = J.map_ids(rows, mapping, extra)
    assert {(r.entity_id, r.target) for r in mapped.collect()} == {("a", "y"), ("b", "s"), ("c", "q")}
    assert [r.entity_id for r in missing.collect()] == ["d"]
