"""Distributed ranks, sums and quantiles against pandas and numpy, with hot keys and values."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seedlift.operators import order as O


@pytest.fixture(scope="module")
def skewed():
    """One key holds most rows and one value a third of them."""
    rng = np.random.default_rng(5)
    n = 900
    return pd.DataFrame({
        "id": [f"e{i:04d}" for i in range(n)],
        "k": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcd"), n)),
        "v": np.where(rng.random(n) < 0.35, 7.0, rng.integers(0, 40, n).astype(float)),
    })


def test_number_rows_within_hot_key(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = O.number_rows(df, [F.desc("v"), F.col("id")], "pos", ["k"], "n", ranges=6).toPandas()
    want = skewed.sort_values(["v", "id"], ascending=[False, True])
    want["pos"] = want.groupby("k").cumcount() + 1
    merged = got.merge(want, on=["id", "k", "v"])
    assert len(got) == len(skewed) and (merged.pos_x == merged.pos_y).all()
    assert (got.n == got.k.map(skewed.k.value_counts())).all()


def test_number_rows_whole_table(spark, skewed):
    got = O.number_rows(spark.createDataFrame(skewed), ["v", "id"], "pos", total="n", ranges=5).toPandas()
    assert got.sort_values("pos").id.tolist() == skewed.sort_values(["v", "id"]).id.tolist()
    assert sorted(got.pos) == list(range(1, len(skewed) + 1)) and set(got.n) == {len(skewed)}


def test_hot_value_spans_ranges_and_ranks_alike(spark, skewed):
    df = spark.createDataFrame(skewed)
    laid = O.lay_out(df, ["v", "id"], 6)
    assert laid.filter("v = 7").select(O.RANGE).distinct().count() > 1
    got = O.average_ranks(df, "v", ["k"]).toPandas()
    want = skewed.assign(r=skewed.groupby("k").v.rank())
    merged = got.merge(want, on="id")
    assert np.allclose(merged.rank_avg, merged.r)
    pct = O.percentile_ranks(df, "v").toPandas().merge(skewed.assign(r=100 * skewed.v.rank(pct=True)), on="id")
    assert np.allclose(pct.percentile, pct.r)


def test_running_sums(spark, skewed):
    got = O.running(spark.createDataFrame(skewed), ["v", "id"], {"s": F.col("v")}, ["k"], totals=True, ranges=7).toPandas()
    want = skewed.sort_values(["v", "id"])
    want["s"] = want.groupby("k").v.cumsum()
    merged = got.merge(want, on="id")
    assert np.allclose(merged.s_x, merged.s_y)
    assert np.allclose(got.s_total, got.k.map(skewed.groupby("k").v.sum()))


def test_exact_quantiles(spark, skewed):
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    holes = skewed.assign(v=skewed.v.where(skewed.index % 11 != 0))
    got = O.exact_quantiles(spark.createDataFrame(holes.astype(object).where(holes.notna(), None), "id string, k string, v double"),
                            "v", probs, "id", ["k"]).toPandas()
    for k, part in holes.dropna().groupby("k"):
        mine = got[got.k == k].set_index("prob")["quantile"]
        assert np.allclose([mine[p] for p in probs], np.quantile(part.v, probs))


def test_shuffled_positions_follow_md5(spark, skewed):
    got = O.shuffled_positions(spark.createDataFrame(skewed), "id", "s", ["k"], total="n").toPandas()
    for k, part in got.groupby("k"):
        order = sorted(part.id, key=lambda i: hashlib.md5(f"s:{k}:{i}".encode()).hexdigest())
        assert part.sort_values("rn").id.tolist() == order and set(part.n) == {len(part)}


def test_value_steps(spark, skewed):
    got = O.value_steps(spark.createDataFrame(skewed), "v", {"n": F.lit(1)}, descending=True).toPandas()
    counts = skewed.v.value_counts().sort_index(ascending=False)
    got = got.sort_values("v", ascending=False)
    assert got.n_here.tolist() == counts.tolist() and got.n.tolist() == counts.cumsum().tolist()
