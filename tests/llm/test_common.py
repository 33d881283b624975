"""Components against a plain union, in both forms, and what they leave on disk."""

import random
from pathlib import Path

import pytest

from seedlift import runtime
from seedlift.llm import common


def united(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        one, two = sorted((find(a), find(b)))
        parent[two] = one
    return {x: find(x) for x in list(parent)}


def folders(spark):
    return set(Path(runtime.checkpoint_root(spark).removeprefix("file://")).glob("*-*"))


@pytest.mark.parametrize("few", [common.NARROW_ROWS, 0])
def test_components_and_what_further_links_join(spark, monkeypatch, few):
    monkeypatch.setattr(common, "NARROW_ROWS", few)
    rng = random.Random(7)
    first = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]  # a chain and a star
    first += [tuple(rng.sample(range(200, 260), 2)) for _ in range(40)] + [(40, 39), (5, 6), (300, 300)]
    more = [(20, 115), (400, 401), (401, 402), (210, 500), (3, 4)]
    schema = "a int, b int"
    before = folders(spark)
    labels = common.components(spark.createDataFrame(first, schema))
    assert {r["node"]: r["label"] for r in labels.collect()} == united(first)
    after = common.grown(labels, spark.createDataFrame(more, schema))
    rows = after.collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["label"] for r in rows} == united(first + more)
    assert {r["node"]: r["label"] for r in common.grown(after, spark.createDataFrame([(1, 2)], schema)).collect()} == united(first + more)
    left = folders(spark) - before
    assert not [f for f in left if f.name.startswith("joined-")]


def test_no_links(spark):
    none = spark.createDataFrame([], "a int, b int")
    assert common.components(none).count() == 0
    assert common.grown(common.components(none), none).count() == 0
