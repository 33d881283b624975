"""Segments against brute force; held-out accuracy; labels that must not leak."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from seedlift.llm import toxicity


def brute_segments(scores):
    """Maximal scoring segments by their definition, recursively around the best one."""
    best, where = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, where = total, (i, j + 1)
    if where is None:
        return []
    low, high = where
    left = [(s, e, v) for s, e, v in brute_segments(scores[:low])]
    right = [(s + high, e + high, v) for s, e, v in brute_segments(scores[high:])]
    return [*left, (low, high, best), *right]


def test_segments_by_definition():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 25)
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        values = [round(rng.uniform(-2, 3), 3) for _ in at]
        scores = [-0.37] * n
        for i, v in zip(at, values):
            scores[i] = v
        got = [(s, e, round(v, 6)) for s, e, v in toxicity.maximal_segments(at, values, -0.37)]
        assert got == [(s, e, round(v, 6)) for s, e, v in brute_segments(scores)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    bad = [f"insult{i}" for i in range(8)]
    rows, marks = [], []
    for i in range(600):
        words, toxic = prose(i, rng.randint(20, 200), 300).split(), int(i % 6 == 0)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        marks.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")


def test_held_out_accuracy_and_passages(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    scored = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    assert sum((r["score"] >= 0.5) == r["toxic"] for r in scored) >= 0.98 * len(scored)
    assert all(0 <= r["score"] <= 1 for r in scored)
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    assert all("insult" in " ".join(texts[r["doc_id"]][p["start"]:p["end"]]) for r in scored if r["toxic"] for p in r["passages"])


def test_odd_rows_and_tables(spark, labelled, odd, empty):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(r["score"] < 0.5 for r in got)
    assert toxicity.score(empty, model).count() == 0
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    assert toxicity.fit(odd, some) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.fit(empty, labels) is None
    assert toxicity.without_toxic(odd, labels.limit(0)).count() == odd.count()


def test_toxic_documents_go(labelled, odd):
    docs, labels = labelled
    clashing = docs.withColumn("_id", F.lit(1)).withColumn("_key", F.lit("x")).withColumn("mark", F.lit(2))
    kept = toxicity.without_toxic(clashing, labels)
    assert kept.columns == clashing.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len(ids & {r["doc_id"] for r in labels.filter("toxic = 1").collect()}) <= 2
    assert len(ids) >= 495
