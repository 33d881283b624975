import math
import random

import numpy as np
from pyspark.sql import functions as F

from seedlift.llm import topk


def brute(rows, k):
    clean = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for at, (q, a) in enumerate(clean):
        if q % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for j, (i, b) in enumerate(clean) if j != at)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_against_brute_force_with_ties_nulls_and_hot_vectors(spark):
    rng = random.Random(4)
    same = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(i, same if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(12)]) for i in range(300)]
    rows += [(None, same), (400, None), (410, [None] * 12), (420, [float("nan")] * 12), (430, [float("inf")] + [0.0] * 11), (440, [0.0] * 12)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for blocks, batch in ((4096, 512), (50, 7)):
        got = topk.top_k(topk.quantised(table), F.col("id") % 10 == 0, 10, blocks, batch).collect()
        assert {tuple(r) for r in got} == brute(rows, 10)


def test_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id bigint, embedding array<double>")
    got = topk.top_k(topk.quantised(table), F.col("id") == 0, 10).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 2097152), (0, 2, 2, -1048576)]
    assert topk.top_k(topk.quantised(table.limit(0)), F.col("id") == 0).count() == 0


def test_scan_stops_before_the_end():
    rng = np.random.default_rng(1)
    rows = np.floor(1024 * rng.standard_normal((4000, 16)) * (2.0 ** -np.arange(16))).astype(np.int64)
    index, query = topk.Index(rows), rows[5]
    found, scores = index.search(query, np.arange(4000), 5, 10)
    want = np.lexsort((np.arange(4000), -(rows @ query)))
    assert found.tolist() == [i for i in want.tolist() if i != 5][:10]
