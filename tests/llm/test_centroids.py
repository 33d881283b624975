import hashlib
import math
import random

import numpy as np
import pytest

from seedlift.llm import centroids as C

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, cluster string, distance int"


def brute(rows, k, rounds, width):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    books = [v for _, v in drawn[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(books))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in rows]
        for n in range(len(books)):
            own = [v for (_, v), a in zip(rows, at) if a == n]
            if own:
                books[n] = [sum(c) // len(own) for c in zip(*own)]
    found = [near(v) for _, v in rows]
    sums = [sum(d for d, n in found if n == c) for c in range(len(books))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in books]
    return sorted(((i, n, d, sums[n], sum(sums), digests[n]) for (i, _), (d, n) in zip(rows, found)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA).repartition(3)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_against_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(2)
    same = [rng.choice([-0.5, 0.25]) for _ in range(6)]
    # Few different values, all exact in 32 bits, so that many distances tie.
    rows = [(i, same if i % 3 == 0 else [rng.choice([-0.5, 0.25, 0.75]) for _ in range(6)]) for i in range(300)]
    rows += [(8, same), (8, [0.0] * 6), (None, same), (None, [1.0] * 6), (None, None)]
    rows += [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] + [0.0] * 5), (404, [float("-inf")] * 6), (405, [0.0] * 5)]
    for k, rounds in ((16, 3), (1, 2), (7, 0), (400, 1)):
        got, books = C.cluster(table(spark, rows), k, rounds, width=6)
        assert result(got) == brute(rows, k, rounds, 6)
        assert books.shape[1] == 6


def test_no_vectors(spark):
    rows = [(1, None), (2, []), (3, [float("nan")] * 6), (4, [0.0] * 5)]
    for frame in (table(spark, rows), table(spark, rows).limit(0)):
        got, _ = C.cluster(frame, width=6)
        assert got.count() == 0
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("spread", [1, 4, 1000, 1 << 26])
def test_walks_end_at_the_nearest_and_the_lowest_of_ties(spread):
    rng = np.random.default_rng(spread)
    centroids = rng.integers(-spread, spread + 1, (40, 8))
    centroids[20:25] = centroids[7]
    rows = np.vstack([rng.integers(-spread, spread + 1, (400, 8)), centroids])
    gaps = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
    at, best, _ = C.Orchard(centroids).search(rows)
    assert (best == gaps.min(axis=1)).all() and (at == gaps.argmin(axis=1)).all()


def test_walks_stop_early():
    rng = np.random.default_rng(5)
    centroids = rng.integers(0, 10_000, (60, 3))
    rows = centroids[rng.integers(0, 60, 2000)] + rng.integers(0, 100, (2000, 3))
    _, _, measured = C.Orchard(centroids).search(rows)
    assert measured < 2000 * 60 / 2
