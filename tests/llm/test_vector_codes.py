import hashlib
import math
import random

import numpy as np
import pytest

from seedlift.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<double>, label int, v string, code int, _none int, error int"


def kept(rows, width):
    out = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
           if v is not None and all(x is not None and math.isfinite(x) for x in v) and len(v) == width]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def brute(rows, width, parts, entries, rounds):
    rows = kept(rows, width)
    cut = width // parts
    split = [[v[p * cut:(p + 1) * cut] for p in range(parts)] for _, v, _ in rows]
    books = [[list(s[p]) for s in split[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            got = [near(s[p], book)[1] for s in split]
            for e in range(len(book)):
                own = [s[p] for s, g in zip(split, got) if g == e]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own)]
    found = [[near(s[p], books[p]) for p in range(parts)] for s in split]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, label), e in zip(rows, errors):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, sums[label], digest)
                   for (i, _, label), f, err in zip(rows, found, errors)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3) for i, v, label in rows], SCHEMA).repartition(3)


def result(frame):
    return sorted((tuple(r) for r in frame.drop("label").collect()), key=str)


def test_against_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(1)
    same = [rng.gauss(0, 0.1) for _ in range(8)]
    rows = [(i, same if i % 3 == 0 else [round(rng.gauss(0, 0.05), 2) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += [(7, same, 1), (7, [0.5] * 8, 1), (None, same, None), (None, [0.25] * 8, 2)]  # repeated and null ids
    rows += [(500, None, 1), (501, [], 1), (502, [None] + [0.0] * 7, 1), (503, [float("nan")] * 8, 1), (504, [float("inf")] * 8, 2),
             (505, [0.0] * 12, 1), (506, [0.0] * 7, 1)]
    for entries, rounds in ((64, 2), (5, 1), (13, 3)):
        got, books = V.compress(table(spark, rows), 4, entries, rounds)
        assert result(got) == brute(rows, 8, 4, entries, rounds)
        assert books.shape == (4, entries, 2)


def test_few_and_no_vectors(spark):
    rows = [(3, [1.0, -1.0], None), (1, [0.5, 0.001], 4)]
    assert result(V.compress(table(spark, rows), 2)[0]) == brute(rows, 2, 2, 64, 2)
    for none in ([], [(1, None, 2), (2, [], 1), (3, [float("nan")] * 2, 1)]):
        got, books = V.compress(table(spark, none) if none else table(spark, rows).limit(0), 2)
        assert got.count() == 0 and books.size == 0
        assert got.drop("label").columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_too_large_components_are_told(spark):
    with pytest.raises(Exception, match="would not fit 64 bits"):
        V.compress(table(spark, [(1, [1e300, 0.0], 1)]), 2)


@pytest.mark.parametrize("degree", [1, 2, 5, 70])
@pytest.mark.parametrize("spread", [1, 3, 1000, 1 << 26])
def test_tree_finds_the_nearest_and_the_lowest_of_ties(degree, spread):
    rng = np.random.default_rng(spread + degree)
    points = rng.integers(-spread, spread + 1, (64, 4))
    points[40:50] = points[3]
    queries = np.vstack([rng.integers(-2 * spread, 2 * spread + 1, (500, 4)), points])
    gaps = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    found, best = V.nearest(V.Gnat(points, np.arange(64), degree), queries)
    assert (best == gaps.min(axis=1)).all() and (found == gaps.argmin(axis=1)).all()


def test_tree_rules_subtrees_out():
    rng = np.random.default_rng(3)
    points = (rng.integers(0, 8, (64, 1)) * 10_000 + rng.integers(0, 50, (64, 4)))
    measured = []
    before = V.squared
    tree = V.Gnat(points, np.arange(64))
    V.squared = lambda a, b: measured.append(len(a)) or before(a, b)
    try:
        V.nearest(tree, points)
    finally:
        V.squared = before
    assert sum(measured) < 64 * 64 / 3
