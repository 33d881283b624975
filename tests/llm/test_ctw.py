"""Context-tree weighting against a plain recursive tree; word scores against counting."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedlift.llm import ctw
from tests.llm.conftest import unlike_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def log_kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


class Tree:
    """Weighted probabilities by the definition, one context at a time."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            for context, node, bit in self.steps(text):
                for d in range(depth + 1):
                    self.counts[context[depth - d:], node][bit] += 1
                    if d:
                        self.children[context[depth - d + 1:], node].add(context[depth - d:])
        self.known = {}

    def steps(self, text):
        data = text.translate(LOWER).encode() + b"\xff"
        padded = b"\xff" * self.depth + data
        for i, byte in enumerate(data):
            node = 1
            for j in range(8):
                bit = byte >> (7 - j) & 1
                yield padded[i:i + self.depth], node, bit
                node = 2 * node + bit

    def weighted(self, context, node):
        if (context, node) not in self.known:
            own = log_kt(*self.counts.get((context, node), (0, 0)))
            if len(context) < self.depth:
                below = sum(self.weighted(c, node) for c in self.children.get((context, node), ()))
                own = np.logaddexp(own, below) - math.log(2)
            self.known[context, node] = own
        return self.known[context, node]

    def chance(self, context, node, bit, d=0):
        here = context[self.depth - d:]
        zeros, ones = self.counts.get((here, node), (0, 0))
        own = ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
        if d == self.depth:
            return own
        weight = math.exp(log_kt(zeros, ones) - math.log(2) - self.weighted(here, node))
        return weight * own + (1 - weight) * self.chance(context, node, bit, d + 1)

    def score(self, text):
        return sum(math.log10(self.chance(*step)) for step in self.steps(text))


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 100.5, 1e4, 1e8])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("depth", [2, 4])
def test_scores_against_the_definition(spark, depth):
    texts = ["Abra cadabra abra", "banana bandana", "", "ABRA, né à Brême", "zebra\tabra\n", "banana bandana"]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "unseen ÿ"])), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ctw.scores(docs, F.col("doc_id") < 6, depth).collect()}
    tree = Tree(texts, depth)
    words = Counter(w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)))
    total, types = sum(words.values()) + 6, len(words) + 1
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (types + 1)))
    for i, text in enumerate([*texts, "", "unseen ÿ"]):
        own = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        assert math.isclose(got[i]["score"], tree.score(text), rel_tol=1e-9), (i, text)
        assert math.isclose(got[i]["base_score"], sum(log(words[w]) for w in own) + log(6), rel_tol=1e-9)
        assert got[i]["n_tokens"] == len(own) + 1 and got[i]["n_known"] == sum(words[w] > 0 for w in own) + 1
        assert got[i]["train_tokens"] == total and got[i]["trains"] == (i < 6)


def test_odd_rows_and_empty_tables(odd, empty):
    rows = ctw.scores(odd, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 and r["trains"] is not None for r in rows)
    assert ctw.scores(empty, F.lit(True)).count() == 0
    blank = ctw.scores(odd.filter("doc_id = 9"), F.lit(False)).first()
    assert math.isclose(blank["score"], 5 * 8 * math.log10(0.5)) and blank["n_known"] == 0


def test_long_words_are_told_apart(spark):
    one, two = unlike_words()
    docs = spark.createDataFrame([(1, one, True), (2, two, False), (3, one.upper(), False)], "doc_id bigint, text string, train boolean")
    known = {r["doc_id"]: r["n_known"] for r in ctw.scores(docs, F.col("train")).collect()}
    assert known == {1: 2, 2: 1, 3: 2}
