"""Kneser-Ney probabilities against the textbook; thresholds on trusted text."""

import math
import random
from collections import Counter, defaultdict

from tests.llm.conftest import prose
from seedlift.llm import quality


class Textbook:
    def __init__(self, texts, order):
        self.order, self.levels = order, []
        strings = Counter()
        for t in texts:
            data = b"\xff" * (order - 1) + t.encode() + b"\xff"
            strings.update(data[i:i + order] for i in range(len(data) - order + 1))
        counts = [strings]
        for _ in range(order - 1):
            counts.append(Counter(s[1:] for s in counts[-1]))
        for table in reversed(counts):
            n = [sum(c == i for c in table.values()) for i in range(1, 5)]
            if all(n[:3]):
                y = n[0] / (n[0] + 2 * n[1])
                cuts = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
                cuts = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(cuts)]
            else:
                cuts = [0.5, 0.75, 0.9]
            total, left = Counter(), defaultdict(float)
            for s, c in table.items():
                total[s[:-1]] += c
                left[s[:-1]] += cuts[min(c, 3) - 1]
            self.levels.append((table, total, left, cuts))

    def p(self, s):
        if not s:
            return 1 / 256
        table, total, left, cuts = self.levels[len(s) - 1]
        shorter = self.p(s[1:])
        if not total[s[:-1]]:
            return shorter
        own = table[s] - cuts[min(table[s], 3) - 1] if table[s] else 0
        return own / total[s[:-1]] + left[s[:-1]] / total[s[:-1]] * shorter

    def perplexity(self, text):
        data = b"\xff" * (self.order - 1) + text.encode() + b"\xff"
        logs = [math.log10(self.p(data[i:i + self.order])) for i in range(len(text.encode()) + 1)]
        return 10 ** (-sum(logs) / len(logs))


def test_probabilities_against_the_textbook(spark):
    texts = [prose(i, 30, 20) for i in range(12)] + ["Élan né à Brême", ""]
    probes = ["w1x1 w2x2", "unseen!", "", "É", texts[0]]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"), 4)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(probes)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(docs, model, quality.F.lit(False)).collect()}
    book = Textbook(texts, 4)
    for i, t in enumerate(probes):
        assert math.isclose(got[i], book.perplexity(t), rel_tol=1e-5), t


def test_junk_is_rejected_by_language(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, 80, 60), "en") for i in range(120)]
    rows += [(200 + i, "".join(rng.choice("%&*#!") for _ in range(200)), "en" if i % 2 else None) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in [*range(0, 100), 200, 201]], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert not any(got[200 + i]["keep"] for i in range(10))
    assert sum(got[i]["keep"] for i in range(100, 120)) >= 18
    assert got[200]["threshold"] is not None  # a language without trusted text takes the common one


def test_thresholds_use_all_trusted_rows_that_the_model_does_not_see(spark):
    docs = spark.createDataFrame([(i, prose(i, 40, 60), "en") for i in range(300)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id bigint, quality int")
    marked = {r["_id"]: r["_seen"] for r in quality.trusted_rows(labels, 40).collect()}
    assert len(marked) == 300 and 20 <= sum(marked.values()) <= 40
    got = quality.judge(docs, labels, most=40, quantile=0.5).collect()
    unseen = sorted(r["perplexity"] for r in got if not marked[r["doc_id"]])
    below = sum(p <= got[0]["threshold"] for p in unseen)
    assert len(unseen) >= 260 and abs(below - len(unseen) / 2) <= 1


def test_the_model_sees_three_in_four_of_all_trusted_rows(spark):
    labels = spark.range(44_000).select(quality.F.col("id").alias("doc_id"), quality.F.lit(1).alias("quality"))
    seen = quality.trusted_rows(labels).filter("_seen").count()
    assert abs(seen - 33_000) < 600


def test_no_single_row_sets_the_threshold_of_a_small_language(spark):
    rows = [(i, "en", True, 100, 5 + i % 100 / 100) for i in range(1000)] + [(2000 + i, "fr", True, 100, 5 + i / 20) for i in range(19)]
    rows += [(3000, "fr", True, 100, 200.0)]
    scored = spark.createDataFrame(rows, "doc_id bigint, lang string, trusted boolean, n_bytes bigint, perplexity double")
    by_lang, whole = quality.thresholds(scored, quality.QUANTILE)
    got = {r["_lang"]: r["_q"] for r in by_lang.collect()}
    assert 5.9 < got["en"] < 6.1 and 5.5 < got["fr"] < 12 and 5.9 < whole < 6.1


def test_odd_rows_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, 0), (None, 1), (9, None), (12, 1)], "doc_id bigint, quality int")
    got = quality.judge(odd, labels).collect()
    assert len(got) == odd.count() and all(r["perplexity"] > 0 for r in got)
    assert quality.judge(empty, labels).count() == 0
    plain = quality.judge(odd, labels.limit(0)).collect()
    assert all(r["keep"] and math.isclose(r["perplexity"], 256, rel_tol=1e-6) for r in plain)
