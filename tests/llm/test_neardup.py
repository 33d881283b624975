"""Signatures against the similarity they estimate; classes against brute force."""

import re
from itertools import combinations

import numpy as np

from tests.llm.conftest import edited, prose
from seedlift.llm import neardup
from seedlift.llm.dartminhash import signatures
from seedlift.llm.words import mix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def brute(rows):
    """Least doc_id of each row's class."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i, j in combinations(range(len(rows)), 2):
        alike = (rows[i][1] or "") == (rows[j][1] or "")
        if alike or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def test_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    elements = mix(np.arange(1, 301, dtype=np.uint64))
    a = rng.exponential(3, 300)
    b = np.where(rng.random(300) < 0.7, a, rng.exponential(3, 300))
    ranks = signatures(np.concatenate([elements, elements]), np.array([0, 300, 600]), 4096, np.concatenate([a, b]))
    assert abs((ranks[0] == ranks[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_agreement_is_jaccard_of_sets_and_repeats_do_not_count():
    elements = mix(np.arange(1, 451, dtype=np.uint64))
    one, two = elements[:300], np.concatenate([elements[100:], elements[100:]])
    ranks = signatures(np.concatenate([one, two, one[:1]]), np.array([0, 300, 1000, 1001]), 4096)
    assert abs((ranks[0] == ranks[1]).mean() - 200 / 450) < 0.04
    assert np.isfinite(ranks).all()  # one element fills every coordinate
    assert np.isinf(signatures(one[:0], np.array([0, 0]), 8)).all()


def test_odd_rows_against_brute_force(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [(r["doc_id"], r["class_id"]) for r in neardup.classes(odd).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    assert sorted(got, key=order) == sorted(zip([d for d, _ in rows], brute(rows)), key=order)


def test_chain_of_near_copies_and_large_group(spark):
    base = prose(1, 200)
    rows = [(i, edited(base, 50 + i % 40)) for i in range(40)] + [(100 + i, base) for i in range(60)]
    rows += [(200, edited(base, 8)), (300, prose(2, 200))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert [got[d] for d, _ in rows] == brute(rows)


def test_members_of_a_bucket_that_no_early_pivot_links_are_compared(spark):
    base = prose(3, 200)
    docs = [(1, prose(1, 200)), (2, prose(2, 200)), (3, base), (4, edited(base, 90))]
    assert len(set(brute(docs))) == 3
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    # 1 and 2 share the most buckets, so they are the first pivots, and link nothing.
    buckets = spark.createDataFrame([(1, [7, 8, 9]), (2, [7, 8, 9]), (3, [7]), (4, [7])], "doc_id bigint, bands array<bigint>")
    first = neardup.F.struct(neardup.F.lit(False).alias("none"), "doc_id").alias("_first")
    texts = docs.join(buckets, "doc_id").select(neardup.text_key("text").alias("key"), first, "bands")
    labels = neardup._labels(docs, texts, 0.8, 5, "doc_id", "text")
    got = texts.join(labels, "key", "left").select("_first.doc_id", neardup.F.coalesce("label", "key").alias("label")).collect()
    assert len({bytes(r["label"]) for r in got}) == 3
    assert len({bytes(r["label"]) for r in got if r["doc_id"] > 2}) == 1


def test_one_document_of_each_class_stays(odd, empty):
    kept = neardup.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len({(t or "") for _, t in rows})
    ids = [d for d, _ in rows]
    assert 1 in ids and 2 not in ids and 3 not in ids and 6 in ids and 7 not in ids and ids.count(11) == 2
    assert neardup.without_near_duplicates(empty).count() == 0
