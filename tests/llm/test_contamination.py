"""Window hits against a plain search."""

import hashlib
import re

from tests.llm.conftest import prose
from seedlift.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, n=13):
    out = []
    for doc, text in docs:
        own, hit, named = words(text), set(), set()
        for item, other in items:
            theirs = words(other)
            for s in range(max(len(theirs) - n, 0) + 1 if theirs else 0):
                window = theirs[s:s + n]
                for at in range(len(own) - len(window) + 1):
                    if own[at:at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        named.add(str(item))
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    item, long = prose(1, 20, 50), prose(2, 30, 50)
    items = [(1, item), (2, long), (10, item), (3, "Élan, The end"), (4, None), (5, ""), (6, "the"), (None, "zz top"), (7, "a a a"), (7, "b b")]
    docs = [(1, "pre " + item.upper().replace(" ", "; ") + " post"), (2, prose(3, 600) + " " + " ".join(long.split()[5:20])),
            (3, "élan the end"), (4, "Élan THE  end."), (5, ""), (6, None), (7, "a a a a a"), (8, prose(4, 30)), (9, "zz top"),
            (10, " ".join(long.split()[:12])), (1, "pre " + item), (1, "pre " + item), (None, item), (11, "the " * 50)]
    got = contamination.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    # A null item has no name, so it is not counted but its words are hit.
    want = brute(docs, [(i, t) for i, t in items if i is not None])
    have = sorted((tuple(r) for r in got.collect()), key=str)
    assert [h for h in have if h[0] != 9] == [w for w in want if w[0] != 9]


def test_slices_of_a_long_term_list_change_nothing(spark):
    items = spark.createDataFrame([(i, prose(i, 20)) for i in range(10)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, prose(i, 20) + " " + prose(100 + i, 40)) for i in range(15)], "doc_id bigint, text string")
    whole = {tuple(r) for r in contamination.contamination(docs, items).collect()}
    assert whole == {tuple(r) for r in contamination.contamination(docs, items, most=20).collect()}
    assert sum(r[5] for r in whole) == 10


def test_odd_rows_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, prose(2, 70))], "item_id bigint, text string")
    got = {r["doc_id"]: r["contaminated"] for r in contamination.contamination(odd, items).collect()}
    assert {d for d, c in got.items() if c} == {4, 5}
    kept = contamination.without_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert contamination.contamination(empty, items).count() == 0
    assert contamination.without_contaminated(odd, items.limit(0)).count() == odd.count()


def test_proximity(spark):
    items = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "blue x green red"), (2, "red green"), (3, "red a b c d e green blue")], "doc_id bigint, text string")
    keys = {r["key"] for r in contamination.find_windows(docs, items, 3, slop=2).collect()}
    assert keys == {hashlib.md5(b"blue x green red").hexdigest()}
