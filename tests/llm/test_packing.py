import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from seedlift.llm import packing


def brute(lengths, length):
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= x]
        if fits:
            best = min(fits, key=lambda i: free[i])
            free[best] -= x
        else:
            free.append(length - x)
    return sorted(free)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(0)
    for _ in range(200):
        length = rng.randint(5, 60)
        pieces = [rng.randint(1, length - 1) for _ in range(rng.randint(1, 80))]
        steps, used = packing.plan(dict(Counter(pieces)), length)
        fill, placed = Counter(), Counter()
        for piece, _, count, per, row, offset in steps:
            for i in range(count):
                assert offset + i % per * piece == fill[row + i // per]
                fill[row + i // per] += piece
                placed[piece] += 1
        assert placed == Counter(pieces) and set(fill) == set(range(used))
        assert sorted(length - f for f in fill.values()) == brute(pieces, length)


def unpack(rows, wide):
    back = defaultdict(dict)
    for r in rows:
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_ids"] and r["resets"] == r["cu_seqlens"][:-1]
        for low, high, doc, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"]):
            back[doc].setdefault(start, []).append(bytes(r["ids"][low * wide:high * wide]))
    return back


def test_odd_rows_come_back_whole(odd, empty):
    docs = odd.withColumn("ids", F.col("text").cast("binary"))
    rows = packing.pack(docs, 128).collect()
    assert {len(r["ids"]) for r in rows} == {128} and sorted(r["pack_id"] for r in rows) == list(range(len(rows)))
    back = unpack(rows, 1)
    texts = defaultdict(list)
    for r in odd.collect():
        if r["text"]:
            texts[r["doc_id"]].append(r["text"].encode())
    for doc, whole in texts.items():
        if len(whole) == 1:
            assert b"".join(back[doc][s][0] for s in sorted(back[doc])) == whole[0]
        assert sum(len(p) for ps in back[doc].values() for p in ps) == sum(map(len, whole))
    assert packing.pack(empty.withColumn("ids", F.col("text").cast("binary")), 128).count() == 0


def test_wide_ids_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, list(range(70_000, 70_025))), (2, [5]), (3, []), (4, None)], "doc_id bigint, ids array<int>")
    packed = packing.pack(packing.as_bytes(docs, "ids"), 10, 4)
    packing.write_matrix(packed, str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    back = unpack(rows, 4)
    joined = b"".join(back[1][s][0] for s in sorted(back[1]))
    assert [int.from_bytes(joined[i:i + 4], "little") for i in range(0, 100, 4)] == list(range(70_000, 70_025))
    assert set(back) == {1, 2} and len(rows) == 3
