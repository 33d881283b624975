import zlib

from seedlift.llm import sharding


def test_balanced_contiguous_and_gapless(spark):
    rows = [(i, "é" * (i * 37 % 101)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(sharding.byte_shards(docs, 8).collect(), key=lambda r: r["doc_id"])
    assert [r["size"] for r in got] == [len(t.encode()) + 1 for _, t in rows]
    assert [r["text_crc32"] for r in got] == [zlib.crc32(t.encode()) for _, t in rows]
    shards = [r["shard"] for r in got]
    assert shards == sorted(shards) and set(shards) == set(range(8))
    total = sum(r["size"] for r in got)
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 8) <= 204


def test_odd_rows_and_empty_table(odd, empty):
    got = sharding.byte_shards(odd, 4).collect()
    assert sorted(r["size"] for r in got) == sorted(len((r["text"] or "").encode()) + 1 for r in odd.collect())
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.byte_shards(empty, 4).count() == 0


def test_a_hot_id(spark):
    docs = spark.createDataFrame([(7, "same")] * 400 + [(i, "t") for i in range(100)], "doc_id bigint, text string")
    sizes = [r["b"] for r in sharding.byte_shards(docs, 5).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 10
