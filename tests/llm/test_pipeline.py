"""The whole pipeline on the smallest tables, each stage held against plain checks of its input."""

import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_keep_columns_and_their_promises(spark):
    from seedlift.llm import contamination, neardup
    from seedlift.runtime import pin

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = pin(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        kept.append(docs)
    counts = [d.count() for d in kept]
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    assert neardup.classes(kept[2]).filter("NOT keep").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert contamination.contamination(kept[4], bench).filter("contaminated").count() == 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert got == {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
