"""Ids and decoded texts against the tokenizers library."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import psutil
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seedlift.llm import bpe
from seedlift.llm.blocks import squeeze
from tests.llm.conftest import prose, unlike_words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokenizer(spark):
    return bpe.read_tokenizer(spark, PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_words_as_the_library_splits_them(library):
    rng = random.Random(5)
    letters = "aAbstmdrveLl''' 09.!-éÉßÀ×Σİ\n\t<|漢́xªº²½€\x00\x1c\x85\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|>a'S <|startoftext|>", "'re're''ve", "x'LLama 'tis", "", " ", "it's", "'", "''s"]
    raw, begins, ends, order, counts, _ = bpe._run_words([t.encode() for t in texts])
    words, at = [bytes(raw[b:e]).decode() for b, e in zip(begins, ends)], 0
    for i, n in zip(order.tolist(), counts.tolist()):
        got = [x for e in library.encode_batch(words[at:at + n], add_special_tokens=False) for x in e.ids] if n else []
        assert got == library.encode(texts[i], add_special_tokens=False).ids, repr(texts[i])
        at += n
    assert at == len(words)


def test_odd_rows(odd, tokenizer, library):
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(odd, tokenizer).collect())
    assert got == sorted(expected(library, r["text"]) for r in odd.collect())


def test_round_trip(spark, tokenizer, library):
    docs = spark.createDataFrame([(1, "Hello <|endoftext|> world's 42"), (2, ""), (3, "Éa 漢字")], "doc_id bigint, text string")
    encoded = bpe.encode(docs, tokenizer)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(encoded, tokenizer).collect()}
    for r in docs.collect():
        want = library.encode(r["text"], add_special_tokens=False).ids
        assert ids[r["doc_id"]] == want
        assert back[r["doc_id"]] == library.decode(want, skip_special_tokens=False)


def test_empty_table(empty, tokenizer):
    assert bpe.encode(empty, tokenizer).count() == 0


def test_long_words_are_told_apart(spark, tokenizer, library):
    texts = [f"{before}{word}" for before in ("", "Some text, then ") for word in unlike_words()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(1)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(docs, tokenizer).collect()}
    assert got == {i: expected(library, t) for i, t in enumerate(texts)}


def test_words_of_a_block_are_told_apart_a_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    from seedlift.llm import bpe
    from seedlift.llm.blocks import squeeze

    texts = [f"word{i} and more, it's {i} " .encode() * 2000 for i in range(30)]
    table = pa.table({"block": [0] * 30, "doc_id": list(range(30)), "size": [len(t) for t in texts],
                      "blob": pa.array([squeeze(t) for t in texts], pa.binary())})
    seen, real = [], bpe._run_words
    monkeypatch.setattr(bpe, "_run_words", lambda some: seen.append(sum(map(len, some))) or real(some))
    parted = bpe._lister(3)(table).to_pylist()
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= 1 << 18
    monkeypatch.setattr(bpe, "RUN_BYTES", 1 << 30)
    assert bpe._lister(3)(table).to_pylist() == parted


def test_memory_goes_back_before_the_tokenizer_and_a_block_are_read(library):
    """Free pieces under a kept one, as other stages leave them in a worker, and a joiner that has no tokenizer."""
    def held():
        return psutil.Process().memory_info().rss / 1e6

    texts = [prose(i, 300) for i in range(40)]
    table = pa.table({"block": pa.array([1] * 40, pa.int64()), "doc_id": pa.array(range(40), pa.int64()),
                      "size": pa.array([len(t) for t in texts], pa.int64()), "blob": pa.array([squeeze(t.encode()) for t in texts], pa.binary())})
    names = [library.id_to_token(i) or "" for i in range(library.get_vocab_size(with_added_tokens=True))]
    many = [np.ones(500) for _ in range(40_000)]
    last = many[-1]
    del many
    before = held()
    lists = bpe._lister(2)(table)
    assert held() < before - 80 and last[0] == 1
    answers = pa.concat_tables([bpe._encoder(SimpleNamespace(value=(library, names)))(lists.slice(i, 1)) for i in range(lists.num_rows)])
    joined = bpe._joiner(SimpleNamespace(value=names), 2, False)(table, answers).to_pylist()
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in joined] == [expected(library, t) for t in texts]
