import random

import numpy as np
from pyspark.sql import functions as F

from seedlift.llm import language as L

STEMS = {"aa": ["lor", "ipsum", "dol", "sit"], "bb": ["krak", "tzu", "wögh", "pf"], "cc": ["éau", "oui", "quel", "ê"]}
SCHEMA = "doc_id bigint, text string, lang string, source string, rank int, hash int, share int, lettered string, score string, lang_pred int"


def text(lang, seed, words=30):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words)).capitalize() + "."


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3, "x", "y", 4) for i, t, lang in rows], SCHEMA).repartition(3)


def runs(t):
    folded = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in f" {t} ".lower())
    raw = folded.encode()
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return {raw[i:i + n] for n in range(1, 5) for i in range(len(raw) - n + 1)}


def test_spectrum_and_kernel_against_sets():
    texts = ["Abc, abc!", "", "éa 12 x", "\x00a\x00b", "-", "bca " * 50, "Äpfel"]
    for t in texts:
        if "\x00" not in t:
            got = {int(x).to_bytes(4, "little").rstrip(b"\0") for x in L.spectrum(t.lower().encode())}
            assert got == runs(t)
    marks = L.Landmarks.of([t.lower().encode() for t in texts[:3]])
    whole = set().union(*(runs(t) for t in texts[:3]))
    others = ["abcabc", "é", "zzz", " ", "b,c"]
    want = [[len(runs(o) & runs(t)) / np.sqrt(max(1, len(runs(o) & whole)) * len(runs(t))) for t in texts[:3]] for o in others]
    assert np.allclose(marks.kernel([o.encode() for o in others]), want)


def test_long_texts_and_crowded_tables(monkeypatch):
    text_ = " ".join(text("bb", i) for i in range(40)).lower().encode()
    whole = L.spectrum(text_)
    monkeypatch.setattr(L, "STRETCH", 7)
    assert (L.spectrum(text_) == whole).all()
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 32, 30_000, dtype=np.uint32))
    vocabulary = L.Vocabulary(keys)
    asked = np.concatenate([keys[::3], np.random.default_rng(2).integers(1, 1 << 32, 9_000, dtype=np.uint32)])
    found, places = vocabulary.find(asked)
    assert (keys[places] == asked[found]).all()
    assert set(found.tolist()) == set(np.flatnonzero(np.isin(asked, keys)).tolist())


def test_fit_against_dense_ridge_regression(spark):
    rows = [(i, text(lang, i), lang) for i in range(60) for lang in STEMS]
    docs = table(spark, rows)
    model = L.fit(docs, landmarks=12)
    taught, _ = L.training_rows(docs)
    taught = taught.orderBy("lang", "rank").collect()
    marks = [r["text"] for r in taught if r["rank"] <= 4]
    whole = set().union(*(runs(t) for t in marks))

    def kernel(a, b):
        return len(runs(a) & runs(b) & whole) / np.sqrt(max(1, len(runs(a) & whole)) * len(runs(b)))

    k = np.array([[kernel(r["text"], m) for m in marks] for r in taught])
    own = np.array([[kernel(a, b) for b in marks] for a in marks])
    y = np.array([[r["lang"] == lang for lang in sorted(STEMS)] for r in taught], float)
    weight = np.eye(len(taught)) / len(taught)
    solved = np.linalg.solve(k.T @ weight @ k + L.RIDGE * own, k.T @ weight @ y)
    others = [text(lang, 900 + i, 5).lower() for i in range(5) for lang in STEMS]
    want = np.array([[kernel(o, m) for m in marks] for o in others]) @ solved
    assert np.allclose(model.outputs([o.encode() for o in others]), want, atol=1e-5)


def test_odd_rows(spark, odd, empty):
    rows = [(i, text(lang, i), lang) for i in range(30) for lang in STEMS]
    rows += [(100, None, "aa"), (101, text("bb", 5), None), (102, "", "cc"), (103, "12 ?!", "cc"), (None, text("cc", 3), "cc"),
             (104, text("aa", 1), "aa"), (104, text("aa", 1), "aa"), (105, "lor " * 100_000, "aa"), (106, "日本", None), (107, "É", "bb")]
    docs = table(spark, rows)
    got = L.identify(docs, L.fit(docs), text_col="text", source=F.col("lang"))
    assert got.columns == ["doc_id", "source", "lang_pred", "score"] and got.count() == len(rows)
    by_id = {r["doc_id"]: r for r in got.collect()}
    for i in (100, 102, 103):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[101]["lang_pred"] == "bb" and by_id[None]["lang_pred"] == "cc" and by_id[105]["lang_pred"] == "aa"
    assert by_id[106]["lang_pred"] in STEMS
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert L.identify(odd, L.fit(odd)).count() == odd.count()
    assert L.identify(empty, L.fit(odd)).count() == 0
    untaught = L.identify(odd, L.fit(empty))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"} and untaught.count() == odd.count()


def test_one_hot_text_and_many_rows_of_one_language(spark):
    """A language with most rows, most of them copies of one text, leaves the others known."""
    rows = [(i, text("aa", 1), "aa") for i in range(400)] + [(i, text("aa", i), "aa") for i in range(400, 900)]
    rows += [(1000 + i, text(lang, i), lang) for i in range(12) for lang in ("bb", "cc")]
    docs = table(spark, rows)
    model = L.fit(docs, most=50, landmarks=30)
    taught, counts = L.training_rows(docs, 50)
    sizes = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().collect()}
    assert counts["aa"] == 501 and sizes["aa"] == 50 and sizes["bb"] == 12
    fresh = table(spark, [(i, text(lang, 5000 + i, 4), lang) for i in range(50) for lang in STEMS])
    right = L.identify(fresh, model, lang=F.col("lang")).filter("lang = lang_pred").count()
    assert right >= 148


def test_held_out_accuracy(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = __spark_entry__.queries()["op12_language"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    seen = got.join(docs.filter("lang IS NOT NULL AND text RLIKE '[a-z]'").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert seen.filter("lang = lang_pred").count() >= 0.98 * seen.count()
