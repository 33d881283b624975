"""Toxic passages by maximum-scoring segments with extreme-value calibration.

Fit, on a bounded sample of labelled rows: distinct words per text are counted in both
classes. A word's log-odds of toxic against clean are smoothed by a Dirichlet prior
whose mean comes from the words that share its first five bytes, theirs from the first
four, theirs from all words. Tokens whose log-odds stay high after two standard
deviations are taken off make the lexicon; every other token scores a small constant
below zero.

Score, over all rows: one linear scan finds every maximal scoring segment of a text. In
clean text the number of segments of score S or more among n tokens is Poisson with
mean K n exp(-lambda S) (Karlin and Altschul); lambda and K come from the clean rows of
the sample. The evidence of a text is the sum of its segments' normalised scores, and a
logistic curve fitted on the sample turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlift.llm.common import bounded_batches, checked, text_key, unused, whole_text
from seedlift.llm.words import FOLDED_VALUES, hashed_spans, in_slices, word_spans
from seedlift.runtime import pin

#: Labelled rows of each class that the fit takes at most, lowest hash first.
SAMPLE = 20_000
#: Lexicon entries of each kind (words, five-byte and four-byte beginnings) that the fit keeps at most.
LEXICON = 50_000
PREFIXES = (5, 4)


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes, with scores
    word_scores: np.ndarray
    stems: tuple[tuple[np.ndarray, np.ndarray], ...]  # for each length in PREFIXES
    drift: float  # what any other token scores
    decay: float  # lambda
    scale: float  # K
    intercept: float
    slope: float

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(evidence))))


def _hashes(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes of the words, of their beginnings, and the texts' bounds."""
    raw, begins, ends, bounds = word_spans(texts)
    stems = [hashed_spans(raw, begins, np.minimum(ends, begins + n), FOLDED_VALUES) for n in PREFIXES]
    return hashed_spans(raw, begins, ends, FOLDED_VALUES), stems, bounds


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text"):
        words, stems, bounds = _hashes(batch.column("text"))
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.lexsort((owner, words))
        new = np.ones(len(order), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        chosen = order[new]
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[owner[chosen]]
        found, first, group = np.unique(words[chosen], return_index=True, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), *[pa.array(s[chosen][first].view(np.int64)) for s in stems],
             pa.array(np.bincount(group, toxic, len(found)).astype(np.int64)),
             pa.array(np.bincount(group, minlength=len(found)).astype(np.int64))],
            names=["word", "p5", "p4", "bad", "n"])


def _log_odds(bad: Column, n: Column, mean: Column, weight: float, base: float) -> Column:
    """Log-odds against the base rate under a Dirichlet prior, less two standard deviations.

    Half a count more in each class keeps a prior near 0 or 1 from making the deviation endless.
    """
    yes, no = bad + weight * mean, (n - bad) + weight * (1 - mean)
    shift = float(np.log(base / (1 - base)))
    return F.log(yes / no) - shift - 2 * F.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Pinned (text, toxic, weight): at most `most` labelled rows of each class; equal texts count once.

    `weight` is the number of labelled rows of the class over those taken. Rows without
    a label or id are left out; of contradictory labels the toxic one holds.
    """
    known = pin(labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
                .filter("_id IS NOT NULL AND toxic IN (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic")), "labels")
    parts = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(most) for c in (0, 1)]
    taken = pin(parts[0].union(parts[1]), "taken")
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text")).join(F.broadcast(taken), "_id")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col("toxic") == 1, max(1.0, totals.get(1, 0) / most)).otherwise(max(1.0, totals.get(0, 0) / most))
    once = rows.groupBy(text_key("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return pin(once.select("text", "toxic", weight.alias("weight")), "training")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, lexicon: int = LEXICON,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model, or None where either class has no rows."""
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, most, id_col, text_col, label_col)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    counted = rows.select("text", "toxic").mapInArrow(_counter, "word bigint, p5 bigint, p4 bigint, bad bigint, n bigint")
    words = pin(counted.groupBy("word", "p5", "p4").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    if not total["n"]:
        return None
    base = min(max(total["bad"] / total["n"], 1e-6), 1 - 1e-6)
    four = words.groupBy("p4").agg(F.sum("bad").alias("bad4"), F.sum("n").alias("n4"))
    five = words.groupBy("p5", "p4").agg(F.sum("bad").alias("bad5"), F.sum("n").alias("n5")).join(four, "p4")
    mean4 = (F.col("bad4") + 20 * base) / (F.col("n4") + 20)
    mean5 = (F.col("bad5") + 10 * mean4) / (F.col("n5") + 10)
    five = pin(five.select("p5", "p4", "bad4", "n4", "bad5", "n5", mean4.alias("mean4"), mean5.alias("mean5"),
                           _log_odds(F.col("bad4"), F.col("n4"), F.lit(base), 20, base).alias("score4"),
                           _log_odds(F.col("bad5"), F.col("n5"), mean4, 10, base).alias("score5")), "stems")
    scored = words.join(five.select("p5", "mean5", "score4", "score5"), "p5").withColumn(
        "score", _log_odds(F.col("bad"), F.col("n"), F.col("mean5"), 5, base))

    def best(frame: DataFrame, key: str, score: str) -> tuple[np.ndarray, np.ndarray]:
        got = frame.select(key, score).distinct().orderBy(F.col(score).desc(), key).limit(lexicon).collect()
        keys = np.array([r[0] for r in got], np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], np.minimum(np.array([r[1] for r in got], np.float64), 8.0)[order]

    # A word that its beginning would make toxic, but that is often clean, keeps its own score.
    against = (F.greatest("score4", "score5") >= 1) & (F.col("n") >= 20)
    lists = best(scored.filter((F.col("score") >= 1) | against), "word", "score")
    stems = tuple(best(five.filter(F.col(c) >= 1), k, c) for k, c in (("p5", "score5"), ("p4", "score4")))
    draft = Model(*lists, stems, -0.1, 1.0, 1.0, 0.0, 0.0)
    return _calibrated(rows, draft)


def _calibrated(rows: DataFrame, draft: Model) -> Model:
    """The draft with lambda, K and the logistic curve, from the sample's segments (a bounded number of rows)."""
    seen = rows.withColumn("doc_id", F.lit(0)).mapInArrow(
        _scanner(draft, ["toxic", "weight"]),
        "toxic int, weight double, n_tokens bigint, hits array<double>, segments array<struct<start:int,end:int,score:double>>")
    got = seen.select("toxic", "weight", "n_tokens", "hits", F.col("segments.score").alias("scores")).toPandas()
    clean = got[got.toxic == 0]
    tokens = float((clean.n_tokens * clean.weight).sum()) + 1
    hits = np.concatenate([np.asarray(h, float) for h in clean.hits] or [np.zeros(0)])
    weights = np.repeat(clean.weight.to_numpy(float), [len(h) for h in clean.hits])
    typical = float(np.median(draft.word_scores[draft.word_scores > 0])) if (draft.word_scores > 0).any() else 1.0
    hits, weights = np.append(hits, typical), np.append(weights, 1.0)
    rest = tokens - weights.sum()

    def excess(decay: float) -> float:
        return float((weights * np.exp(np.minimum(decay * hits, 500))).sum() + rest * np.exp(decay * draft.drift) - tokens)

    low, high = 1e-6, 50.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    decay = low
    scores = np.concatenate([np.asarray(s, float) for s in clean.scores] or [np.zeros(0)])
    above = np.repeat(clean.weight.to_numpy(float), [len(s) for s in clean.scores])
    least = float(scores.min()) if len(scores) else typical
    scale = max(float(above.sum()), 1.0) / (tokens * np.exp(-decay * least))
    model = Model(draft.words, draft.word_scores, draft.stems, draft.drift, decay, scale, 0.0, 0.0)
    evidence = np.array([_evidence(np.asarray(s, float), n, model) for s, n in zip(got.scores, got.n_tokens)])
    a, b = _logistic(np.log1p(evidence), got.toxic.to_numpy(float), got.weight.to_numpy(float))
    return Model(draft.words, draft.word_scores, draft.stems, draft.drift, decay, scale, a, b)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton's method."""
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        pull = design.T @ (weight * (y - p)) - ridge * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + (ridge + 1e-6) * np.eye(2)
        step = np.linalg.solve(curve, pull)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _evidence(scores: np.ndarray, n: int, model: Model) -> float:
    """Sum of the normalised scores lambda S - ln(K n) that are above zero."""
    if not len(scores):
        return 0.0
    return float(np.maximum(model.decay * scores - np.log(max(model.scale * n, 1e-12)), 0).sum())


def maximal_segments(at: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) of a sequence that scores `drift` but at `at`.

    The scan of Ruzzo and Tompa over runs: each hit is preceded by a run of `drift`.
    A hit that itself scores below zero only lowers the running sum.
    """
    found: list[list[float]] = []  # start, end, sum before, sum after
    total, last = 0.0, -1
    for where, score in zip(at, scores):
        total += drift * (where - last - 1)
        last = where
        before, total = total, total + score
        if score <= 0:
            continue
        new = [where, where + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(s), int(e), after - before) for s, e, before, after in found]


def _look_up(keys: np.ndarray, scores: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted hash is known, and its score."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[place] == wanted, scores[place]


def _scanner(model: Model, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for batch in in_slices(batches, "text"):
            words, stems, bounds = _hashes(batch.column("text"))
            hit, score = _look_up(model.words, model.word_scores, words)
            for (keys, scores), wanted in zip(model.stems, stems):
                more, value = _look_up(keys, scores, wanted)
                more &= ~hit
                score = np.where(more, value, score)
                hit |= more
            at = np.flatnonzero(hit)
            cuts = np.searchsorted(at, bounds)
            hits, segments = [], []
            for i, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                mine = score[at[low:high]].tolist()
                hits.append(mine)
                segments.append([{"start": s, "end": e, "score": v} for s, e, v in maximal_segments(
                    (at[low:high] - bounds[i]).tolist(), mine, model.drift)] if mine else [])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.diff(bounds).astype(np.int64)),
                 pa.array(hits, pa.list_(pa.float64())), pa.array(segments, pa.list_(segment))],
                names=[*kept, "n_tokens", "hits", "segments"])
    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, score, passages.

    `passages` are the segments with their expected number in clean text, if below 1:
    (start, end, score, expected), in word numbers, end exclusive. Null and empty texts
    have no tokens and the score of a text without evidence; without a model every
    score is 0; repeated rows score alike.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    empty = "array<struct<start:int,end:int,score:double,expected:double>>"
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("bigint").alias("n_tokens"), F.lit(0.0).alias("score"),
                           F.array().cast(empty).alias("passages"))
    found = rows.mapInArrow(
        _scanner(model, ["doc_id"]),
        f"doc_id {kind}, n_tokens bigint, hits array<double>, segments array<struct<start:int,end:int,score:double>>")
    expected = F.transform("segments", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"),
        (F.lit(model.scale) * F.col("n_tokens") * F.exp(-model.decay * s["score"])).alias("expected")))
    passages = F.filter(expected, lambda s: s["expected"] < 1)
    evidence = F.aggregate(passages, F.lit(0.0), lambda total, s: total - F.log(s["expected"]))
    return found.select("doc_id", "n_tokens", passages.alias("passages"), evidence.alias("_evidence")).select(
        "doc_id", "n_tokens",
        (1 / (1 + F.exp(-(F.lit(model.intercept) + model.slope * F.log1p("_evidence"))))).alias("score"), "passages")


def held_out(id_col: str = "doc_id", remainder: int = 0) -> Column:
    """Rows that a fit must not see: crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == remainder


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents that score 0.5 or more; labels of held-out rows are not used."""
    model = fit(docs, labels.filter(~held_out(id_col)), id_col=id_col, text_col=text_col)
    if model is None:
        return docs
    name, key = unused(docs, "_id"), unused(docs, "_key")
    marked = docs.select(F.struct(F.col(id_col).alias("id"), text_key(text_col).alias("key")).alias("mark"), F.col(text_col).alias("text"))
    bad = pin(score(marked, model, "mark", "text").filter("score >= 0.5").select(
        F.col("doc_id.id").alias(name), F.col("doc_id.key").alias(key)).distinct(), "toxic")
    return docs.join(checked(bad), F.col(id_col).eqNullSafe(F.col(name)) & (text_key(text_col) == F.col(key)), "left_anti")
