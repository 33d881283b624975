"""Language identification by a string kernel, Nystroem landmarks and one-versus-rest kernel ridge regression.

A text's blended spectrum is the set of all runs of 1 to 4 UTF-8 bytes of its lower-case
form, in which whatever is neither a letter of ASCII nor beyond ASCII is one blank. The
presence kernel of two texts is the number of runs they share over the geometric mean of
their numbers of runs; it is taken over the runs that the landmarks have. With the
landmarks' own kernel matrix K = U S U', texts get the features k(x) U S^(-1/2), and one
ridge regression for each language tells it from the rest.

Scoring is a product of matrices: presence (texts by runs) times presence of the
landmarks (runs by landmarks) times coefficients (landmarks by languages). The last two
are multiplied once, so a batch of texts costs one product, however many landmarks there
are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedlift.llm.common import bounded_batches, whole_text
from seedlift.llm.words import in_slices
from seedlift.runtime import pin

#: Different texts of each language that the fit takes at most, lowest hash first, and their bytes at most.
PER_LANGUAGE, LONGEST = 2_000, 8_192
#: Landmarks of all languages together; every language has one at least.
LANDMARKS = 256
RIDGE, LENGTHS = 1e-4, 4
UNKNOWN = "und"
#: Bytes of text and cells of a presence matrix that are worked on at a time.
STRETCH, CELLS = 1 << 18, 1 << 22

_BREAK, _BLANK = 0, 32
# Non-letters of ASCII are blanks; 0 stays and lies in no run.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[1:128] = _BLANK
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, runs) in stretches: the run that begins at each place, once for each length.

    A run's bytes are those of its number, so different runs never share one. Every text begins and ends in
    a blank; runs over a text's end hold a zero byte inside, or are a shorter run of that end.
    """
    raw = _FOLD[np.frombuffer(b" " + b" \0 ".join(texts) + b" \0", np.uint8)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != _BLANK) | (raw[:-1] != _BLANK)
    raw, owner = raw[keep], owner[keep]
    for low in range(0, len(raw), STRETCH):
        high = min(low + STRETCH, len(raw))
        run = np.zeros(high - low, np.uint32)
        for n in range(LENGTHS):
            ahead = raw[low + n:high + n]
            run[:len(ahead)] |= ahead.astype(np.uint32) << np.uint32(8 * n)
            yield owner[low:high], run


def spectrum(text: bytes) -> np.ndarray:
    """The distinct runs of one text, ascending."""
    found = np.unique(np.concatenate([np.unique(run) for _, run in _runs([text])]))
    inside = [(found >> np.uint32(8 * n)) & np.uint32(255) for n in range(LENGTHS)]
    ended, good = np.zeros(len(found), bool), inside[0] != _BREAK
    for part in inside:  # no byte follows a break
        good &= ~(ended & (part != _BREAK))
        ended |= part == _BREAK
    return found[good]


class Vocabulary:
    """Places of runs in a sorted list, by a hash table with linear probing."""

    def __init__(self, runs: np.ndarray):
        self.size = len(runs)
        bits = max(10, int(np.ceil(np.log2(8 * max(1, len(runs))))))
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.places = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.int32)
        at, left = self._slots(runs), np.arange(len(runs))
        while len(left):  # the first of those that want a free slot takes it, the others go on
            free = self.keys[at[left]] == 0
            slots, first = np.unique(at[left[free]], return_index=True)
            taken = left[free][first]
            self.keys[slots], self.places[slots] = runs[taken], taken
            left = np.setdiff1d(left, taken, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slots(self, runs: np.ndarray) -> np.ndarray:
        return ((runs * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `runs` are listed, and their places."""
        at = self._slots(runs)
        held = self.keys[at]
        hit = held == runs
        indexes, places = [np.flatnonzero(hit)], [self.places[at[hit]]]
        left = np.flatnonzero(~hit & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == runs[left]
            indexes.append(left[hit])
            places.append(self.places[at[left[hit]]])
            left = left[~hit & (held != 0)]
        return np.concatenate(indexes), np.concatenate(places)


def _presence(texts: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """1 where a text (row) has a run of the vocabulary (column)."""
    cells = np.zeros(len(texts) * vocabulary.size)
    for owner, runs in _runs(texts):
        found, places = vocabulary.find(runs)
        cells[owner[found] * vocabulary.size + places] = 1
    return cells.reshape(len(texts), vocabulary.size)


def _batches(texts: list[bytes], vocabulary: Vocabulary) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, presence) of batches of texts whose matrix stays within `CELLS`."""
    rows = max(1, CELLS // max(1, vocabulary.size))
    for low in range(0, len(texts), rows):
        yield low, _presence(texts[low:low + rows], vocabulary)


def _unit(dots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows over the square root of the sizes; rows of no size stay zero."""
    return dots / np.sqrt(np.maximum(sizes, 1))[:, None]


@dataclass(frozen=True)
class Landmarks:
    """The landmarks' spectra as places in the vocabulary."""

    vocabulary: Vocabulary
    spectra: tuple[np.ndarray, ...]

    @staticmethod
    def of(texts: list[bytes]) -> Landmarks:
        spectra = [spectrum(t) for t in texts]
        runs = np.unique(np.concatenate(spectra))
        return Landmarks(Vocabulary(runs), tuple(np.searchsorted(runs, s) for s in spectra))

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        """Texts by landmarks."""
        out = np.zeros((len(texts), len(self.spectra)))
        across = max(1, CELLS // self.vocabulary.size)
        for at, presence in _batches(texts, self.vocabulary):
            sizes = presence.sum(axis=1)
            for low in range(0, len(self.spectra), across):
                own = self.spectra[low:low + across]
                columns = np.zeros((self.vocabulary.size, len(own)))
                for j, places in enumerate(own):
                    columns[places, j] = 1 / np.sqrt(len(places))
                out[at:at + len(presence), low:low + across] = _unit(presence @ columns, sizes)
        return out

    def weights(self, coefficients: np.ndarray) -> np.ndarray:
        """Runs by languages: the landmarks' presence times their coefficients."""
        out = np.zeros((self.vocabulary.size, coefficients.shape[1]))
        for places, row in zip(self.spectra, coefficients):
            out[places] += row / np.sqrt(len(places))
        return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    vocabulary: Vocabulary | None
    weights: np.ndarray  # runs by languages
    fallback: int  # the language with the most texts, for texts without any run of the vocabulary

    def outputs(self, texts: list[bytes]) -> np.ndarray:
        """Texts by languages: the regressions' values."""
        out = np.zeros((len(texts), len(self.languages)))
        for low, presence in _batches(texts, self.vocabulary):
            out[low:low + len(presence)] = _unit(presence @ self.weights, presence.sum(axis=1))
        return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_rows(docs: DataFrame, most: int = PER_LANGUAGE, longest: int = LONGEST, text_col: str = "text",
                  lang_col: str = "lang") -> tuple[DataFrame, dict[str, int]]:
    """(pinned (lang, text, rank), different texts by language): at most `most` texts a language, the lowest hashes first.

    Rows without a language, a text or a letter, and texts of more than `longest` bytes, teach nothing; equal
    texts of a language count once. The number of languages, not of rows, decides what reaches the driver.
    """
    text = F.lower(F.col(text_col))
    rows = docs.filter(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)) & (F.octet_length(text) <= longest)).select(
        F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("hash"))
    counted = rows.select("lang", "hash").distinct().groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in counted}
    # Hashes are even, so a share of them holds about that share of the texts: half as many again as wanted.
    shares = [(lang, min(1.0, 1.5 * most / n) + 1e-9) for lang, n in counts.items()]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    low = F.pmod(F.col("hash"), F.lit(1 << 30)) / float(1 << 30) < F.col("share")
    few = rows.join(F.broadcast(shares), "lang").filter(low).dropDuplicates(["lang", "hash"])
    order = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash")
    return pin(few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(
        "lang", "text", "rank"), "training"), counts


def _moments(landmarks: Landmarks, languages: list[str], weight: dict[str, float]):
    """Each task's share of K'WK and K'WY, as (row, column, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, place = len(landmarks.spectra), {lang: i for i, lang in enumerate(languages)}
        total = np.zeros((m, m + len(languages)))
        for batch in batches:
            for part in in_slices([batch], "text", STRETCH):
                k = landmarks.kernel([t.as_buffer().to_pybytes() for t in part.column("text")])
                of = part.column("lang").to_pylist()
                weighted = k * np.array([weight[x] for x in of])[:, None]
                total[:, :m] += weighted.T @ k
                np.add.at(total.T, m + np.array([place[x] for x in of]), weighted)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "value"])
    return run


def fit(docs: DataFrame, most: int = PER_LANGUAGE, longest: int = LONGEST, landmarks: int = LANDMARKS, ridge: float = RIDGE,
        text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of `docs`; every language weighs alike, however many texts it has.

    No usable row gives a model without languages; ids and other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, counts = training_rows(docs, most, longest, text_col, lang_col)
    languages = sorted(counts)
    if not languages:
        return Model((), None, np.zeros((0, 0)), 0)
    chosen = rows.filter(F.col("rank") <= max(1, landmarks // len(languages))).orderBy("lang", "rank").select("text").collect()
    marks = Landmarks.of([r["text"].encode() for r in chosen])
    weight = {lang: 1 / (len(languages) * min(most, n)) for lang, n in counts.items()}
    m = len(marks.spectra)
    total = np.zeros((m, m + len(languages)))
    for r in rows.select("lang", "text").mapInArrow(_moments(marks, languages, weight), "i bigint, j bigint, value double").groupBy(
            "i", "j").agg(F.sum("value").alias("value")).collect():  # landmarks by landmarks and languages
        total[r["i"], r["j"]] = r["value"]
    values, axes = np.linalg.eigh(marks.kernel([r["text"].encode() for r in chosen]))
    sound = values > 1e-8 * values[-1]
    to_features = axes[:, sound] / np.sqrt(values[sound])
    gram = to_features.T @ total[:, :m] @ to_features
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), to_features.T @ total[:, m:])
    fallback = min(range(len(languages)), key=lambda i: (-counts[languages[i]], languages[i]))
    return Model(tuple(languages), marks.vocabulary, marks.weights(to_features @ solved), fallback)


def _identifier(model: Model, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices([batch], "text", STRETCH):
                lettered = part.column("lettered").to_numpy(zero_copy_only=False)
                texts = [t.as_buffer().to_pybytes() for t in part.column("text")]
                out = model.outputs(texts)
                best = np.where(out.any(axis=1), out.argmax(axis=1), model.fallback)
                score = np.round(np.clip(out[np.arange(len(out)), best], 0, 1), 9)
                names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))],
                    names=[*kept, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", **extra: Column) -> DataFrame:
    """(doc_id, extra..., lang_pred, score) for every row of `docs`, whose whole text is read.

    `score` is the winning regression's value, held between 0 and 1. Null, empty and letterless texts are
    `und` with score 0, as is every text where the model has no language. A text that shares no run with any
    landmark gets the language with the most texts and score 0; of equal values the first language by name
    wins. Repeated rows are rows of their own; no other column is read.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(text_col)
    columns = {"doc_id": F.col(id_col), **extra}
    if not model.languages:
        return docs.select(*[c.alias(n) for n, c in columns.items()], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], has_letter(text).alias("lettered"),
                       F.lower(whole_text(text_col)).alias("text"))
    kinds = [f"{name} {kind}" for name, kind in rows.dtypes if name in columns]
    return rows.mapInArrow(_identifier(model, list(columns)), ", ".join(kinds) + ", lang_pred string, score double")
