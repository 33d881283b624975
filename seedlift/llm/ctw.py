"""Language-model scores of whole texts by context-tree weighting over bytes.

A text is its bytes, A-Z in lower case, and one end byte. The next byte is eight binary
decisions; each has a node in the tree of every context of 0 to `depth` preceding bytes.
A node's Krichevsky-Trofimov estimate follows from its counts of zeros and ones, its
weighted probability is half of that and half the product over its longer contexts, so
all depths are mixed by how well they coded the training text. The trained mixture
scores every text, as log10 probability; over bytes that is the code length.

Counts are of byte strings of depth + 1 and of words. Blocks of texts list their
distinct ones, and the lists meet in shards by hash, which add the counts up. The
distinct strings are then grouped by their two nearest context bytes, so that a group
holds whole subtrees; only the nodes of depth 1, at most 256 * 255, pass through the
driver. Log probabilities go back to the shards and from there to the blocks, which add
them up by text.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlift.llm.blocks import (LIST_SCHEMA, block_count, key_lists, keyed, lister, merged, packed, shard_of, squeezed_array,
                                 swollen_array, unpacked)
from seedlift.llm.words import FOLDED_VALUES, hashed_spans
from seedlift.runtime import pin

DEPTH = 5
END = 0xFF
STRINGS, WORDS = 0, 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[9:14] = _BLANK[32] = True


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series after a shift of 8."""
    y = x + 8
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    shift = np.ones_like(y)
    for k in range(8):
        shift = shift * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def _mix(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln weighted probability, the node's own weight, its probability of a one)."""
    own = _log_kt(zeros, ones)
    if below is None:
        weighted, weight = own, np.ones_like(own)
    else:
        weighted = np.logaddexp(own, below) - np.log(2)
        weight = np.exp(own - np.log(2) - weighted)
    return weighted, weight, (ones + 0.5) / (zeros + ones + 1)


def _paths(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight nodes (1 to 255) on the way to each string's last byte, and the bits taken."""
    symbol = (strings & np.uint64(255)).astype(np.int64)
    nodes = np.stack([(symbol | 256) >> (8 - j) for j in range(8)], axis=1)
    bits = np.stack([(symbol >> (7 - j)) & 1 for j in range(8)], axis=1)
    return nodes, bits


def subtree(strings: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Mix depths `depth` to 2 for distinct strings that hold whole subtrees of depth 2.

    Returns each string's eight probabilities, and the nodes of depth 2 as
    (two context bytes, node, zeros, ones, ln weighted probability).
    """
    nodes, bits = _paths(strings)
    weight_of = np.repeat(counts.astype(np.float64), 8)
    flat_bits = bits.ravel()
    mixed, keys_above, log_above = np.full(len(flat_bits), 0.5), None, None
    for d in range(depth, 1, -1):
        context = (strings >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
        keys, inverse = np.unique((np.repeat(context, 8) << np.uint64(8)) | nodes.ravel().astype(np.uint64), return_inverse=True)
        ones = np.bincount(inverse, weight_of * flat_bits, len(keys))
        zeros = np.bincount(inverse, weight_of, len(keys)) - ones
        below = None
        if keys_above is not None:
            parent = np.searchsorted(keys, keys_above & np.uint64((1 << (8 * d + 8)) - 1))
            below = np.bincount(parent, log_above, len(keys))
        weighted, weight, one = _mix(zeros, ones, below)
        chance = np.where(flat_bits == 1, one[inverse], 1 - one[inverse])
        mixed = weight[inverse] * chance + (1 - weight[inverse]) * mixed
        keys_above, log_above = keys, weighted
    return mixed.reshape(-1, 8), ((keys >> np.uint64(8)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64), zeros, ones, weighted)


def top(context: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights and chances of a one of depth 1 (256 x 256) and depth 0 (256), from sums over depth 2."""
    at = context * 256 + node
    size = 256 * 256
    z, o = np.bincount(at, zeros, size), np.bincount(at, ones, size)
    weighted, weight1, one1 = _mix(z, o, np.bincount(at, below, size))
    z0, o0 = z.reshape(256, 256).sum(axis=0), o.reshape(256, 256).sum(axis=0)
    _, weight0, one0 = _mix(z0, o0, weighted.reshape(256, 256).sum(axis=0))
    return weight1, one1, weight0, one0


def log10_chances(strings: np.ndarray, mixed: np.ndarray, upper: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 probability of each string's last byte after the others."""
    weight1, one1, weight0, one0 = upper
    nodes, bits = _paths(strings)
    at = (((strings >> np.uint64(8)) & np.uint64(255)).astype(np.int64) * 256)[:, None] + nodes
    for weight, one in ((weight1[at], one1[at]), (weight0[nodes], one0[nodes])):
        mixed = weight * np.where(bits == 1, one, 1 - one) + (1 - weight) * mixed
    return np.log10(mixed).sum(axis=1)


def byte_strings(raw: np.ndarray, at: np.ndarray, depth: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(strings, bounds): for each text, every byte and the end with the `depth` bytes before, as one number.

    Before a text stand end bytes; `fold` takes A-Z as a-z.
    """
    n, texts = len(raw), len(at) - 1
    sizes = np.diff(at)
    stream = np.full(n + (texts + 1) * depth, END, np.uint8)
    place = np.arange(n) + np.repeat((np.arange(texts) + 1) * depth, sizes)
    stream[place] = _LOWER[raw] if fold else raw
    out = np.zeros(len(stream) - depth, np.uint64)
    for k in range(depth + 1):
        out |= stream[depth - k:len(stream) - k].astype(np.uint64) << np.uint64(8 * k)
    # Of the end bytes between two texts only the first is coded.
    bounds = at + np.arange(texts + 1)
    keep = np.repeat(at[:-1] + np.arange(texts) * depth, sizes + 1) + np.arange(n + texts) - np.repeat(bounds[:-1], sizes + 1)
    return out[keep], bounds


def token_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the runs without blanks, A-Z in lower case."""
    word = ~_BLANK[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    starts, ends = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1
    first[starts], last[ends] = word[starts], word[ends]
    begins = np.flatnonzero(first)
    return hashed_spans(raw, begins, np.flatnonzero(last) + 1, FOLDED_VALUES), np.searchsorted(begins, at)


def _keyers(depth: int) -> dict:
    return {STRINGS: partial(byte_strings, depth=depth), WORDS: token_hashes}


def _totals(table: pa.Table) -> pa.Table:
    """The strings of a shard with their counts; of its words one row: how many distinct ones and tokens train."""
    kind = table.column("kind")[0].as_py()
    keys, counts = merged(table, key_lists(table))
    if kind == WORDS:
        keys, counts = np.array([(counts > 0).sum()]), np.array([counts.sum()])
    return pa.table({"kind": pa.array(np.full(len(keys), kind), pa.int32()),
                     "key": pa.array(keys.astype(np.uint64).view(np.int64)), "n": pa.array(counts)})


def _strings(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("key").to_numpy().astype(np.int64).view(np.uint64), table.column("n").to_numpy()


def _roots(depth: int):
    """Of whole subtrees: sums over the nodes of depth 2 by their node of depth 1."""
    def run(table: pa.Table) -> pa.Table:
        _, (context, node, zeros, ones, weighted) = subtree(*_strings(table), depth)
        at, inverse = np.unique((context & 255) * 256 + node, return_inverse=True)
        sums = [np.bincount(inverse, v, len(at)) for v in (zeros, ones, weighted)]
        return pa.table({"context": at >> 8, "node": at & 255, "zeros": sums[0], "ones": sums[1], "below": sums[2]})
    return run


def _chances(depth: int, shards: int, upper: tuple[np.ndarray, ...]):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _strings(table)
        chances = log10_chances(keys, subtree(keys, counts, depth)[0], upper)
        return pa.table({"shard": shard_of(keys, shards), "kind": pa.array(np.full(len(keys), STRINGS), pa.int32()),
                         "key": keys.view(np.int64), "chance": chances})
    return run


def _answers(lists: pa.Table, chances: pa.Table) -> pa.Table:
    """Per shard and block: log10 chances of the block's strings; training counts of its words."""
    own = key_lists(lists)
    if own and lists.column("kind")[0].as_py() == STRINGS:
        keys = chances.column("key").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys, values = keys[order], chances.column("chance").to_numpy()[order]
    else:
        keys, counts = merged(lists, own)
        values = counts.astype(np.float64)
    blobs = [squeezed_array(values[np.searchsorted(keys, k)]) for k in own]
    return pa.table({c: lists.column(c) for c in ("block", "shard", "kind", "n")} | {"values": pa.array(blobs, pa.binary())})


def _scorer(depth: int, shards: int, words: int, types: int, ends: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        content = unpacked(texts)
        n = len(content)
        got = {(k, s): swollen_array(v, size, np.float64) for k, s, size, v in zip(
            *[answers.column(c).to_pylist() for c in ("kind", "shard", "n", "values")])}
        floor = words + 0.5 * (types + 1)
        score, base, tokens, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for kind in (STRINGS, WORDS):
            parts = [(low, *np.unique(keys, return_inverse=True), bounds) for low, keys, bounds in keyed(content, _keyers(depth)[kind])]
            if not parts:
                continue
            parts = [(low, own, inverse.astype(np.int32), bounds) for low, own, inverse, bounds in parts]
            distinct = np.unique(np.concatenate([p[1] for p in parts]))
            shard, values = shard_of(distinct, shards), np.zeros(len(distinct))
            for s in np.unique(shard).tolist():
                values[shard == s] = got[kind, s]
            for low, own, inverse, bounds in parts:
                here = values[np.searchsorted(distinct, own)][inverse]
                size = len(bounds) - 1
                owner, into = np.repeat(np.arange(size), np.diff(bounds)), slice(low, low + size)
                if kind == STRINGS:
                    score[into] = np.bincount(owner, here, size)
                else:
                    base[into] = np.bincount(owner, np.log10((here + 0.5) / floor), size)
                    tokens[into] = np.diff(bounds)
                    known[into] = np.bincount(owner, here > 0, size)
        return pa.table({
            "doc_id": texts.column("doc_id"), "trains": texts.column("trains"),
            "n_tokens": tokens + 1, "n_known": known + (ends > 0), "train_tokens": np.full(n, words, np.int64),
            "base_score": base + np.log10((ends + 0.5) / floor), "score": score,
            "n_bytes": np.array([len(t) + 1 for t in content], np.int64)})
    return run


def scores(docs: DataFrame, trains: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, trains, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    The model and the word counts come from the rows where `trains` holds (null: not).
    `score` is the log10 probability of the text's bytes and end, `base_score` that of its
    words and end one by one, `n_bytes` counts the end. Null and empty texts are an end
    alone; repeated rows count, and are scored, each; without training rows every bit has
    an even chance and no word is known. `depth` is from 2 to 7.
    """
    blocks = block_count(docs, text_col)
    shards = max(1, blocks // 2)
    rows = packed(docs, blocks, id_col, text_col, trains=F.coalesce(trains, F.lit(False)))
    lists = pin(rows.groupBy("block").applyInArrow(
        lister(_keyers(depth), shards), LIST_SCHEMA), "lists")
    totals = pin(lists.groupBy("kind", "shard").applyInArrow(_totals, "kind int, key bigint, n bigint"), "totals")
    told = totals.filter(F.col("kind") == WORDS).agg(F.sum("key").alias("types"), F.sum("n").alias("tokens")).first()
    ends = docs.filter(F.coalesce(trains, F.lit(False))).count()
    words, types = (told["tokens"] or 0) + ends, (told["types"] or 0) + (ends > 0)

    # A string's two nearest context bytes decide its group, which so holds whole subtrees of distinct strings.
    near = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(shards))
    strings = totals.filter(F.col("kind") == STRINGS).select(near.alias("near"), "key", "n").groupBy("near")
    sums = strings.applyInArrow(_roots(depth), "context bigint, node bigint, zeros double, ones double, below double")
    # At most 256 * 255 rows.
    roots = sums.groupBy("context", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toPandas()
    upper = top(*[roots[c].to_numpy() for c in ("context", "node", "zeros", "ones", "below")])
    chances = strings.applyInArrow(_chances(depth, shards, upper), "shard bigint, kind int, key bigint, chance double")
    answers = lists.groupBy("kind", "shard").cogroup(chances.groupBy("kind", "shard")).applyInArrow(
        _answers, "block bigint, shard bigint, kind int, n bigint, values binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scorer(depth, shards, words, types, ends),
        f"doc_id {dict(docs.dtypes)[id_col]}, trains boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double, n_bytes bigint")
