"""BPE encoding and decoding through a table of distinct words.

Texts are dealt to blocks by a hash of id and text. A block lists its distinct words;
the lists meet by word, where each distinct word of the corpus is encoded once; the ids
go back to the blocks, which put them at the words' positions. Only compressed texts
and word lists are shuffled, never a row for each position.

The tokenizer is any `tokenizers` JSON of the word kind: NFC, lower case, words split as
letters, single digits, other runs and seven contractions, ids ending a word marked.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seedlift.llm.blocks import block_count, packed, squeeze, swell, text_runs, unpacked
from seedlift.llm.common import give_back
from seedlift.llm.words import hashed_spans, text_bytes

#: Bytes of input, as Spark estimates it, for each block.
BLOCK_BYTES = 2 << 20
#: Blocks for each bucket of words. Their lists are parted into as many rows as there are pairs of block and bucket.
BLOCKS_A_BUCKET = 8
#: Bytes of text whose words are told apart at a time: a position takes some fifty times its byte in memory.
RUN_BYTES = 1 << 17
#: Words that are handed to the library in one call.
AT_ONCE = 2000

# Fixed value: the word pattern of this kind of tokenizer.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPECIAL = regex.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = LETTER
_UNDER = np.arange(256, dtype=np.uint8)
_UNDER[65:91] += 32


def words_of(text: str) -> list[str]:
    """A text's words, with the special tokens that it spells out."""
    out: list[str] = []
    for i, part in enumerate(SPECIAL.split(text)):
        if i % 2:
            out.append(part)
        else:  # a final sigma is not told apart, so Python's rule for it must not apply
            out.extend(WORD.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()))
    return out


def _hard(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold more than ASCII and the Latin letters from U+00C0 to U+00FF, or may hold a special token."""
    lead = raw == 0xC3
    odd = (raw >= 128) & ~lead
    odd[1:] &= ~lead[:-1]
    odd[1:] |= lead[:-1] & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # multiplication and division signs
    odd[1:] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    return np.unique(np.searchsorted(at, np.flatnonzero(odd), side="right") - 1)


def _spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of simple, lower-case texts begin and end."""
    n = len(raw)
    kind = _KIND[raw]
    before = np.full(n, SPACE, np.uint8)
    before[1:] = kind[:-1]
    before[at[:-1][at[:-1] < n]] = SPACE
    starts = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
    # A contraction starts at an apostrophe that no other sign precedes.
    marks = np.flatnonzero((raw == ord("'")) & (before != OTHER))
    if len(marks):
        limit = at[np.searchsorted(at, marks, side="right")]
        one = np.where(marks + 1 < limit, raw[np.minimum(marks + 1, n - 1)], 0)
        two = np.where(marks + 2 < limit, raw[np.minimum(marks + 2, n - 1)], 0)
        single = np.isin(one, list(b"stmd"))
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | (
            (one == ord("l")) & (two == ord("l")))
        found = single | double
        marks, ends, limit = marks[found], (marks + np.where(single, 2, 3))[found], limit[found]
        starts[marks + 1] = False
        rest = ends < limit
        starts[ends[rest]] |= kind[ends[rest]] == LETTER
    begins = np.flatnonzero(starts)
    stop = starts | (kind == SPACE)
    stop[at[:-1][at[:-1] < n]] = True
    stops = np.append(np.flatnonzero(stop), n)
    return begins, stops[np.searchsorted(stops, begins, side="right")]


def _run_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some texts: (bytes, begins, ends, text order, words of each text in that order, hashes)."""
    raw, at = text_bytes(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    hard = _hard(raw, at)
    rows = np.setdiff1d(np.arange(len(texts)), hard)
    if len(hard):
        raw, at = text_bytes(pa.array([texts[i] for i in rows], pa.large_binary()).cast(pa.large_string()))
    raw = _UNDER[raw]
    if len(raw):  # the capital Latin letters, whose second byte follows 0xC3
        capital = np.flatnonzero(raw[:-1] == 0xC3) + 1
        capital = capital[(raw[capital] >= 0x80) & (raw[capital] <= 0x9E)]
        raw[capital] += 32
    begins, ends = _spans(raw, at)
    counts = np.diff(np.searchsorted(begins, at))
    if len(hard):
        lists = [[w.encode() for w in words_of(texts[i].decode())] for i in hard]
        flat = [w for ws in lists for w in ws]
        sizes = np.array([len(w) for w in flat], np.int64)
        more = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) + len(raw)
        raw = np.concatenate([raw, np.frombuffer(b"".join(flat), np.uint8)])
        begins, ends = np.concatenate([begins, more[:-1]]), np.concatenate([ends, more[1:]])
        counts = np.concatenate([counts, [len(ws) for ws in lists]]).astype(np.int64)
    return raw, begins, ends, np.concatenate([rows, hard]), counts, hashed_spans(raw, begins, ends)


def _lister(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        give_back()
        texts = unpacked(table)
        hashes, sizes, parts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [b""]
        for low, high in text_runs(texts, RUN_BYTES):
            raw, begins, ends, _, _, own = _run_words(texts[low:high])
            distinct, first = np.unique(own, return_index=True)
            data = raw.tobytes()
            hashes.append(distinct)
            sizes.append(ends[first] - begins[first] + 1)
            parts.append(b"".join([data[x:y] + b"\n" for x, y in zip(begins[first].tolist(), ends[first].tolist())]))
        del texts
        lines, ends = b"".join(parts), np.cumsum(np.concatenate(sizes))
        starts = ends - np.concatenate(sizes)
        distinct, first = np.unique(np.concatenate(hashes), return_index=True)
        bucket = (distinct % np.uint64(buckets)).astype(np.int64)
        rows = []
        for b in np.unique(bucket).tolist():
            mine = first[bucket == b]
            blob = b"".join([lines[x:y] for x, y in zip(starts[mine].tolist(), ends[mine].tolist())])[:-1]
            rows.append((b, len(blob), squeeze(blob)))
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int64()),
            "bucket": pa.array([r[0] for r in rows], pa.int64()), "size": pa.array([r[1] for r in rows], pa.int64()),
            "words": pa.array([r[2] for r in rows], pa.binary())})
    return run


def _encoder(content: Broadcast):
    def run(table: pa.Table) -> pa.Table:
        give_back()
        found = content.value[0]
        give_back()  # reading the tokenizer takes several times what it holds
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # threads of the library would each keep memory; Spark's tasks are the threads
        packs = list(zip(table.column("words").to_pylist(), table.column("size").to_pylist()))
        number: dict[str, int] = {}
        for blob, size in packs:
            for w in swell(blob, size).decode().split("\n"):
                number.setdefault(w, len(number))
        words, counts, parts = list(number), [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for low in range(0, len(words), AT_ONCE):  # the library's results are far larger than the ids
            encoded = [e.ids for e in found.encode_batch(words[low:low + AT_ONCE], add_special_tokens=False)]
            counts.append(np.array([len(e) for e in encoded], np.int32))
            parts.append(np.array([i for e in encoded for i in e], np.int32))
        del words
        sizes, ids = np.concatenate(counts), np.concatenate(parts)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        blobs, lengths = [], []
        for blob, size in packs:
            row = np.array([number[w] for w in swell(blob, size).decode().split("\n")], np.int64)
            blob = sizes[row].tobytes() + _gather(ids, starts[:-1][row], sizes[row]).tobytes()
            lengths.append(len(blob))
            blobs.append(squeeze(blob))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         "size": pa.array(lengths, pa.int64()), "ids": pa.array(blobs, pa.binary())})
    return run


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs `values[starts[i]:starts[i] + sizes[i]]`, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


def _joiner(pieces: Broadcast, buckets: int, with_ids: bool):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        whole, runs = unpacked(texts), []
        for low, high in text_runs(whole, RUN_BYTES):
            _, _, _, order, counts, hashes = _run_words(whole[low:high])
            own, inverse = np.unique(hashes, return_inverse=True)
            runs.append((low + order, counts, own, inverse.astype(np.int32)))
        del whole
        distinct = np.unique(np.concatenate([np.zeros(0, np.uint64), *[r[2] for r in runs]]))
        bucket = (distinct % np.uint64(buckets)).astype(np.int64)
        sizes, starts, parts, base = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), [np.zeros(0, np.int32)], 0
        for b, size, blob in zip(*[answers.column(c).to_pylist() for c in ("bucket", "size", "ids")]):
            mine = np.flatnonzero(bucket == b)
            numbers = np.frombuffer(swell(blob, size), np.int32)
            own, got = numbers[:len(mine)].astype(np.int64), numbers[len(mine):]
            sizes[mine] = own
            starts[mine] = base + np.concatenate([[0], np.cumsum(own)])[:-1]
            parts.append(got)
            base += len(got)
        ids = np.concatenate(parts)
        del parts, bucket
        give_back()
        names, numerals, spelled = pieces.value, [], []
        for low in range(0, len(distinct), AT_ONCE):
            cuts = slice(low, low + AT_ONCE)
            for x, y in zip(starts[cuts].tolist(), (starts + sizes)[cuts].tolist()):
                own = ids[x:y].tolist()
                numerals.append(" ".join(map(str, own)))
                spelled.append(" ".join([names[i] for i in own]))
        out = []
        for order, counts, own, inverse in runs:
            code = np.searchsorted(distinct, own)[inverse]
            bounds = np.concatenate([[0], np.cumsum(counts)])
            total = np.concatenate([[0], np.cumsum(sizes[code])])
            codes, shas, texts_of = code.tolist(), [], []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                mine = codes[low:high]
                shas.append(hashlib.sha256(" ".join(map(numerals.__getitem__, mine)).encode()).hexdigest())
                texts_of.append(hashlib.sha256(" ".join(map(spelled.__getitem__, mine)).encode()).hexdigest())
            columns = {"doc_id": texts.column("doc_id").take(pa.array(order)),
                       "n_tokens": pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64()),
                       "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(texts_of, pa.string())}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(
                    pa.array(total[bounds], pa.int32()), pa.array(_gather(ids, starts[code], sizes[code])))
            out.append(pa.table(columns))
        return pa.concat_tables(out)
    return run


def read_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """(tokenizer, its id-to-piece table), of fixed size, for every executor."""
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    names = [found.id_to_token(i) or "" for i in range(found.get_vocab_size(with_added_tokens=True))]
    return spark.sparkContext.broadcast((found, names))


def encode(docs: DataFrame, tokenizer: Broadcast, with_ids: bool = True,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Null and empty texts have no ids; repeated rows each give a row; nothing is added
    or cut off. The digests are of the decimal ids and of the decoded text.
    """
    blocks = block_count(docs, text_col, BLOCK_BYTES)
    buckets = max(1, blocks // BLOCKS_A_BUCKET)
    # A worker drops the tokenizer for a task that reads the pieces alone.
    spelling = docs.sparkSession.sparkContext.broadcast(tokenizer.value[1])
    kind = dict(docs.dtypes)[id_col]
    rows = packed(docs, blocks, id_col, text_col)
    lists = rows.groupBy("block").applyInArrow(
        _lister(buckets), "block bigint, bucket bigint, size bigint, words binary")
    answers = lists.groupBy("bucket").applyInArrow(
        _encoder(tokenizer), "block bigint, bucket bigint, size bigint, ids binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _joiner(spelling, buckets, with_ids),
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, tokenizer: Broadcast, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): pieces joined by single spaces, special tokens kept; a null list decodes to nothing.

    Ids meet their pieces in a join with the vocabulary, which is of fixed size.
    """
    spark = encoded.sparkSession
    table = F.broadcast(spark.createDataFrame(list(enumerate(tokenizer.value[1])), "id int, piece string"))
    rows = encoded.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), ids_col).select(
        "_row", "doc_id", F.posexplode_outer(ids_col).alias("_pos", "id"))
    spelled = rows.join(table, "id", "left").groupBy("_row", "doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "piece")))).alias("_p"))
    return spelled.select("doc_id", F.array_join(F.col("_p.piece"), " ").alias("decoded"))
