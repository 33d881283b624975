"""Words of whole Arrow batches as 64-bit hashes, in a few passes over the bytes.

A word is a run of ASCII letters and digits and of bytes above 0x7F, with A-Z in
lower case. Its hash is a polynomial of random byte values modulo 2**64, taken as a
difference of running sums, so no Python object is made per word. Such polynomials
are equal for certain pairs of long words, whatever the byte values; long words get a
cryptographic hash instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a batch, and bytes that one pass of hashing works on.
SLICE, STRETCH = 4 << 20, 1 << 18
#: Words of more bytes than this are hashed one by one.
LONG = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
# The same with A-Z as a-z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = FOLDED_VALUES[97:123]
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def hashed_spans(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, values: np.ndarray = None) -> np.ndarray:
    """Hashes of the non-empty byte spans `raw[begins[i]:ends[i]]`, in order and without overlap."""
    values = BYTE_VALUES if values is None else values
    folded = values is FOLDED_VALUES
    hashes = np.empty(len(begins), np.uint64)
    up, down = _powers(min(STRETCH, len(raw)))
    low = 0
    while low < len(begins):  # stretches of whole spans
        base = begins[low]
        high = max(int(np.searchsorted(ends, base + STRETCH, side="right")), low + 1)
        stretch = int(ends[high - 1] - base)
        if stretch > len(up):
            up, down = _powers(stretch)
        sums = np.zeros(stretch + 1, np.uint64)
        np.cumsum(values[raw[base:base + stretch]] * up[:stretch], out=sums[1:])
        b, e = begins[low:high] - base, ends[low:high] - base
        hashes[low:high] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
        low = high
    for i in np.flatnonzero(ends - begins > LONG).tolist():
        span = raw[begins[i]:ends[i]].tobytes()
        hashes[i] = int.from_bytes(blake2b(span.lower() if folded else span, digest_size=8).digest(), "little")
    return hashes


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, ends, bounds): text i has the words `bounds[i]` to `bounds[i + 1]`."""
    raw, at = text_bytes(texts)
    n = len(raw)
    word = _IS_WORD[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    starts, ends = at[:-1][at[:-1] < n], at[1:][at[1:] > 0] - 1
    first[starts], last[ends] = word[starts], word[ends]
    begins = np.flatnonzero(first)
    return raw, begins, np.flatnonzero(last) + 1, np.searchsorted(begins, at)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i has the words `hashes[bounds[i]:bounds[i + 1]]`."""
    raw, begins, ends, bounds = word_spans(texts)
    return hashed_spans(raw, begins, ends, FOLDED_VALUES), bounds


def hashed_shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `n` words of each text, as (hashes, bounds). A text of fewer words, but some, is one shingle."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out = np.concatenate([[0], np.cumsum(sizes)])
    total = int(out[-1])
    rolled = np.zeros(total, np.uint64)
    # The word at which each shingle starts: its text's first word plus its place in the text.
    at = np.repeat(bounds[:-1] - out[:-1], sizes) + np.arange(total)
    left = np.repeat(bounds[1:], sizes)
    for k in range(n):
        inside = at + k < left
        part = hashes[np.minimum(at + k, len(hashes) - 1)] if len(hashes) else rolled
        rolled = rolled * _BASE + np.where(inside, part, np.uint64(k + 1))
    return mix(rolled), out


def in_slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `most` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cuts, total = [0], 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > most:
                cuts.append(i)
                total = 0
            total += size
        for low, high in zip(cuts, [*cuts[1:], batch.num_rows]):
            if high > low:
                yield batch.slice(low, high - low)
