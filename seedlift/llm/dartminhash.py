"""Weighted MinHash signatures by throwing darts (DartMinHash).

Each element owns regions in the plane of weight and rank: region v covers weights
from 2**v - 1 to 2**(v+1) - 1. Darts fall into a region as a Poisson process of unit
density, drawn from a hash of (element, region), so every set that holds the element
sees the same darts. A dart carries its rank, a weight and one of `k` coordinates; it
counts if its weight is under the element's. Only darts of rank below a limit are
drawn, chosen so that about k ln k + 2k of them fall on a whole set. Each coordinate
keeps its earliest dart; two sets agree in a coordinate with the probability of their
weighted Jaccard similarity. A set that leaves a coordinate empty is thrown at again
with the limit doubled.
"""

from __future__ import annotations

import numpy as np

from seedlift.llm.words import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_REGION = np.uint64(0xD1B54A32D192ED03)
_REGIONS = np.arange(64, dtype=np.uint64) * _REGION


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def _throw(best: np.ndarray, owner: np.ndarray, seed: np.ndarray, weight: np.ndarray | None,
           limit: np.ndarray, low: float, density: float, k: int) -> None:
    """Draw one region's darts of every element in rank order and lower `best[owner, coordinate]`."""
    rank = np.zeros(len(seed))
    state = seed
    while len(state):
        state = mix(state + _STEP)
        rank = rank - np.log(_uniform(state)) / density
        on = rank < limit
        if not on.all():
            owner, state, rank, limit = owner[on], state[on], rank[on], limit[on]
            if weight is not None:
                weight = weight[on]
        if not len(state):
            return
        more = mix(state ^ _REGION)
        coordinate = (more % np.uint64(k)).astype(np.int64)
        slot, value = owner * k + coordinate, rank
        if weight is not None:
            under = low + _uniform(mix(more)) * density < weight
            slot, value = slot[under], rank[under]
        np.minimum.at(best, slot, value)


def signatures(elements: np.ndarray, bounds: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(sets, k) earliest ranks; row i is for `elements[bounds[i]:bounds[i + 1]]`, infinite if that is empty.

    Without `weights` every distinct element weighs 1; repeats in a set change nothing.
    Weights are positive. Equal ranks mean the same dart.
    """
    sizes = np.diff(bounds)
    n = len(sizes)
    owners = np.repeat(np.arange(n), sizes)
    if weights is None:
        mass = sizes.astype(np.float64)
    else:
        mass = np.bincount(owners, weights, minlength=n)
    wanted = k * np.log(max(k, 2)) + 2 * k
    limits = wanted / np.maximum(mass, 1e-300)
    out = np.full((n, k), np.inf)
    todo = np.flatnonzero(sizes > 0)
    while len(todo):
        chosen = np.zeros(n, bool)
        chosen[todo] = True
        rows = np.flatnonzero(chosen[owners])
        best = np.full(n * k, np.inf)
        region = 0
        while len(rows):
            low, density = 2.0 ** region - 1, 2.0 ** region
            seed = mix(elements[rows] + _REGIONS[region])
            part = None if weights is None else weights[rows]
            _throw(best, owners[rows], seed, part, limits[owners[rows]], low, density, k)
            if weights is None:
                break
            rows = rows[weights[rows] > 2.0 ** (region + 1) - 1]
            region += 1
        best = best.reshape(n, k)
        full = np.isfinite(best[todo]).all(axis=1)
        out[todo[full]] = best[todo[full]]
        todo = todo[~full]
        limits[todo] *= 2
    return out


def band_hashes(ranks: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) signed 64-bit hashes of `rows` neighbouring coordinates."""
    bits = ranks.view(np.uint64).reshape(len(ranks), -1, rows)
    h = np.tile(mix(np.arange(bits.shape[1], dtype=np.uint64)), (len(ranks), 1))
    for r in range(rows):
        h = mix(h * _STEP + bits[:, :, r])
    return h.view(np.int64)
