"""DartMinHash signatures of weighted sets (Christiani, 2020).

Every element throws its own darts at the plane of weight by rank: a Poisson process of unit intensity, made from hashes,
so that it is the same in every set that holds the element. A set keeps the darts that fall below the element's weight and
below a common rank, about ``k ln k + 2k`` of them, deals them to ``k`` coordinates by a hash, and the earliest dart of
each coordinate is its value. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
The work grows with the set's total weight and ``k``, not with their product.
"""

from __future__ import annotations

import math

import numpy as np

from .common import mix

_CELL, _DART, _RANK, _WEIGHT, _PLACE = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
))
#: P(at most n darts in a unit cell), n = 0, 1, ...
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(20)])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(elements: np.ndarray, weights: np.ndarray, reach: np.ndarray):
    """Darts below the weight and the rank ``reach`` of each element: (index of the element, rank, dart)."""
    columns, rows = np.ceil(weights).astype(np.int64), np.ceil(reach).astype(np.int64)
    cells = columns * rows
    at = np.repeat(np.arange(len(elements)), cells)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    step, level = nth // rows[at], nth % rows[at]
    cell = mix(elements[at] ^ mix(step.astype(np.uint64) * _CELL + level.astype(np.uint64) * _DART + np.uint64(1)))
    darts = np.searchsorted(_AT_MOST, _unit(cell), side="right")
    which = np.repeat(np.arange(len(at)), darts)
    number = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(cell[which] + (number.astype(np.uint64) + np.uint64(1)) * _DART)
    rank = level[which] + _unit(mix(dart ^ _RANK))
    at = at[which]
    weight = step[which] + _unit(mix(dart ^ _WEIGHT))
    inside = (rank < reach[at]) & (weight < weights[at])
    return at[inside], rank[inside], dart[inside]


def signatures(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, sets: int, k: int) -> np.ndarray:
    """Signatures, sets by ``k``, of sets given as (element hash, weight, set number) without repeats.

    Sets without elements get zeros. A set that leaves a coordinate empty is thrown again with twice the rank.
    """
    out = np.zeros((sets, k), np.uint64)
    total = np.bincount(owners, weights, sets)
    reach = np.zeros(sets)
    reach[total > 0] = (k * math.log(k) + 2 * k) / total[total > 0]
    todo = total > 0
    while todo.any():
        mine = todo[owners]
        e, w, o = elements[mine], weights[mine], owners[mine]
        at, rank, dart = _throw(e, w, reach[o])
        slot = o[at] * k + (mix(dart ^ _PLACE) % np.uint64(k)).astype(np.int64)
        best = np.full(sets * k, np.inf)
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        found = np.zeros(sets * k, np.uint64)
        found[slot[first]] = dart[first]
        whole = todo & np.isfinite(best.reshape(sets, k)).all(axis=1)
        out[whole] = found.reshape(sets, k)[whole]
        todo &= ~whole
        reach[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band and set, of the band's number and its coordinates."""
    sets, k = signature.shape
    rows = k // bands
    keys = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (sets, 1))
    for r in range(rows):
        keys = mix(keys * np.uint64(0x100000001B3) ^ signature[:, r : bands * rows : rows])
    return keys


PLANES = 4


def bit_planes(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, packed plane by plane into 64-bit words: sets by (4 * words)."""
    sets, k = signature.shape
    words = -(-k // 64)
    out = []
    for plane in range(PLANES):
        bits = np.zeros((sets, words * 64), np.uint8)
        bits[:, :k] = (mix(signature) >> np.uint64(plane)) & np.uint64(1)
        out.append(np.packbits(bits, axis=1).view(np.int64).reshape(sets, words))
    return np.concatenate(out, axis=1)


def most_differing(k: int, similarity: float, deviations: float = 4.0) -> int:
    """The most coordinates that differ, by their four bits, in all but a 30,000th of the pairs of that similarity."""
    alike = similarity + (1 - similarity) / 2**PLANES
    return math.ceil(k * (1 - alike) + deviations * math.sqrt(k * alike * (1 - alike)))
