"""DartMinHash signatures of weighted sets (after Christiani, 2020), vectorised over many sets.

Every element owns a plane of weight x rank on which darts are thrown at random, one for each unit of area on
average, each dart marked with one of k coordinates; hashes of the element and of the region decide all of it, so
equal elements have equal darts in any set. A set sees the darts of an element below its weight. For each
coordinate it keeps the dart of least rank; two sets keep the same one with a probability equal to their weighted
Jaccard similarity. Regions double in size along both axes; those that hold no dart a set can use are never
opened, so that a set of total weight W opens about k ln k darts in all rather than k for each element.
"""

from __future__ import annotations

import numpy as np

from .kernels import U64, mix64, ragged

#: Ranks below this are one region; further ones double.
FIRST_RANK = 0.25


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts in a region."""
    n = int(mean + 12 * np.sqrt(mean) + 20)
    logs = np.append(0.0, np.cumsum(np.log(np.arange(1, n))))
    return np.cumsum(np.exp(np.arange(n) * np.log(mean) - mean - logs))


_TABLES: dict[float, np.ndarray] = {}


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """(sets x k) 32-bit values; set i has the distinct elements first[i]..first[i+1]. An empty set has zeros."""
    n = len(first) - 1
    out = np.full((n, k), np.uint64(0xFFFF_FFFF_FFFF_FFFF))
    total = np.append(0.0, np.cumsum(weights))
    total = total[first[1:]] - total[first[:-1]]
    todo = np.flatnonzero(np.diff(first) > 0)
    darts = k * np.log(k) + 2 * k  # with so many, each coordinate stays without one with a chance of 1/(k e^2)
    while len(todo):
        limit = darts / total[todo]
        size = first[todo + 1] - first[todo]
        at = ragged(first[todo], size)
        _throw(elements[at], weights[at], np.repeat(np.arange(len(todo)), size), np.repeat(limit, size), out, todo, k, seed)
        # A dart of rank below the limit is final; a set that lacks a coordinate throws further.
        lacking = (out[todo] == np.uint64(0xFFFF_FFFF_FFFF_FFFF)).any(1)
        todo = todo[lacking]
        out[todo] = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
        darts *= 2
    out[np.diff(first) == 0] = 0
    return (out & U64(0xFFFF_FFFF)).astype(np.uint32)


def _throw(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray, out: np.ndarray, rows: np.ndarray, k: int, seed: int) -> None:
    heaviest, furthest = float(weights.max()), float(limit.max())
    base = mix64(elements + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFF_FFFF_FFFF_FFFF))
    w_low, w_high, column = 0.0, 1.0, 0
    while w_low < heaviest:
        in_column = np.flatnonzero(weights > w_low)
        r_low, r_high, band = 0.0, FIRST_RANK, 0
        while r_low < furthest and len(in_column):
            cell = in_column if not band else in_column[limit[in_column] > r_low]
            if len(cell):
                region = mix64(base[cell] + U64(((column << 8 | band) + 1) * 0xD1B54A32D192ED03 & 0xFFFF_FFFF_FFFF_FFFF))
                area = (w_high - w_low) * (r_high - r_low)
                table = _TABLES.setdefault(area, _poisson(area))
                count = np.searchsorted(table, _unit(region), side="right")
                hit = np.flatnonzero(count)
                if len(hit):
                    times = count[hit]
                    which = np.repeat(hit, times)
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    dart = mix64(region[which] + (nth.astype(np.uint64) + U64(1)) * U64(0x8CB92BA72F3D8DD7))
                    rank = r_low + (r_high - r_low) * _unit(dart)
                    own = cell[which]
                    mark = mix64(dart + U64(0x2545F4914F6CDD1D))
                    seen = rank < limit[own]
                    if w_high > 1 or weights.min() < 1:
                        seen &= w_low + (w_high - w_low) * _unit(mix64(mark)) < weights[own]
                    own, rank, mark = own[seen], rank[seen].astype(np.float32), mark[seen]
                    # Least rank first; positive floats order as their bits. The dart's own bits tell it apart.
                    packed = rank.view(np.uint32).astype(np.uint64) << U64(32) | (mark >> U64(32))
                    coordinate = ((mark & U64(0xFFFF_FFFF)) * U64(k) >> U64(32)).astype(np.int64)
                    np.minimum.at(out.reshape(-1), rows[owner[own]] * k + coordinate, packed)
            r_low, r_high, band = r_high, 2 * r_high, band + 1
        w_low, w_high, column = w_high, 2 * w_high, column + 1
