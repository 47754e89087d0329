"""DartMinHash: weighted minwise signatures from darts thrown into weighted element regions.

An element is a word shingle, its weight the number of times it occurs.  Over each element's unit cells of
weight a unit-rate Poisson process of darts falls along the rank axis; a dart has a rank and one of k coordinates, all
from a hash of (element, cell, serial), so that texts share the darts of what they share.  Per coordinate, the
dart of least rank among those within the text's weights is kept.  The chance that two texts keep the same dart
is their weighted Jaccard similarity.  Ranks are thrown up to (k ln k + 2k) / total weight, and on to twice
that for texts with an empty coordinate, until none is empty.
"""

from __future__ import annotations

import numpy as np

from .textops import U64, mix

_GOLD = U64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within rows (a shorter row is one shingle), and row offsets."""
    n = np.diff(offsets)
    m = np.minimum(n, size)
    count = np.where(n > 0, n - m + 1, 0)
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(offsets[:-1], count) + np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], count)
    width = np.repeat(m, count)
    out = np.zeros(len(first), U64)
    with np.errstate(over="ignore"):
        for j in range(size):
            on = width > j
            out[on] = out[on] * _GOLD + hashes[first[on] + j]
        return mix(out + width.astype(U64)), out_offsets


def occurrences(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, cell, row): the c-th occurrence of an element in a row is its unit cell c of weight."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((elements, row))
    e, r = elements[order], row[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    cell = np.arange(len(e)) - np.repeat(at, np.diff(np.append(at, len(e))))
    return e, cell, r


#: elements of up to so many of some rows are counted pair by pair, others by products of matrices of so many elements
FEW, WIDE = 16, 2048


def overlaps(cells: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Common numbers of each two rows, which are distinct within a row."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    order = np.argsort(cells, kind="stable")
    c, r = cells[order], row[order]
    at = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(c)))
    of = np.repeat(size, size)
    out = np.zeros((n, n))
    few = (of > 1) & (of <= FEW)
    a, b = c[few], r[few]
    for d in range(1, FEW):
        same = np.flatnonzero(a[d:] == a[:-d])
        if not len(same):
            break
        out += np.bincount(b[same] * n + b[same + d], minlength=n * n).reshape(n, n)
    out += out.T
    seat, b = np.repeat(np.cumsum(size > FEW) - 1, size)[of > FEW], r[of > FEW]
    for k in range(0, int(seat[-1]) + 1 if len(seat) else 0, WIDE):
        x, y = np.searchsorted(seat, [k, k + WIDE])
        has = np.zeros((n, WIDE), np.float32)
        has[b[x:y], seat[x:y] - k] = 1
        out += has @ has.T
    return out


def signatures(elements: np.ndarray, offsets: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """rows x k dart ids (uint64); a row without elements keeps zeros."""
    n = len(offsets) - 1
    rank, dart = np.full(n * k, np.inf), np.zeros(n * k, U64)
    e, cell, row = occurrences(elements, offsets)
    limit = (k * np.log(k) + 2 * k) / np.maximum(np.diff(offsets), 1)
    with np.errstate(over="ignore"):
        state = mix(mix(e + U64(seed)) + cell.astype(U64) * _GOLD)
    at = _gap(state)  # the rank of each cell's next dart
    while len(row):
        on = np.flatnonzero(at < limit[row])
        while len(on):
            h, r = state[on], at[on]
            spot = row[on] * k + ((mix(h ^ _GOLD) >> U64(32)) * U64(k) >> U64(32)).astype(np.int64)
            np.minimum.at(rank, spot, r)
            best = r == rank[spot]
            dart[spot[best]] = h[best]
            with np.errstate(over="ignore"):
                state[on] = mix(h + _GOLD)
            at[on] = r + _gap(state[on])
            on = on[at[on] < limit[row[on]]]
        empty = np.isinf(rank.reshape(n, k)).any(axis=1)
        again = empty[row]
        row, at, state = row[again], at[again], state[again]
        limit = np.where(empty, limit * 2, limit)
    return dart.reshape(n, k)


def _gap(h: np.ndarray) -> np.ndarray:
    """Exponential steps between the ranks of a cell's darts."""
    return -np.log(((mix(h) >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52)
