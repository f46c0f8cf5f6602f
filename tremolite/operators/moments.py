"""Power moments of cells of time, for sums of a smooth kernel over all earlier events: a cell far enough away stands for its events.

Cells have widths of 2^level; a moment holds powers of (middle - time) / half, weighed.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def cell_moments(t, cell, weights, width: float, level: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells of the level, moments (cell, weight, order)) of events in the order of their cells."""
    at = cell >> level
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    size = width * 2.0 ** level
    x = ((at + 0.5) * size - t) / (size / 2)
    out = np.empty((len(start), len(weights), order))
    power = np.array(weights, float)
    for k in range(order):
        out[:, :, k] = np.add.reduceat(power, start, axis=1).T
        power *= x
    return at[start], out


@lru_cache
def shifts(left: float, right: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For both halves of a cell the matrix that moves series down; transposed, with signs changed, moments up."""
    k = np.arange(order)
    comb = np.array([[math.comb(i, j) for j in k] for i in k], float) * 0.5 ** k[:, None]
    return tuple(comb * s ** np.maximum(k[:, None] - k[None, :], 0) for s in (left, right))


def by_half(cells: np.ndarray, x: np.ndarray, halves) -> np.ndarray:
    odd = (cells & 1).astype(bool)
    out = np.empty_like(x)
    for side, half in zip((~odd, odd), halves):
        out[side] = (x[side].reshape(-1, x.shape[-1]) @ half).reshape(-1, *x.shape[1:])
    return out


def parents(cells: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moments of the next level: those of both halves about the middle of the whole, by the binomial theorem; cells come in order."""
    moved = by_half(cells, m, [x.T for x in shifts(1.0, -1.0, m.shape[-1])])
    up = cells >> 1
    start = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
    return up[start], np.add.reduceat(moved, start, axis=0)


def binomials(p: float, n: int) -> np.ndarray:
    """Coefficients of (1 + x)^-p."""
    k = np.arange(n - 1)
    return np.r_[1.0, np.cumprod(-(p + k) / (k + 1))]
