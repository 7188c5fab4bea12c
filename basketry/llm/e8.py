"""The E8 lattice: nearest points, and the next nearest ones."""

from __future__ import annotations

import itertools

import numpy as np


def _vectors() -> np.ndarray:
    """The 240 shortest vectors: two ones of any sign, or eight halves with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


SHORTEST = _vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole-numbered points with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.argmax(np.abs(off), axis=1)
    rows = np.arange(len(x))
    odd = (near.sum(axis=1) % 2) != 0
    step = np.where(off[rows, worst] >= 0, 1.0, -1.0)
    near[rows[odd], worst[odd]] += step[odd]
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row of eight numbers."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def neighbours(x: np.ndarray, point: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, costs): for each row the ``count`` lattice points next nearest to x after ``point``,
    as offsets from it, and by how much their squared distance is larger."""
    cost = 2.0 - 2.0 * (x - point) @ SHORTEST.T
    best = np.argsort(cost, axis=1, kind="stable")[:, :count]
    return SHORTEST[best], np.take_along_axis(cost, best, axis=1)
