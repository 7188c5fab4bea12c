"""Byte n-grams of whole texts, numbered by walking a context trie level by level.

A document's symbols are BEGIN (as many as a context is long), its UTF-8
bytes and END; neither of the two occurs in UTF-8. A gram is packed into an
integer, its last symbol in the lowest byte.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

BEGIN, END = 0xFE, 0xFF
#: cells of a level's table, at most; beyond, the cells in use are numbered by hashing
CELLS = 4 << 20


def padded(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all rows, bounds of the rows in them); each row has ``order`` BEGINs in front and END behind."""
    n = len(bounds) - 1
    out = np.full(len(data) + n * (order + 1), BEGIN, dtype=np.uint8)
    at = bounds + np.arange(n + 1) * (order + 1)
    for k in range(n):
        a, b = at[k] + order, at[k + 1] - 1
        out[a:b] = data[bounds[k]: bounds[k + 1]]
        out[b] = END
    return out, at


def gram_numbers(symbols: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, keys): position i's gram of order + 1 symbols ends at i + order, and is keys[number[i]].

    One table step per symbol: the node of a gram's first symbols and the next
    symbol give a cell, and the cells in use are the nodes of the next level.
    """
    used = np.zeros(256, dtype=bool)
    used[symbols] = True
    alphabet = np.flatnonzero(used)
    small = np.zeros(256, dtype=np.int32)
    small[alphabet] = np.arange(len(alphabet), dtype=np.int32)
    narrow, width = small[symbols], len(alphabet)
    count = len(symbols) - order
    number, keys = narrow[:count], alphabet.astype(np.uint64)
    for level in range(1, order + 1):
        cell = number.astype(np.int64) * width + narrow[level: level + count]
        if len(keys) * width <= CELLS:
            taken = np.zeros(len(keys) * width, dtype=bool)
            taken[cell] = True
            nodes = np.flatnonzero(taken)
            renumber = np.empty(len(taken), dtype=np.int32)
            renumber[nodes] = np.arange(len(nodes), dtype=np.int32)
            number = renumber[cell]
        else:
            number, nodes = pd.factorize(cell)
        keys = keys[nodes // width] << np.uint64(8) | alphabet[nodes % width].astype(np.uint64)
    return number, keys


def row_sums(values: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Per row the sum over the grams that end in it (bytes and END)."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[at[1:] - order] - total[at[:-1]]
