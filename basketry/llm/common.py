"""Helpers shared by the operators: Arrow text columns as byte arrays, hashes
of words, and the row key of a document."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import shared_path, stored  # noqa: F401

#: bytes of text that one numpy step works on (its arrays take some 30 times as much)
SLICE_BYTES = 2 << 20

#: True for the six ASCII white-space bytes that separate words
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(text: Column) -> Column:
    """Tells rows with one id but different texts apart (null text: as empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with its columns inside ``row``, so that none clashes with ``columns``; ``select("row.*")`` undoes it."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, bounds) of a string column: row i is data[bounds[i]:bounds[i + 1]], a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[bounds[0]: bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of up to ``most`` bytes each (a longer row is a range of its own)."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(member: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the maximal runs of ``member`` inside rows, and for each row
    the number of runs before it (one more at the end)."""
    before = np.empty_like(member)
    before[:1] = False
    before[1:] = member[:-1]
    inner = bounds[1:-1][bounds[1:-1] < len(member)]
    before[inner] = False
    start = np.flatnonzero(member & ~before)
    after = np.empty_like(member)
    after[-1:] = False
    after[:-1] = member[1:]
    inner = inner[inner > 0]
    after[inner - 1] = False
    end = np.flatnonzero(member & ~after) + 1
    return start, end, np.searchsorted(start, bounds)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spans`` of the words, which ASCII white space parts."""
    return spans(~IS_SPACE[data], bounds)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)


def pieces(data: np.ndarray, bounds: np.ndarray, member: np.ndarray,
           most: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bounds): rows of more than ``most`` bytes cut into several, behind a byte that is no ``member``.

    A run of members is never cut, so a piece of one run can be longer. ``member``: by byte value.
    """
    long = np.flatnonzero(np.diff(bounds) > most)
    if not len(long):
        return np.arange(len(bounds) - 1), bounds
    owner, cuts, done = [], [], 0
    for k in long.tolist():
        owner.append(np.arange(done, k))
        cuts.append(bounds[done: k])
        at, end, own = int(bounds[k]), int(bounds[k + 1]), []
        while at < end:
            own.append(at)
            stop = at + most
            while stop < end:  # the first byte from there on that parts runs
                free = np.flatnonzero(~member[data[stop: min(end, stop + most)]])
                if len(free):
                    stop += int(free[0]) + 1
                    break
                stop += most
            at = min(stop, end)
        owner.append(np.full(len(own), k))
        cuts.append(np.array(own, dtype=bounds.dtype))
        done = k + 1
    owner.append(np.arange(done, len(bounds) - 1))
    cuts.append(bounds[done:])
    return np.concatenate(owner), np.concatenate(cuts)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash (SplitMix64), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: bytes from which on a word is hashed by itself
_LONG = 4096


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span: its eight-byte pieces, mixed one after the other."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    pieces = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = end - start
    out = mix64(left.astype(np.uint64) * np.uint64(_ODD))
    live = np.flatnonzero((left > 0) & (left <= _LONG))
    at, left = start[live], left[live]
    while len(live):
        out[live] = mix64(out[live] ^ (pieces[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(end - start > _LONG):
        digest = hashlib.blake2b(data[start[k]: end[k]].tobytes(), digest_size=8).digest()
        out[k] = np.frombuffer(digest, "<u8")[0]
    return out


@functools.lru_cache(maxsize=2)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(16, int(n).bit_length()))[:n]


def run_hashes(items: np.ndarray, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """A 64-bit hash of items[start:start+length] for each start, from the items' own hashes."""
    total = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * powers(_ODD, len(items)), out=total[1:])
    return mix64((total[start + length] - total[start]) * powers(_ODD_INVERSE, len(items) + 1)[start])
