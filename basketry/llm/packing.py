"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents of its own input partition as they come, so
packing shuffles nothing and holds no more than its open windows. A document
is tokenised, ended with one token, and its whole windows are sealed at
once. The rest goes into the fill level that leaves the sum of the squared
numbers of partly filled windows smallest; a level array holds those numbers.
There are LEVELS levels, so that a few hundred documents fill windows as fast
as they open them; a window that lacks less than a level's width is topped up
with the head of the next document. Only what is open at the end of a
partition, a few windows for each level, is emptied end to end into full
windows, and the last tokens fill windows whose sizes are powers of two, so
that nothing is padded.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import lowered, slices, span_hashes, utf8, word_spans

#: words that a task remembers the tokens of
CACHE_WORDS = 800_000
#: fill levels of windows
LEVELS = 32
#: sequences that one partition can number
SEQUENCES = 1 << 40

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")

_ASCII_WORD = np.zeros(256, dtype=bool)
_ASCII_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Numbers:
    """Numbers by 64-bit hash, in sorted arrays: 12 bytes for each."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.add(hashes, numbers)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], np.int32(-1))

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Takes up hashes that are not there yet."""
        by = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[by])
        self.hashes = np.insert(self.hashes, at, hashes[by])
        self.numbers = np.insert(self.numbers, at, numbers[by])


class WordTokens:
    """Token ids of texts, for a tokenizer that drops white space and works on each stretch between it alone.

    A stretch (here: word) is encoded once and remembered under a 64-bit hash
    of its bytes, CACHE_WORDS of them at most (then the memory starts
    afresh). Sentence marks behind an ASCII letter or digit are encoded apart
    from what they follow: the tokenizer splits there anyway. What is left
    (the stem) and the marks are remembered in the same way. Words that are
    all letters go through the tokenizer many at a time; the ids that end a
    word part them again.
    """

    MARKS = b".,;:!?#$%&*|"
    JOINED = 1000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.is_mark = np.zeros(256, dtype=bool)
        self.is_mark[list(self.MARKS)] = True
        self._forget()

    def _forget(self) -> None:
        self.word = Numbers(np.empty(0, np.uint64), np.empty(0, np.int32))
        self.parts = np.empty((0, 2), np.int32)  # of a word: its stem and its marks
        nothing = span_hashes(np.empty(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))
        self.stem = Numbers(nothing, np.zeros(1, np.int32))
        self.start, self.length = np.zeros(1, np.int64), np.zeros(1, np.int32)  # of a stem's ids, in flat
        self.flat = np.empty(0, np.uint32)

    def _encode(self, stems: list[bytes]) -> np.ndarray:
        """Takes up the ids of these stems; their numbers."""
        texts = [s.decode("utf-8", "replace") for s in stems]
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        alone = [k for k, t in enumerate(texts) if not t.isalpha()]
        order, lengths, flat = [], [], [self.flat]
        groups = [plain[i: i + self.JOINED] for i in range(0, len(plain), self.JOINED)]
        found = self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in g]) for g in groups],
                                                 add_special_tokens=False)
        for g, e in zip(groups, found):
            ids = np.array(e.ids, dtype=np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(g):
                order += g
                lengths.append(np.diff(last, prepend=0))
                flat.append(ids)
            else:  # some letter became two pieces on the way
                alone += g
        for i in range(0, len(alone), 20_000):
            part = alone[i: i + 20_000]
            found = self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)
            own = [e.ids for e in found]
            order += part
            lengths.append(np.fromiter(map(len, own), np.int64, len(own)))
            flat.append(np.fromiter(itertools.chain.from_iterable(own), np.uint32))
        length = np.concatenate(lengths)
        numbers = np.empty(len(stems), np.int32)
        numbers[order] = np.arange(len(self.start), len(self.start) + len(order))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length.astype(np.int32)))
        self.flat = np.concatenate(flat)
        return numbers

    def _learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Takes up the words data[start:end], which have these hashes."""
        cut, live = end.copy(), np.arange(len(end))  # where the marks begin
        while len(live):
            live = live[self.is_mark[data[cut[live] - 1]]]
            cut[live] -= 1
            live = live[cut[live] > start[live]]
        apart = (cut < end) & (cut > start)
        apart[apart] = _ASCII_WORD[data[cut[apart] - 1]]
        cut = np.where(apart, cut, end)
        # lower case comes first in the tokenizer too, but for its special tokens
        odd = np.concatenate(([0], np.cumsum(data >= 0x80)))
        special = np.concatenate(([0], np.cumsum((data[:-1] == ord("<")) & (data[1:] == ord("|"))), [0]))
        special[-1] = special[-2]
        whole = (odd[cut] > odd[start]) | (special[cut - 1] > special[start])
        low = lowered(data)
        stems = np.where(whole, span_hashes(data, start, cut), span_hashes(low, start, cut))
        marks = span_hashes(data, cut, end)
        known, first, own = np.unique(np.concatenate((stems, marks)), return_index=True, return_inverse=True)
        missing = self.stem.find(known) < 0
        if missing.any():
            first = first[missing]
            raw, plain, n = data.tobytes(), low.tobytes(), len(start)
            a, b = np.concatenate((start, cut))[first], np.concatenate((cut, end))[first]
            kept = np.concatenate((whole, np.ones(n, bool)))[first]
            self.stem.add(known[missing], self._encode([
                (raw if k else plain)[i: j] for i, j, k in zip(a.tolist(), b.tolist(), kept.tolist())]))
        numbers = np.arange(len(self.parts), len(self.parts) + len(hashes), dtype=np.int32)
        self.parts = np.concatenate((self.parts, self.stem.find(known)[own].reshape(2, -1).T))
        self.word.add(hashes, numbers)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of ids) of the rows data[bounds[i]:bounds[i + 1]]."""
        start, end, first = word_spans(data, bounds)
        code, hashes = pd.factorize(span_hashes(data, start, end))
        by = np.argsort(hashes)  # sorted ones are found much faster
        hashes, rank = hashes[by], np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        code = rank[code]
        number = self.word.find(hashes)
        if new := int((number < 0).sum()):
            if len(self.word) + new > CACHE_WORDS:
                self._forget()
                number = np.full(len(hashes), -1, np.int32)
            example = np.empty(len(hashes), np.int64)
            example[code] = np.arange(len(code))
            missing = number < 0
            at = example[missing]
            self._learn(hashes[missing], data, start[at], end[at])
            number = self.word.find(hashes)
        stems = self.parts[number[code]].ravel()
        n = self.length[stems]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[stems] - (ends - n), n)]
        return ids, np.concatenate(([0], ends[1::2]))[first]


class LevelArray:
    """Windows of ``size`` tokens; ``count[k]`` of the open ones hold from k * ``grain`` tokens on, below (k + 1) * ``grain``.

    A window with less than ``grain`` tokens of room counts as filled.
    """

    def __init__(self, size: int, grain: int = 1):
        self.size, self.grain = size, grain
        levels = -(-size // grain)
        self.count = np.zeros(levels + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(levels)]  # the pieces of a window, and how much it holds
        self.fill: list[list[int]] = [[] for _ in range(levels)]
        self.last = np.full(levels, size, dtype=np.int64)  # what the last window of a level holds; none: no room

    def place(self, piece: tuple, n: int) -> tuple[list, int] | None:
        """Puts a piece of n < size tokens into a window; that window and what it holds, if it is filled now."""
        c, size, grain = self.count, self.size, self.grain
        after = self.last + n
        level = np.arange(len(after))
        new = np.minimum(after // grain, len(after))
        filled = after > size - grain
        # change of the sum of squares when the last window of each level takes the piece
        change = np.where((new == level) & ~filled, 0, 1 - 2 * c[:-1] + np.where(filled, 0, 2 * c[new] + 1))
        change[after > size] = np.iinfo(np.int64).max
        best = int(np.lexsort((~filled, change))[0])  # of equal ones rather a window that this fills
        alone = 0 if n > size - grain else 2 * int(c[n // grain]) + 1
        if change[best] <= alone and after[best] <= size:
            window, held = self.open[best].pop(), self.fill[best].pop()
            c[best] -= 1
            self.last[best] = self.fill[best][-1] if self.fill[best] else size
        else:
            window, held = [], 0
        window.append(piece)
        held += n
        if held > size - grain:
            return window, held
        k = held // grain
        c[k] += 1
        self.open[k].append(window)
        self.fill[k].append(held)
        self.last[k] = held
        return None

    def rest(self) -> Iterator[tuple]:
        """The pieces of all open windows, fullest first."""
        for windows in reversed(self.open):
            for window in windows:
                yield from window


class Packer:
    """Packs one partition's documents; rows of PIECES come out as windows fill."""

    def __init__(self, size: int, first_sequence: int, levels: int = LEVELS):
        self.size, self.sequence = size, first_sequence
        self.levels = LevelArray(size, max(1, size // levels))
        self.short: list[tuple[list, int]] = []  # filled windows that the next piece tops up
        self.redealt = 0  # tokens that were not placed by the sum of squares
        self.rows: list[tuple] = []

    def _seal(self, window: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total,
                              self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.size
        for start in range(0, whole, self.size):
            self._seal([(doc, start, ids[start: start + self.size], n)])
        while self.short and self.size - self.short[-1][1] < n - whole:
            window, held = self.short.pop()
            room = self.size - held
            window.append((doc, whole, ids[whole: whole + room].copy(), n))
            whole += room
            self._seal(window)
        if whole < n:
            if found := self.levels.place((doc, whole, ids[whole:].copy(), n), n - whole):
                if found[1] == self.size:
                    self._seal(found[0])
                else:
                    self.short.append(found)

    def finish(self) -> None:
        pieces = [p for window, _ in self.short for p in window] + list(self.levels.rest())
        left = sum(len(p[2]) for p in pieces)
        self.redealt += left
        sizes = [self.size] * (left // self.size)
        sizes += [1 << b for b in range(self.size.bit_length(), -1, -1) if left % self.size >> b & 1]
        queue = iter(pieces)
        piece = next(queue, None)
        for size in sizes:
            window, room = [], size
            while room:
                doc, start, ids, total = piece
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    piece, room = (doc, start + room, ids[room:], total), 0
                else:
                    piece, room = next(queue, None), room - len(ids)
            self._seal(window)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


@functools.lru_cache(maxsize=1)
def _words(path: str) -> WordTokens:
    """One for all tasks that a Python worker runs."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks beside this one use the other cores
    return WordTokens(path)


def pack_documents(docs: DataFrame, tokenizer: Callable[[], str], *, size: int = 2048, end_id: int = 1,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document, with the window (``sequence_id``, ``offset``) it lies in.

    ``tokenizer``: a function without arguments that gives the path of a
    tokenizer file on the machine it runs on. The file's tokenizer must drop
    white space and treat what lies between apart from the rest.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``:
    the document's tokens ``start .. start + length`` are at ``offset`` in
    their sequence. Sequences hold ``size`` tokens, the last few of a
    partition a smaller power of two. Reruns over the same partitions agree.

    A null or empty text is its end token alone. Rows with the same id, or
    equal rows, are packed each for itself; a null id stays null. An empty
    table gives no rows. Other columns are not read. A document of any length
    is cut into whole windows and one rest.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _words(tokenizer())
        packer = Packer(size, TaskContext.get().partitionId() * SEQUENCES)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in slices(bounds):
                found, at = tokens(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i])
                for k, doc in enumerate(ids[i:j]):
                    packer.add(doc, np.concatenate((found[at[k]: at[k + 1]], end)))
                yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInArrow(pack, PIECES)
