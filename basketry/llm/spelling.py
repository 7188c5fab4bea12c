"""Spelling variants: words one edit apart, by k-d trees over letter-count vectors.

Inserting or deleting a letter changes one letter's count by one, replacing one
changes two counts by one: words one edit apart have letter-count vectors at an
L1 distance of at most two. A vector is kept as bits, a letter's count in unary
(a bit for "at least one", one for "at least two", ...), so that the number of
bits in which two vectors differ is their L1 distance, or less where letters
share bits or are very frequent.

1. Words are counted over all texts.
2. For each word length a k-d tree, grown over a bounded sample, cuts the
   vectors into cells: a node asks whether a letter occurs so often. Every word
   is stored in its cell, and visits all cells that may hold a neighbour: those
   whose box is at most two bits from its vector for words of its own length,
   and at most one bit for words that are one letter longer. Of two cells of one
   length only the lower visits the higher.
3. A cell goes on cutting its words by the same rule, prunes visitors at each
   node by their distance to the box, and at the leaves compares vectors, then
   the letters in their order. Per word, numbers and best neighbours come out,
   not pairs.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import stored

#: letters of words, all in Latin-1: a letter is a byte here
LETTERS = "A-Za-zÀ-ÿ"
#: letters of a cell's words, on average
CELL_LETTERS = 400_000
#: words per length that cells are cut by, at most, and the fewest of them in a cell that is cut
SAMPLE, LEAST = 100_000, 64
#: words of a leaf
LEAF = 64
#: letters of a cell's visitors that a task takes
VISITOR_LETTERS = 4_000_000
#: vectors compared at once
AT_ONCE = 1 << 20
#: different words that are counted before counts are handed on
FLUSH = 400_000


def word_counts(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    """(word, n): the words of texts, some with a letter deleted (see ``spelling_variants``)."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = runs.findall(text.as_py() or "")
            if not found:
                continue
            prefix = b"" if doc is None else str(doc).encode()
            seed = zlib.crc32(prefix + b":")
            # lower() of bytes changes A-Z alone
            own = Counter("\n".join(found).encode("latin-1").lower().split(b"\n"))
            for word, n in own.items():
                h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                if every and h % every == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1:]
                    if len(word) < least:
                        continue
                counts[word] += n
            if len(counts) > FLUSH:
                yield rows()
                counts.clear()
    yield rows()


# ------------------------------------------------------------------ vectors

#: for each letter its first bit, and the bits that its count may take
_FIRST = np.zeros(256, dtype=np.int64)
_ROOM = np.zeros(256, dtype=np.int64)
_FIRST[0x61:0x7B], _ROOM[0x61:0x7B] = np.arange(26) * 3, 3
_FIRST[0xE0:0x100], _ROOM[0xE0:0x100] = 78 + np.arange(32), 1
_FIRST[0xC0:0xE0], _ROOM[0xC0:0xE0] = 110 + np.arange(32) % 18, 1
BITS = 128


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters, lengths): a row of bytes for each word, zeros behind its end."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    width = max(int(length.max(initial=0)), 1)
    table = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raw), np.uint8).reshape(len(raw), width)
    return table, length


def vectors(table: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each word: its letter counts in unary."""
    n = len(table)
    bits = np.zeros((n, BITS), dtype=bool)
    room = _ROOM[table]  # none behind a word's end
    # letters that share a bit count together; a letter's k-th occurrence sets its k-th bit
    count = np.zeros((n, BITS), dtype=np.int16)
    for k in range(table.shape[1]):
        at = np.flatnonzero(room[:, k])
        first, most = _FIRST[table[at, k]], room[at, k]
        seen = count[at, first]
        fits = seen < most
        bits[at[fits], first[fits] + seen[fits]] = True
        count[at, first] = seen + 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def has(vector: np.ndarray, bit: int) -> np.ndarray:
    return (vector[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(bool)


def best_bit(vector: np.ndarray) -> int | None:
    """The bit that halves the vectors best; None if all are equal."""
    ones = np.unpackbits(np.ascontiguousarray(vector).view(np.uint8).reshape(len(vector), -1), axis=1,
                         bitorder="little").sum(axis=0, dtype=np.int64)
    uneven = np.abs(2 * ones - len(vector))
    bit = int(np.argmin(uneven))
    return bit if 0 < ones[bit] < len(vector) else None


class Cells:
    """A k-d tree over vectors; leaves are numbered from 0, left to right."""

    def __init__(self, vector: np.ndarray, words: float, most: int, least: int):
        """Cuts until a leaf's share of ``words`` is at most ``most``, or it has fewer than ``least`` vectors."""
        self.nodes: list[tuple[int, int, int]] = []  # bit (or -1: leaf), child without it (or number), child with it
        self.leaves = 0
        self._grow(vector, words / max(len(vector), 1), most, least)

    def _grow(self, vector: np.ndarray, weight: float, most: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, self.leaves, 0))
        bit = None
        if len(vector) * weight > most and len(vector) >= least:
            bit = best_bit(vector)
        if bit is None:
            self.leaves += 1
            return at
        one = has(vector, bit)
        a = self._grow(vector[~one], weight, most, least)
        b = self._grow(vector[one], weight, most, least)
        self.nodes[at] = (bit, a, b)
        return at

    def own(self, vector: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        rows, leaf = self.visits(vector, 0)
        out = np.empty(len(vector), dtype=np.int64)
        out[rows] = leaf
        return out

    def visits(self, vector: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose boxes are within ``radius`` bits."""
        rows, leaves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo = [(0, np.arange(len(vector)), np.zeros(len(vector), np.int8))]
        while todo:
            at, row, away = todo.pop()
            bit, a, b = self.nodes[at]
            if bit < 0:
                rows.append(row)
                leaves.append(np.full(len(row), a))
                continue
            one = has(vector[row], bit)
            for child, side in ((a, ~one), (b, one)):
                off = away + ~side
                inside = off <= radius
                if inside.any():
                    todo.append((child, row[inside], off[inside]))
        return np.concatenate(rows), np.concatenate(leaves)


# ------------------------------------------------------------------ neighbours


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_more(short: np.ndarray, long: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``long`` is ``short`` with one letter put in; ``length``: of the short ones."""
    n = len(short)
    width = long.shape[1]
    wide = np.zeros((n, width), dtype=np.uint8)
    wide[:, : min(short.shape[1], width)] = short[:, :width]
    place = np.arange(width)
    inside = place[None, :] < length[:, None]
    head = np.argmin(np.concatenate(((wide == long) & inside, np.zeros((n, 1), bool)), axis=1), axis=1)
    shifted = np.zeros_like(long)
    shifted[:, :-1] = long[:, 1:]
    same = (wide == shifted) | ~inside | (place[None, :] < head[:, None])
    return same.all(axis=1)


NEAR = "word string, n_near bigint, best struct<n:bigint,word:string>"


def cell_neighbours(table: pa.Table, leaf: int) -> pa.Table:
    """Of a cell's words and its visitors: for each, the number of near words and the best of them."""
    word = table.column("word").combine_chunks()
    n = table.column("n").to_numpy()
    kind = table.column("kind").to_numpy()  # 0: stored here, 1: visitor of this length, 2: one letter shorter
    text, length = letters(word)
    vector = vectors(text)
    # places in (n descending, word) order: the best neighbour is the one with the lowest
    rank = np.empty(len(n), dtype=np.int64)
    by = np.lexsort((*(text[:, k] for k in range(text.shape[1] - 1, -1, -1)), -n))
    rank[by] = np.arange(len(n))
    near = np.zeros(len(n), dtype=np.int64)
    best = np.full(len(n), len(n), dtype=np.int64)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(near, a, 1)
        np.add.at(near, b, 1)
        np.minimum.at(best, a, rank[b])
        np.minimum.at(best, b, rank[a])

    def compare(stored_rows: np.ndarray, visitors: np.ndarray) -> None:
        """All visitors that came to a leaf against its words."""
        step = max(1, AT_ONCE // max(len(stored_rows), 1))
        mine = vector[stored_rows]
        for i in range(0, len(visitors), step):
            v = visitors[i: i + step]
            x = vector[v]
            off = (np.bitwise_count(x[:, None, 0] ^ mine[None, :, 0]) + np.bitwise_count(x[:, None, 1] ^ mine[None, :, 1]))
            most = np.where(kind[v] == 2, 1, 2)[:, None]
            p, q = np.nonzero(off <= most)
            a, b = v[p], stored_rows[q]
            # words of this cell meet from both sides
            once = (kind[a] > 0) | (a < b)
            a, b = a[once], b[once]
            shorter = kind[a] == 2
            ok = np.zeros(len(a), dtype=bool)
            same = ~shorter
            ok[same] = one_replaced(text[a[same]], text[b[same]])
            ok[shorter] = one_more(text[a[shorter]], text[b[shorter]], length[a[shorter]])
            link(a[ok], b[ok])

    own = np.flatnonzero(kind == 0)
    # a cell that several tasks share: its words meet each other in the first of them
    first = bool(table.column("chunk")[0].as_py() == 0) if len(table) else True
    visiting = np.flatnonzero(kind > 0) if not first else np.arange(len(n))
    radius = np.where(kind == 2, 1, 2).astype(np.int8)
    todo = [(own, visiting, np.zeros(len(visiting), np.int8))]
    while todo:
        rows, row, away = todo.pop()
        if not len(rows) or not len(row):
            continue
        bit = best_bit(vector[rows]) if len(rows) > leaf else None
        if bit is None:
            compare(rows, row)
            continue
        mine, one = has(vector[rows], bit), has(vector[row], bit)
        for side, keep in ((False, ~mine), (True, mine)):
            off = away + (one != side)
            inside = off <= radius[row]
            todo.append((rows[keep], row[inside], off[inside]))
    some = np.flatnonzero(near)
    at = by[best[some]]
    return pa.table({"word": word.take(pa.array(some)), "n_near": pa.array(near[some]),
                     "best": pa.StructArray.from_arrays([pa.array(n[at]), word.take(pa.array(at))], names=["n", "word"])})


def _visits(batches: Iterator[pa.RecordBatch], trees: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
    """(length, cell, kind, word, n): each word in its cell, and wherever it may have neighbours."""
    for batch in batches:
        lengths = pc.utf8_length(batch.column(0)).to_numpy()
        for size in np.unique(lengths).tolist():
            of_size = np.flatnonzero(lengths == size)
            step = max(1, 200_000 // size)
            for i in range(0, len(of_size), step):
                part = batch.take(pa.array(of_size[i: i + step]))
                vector = vectors(letters(part.column(0))[0])
                home = trees[size].own(vector)
                row, cell = trees[size].visits(vector, 2)
                higher = cell > home[row]
                out = [(np.arange(len(home)), home, 0, size), (row[higher], cell[higher], 1, size)]
                if (tree := trees.get(size + 1)) is not None:
                    out.append((*tree.visits(vector, 1), 2, size + 1))
                for row, cell, kind, of in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), of, np.int32)), pa.array(cell.astype(np.int32)),
                         pa.array(np.full(len(row), kind, np.int32)), part.column(0).take(pa.array(row)),
                         part.column(1).take(pa.array(row))], names=["length", "cell", "kind", "word", "n"])


def near_words(words: DataFrame, *, cell_letters: int = CELL_LETTERS, visitor_letters: int = VISITOR_LETTERS,
               sample: int = SAMPLE, least: int = LEAST, leaf: int = LEAF) -> DataFrame:
    """``word, n_near, most, form`` of each word of ``words`` (distinct ``word`` of Latin-1 letters, ``n``) that has
    words one edit apart: their number, and of those of largest n (``most``) the first in code-point order."""
    spark = words.sparkSession
    sized = words.withColumn("length", F.length("word"))
    trees: dict[int, Cells] = {}
    for length, count in sized.groupBy("length").count().collect():  # a row for each word length
        most = max(leaf, cell_letters // length)
        vector = np.zeros((0, 2), np.uint64)
        if count > most:
            lowest = sized.where(F.col("length") == length).select("word").orderBy(F.xxhash64("word"), "word")
            taken = lowest.limit(max(least, min(sample, 4_000_000 // length))).toArrow().column("word")
            vector = vectors(letters(taken.combine_chunks())[0])
        trees[length] = Cells(vector, count, most, least)
    shared = spark.sparkContext.broadcast(trees)  # per length 2 * SAMPLE / LEAST nodes, about
    placed = words.select("word", "n").mapInArrow(lambda b: _visits(b, shared.value),
                                                  "length int, cell int, kind int, word string, n bigint")
    placed = stored(placed, "word-cells")
    chunks = (placed.where("kind > 0").groupBy(F.col("length").alias("_l"), F.col("cell").alias("_c"))
              .agg(F.ceil(F.count(F.lit(1)) * F.col("_l") / visitor_letters).cast("int").alias("chunks")))
    dealt = placed.join(chunks, (F.col("length") == F.col("_l")) & (F.col("cell") == F.col("_c")), "left")
    chunk = F.when(F.col("kind") > 0, F.array(F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    dealt = dealt.select("length", "cell", "kind", "word", "n", F.explode(chunk).alias("chunk"))
    found = dealt.groupBy("length", "cell", "chunk").applyInArrow(lambda t: cell_neighbours(t, leaf), NEAR)
    first = F.min(F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word"))).alias("first")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
            .select("word", "n_near", (-F.col("first.n")).alias("most"), F.col("first.word").alias("form")))


def spelling_variants(docs: DataFrame, *, least: int = 7, min_count: int = 2, ratio: int = 10, every: int = 0,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the words of all texts, and what each seems to be a variant of.

    Words are the maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF,
    A-Z as a-z, that have at least ``least`` letters and occur ``min_count``
    times (``n``) in all texts together. Two are near if one edit turns one
    into the other: a letter put in, taken out or replaced. ``n_near``: the
    near words. ``form``: the one of largest n (ties: the first in code-point
    order), if that is at least ``ratio`` times the word's, else null;
    ``form_n``: its n. ``root``: where forms of forms end, the word itself if
    it has none.

    With ``every`` above 0, errors are planted: of a run whose
    crc32("<id>:<run>") it divides, the letter at that crc32 modulo the length
    is deleted before counting (a null id is written as nothing).

    Null and empty texts have no words. Repeated rows count each. Texts and
    words of any length are whole. An empty table gives no rows. Other columns
    are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that a form is more frequent than its word")
    counted = (docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
               .mapInArrow(functools.partial(word_counts, least=least, every=every), "word string, n bigint")
               .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    words = stored(counted, "words")
    near = near_words(words).withColumnRenamed("word", "_w")
    found = words.join(near, F.col("word") == F.col("_w"), "left")
    frequent = F.col("most") >= ratio * F.col("n")
    found = stored(found.select(
        "word", F.when(frequent, F.col("form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(frequent, F.col("most")).alias("form_n")),
        "word-forms")
    # a form is ``ratio`` times as frequent as its word: chains are short, and each round doubles what they reach
    top = words.agg(F.max("n")).first()[0] or 1
    hops = 1
    while min_count * ratio ** hops <= top:
        hops += 1
    ends = found.where("form is not null").select("word", F.col("form").alias("end"))
    reach = 1
    while reach < hops:
        ends = stored(ends, "word-ends")
        further = ends.select(F.col("word").alias("_w"), F.col("end").alias("_end"))
        ends = ends.join(further, F.col("end") == F.col("_w"), "left").select("word", F.coalesce("_end", "end").alias("end"))
        reach *= 2
    ends = ends.select(F.col("word").alias("_w"), "end")
    return (found.join(ends, F.col("word") == F.col("_w"), "left")
            .select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n"))
