"""Prediction by partial matching over bytes, as tables.

Documents are dealt to batches by hash. A batch reports each of its distinct
grams and words once, with its training count; their sums over all batches
are the model, which no task or driver holds whole. What a gram or a word is
worth goes back, by a join, to the batches that have it, and a batch adds it
up over its documents. So the model grows with the corpus, and only the
number of distinct grams of a batch is shuffled, not its text's length.

The context trie is a table of grams (a context of ``order`` symbols and the
next one) with their training counts. A gram's code length is found where
the contexts with the same last two bytes are together: the longest context
that has the symbol codes it, each longer one that was seen costs an escape,
and symbols seen in a longer context are excluded from the shorter ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.bytegrams import gram_numbers, padded, row_sums
from basketry.llm.common import partitions, row_key, slices, span_hashes, stored, utf8, word_spans

#: symbols that a text can have, where no context is left
ALPHABET = 256
#: bytes of text in a batch, on average
BATCH_BYTES = 48 << 20
#: bytes of text that one step works on
SLICE = 1 << 20
#: keys that are counted before they are folded together, and rows that are handed on at once
FOLD, ROWS = 1_000_000, 200_000
#: key of the end of a text among the words
END_KEY = -(1 << 63)


class Level:
    """The contexts of one length in a shard: their symbols with counts, sorted by (context, symbol)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """grams: context and symbol packed; sorted, distinct; counts above 0."""
        self.grams, self.counts = grams, counts.astype(np.float64)
        self.contexts, self.first = np.unique(grams >> np.uint64(8), return_index=True)
        bounds = np.append(self.first, len(grams))
        self.kinds = np.diff(bounds).astype(np.float64)
        self.totals = np.add.reduceat(self.counts, self.first) if len(grams) else np.empty(0)
        self.excluded = np.zeros(len(self.contexts))  # of the parent's counts, by a context's symbols

    def shorter(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The grams without their first symbol, each with the number of contexts here that have it."""
        low = self.grams & np.uint64((1 << 8 * order) - 1)
        return np.unique(low, return_counts=True)

    def exclude(self, parent_count: np.ndarray) -> None:
        if len(self.grams):
            self.excluded = np.add.reduceat(parent_count, self.first)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of each gram or 0, index of its context or -1)."""
        return _at(self.grams, grams, self.counts), _index(self.contexts, grams >> np.uint64(8))


def _index(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _at(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _index(table, keys)
    return np.where(at >= 0, values[at] if len(values) else 0.0, 0.0)


def levels(grams: np.ndarray, counts: np.ndarray, order: int, pairs: np.ndarray) -> list[Level]:
    """Trie levels of a shard, longest contexts first, down to no context.

    ``grams``, ``counts``: the shard's training grams, sorted. ``pairs``: for
    the whole corpus, by (byte, symbol), the number of longer contexts with
    that pair. A shorter context counts a symbol once for each longer context
    it follows (update exclusion).
    """
    out = [Level(grams, counts)]
    for length in range(order - 1, 1, -1):
        out.append(Level(*out[-1].shorter(length + 1)))
    flat = pairs.ravel()
    out.append(Level(np.flatnonzero(flat).astype(np.uint64), flat[flat > 0]))
    single = (pairs > 0).sum(axis=0)
    out.append(Level(np.flatnonzero(single).astype(np.uint64), single[single > 0]))
    for length, (longer, parent) in zip(range(order, 0, -1), zip(out[:-1], out[1:])):
        longer.exclude(_at(parent.grams, longer.grams & np.uint64((1 << 8 * length) - 1), parent.counts))
    return out


def code_lengths(wanted: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log2 of the probability of each wanted gram (sorted out by its context's last bytes like the trie)."""
    order = len(trie) - 1
    out = np.zeros(len(wanted))
    rest = np.arange(len(wanted))
    excluded, kinds = np.zeros(len(wanted)), np.zeros(len(wanted))  # by the longer context, if seen
    for length, level in zip(range(order, -1, -1), trie):
        keys = wanted[rest] & np.uint64((1 << 8 * (length + 1)) - 1)
        count, context = level.find(keys)
        seen = context >= 0
        total = np.where(seen, level.totals[context] if len(level.totals) else 0.0, 0.0) - excluded[rest]
        own = np.where(seen, level.kinds[context] if len(level.kinds) else 0.0, 0.0) - kinds[rest]
        hit = count > 0
        out[rest[hit]] += np.log2((2 * count[hit] - 1) / (2 * total[hit]))
        escape = ~hit & seen & (total > 0)
        out[rest[escape]] += np.log2(own[escape] / (2 * total[escape]))
        moved = rest[seen & ~hit]
        at = context[seen & ~hit]
        excluded[moved] = level.excluded[at]
        kinds[moved] = level.kinds[at]
        unseen = rest[~seen & ~hit]
        excluded[unseen], kinds[unseen] = 0.0, 0.0
        rest = rest[~hit]
    out[rest] -= np.log2(np.maximum(ALPHABET - kinds[rest], 1))
    return out


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all words, words before each row); A-Z count as a-z. Keys are negative."""
    data = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    start, end, first = word_spans(data, bounds)
    hashes = span_hashes(data, start, end) | np.uint64(1 << 63)
    return np.maximum(hashes.view(np.int64), END_KEY + 1), first


class Counts:
    """Counts by key, added up as they come: a sorted table, and what was added since it was last folded in."""

    def __init__(self):
        self.keys, self.counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.size = self.folded = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys.astype(np.int64, copy=False))
        self.counts.append(counts.astype(np.int64))
        self.size += len(keys)
        if self.size > max(FOLD, 2 * self.folded):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts = [], []
        by = np.argsort(key, kind="stable")
        key, n = key[by], n[by]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        self.keys, self.counts = [key[at]], [np.add.reduceat(n, at) if len(at) else n]
        self.size = self.folded = len(at)
        return self.keys[0], self.counts[0]


COUNTS = "key bigint, batch int, n bigint"


def _batch_counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(key, batch, n): the distinct grams and words of a batch with their training counts."""
    found, number = Counts(), 0
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        train = batch.column("train").to_numpy(zero_copy_only=False)
        number = batch.column("batch")[0].as_py() if batch.num_rows else number
        found.add(np.array([END_KEY]), np.array([train.sum()]))
        for i, j in slices(bounds, SLICE):
            own, at = data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i]
            symbols, ends = padded(own, at, order)
            gram, key = gram_numbers(symbols, order)
            weight = np.repeat(train[i:j].astype(np.int8), np.diff(ends))[: len(gram)]
            inside = np.ones(len(gram), bool)  # not over the end of a row
            for k in range(1, order + 1):
                inside[ends[1:-1] - k] = False
            there = np.zeros(len(key), bool)
            there[gram[inside]] = True
            found.add(key[there].view(np.int64), np.bincount(gram[inside], weights=weight[inside], minlength=len(key))[there])
            words, first = _words(own, at)
            code, distinct = pd.factorize(words)
            found.add(distinct, np.bincount(code, weights=np.repeat(train[i:j], np.diff(first)), minlength=len(distinct)))
    key, n = found.fold()
    for i in range(0, len(key), ROWS):
        part = key[i: i + ROWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(np.full(len(part), number, np.int32)), pa.array(n[i: i + ROWS])],
            names=["key", "batch", "n"])


def _shard_values(table: pa.Table, order: int, pairs: np.ndarray) -> pa.Table:
    grams, n = (table.column(c).to_numpy() for c in ("key", "n"))
    by = np.argsort(grams)
    grams, n = grams[by].astype(np.uint64), n[by]
    trie = levels(grams[n > 0], n[n > 0], order, pairs)
    return pa.table({"key": pa.array(grams.astype(np.int64)), "value": pa.array(code_lengths(grams, trie))})


SCORES = ("doc_id bigint, row_key bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, "
          "score double")


def _batch_scores(docs: pa.Table, values: pa.Table, order: int, total: int, distinct: int) -> pa.Table:
    key, value = values.column("key").to_numpy(), values.column("value").to_numpy()
    by = np.argsort(key)
    key, value = key[by], value[by]
    ends = float(value[0]) if len(key) and key[0] == END_KEY else 0.0
    tokens, known, base, score = [], [], [], []

    def log(count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))

    for batch in docs.to_batches():
        data, bounds = utf8(batch.column("text"))
        for i, j in slices(bounds, SLICE):
            own, at = data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i]
            symbols, rows = padded(own, at, order)
            number, grams = gram_numbers(symbols, order)
            bits = _at(key, grams.view(np.int64), value)
            score.append(row_sums(bits[number], rows, order) * np.log10(2.0))
            words, first = _words(own, at)
            code, words = pd.factorize(words)
            count = _at(key, words, value)[code]
            sums = [np.concatenate(([0.0], np.cumsum(x)))[first] for x in (log(count), count > 0)]
            tokens.append(np.diff(first) + 1)
            known.append(np.diff(sums[1]) + (ends > 0))
            base.append(np.diff(sums[0]) + log(np.float64(ends)))

    def joined(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        return pa.array(np.concatenate(parts) if parts else np.empty(0)).cast(kind)

    return pa.table({"doc_id": docs.column("doc_id"), "row_key": docs.column("row_key"), "train": docs.column("train"),
                     "n_tokens": joined(tokens, pa.int64()), "n_known": joined(known, pa.int64()),
                     "base_score": joined(base, pa.float64()), "score": joined(score, pa.float64())})


def ppm_scores(docs: DataFrame, train: Column, *, order: int = 5, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Log10 probability of every text under a model of those that ``train`` picks; one row per row of ``docs``.

    ``doc_id, row_key, train, n_tokens, n_known, train_tokens, base_score,
    score``. ``score`` is the model's, of the text's bytes and its end. The
    base is a smoothed unigram model over words (A-Z lower-cased) and one end
    per text: its token counts, and the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))). Words are told apart by 63 bits of
    hash.

    ``train`` null means false. A null or empty text is its end alone. Equal
    rows are scored alike, and each counts in training. With nothing to train
    on, every symbol is as likely as any other. An empty table gives no rows.
    Other columns are not read.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6: a gram has to fit 56 bits")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
                       F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("batch", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "row_key"),
                                           F.lit(max(1, -(-size // BATCH_BYTES)))).cast("int"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batch_counts(batches, order)

    counts = stored(rows.select("text", "train", "batch").groupBy("batch").applyInArrow(counted, COUNTS), "ppm-batches")
    totals = stored(counts.groupBy("key").agg(F.sum("n").alias("n")), "ppm-totals")
    tokens = totals.where("key < 0").agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    total, distinct = int(tokens[0] or 0), int(tokens[1] or 0)
    # at most 65,536 rows: for each byte and symbol, the two-byte contexts with them
    pairs = np.zeros(1 << 16, dtype=np.int64)
    longer = totals.where("key >= 0 and n > 0").select((F.col("key").bitwiseAND(0xFFFFFF)).alias("t")).distinct()
    for pair, n in longer.groupBy(F.col("t").bitwiseAND(0xFFFF)).count().collect():
        pairs[pair] = n
    pairs = pairs.reshape(256, 256)
    # contexts with the same last two bytes share a shard
    shard = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(4 * partitions(docs.sparkSession)))
    grams = (totals.where("key >= 0").withColumn("shard", shard).groupBy("shard")
             .applyInArrow(lambda t: _shard_values(t, order, pairs), "key bigint, value double"))
    values = grams.unionAll(totals.where("key < 0").select("key", F.col("n").cast("double").alias("value")))
    back = counts.select("key", "batch").join(values, "key").groupBy("batch")
    scored = rows.groupBy("batch").cogroup(back).applyInArrow(
        lambda d, v: _batch_scores(d, v, order, total, distinct), SCORES)
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint"))
