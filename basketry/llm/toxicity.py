"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words, and the beginnings of its words, hashed into
buckets. The score of the buckets that a text has is a bias, a weight for each
of them, and for each two of them the inner product of their factors: what a
pair says beyond its two terms, which a sum of weights cannot.

Spark counts in how many labelled texts of either kind a bucket is found, over
a sample with a bound for each kind, and the buckets that say most are the
model's terms. The machine is fitted to the sample's rows of such terms in one
task (all three sizes are parameters), goes to all tasks, and scores whole
texts where they are: no text is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import lowered, mix64, pieces, row_key, slices, span_hashes, spans, stored, utf8

#: buckets that terms are hashed into
BUCKETS = 1 << 20
#: lengths in bytes of the word beginnings that are terms, beside the word itself
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: a term that a text has this often is another term besides
OFTEN = 3
#: labelled texts of each kind that are learned from, at most
SAMPLE = 4000
#: terms of the model
TERMS = 1024
#: factors of a term
FACTORS = 8

#: bytes that words are made of: ASCII letters and all that is not ASCII
IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)


@functools.lru_cache(maxsize=1)
def _often() -> np.ndarray:
    """For each bucket the one that says that it occurs OFTEN times or more."""
    return _buckets(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(0x0F7E4))


def row_terms(data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct buckets of each row, sorted; with ``wanted``: those with
    wanted[bucket] >= 0, as that number."""
    owner, cuts = pieces(data, bounds, IS_LETTER)
    often = _often()
    useful = None if wanted is None else (wanted >= 0) | (wanted[often] >= 0)
    cells, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in slices(cuts):
        own = lowered(data[cuts[i]: cuts[j]])
        start, end, first = spans(IS_LETTER[own], cuts[i: j + 1] - cuts[i])
        code, words = pd.factorize(span_hashes(own, start, end))
        example = np.empty(len(words), np.int64)
        example[code] = np.arange(len(code))
        a, b = start[example], end[example]
        # the buckets of a word, one column for each kind of term; -1: none
        terms = np.full((len(words), 1 + len(BEGINNINGS)), -1, dtype=np.int64)
        terms[:, 0] = _buckets(words.astype(np.uint64))
        for k, n in enumerate(BEGINNINGS, start=1):
            longer = np.flatnonzero(b - a > n)
            terms[longer, k] = _buckets(span_hashes(own, a[longer], a[longer] + n) + np.uint64(n))
        if useful is not None:
            terms[(terms >= 0) & ~useful[terms]] = -1
        row = np.repeat(owner[i:j], np.diff(first))
        width = max(len(words), 1)
        at, cell = pd.factorize(row * width + code)  # a row's distinct words
        times = np.bincount(at, minlength=len(cell))
        found = terms[cell % width]
        keep = found >= 0
        at, cell = pd.factorize(((cell // width)[:, None] * BUCKETS + found)[keep])
        cells.append(cell)
        counts.append(np.bincount(at, np.broadcast_to(times[:, None], found.shape)[keep], len(cell)))
    cell, at = np.unique(np.concatenate(cells), return_inverse=True)
    many = cell[np.bincount(at, np.concatenate(counts), len(cell)) >= OFTEN]
    cell = np.unique(np.concatenate((cell, many - many % BUCKETS + often[many % BUCKETS])))
    row, bucket = cell // BUCKETS, cell % BUCKETS
    if wanted is None:
        return row, bucket
    keep = wanted[bucket] >= 0
    return row[keep], wanted[bucket[keep]]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, terms, id) of each text."""
    for batch in batches:
        data, bounds = utf8(batch.column(1))
        row, bucket = row_terms(data, bounds)
        at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32))),
             batch.column(2)], names=["label", "terms", "id"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): texts of each kind with the term, by batch."""
    for batch in batches:
        terms = batch.column(1)
        label = np.repeat(batch.column(0).to_numpy(), np.diff(terms.offsets.to_numpy()))
        term, code = np.unique(terms.flatten().to_numpy(), return_inverse=True)
        toxic = np.bincount(code, weights=label, minlength=len(term)).astype(np.int64)
        both = np.bincount(code, minlength=len(term))
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(toxic), pa.array(both - toxic)],
                                         names=["term", "toxic", "clean"])


class Machine:
    """A factorization machine over numbered terms that a text has or has not."""

    def __init__(self, terms: int, factors: int, seed: int = 7):
        self.bias = 0.0
        self.weight = np.zeros(terms)
        self.factor = np.random.default_rng(seed).normal(0, 0.05, (terms, factors))

    def scores(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Of each row the log-odds, from its (row, term) entries, sorted by row."""
        own, at = np.unique(row, return_index=True)

        def sums(x: np.ndarray) -> np.ndarray:
            total = np.zeros((rows, *x.shape[1:]))
            if len(at):
                total[own] = np.add.reduceat(x, at, axis=0)
            return total

        v = self.factor[term]
        pairs = (sums(v) ** 2).sum(axis=1) - sums((v ** 2).sum(axis=1))
        return self.bias + sums(self.weight[term]) + 0.5 * pairs

    def fit(self, row: np.ndarray, term: np.ndarray, label: np.ndarray, *, epochs: int = 40, batch: int = 64,
            rate: float = 0.1, decay: float = 2e-2, seed: int = 11) -> None:
        """Logistic loss, both kinds of equal weight, AdaGrad steps over shuffled batches."""
        at = np.searchsorted(row, np.arange(len(label) + 1))
        share = max(label.mean(), 1e-9), max(1 - label.mean(), 1e-9)
        importance = np.where(label > 0, 0.5 / share[0], 0.5 / share[1])
        order = np.random.default_rng(seed)
        seen_w, seen_v, seen_b = np.full(len(self.weight), 1e-6), np.full(self.factor.shape, 1e-6), 1e-6
        for _ in range(epochs):
            mixed = order.permutation(len(label))
            for i in range(0, len(mixed), batch):
                rows = mixed[i: i + batch]
                n = at[rows + 1] - at[rows]
                own = np.repeat(np.arange(len(rows)), n)
                t = term[np.repeat(at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                v = self.factor[t]
                total = np.zeros((len(rows), v.shape[1]))
                np.add.at(total, own, v)
                z = (self.bias + np.bincount(own, self.weight[t], len(rows))
                     + 0.5 * ((total ** 2).sum(axis=1) - np.bincount(own, (v ** 2).sum(axis=1), len(rows))))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) * importance[rows] / len(rows)
                used, code = np.unique(t, return_inverse=True)
                gw = np.bincount(code, g[own], len(used)) + decay * self.weight[used] / len(rows)
                gv = np.zeros((len(used), v.shape[1]))
                np.add.at(gv, code, g[own][:, None] * (total[own] - v))
                gv += decay * self.factor[used] / len(rows)
                seen_w[used] += gw ** 2
                seen_v[used] += gv ** 2
                seen_b += g.sum() ** 2
                self.weight[used] -= rate * gw / np.sqrt(seen_w[used])
                self.factor[used] -= rate * gv / np.sqrt(seen_v[used])
                self.bias -= rate * g.sum() / np.sqrt(seen_b)


def _fitted(table: pa.Table, terms: int, factors: int) -> pa.Table:
    """The machine of the sample's rows (label, terms), as one row of numbers."""
    found = table.column("terms").combine_chunks()
    order = np.lexsort((table.column("id").to_numpy(),))  # the same whatever order the rows come in
    lists = found.take(pa.array(order))
    label = table.column("label").to_numpy()[order].astype(np.float64)
    row = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy()))
    machine = Machine(terms, factors)
    machine.fit(row, lists.flatten().to_numpy().astype(np.int64), label)
    return pa.table({"bias": pa.array([machine.bias]), "weight": pa.array([machine.weight.tolist()]),
                     "factor": pa.array([machine.factor.ravel().tolist()])})


def train(docs: DataFrame, labels: DataFrame, *, most: int = SAMPLE, terms: int = TERMS,
          factors: int = FACTORS) -> tuple[np.ndarray, Machine] | None:
    """(number of each bucket that is a term or -1, machine); None unless texts of both labels are there.

    ``docs``: ``doc_id, row_key, text``. ``labels``: ``doc_id, label``; at most ``most`` ids of each
    label, those that hash lowest.
    """
    chosen = None
    for label in (0, 1):
        ids = labels.where(F.col("label") == label).select(F.col("doc_id").alias("_doc"), "label")
        ids = ids.orderBy(F.xxhash64("_doc"), "_doc").limit(most)
        chosen = ids if chosen is None else chosen.unionAll(ids)
    # 2 * most ids; of rows with one id one is learned from
    rows = (docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc")).groupBy("doc_id", "label")
            .agg(F.min_by("text", "row_key").alias("text")))
    rows = stored(rows.select("label", "text", F.col("doc_id").alias("id")).mapInArrow(
        _sample_rows, "label int, terms array<int>, id bigint"), "labelled-terms")
    sizes = rows.agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")).first()
    if not sizes["toxic"] or not sizes["clean"]:
        return None
    counts = rows.select("label", "terms").mapInArrow(_term_counts, "term int, toxic bigint, clean bigint")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    def entropy(p: Column) -> Column:
        return -(p * F.log(p) + (1 - p) * F.log(1 - p))

    p, q = ((F.col(c) + 0.5) / (sizes[c] + 1.0) for c in ("toxic", "clean"))
    gain = entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2
    best = (counts.where(F.col("toxic") + F.col("clean") >= 5).orderBy(gain.desc(), "term").limit(terms)
            .select("term").collect())  # as many rows as the model has terms, at most
    number = np.full(BUCKETS, -1, dtype=np.int64)
    number[[r.term for r in best]] = np.arange(len(best))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            found = number[lists.flatten().to_numpy()]
            row, found = row[found >= 0], found[found >= 0]
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(found.astype(np.int32)))], names=["id", "label", "terms"])

    kept = rows.select("id", "label", "terms").mapInArrow(numbered, "id bigint, label int, terms array<int>")
    # 2 * most rows of the model's terms
    fitted = (kept.groupBy().applyInArrow(lambda t: _fitted(t, max(1, len(best)), factors),
                                                  "bias double, weight array<double>, factor array<double>").first())
    machine = Machine(max(1, len(best)), factors)
    machine.bias, machine.weight = fitted["bias"], np.array(fitted["weight"])
    machine.factor = np.array(fitted["factor"]).reshape(-1, factors)
    return number, machine


SCORES = "doc_id bigint, row_key bigint, score double, predicted int"


def toxic_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "label", **options) -> DataFrame:
    """``doc_id, row_key, score, predicted``: one row per row of ``docs``, scored by a machine that learns from ``labels``.

    ``labels`` (``id_col``, ``label_col``): ids of documents with 1 (toxic) or
    0. Null labels and ids are none, ids that are not in ``docs`` do nothing,
    an id with both labels is toxic. ``score`` is from 0 to 1, higher where 1
    is likelier; ``predicted`` is 1 from 0.5 on. Only the text is an input of a
    score.

    A null or empty text has no terms: its score is the machine's bias. Equal
    texts are scored alike. Texts of any length are whole, worked on in pieces
    of about 2 MB. Without labelled texts of both kinds every score is 0.5 less
    a hair, predicted 0. A null id stays null. An empty table gives no rows.
    Other columns are not read. Words are told apart by 64 bits of hash, terms
    by their bucket.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
                       F.col(text_col).alias("text"))
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label")))
    trained = train(rows, known, **options)
    if trained is None:
        trained = np.full(BUCKETS, -1, dtype=np.int64), Machine(1, 1)
        trained[1].bias = -1e-9
    shared = docs.sparkSession.sparkContext.broadcast(trained)  # BUCKETS numbers, and terms * (1 + factors)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, machine = shared.value
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            odds = [machine.scores(*row_terms(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i], number), j - i)
                    for i, j in slices(bounds)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(odds or [np.empty(0)]), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "row_key", "score", "predicted"])

    return rows.mapInArrow(score, SCORES)
