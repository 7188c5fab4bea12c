"""Ranked lexical search with hashed max-sketches.

A document's sketch has a coordinate for each value of a 16-bit hash of terms,
and there the greatest impact of the document's terms that hash to it; only
coordinates above zero are kept. A query looks its terms up: the sum of weight
times coordinate is an upper bound of the document's score, and the score
itself where no other term shares a coordinate.

1. One pass counts documents, terms, and the documents that hold each query
   term (of a batch of queries).
2. One pass folds every document into its sketch, a stored table.
3. Every task looks a batch of queries up in its sketches at once, and gives
   each query's documents of highest bound. The best of all tasks are scored
   exactly on their texts; the k-th best score is the query's threshold.
4. Documents whose bound reaches the threshold and that were not scored are
   scored exactly too. What is left cannot be among the k best.

Queries are dealt to batches of bounded size, which go to all tasks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.llm.common import lowered, mix64, pieces, row_key, slices, span_hashes, spans, stored, utf8

#: coordinates of a sketch: a power of two, at most this
WIDTH = 1 << 16
#: bytes of query text, and queries, of a batch at most (a longer query is a batch of its own)
BATCH_BYTES, BATCH_QUERIES = 1 << 20, 512
#: documents looked up at once
AT_ONCE = 512
#: documents of highest bound that are scored first, in multiples of k
FIRST = 4

#: no impact is as great
IMPACT = 1_000_000

#: bytes that terms are made of: ASCII letters and digits, and all that is not ASCII
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_counts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each row's distinct terms, sorted; terms are 64-bit hashes."""
    owner, cuts = pieces(data, bounds, IS_TERM)
    rows, terms, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in slices(cuts):
        own = lowered(data[cuts[i]: cuts[j]])
        start, end, first = spans(IS_TERM[own], cuts[i: j + 1] - cuts[i])
        code, known = pd.factorize(span_hashes(own, start, end).view(np.int64))
        row = np.repeat(owner[i:j], np.diff(first))
        cell, times = np.unique(row * max(len(known), 1) + code, return_counts=True)
        rows.append(cell // max(len(known), 1))
        terms.append(known[cell % max(len(known), 1)] if len(known) else np.empty(0, np.int64))
        counts.append(times)
    row, term, count = (np.concatenate(x) for x in (rows, terms, counts))
    by = np.lexsort((term, row))
    row, term, count = row[by], term[by], count[by]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return row[at], term[at], np.add.reduceat(count, at) if len(at) else count


def impacts(count: np.ndarray, size: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term that occurs ``count`` times in a document of ``size`` terms is worth there, before its weight."""
    m = 100 - 75 + (75 * size * documents) // max(total, 1)
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def coordinate(term: np.ndarray, width: int) -> np.ndarray:
    return (mix64(term.view(np.uint64)) & np.uint64(width - 1)).astype(np.int64)


class Queries:
    """A batch of queries: numbers from 0, their distinct terms, and how often a query has a term."""

    def __init__(self, ids: list[int], texts: list[str], width: int = WIDTH):
        self.ids, self.width = ids, width
        row, term, times = term_counts(*utf8(pa.array(texts, pa.string())))
        self.terms, self.term = np.unique(term, return_inverse=True)
        self.query, self.times = row, times

    def weigh(self, weights: np.ndarray) -> None:
        """Takes the weights of ``terms``. Sums are in doubles where these hold them all exactly, else in 64-bit integers."""
        own = weights[self.term] * self.times
        most = np.bincount(self.query, own, len(self.ids)).max(initial=0) * IMPACT
        kind = np.float64 if most < 2.0 ** 53 else np.int64
        self.weight = np.zeros((len(self.terms), len(self.ids)), dtype=kind)
        self.weight[self.term, self.query] = own
        cells, cell = np.unique(coordinate(self.terms, self.width), return_inverse=True)
        self.at = np.full(self.width, -1, dtype=np.int64)
        self.at[cells] = np.arange(len(cells))
        # query terms of one coordinate: each may be the one that the document has
        self.lookup = np.zeros((len(cells), len(self.ids)), dtype=kind)
        np.add.at(self.lookup, cell, self.weight)

    def number(self, term: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, term), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == term, at, -1) if len(self.terms) else np.full(len(term), -1)


def sums(row: np.ndarray, column: np.ndarray, value: np.ndarray, table: np.ndarray, rows: int) -> np.ndarray:
    """Of each row, by query, the sum of value * table[column]."""
    x = np.zeros((rows, len(table)), dtype=table.dtype)
    x[row, column] = value
    return x @ table


COUNTS = "term bigint, documents bigint, total bigint"


def _statistics(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each wanted term the documents that hold it, and under a null term those with any, and all terms."""
    holding = np.zeros(len(wanted), dtype=np.int64)
    documents = total = 0
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        for i, j in slices(bounds):
            row, term, count = term_counts(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i])
            documents += len(np.unique(row))
            total += int(count.sum())
            if len(wanted):
                at = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
                holding += np.bincount(at[wanted[at] == term], minlength=len(wanted))
    seen = np.flatnonzero(holding)
    yield pa.RecordBatch.from_arrays(
        [pa.array([None, *wanted[seen].tolist()], pa.int64()), pa.array([documents, *holding[seen].tolist()], pa.int64()),
         pa.array([total] + [0] * len(seen), pa.int64())], names=["term", "documents", "total"])


SKETCHES = "doc_id bigint, row_key bigint, coordinates binary, impacts binary"


def _sketches(batches: Iterator[pa.RecordBatch], documents: int, total: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        for i, j in slices(bounds):
            row, term, count = term_counts(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i])
            size = np.bincount(row, count, j - i).astype(np.int64)
            value = impacts(count, size[row], documents, total)
            cell = row * width + coordinate(term, width)
            by = np.lexsort((-value, cell))
            cell, value = cell[by], value[by]
            new = np.ones(len(cell), dtype=bool)
            new[1:] = cell[1:] != cell[:-1]
            cell, value = cell[new], value[new]
            at = np.searchsorted(cell // width, np.arange(j - i + 1)).tolist()
            places, values = (cell % width).astype("<u2"), value.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("row_key").slice(i, j - i),
                 pa.array([places[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                 pa.array([values[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())],
                names=["doc_id", "row_key", "coordinates", "impacts"])


BOUNDS = "query int, doc_id bigint, row_key bigint, bound bigint"
LAST = (1 << 63) - 1


def bounds_of(batch: pa.RecordBatch, queries: Queries) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, bounds by row and query) of a batch of sketches."""
    for i in range(0, batch.num_rows, AT_ONCE):
        part = batch.slice(i, AT_ONCE)
        places, values = (part.column(c).to_pylist() for c in ("coordinates", "impacts"))
        row = np.repeat(np.arange(len(places)), [len(x) // 2 for x in places])
        place = np.frombuffer(b"".join(places), "<u2")
        value = np.frombuffer(b"".join(values), "<u4")
        column = queries.at[place]
        hit = column >= 0
        yield i, sums(row[hit], column[hit], value[hit], queries.lookup, len(places))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(id, key) of rows; a null id is after all others."""
    return batch.column("doc_id").fill_null(LAST).to_numpy(), batch.column("row_key").to_numpy()


def _highest(batches: Iterator[pa.RecordBatch], queries: Queries, most: int) -> Iterator[pa.RecordBatch]:
    """The ``most`` rows of a partition with the highest bounds above 0, by query (ties: the smaller id)."""
    kept = [np.empty(0, np.int64)] * 4  # query, bound, id, key
    least = np.ones(len(queries.ids), dtype=np.int64)  # bounds below it are out
    for batch in batches:
        ids, keys = _ids(batch)
        for i, found in bounds_of(batch, queries):
            row, query = np.nonzero(found >= least)
            new = [query, found[row, query].astype(np.int64), ids[i + row], keys[i + row]]
            kept = [np.concatenate(x) for x in zip(kept, new)]
            if len(kept[0]) > 2 * most * len(queries.ids):
                kept = _best(kept, most)
                full = np.bincount(kept[0], minlength=len(least)) >= most
                last = np.searchsorted(kept[0], np.flatnonzero(full), side="right") - 1
                least[full] = kept[1][last]
    q, bound, doc, key = _best(kept, most)
    yield pa.RecordBatch.from_arrays(
        [pa.array(q, pa.int32()), pa.array(doc, mask=doc == LAST), pa.array(key), pa.array(bound)],
        names=["query", "doc_id", "row_key", "bound"])


def _best(rows: list[np.ndarray], most: int) -> list[np.ndarray]:
    query, bound, doc, key = rows
    by = np.lexsort((key, doc, -bound, query))
    place = np.arange(len(by)) - np.searchsorted(query[by], query[by])
    by = by[place < most]
    return [x[by] for x in rows]


def _reaching(batches: Iterator[pa.RecordBatch], queries: Queries, least: np.ndarray, last: np.ndarray,
              first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows whose bound is above ``least`` of the query, or equal and with an id up to ``last``; not those
    that the first bounds had: of the query's ``first`` bound the row that came last there, as (bound, id, key)."""
    for batch in batches:
        ids, keys = _ids(batch)
        for i, found in bounds_of(batch, queries):
            n = len(found)
            bound, doc, key = found.astype(np.int64), ids[i: i + n, None], keys[i: i + n, None]
            keep = (bound > least) | ((bound == least) & (doc <= last))
            # the rows behind the last one that was scored first
            behind = (bound < first[0]) | ((bound == first[0]) & ((doc > first[1]) | ((doc == first[1]) & (key > first[2]))))
            row, query = np.nonzero(keep & behind & (bound > 0))
            own = ids[i + row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(own, mask=own == LAST), pa.array(keys[i + row]),
                 pa.array(bound[row, query])], names=["query", "doc_id", "row_key", "bound"])


SCORED = "query int, doc_id bigint, row_key bigint, score bigint"


def _scored(batches: Iterator[pa.RecordBatch], queries: Queries, documents: int, total: int) -> Iterator[pa.RecordBatch]:
    """The exact scores of texts for the queries that each is wanted for."""
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        wanted = batch.column("wanted").to_pylist()
        for i, j in slices(bounds):
            row, term, count = term_counts(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i])
            size = np.bincount(row, count, j - i).astype(np.int64)
            number = queries.number(term)
            hit = number >= 0
            row, number = row[hit], number[hit]
            value = impacts(count[hit], size[row], documents, total)
            at = np.searchsorted(row, np.arange(j - i + 1))
            out = []
            for k in range(j - i):
                a, b = at[k], at[k + 1]
                score = value[a:b].astype(queries.weight.dtype) @ queries.weight[np.ix_(number[a:b], wanted[i + k])]
                out += [(q, i + k, int(s)) for q, s in zip(wanted[i + k], score)]
            query, at_row, score = (np.array(x, dtype=np.int64) for x in zip(*out)) if out else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), batch.column("doc_id").take(pa.array(at_row)),
                 batch.column("row_key").take(pa.array(at_row)), pa.array(score)],
                names=["query", "doc_id", "row_key", "score"])


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents of highest score above 0 (all, if fewer).

    Terms are runs of ASCII letters, digits and all that is not ASCII, A-Z as
    a-z. A document's score sums, over the item's terms with repeats, the
    term's weight times its impact in the document (``weight``, ``impacts``).
    Equal scores go by the smaller id; ranks are unique.

    Null and empty texts have no terms and are not counted as documents. Every
    row is a document of its own, with the same id or equal ones too; rows
    without id come after all others of their score. Texts of any length are
    whole, worked on in pieces of about 2 MB. Rows of one item id are one item
    that has the terms of all; items without id are left out, those without
    terms get no rows. An empty table on either side gives no rows. Other
    columns are not read. Terms are told apart by 64 bits of hash.
    """
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
                       F.col(text_col).alias("text"))
    asked = (items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
             .groupBy(F.col(item_col).cast("bigint").alias("item_id"))
             .agg(F.concat_ws(" ", F.sort_array(F.collect_list(item_text_col))).alias("text")))
    asked = stored(asked, "search-items")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // BATCH_QUERIES), -(-(size["bytes"] or 0) // BATCH_BYTES))
    sketches, found = None, []
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id").collect()
        queries = Queries([r["item_id"] for r in rows], [r["text"] for r in rows], width)
        counts = (read.select("text").mapInArrow(functools.partial(_statistics, wanted=queries.terms), COUNTS)
                  .groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("total").alias("total")).collect())
        all_of = next(((r["documents"], r["total"]) for r in counts if r["term"] is None), (0, 0))
        holding = {r["term"]: r["documents"] for r in counts if r["term"] is not None}
        queries.weigh(np.array([weight(all_of[0], holding.get(t, 0)) for t in queries.terms.tolist()], dtype=np.int64))
        if sketches is None:
            sketches = stored(read.mapInArrow(functools.partial(_sketches, documents=all_of[0], total=all_of[1],
                                                                width=width),
                                              SKETCHES), "sketches")
        found.append(_batch_search(read, sketches, queries, all_of, k))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _batch_search(read: DataFrame, sketches: DataFrame, queries: Queries, all_of: tuple[int, int], k: int) -> DataFrame:
    spark = read.sparkSession
    shared = spark.sparkContext.broadcast(queries)  # a batch of queries
    most = FIRST * k

    def scores(candidates: DataFrame, few: bool) -> DataFrame:
        wanted = (candidates.groupBy(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"))
                  .agg(F.sort_array(F.collect_set("query")).alias("wanted")))
        if few:
            wanted = F.broadcast(wanted)
        own = read.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_key") == F.col("_key")))
        return own.select("doc_id", "row_key", "text", "wanted").mapInArrow(
            lambda b: _scored(b, shared.value, *all_of), SCORED).where("score > 0")

    place = W.partitionBy("query").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last(), "row_key")
    first = sketches.mapInArrow(lambda b: _highest(b, shared.value, most), BOUNDS)
    first = first.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most)
    first = stored(first, "first-bounds")
    # at most ``most`` rows of each query of the batch
    best = stored(scores(first, True), "first-scores")
    rank = F.row_number().over(W.partitionBy("query").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row_key"))

    # per query: the k-th best score with its id, and the row that came last among the first bounds
    n = len(queries.ids)
    least, last = np.zeros(n, np.int64), np.full(n, LAST)
    for r in best.withColumn("n", rank).where(F.col("n") == k).collect():
        least[r["query"]], last[r["query"]] = r["score"], LAST if r["doc_id"] is None else r["doc_id"]
    behind = np.zeros((3, n), np.int64)
    behind[1:] = LAST
    for r in first.where(F.col("n") == most).collect():
        behind[:, r["query"]] = r["bound"], LAST if r["doc_id"] is None else r["doc_id"], r["row_key"]
    rest = stored(sketches.mapInArrow(lambda b: _reaching(b, shared.value, least, last, behind), BOUNDS), "more-bounds")
    scored = best.unionAll(scores(rest, False))
    names = F.array(*[F.lit(i) for i in queries.ids]) if n else F.array().cast("array<bigint>")
    return (scored.withColumn("rank", rank).where(F.col("rank") <= k)
            .select(F.element_at(names, F.col("query") + 1).cast("bigint").alias("item_id"), F.col("rank").cast("int").alias("rank"),
                    "doc_id", "score"))
