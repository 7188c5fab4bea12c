"""Substring dedup: windows of words that an earlier document has.

1. Every window of a document is represented by the least of the hashes of
   its shorter runs of words (its anchor), so equal windows have equal
   anchors. Windows in a row with one anchor form a passage.
2. Passages whose anchor occurs in more than one document are candidates.
   Equal ones are folded to the first document that has them.
3. A shard takes all passages of its anchors. It builds compressed FM-indexes
   (wavelet matrix over the Burrows-Wheeler transform) of earlier passages and
   streams later ones, which the index does not have, through them: backward
   search gives the matching statistics, and where they reach the length of a
   window, the interval's places name the first document that has it.
4. Windows whose first document is smaller than their own are reported; what
   they cover is removed.

Passages of an anchor that has very many different ones are cut into single
windows. A window is its own anchor there, so equal windows meet in one shard,
and neither the indexed nor the streamed side of a hot anchor stays together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import mix64, row_key, run_hashes, slices, span_hashes, stored, utf8, word_spans
from basketry.llm.fm_index import FMIndex

#: words of an index, on average
SHARD_WORDS = 1_500_000
#: different passages of one anchor that an index takes; beyond, it takes their windows one by one
HOT_PASSAGES = 20_000
#: document number of rows without one: after all others
LAST = (1 << 63) - 1

PASSAGES = "anchor bigint, passage bigint, doc bigint, row_key bigint, start int, n int"


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """For each start the position of the least of ``width`` values in a row (the first, if several)."""
    at, span = np.arange(len(values)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while span * 2 <= width:
        at = better(at[:-span], at[span:])
        span *= 2
    if rest := width - span:
        at = better(at[:-rest], at[rest:])
    return at


def _passages(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    short = window // 2  # words of an anchor
    names = [x.split()[0] for x in PASSAGES.split(", ")]
    for batch in batches:
        data, bounds = utf8(batch.column(2))
        docs, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for i, j in slices(bounds):
            own = data[bounds[i]: bounds[j]]
            start, end, first = word_spans(own, bounds[i: j + 1] - bounds[i])
            if len(start) < window:
                continue
            words = span_hashes(own, start, end)
            runs = run_hashes(words, np.arange(len(words) - short + 1), short)
            anchor = least_in_window(runs, window - short + 1)  # of each window over the slice
            row = np.repeat(np.arange(j - i), np.diff(first))[: len(anchor)]
            inside = np.arange(len(anchor)) + window <= first[1:][row]
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            starts = np.flatnonzero(new & inside)
            n = np.diff(np.append(np.flatnonzero(new), len(anchor)))[inside[new]]
            last = np.cumsum(inside)  # a row's last windows are not inside it
            n = np.minimum(n, last[np.minimum(starts + n, len(last)) - 1] - last[starts] + 1)
            content = run_hashes(words, starts, n + window - 1)
            content = mix64(content + n.astype(np.uint64))
            own_row = row[starts]
            columns = [runs[anchor[starts]].view(np.int64), content.view(np.int64), docs[i:j][own_row],
                       keys[i:j][own_row], (starts - first[own_row]).astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each window of the wanted passages as a passage of its own; its anchor is a hash of all its words."""
    names = [x.split()[0] for x in PASSAGES.split(", ")]
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        docs, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row_key"))
        wanted = batch.column("wanted").to_pylist()
        for i, j in slices(bounds):
            own = data[bounds[i]: bounds[j]]
            start, end, first = word_spans(own, bounds[i: j + 1] - bounds[i])
            words = span_hashes(own, start, end)
            spans = np.array([(k - i, w["start"], w["n"]) for k in range(i, j) for w in wanted[k]], dtype=np.int64)
            row, begin, n = spans.reshape(-1, 3).T
            begin = np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(row, n)
            at = first[row] + begin
            columns = [run_hashes(words, at, window).view(np.int64),
                       run_hashes(mix64(words + np.uint64(1)), at, window).view(np.int64), docs[i:j][row],
                       keys[i:j][row], begin.astype(np.int32), np.ones(len(at), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


TEXTS = "anchor bigint, passage bigint, doc bigint, n int, text string"


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of a document's passages, each as a text of its own."""
    for batch in batches:
        docs = batch.column("doc").to_pylist()
        data, bounds = utf8(batch.column("text"))
        wanted = batch.column("wanted").to_pylist()
        rows: list[tuple] = []
        size = 0
        for k, doc in enumerate(docs):
            text = data[bounds[k]: bounds[k + 1]]
            start, end, _ = word_spans(text, np.array([0, len(text)]))
            raw = text.tobytes()
            for w in wanted[k]:
                a, b = w["start"], w["start"] + w["n"] + window - 2
                piece = raw[start[a]: end[b]].decode("utf-8", "replace")
                rows.append((w["anchor"], w["passage"], doc, w["n"], piece))
                size += len(piece)
            if size > 8 << 20:
                yield _text_batch(rows)
                rows, size = [], 0
        if rows:
            yield _text_batch(rows)


def _text_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=[x.split()[0] for x in TEXTS.split(", ")])


def _search(table: pa.Table, window: int) -> pa.Table:
    """(anchor, passage, firsts): for each passage the first document of each of its windows.

    The passages of an anchor are in document order. In round k, those whose number has a 0 as its k-th
    binary digit are indexed, the others are streamed: of any two passages one is indexed when the other
    is streamed, and never both.
    """
    data, bounds = utf8(table.column("text"))
    start, end, first = word_spans(data, bounds)
    numbers, distinct = pd.factorize(span_hashes(data, start, end))
    lengths = np.diff(first)
    n = table.column("n").to_numpy()
    doc = table.column("doc").to_numpy()
    anchor = table.column("anchor").to_numpy()
    by = np.lexsort((table.column("passage").to_numpy(), doc, anchor))
    new = np.ones(len(by), dtype=bool)
    new[1:] = anchor[by][1:] != anchor[by][:-1]
    group = np.cumsum(new) - 1
    number = np.empty(len(by), dtype=np.int64)  # of a passage among those of its anchor
    number[by] = np.arange(len(by)) - np.flatnonzero(new)[group]
    members = np.empty(len(by), dtype=np.int64)
    members[by] = np.bincount(group)[group]
    firsts = np.repeat(doc, n)
    windows = np.cumsum(n) - n  # before each passage
    for k in range(int(members.max(initial=1) - 1).bit_length()):
        second = (number >> k & 1).astype(bool)
        indexed = np.flatnonzero(~second & ((number >> k + 1 << k + 1) + (1 << k) < members))  # later ones are streamed
        streamed = np.flatnonzero(second)
        index = FMIndex(numbers[_stretches(first[indexed], lengths[indexed])], lengths[indexed], doc[indexed],
                        max(1, len(distinct)), window)
        found = index.owners(numbers, first[streamed], lengths[streamed], LAST)
        at = _stretches(windows[streamed], n[streamed])
        firsts[at] = np.minimum(firsts[at], found)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(firsts))
    return pa.table({"anchor": table.column("anchor"), "passage": table.column("passage"), "firsts": lists})


def _stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] numbers), start[1], ..."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


def repeated_windows(docs: DataFrame, *, window: int = 50, hot: int = HOT_PASSAGES, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id, row_key, starts``: per document the windows (by first word) that a smaller id has too.

    Documents without such windows have no row. See ``remove_repeats``.
    """
    read = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc"),
                       row_key(F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    passages = stored(read.mapInArrow(lambda b: _passages(b, window), PASSAGES), "passages")
    shared = stored(passages.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
                    .where("a < b").select("anchor"), "shared-anchors")
    found = stored(passages.join(shared, "anchor", "left_semi"), "shared-passages")
    many = found.select("anchor", "passage", "n").distinct().groupBy("anchor").count().where(F.col("count") > hot)
    many = stored(many.select("anchor"), "hot-anchors")
    if not many.isEmpty():
        hot_rows = (found.join(many, "anchor", "left_semi")
                    .groupBy(F.col("doc").alias("_doc"), F.col("row_key").alias("_key"))
                    .agg(F.collect_set(F.struct("start", "n")).alias("wanted")))
        windows = (read.join(hot_rows, (F.col("doc") == F.col("_doc")) & (F.col("row_key") == F.col("_key")))
                   .select("doc", "row_key", "wanted", "text").mapInArrow(lambda b: _windows(b, window), PASSAGES))
        windows = stored(windows, "hot-windows")
        again = stored(windows.groupBy("anchor", "passage").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
                       .where("a < b").select("anchor", "passage"), "shared-windows")
        found = found.join(many, "anchor", "left_anti").unionByName(
            windows.join(again, ["anchor", "passage"], "left_semi"))
        found = stored(found, "shared-passages")
    distinct = found.groupBy("anchor", "passage", "n").agg(F.min(F.struct("doc", "row_key", "start")).alias("at"))
    wanted = (distinct.groupBy(F.col("at.doc").alias("_doc"), F.col("at.row_key").alias("_key"))
              .agg(F.collect_list(F.struct("anchor", "passage", "n", F.col("at.start").alias("start"))).alias("wanted")))
    # equal rows: one of them will do
    texts = (read.join(wanted, (F.col("doc") == F.col("_doc")) & (F.col("row_key") == F.col("_key")))
             .select("doc", "wanted", "text").mapInArrow(lambda b: _texts(b, window), TEXTS))
    texts = stored(texts.dropDuplicates(["anchor", "passage", "n"]), "passage-texts")

    total = texts.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    results = (texts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard")
               .applyInArrow(lambda t: _search(t, window), "anchor bigint, passage bigint, firsts array<bigint>"))
    results = stored(results.select(F.col("anchor").alias("_anchor"), F.col("passage").alias("_passage"), "firsts"),
                     "window-firsts")
    earlier = F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("doc"), F.col("start") + i)),
                       lambda x: x.isNotNull())
    return (found.join(results, (F.col("anchor") == F.col("_anchor")) & (F.col("passage") == F.col("_passage")))
            .select("doc", "row_key", earlier.alias("starts")).where(F.size("starts") > 0)
            .groupBy("doc", "row_key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
            .select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "row_key", "starts"))


def kept_words(text: bytes, starts: list[int] | np.ndarray | None, window: int) -> tuple[list[bytes], int]:
    """(words that no window covers, number of all words)."""
    words = text.split()
    if starts is None or not len(starts):
        return words, len(words)
    starts = np.asarray(starts)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()], len(words)


def remove_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, text`` with the kept words joined by spaces.

    Words are what ASCII white space parts, unchanged. A window is ``window``
    words in a row of one document. All words are removed that a window covers
    whose words also start a window in a document with a smaller id; windows
    are judged on the input.

    A null or empty text has no words. A row without id counts as later than
    all others, and keeps its null. Rows with one id are one document: none
    takes words from the other. Texts shorter than a window are kept. An empty
    table gives no rows. Other columns are not read. Words and runs of words
    are told apart by 64 bits of hash, passages by 128.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            starts = batch.column("starts").to_pylist()
            kept, total, removed = [], [], []
            for k in range(batch.num_rows):
                words, n = kept_words(data[bounds[k]: bounds[k + 1]].tobytes(), starts[k], window)
                kept.append(b" ".join(words).decode("utf-8", "replace"))
                total.append(n)
                removed.append(n - len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
                       F.col(text_col).alias("text"))
    found = repeated_windows(docs, window=window, id_col=id_col, text_col=text_col, **options)
    found = found.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), "starts")
    both = read.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_key") == F.col("_key")), "left")
    return both.select("doc_id", "text", "starts").mapInArrow(
        cut, "doc_id bigint, n_words bigint, n_removed bigint, text string")
