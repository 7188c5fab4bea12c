"""Line dedup over range-partitioned line hashes.

Line keys become 128-bit hashes with their document and positions, are
partitioned by range of (hash, document) and sorted so, and stream by once:
a run of one hash tells in how many documents the line occurs, and its first
row is its first occurrence. A frequent line spans several partitions; each
partition reports the runs at its two ends, and these few rows complete the
counts. What comes back are compressed bitmaps of the kept lines of each
document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import carried, partitions, row_key, slices, stored, utf8

LINES = "hi bigint, lo bigint, doc_id bigint, row_key bigint, n_lines int, at array<int>"
STREAMED = LINES + ", kind string, docs bigint"


def _keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """A row for each distinct key of a document, with the positions of its lines."""
    for batch in batches:
        data, bounds = utf8(batch.column(2))
        ids, keys = batch.column(0), batch.column(1)
        for i, j in slices(bounds):
            raw = data[bounds[i]: bounds[j]].tobytes()
            base = bounds[i]
            doc, digest, n_lines, at = [], [], [], []
            for k in range(i, j):
                lines = raw[bounds[k] - base: bounds[k + 1] - base].split(b"\n")
                own: dict[bytes, list[int]] = {}
                for n, line in enumerate(lines):
                    key = line.strip().lower()
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        own.setdefault(xxhash.xxh3_128_digest(key), []).append(n)
                doc += [k] * len(own)
                digest += own
                n_lines += [len(lines)] * len(own)
                at += own.values()
            halves = np.frombuffer(b"".join(digest), dtype="<i8").reshape(-1, 2)
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), ids.take(take), keys.take(take),
                 pa.array(n_lines, pa.int32()), pa.array(at, pa.list_(pa.int32()))],
                names=["hi", "lo", "doc_id", "row_key", "n_lines", "at"])


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Streams one sorted partition; rows of three kinds come out (column ``kind``).

    "drop": lines of a run that has min_docs documents here. "wait": the rows
    of the partition's first or last run, if the documents found here are too
    few, as the run may go on in a neighbour. "edge": the first row of each of
    these two runs, with the documents found here. Rows of a run are held
    until it has min_docs documents or ends; from then on they leave as they
    come. With ``keep_first`` the first line of a run's first row stays out.
    """
    names = [x.split()[0] for x in LINES.split(", ")]

    def out(rows: pa.RecordBatch, kind: str, docs: int = 0) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array([kind] * n, pa.string()), pa.array(np.full(n, docs, np.int64))],
            names=[*names, "kind", "docs"])

    def ready(rows: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        """``rows``, with keep_first without the first line of each row that begins a run here."""
        if not keep_first:
            return rows
        at = rows.column("at").to_pylist()
        for k in np.flatnonzero(begins):
            at[k] = at[k][1:]
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(at, pa.list_(pa.int32()))], names=names)

    rest: pa.RecordBatch | None = None  # the last run so far
    seen, last_doc = 0, None  # documents of it that have left, and the last one's id
    head: pa.RecordBatch | None = None
    opening = True  # still in the partition's first run
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None and rest.num_rows:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        hi, lo = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        doc = pc.fill_null(batch.column(2), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        new_run = np.ones(len(hi), bool)
        new_run[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        new_doc = new_run.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        if seen:  # the first rows go on with a run that has partly left
            new_run[0] = (int(hi[0]), int(lo[0])) != (head.column(0)[0].as_py(), head.column(1)[0].as_py())
            new_doc[0] = new_run[0] or doc[0] != last_doc
        starts = np.flatnonzero(new_run)
        if not new_run[0]:
            starts = np.concatenate(([0], starts))
        docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        continued = not new_run[0]
        if continued:
            docs[0] += seen
        ends = np.append(starts[1:], len(hi))
        done = np.ones(len(starts), bool)
        done[-1] = False  # may go on
        if opening and head is None:
            head = batch.slice(0, 1)
        if opening and len(starts) > 1:  # the partition's first run has ended
            opening = False
            yield out(head, "edge", int(docs[0]))
            if docs[0] < min_docs:
                yield out(ready(batch.slice(0, ends[0]), new_run[: ends[0]]), "wait")
                done[0] = False
        drop = done & (docs >= min_docs)
        drop[-1] = docs[-1] >= min_docs
        rows = np.repeat(drop, ends - starts)
        if rows.any():
            yield out(ready(batch.filter(pa.array(rows)), new_run[rows]), "drop")
        if len(starts) > 1 or not continued:
            head = batch.slice(int(starts[-1]), 1)
        total, last_doc = int(docs[-1]), doc[-1]
        seen, rest = (total, None) if drop[-1] else (0, batch.slice(int(starts[-1])))
    if head is not None:  # the partition's last run
        yield out(head, "edge", total)
        if rest is not None:
            begins = np.zeros(rest.num_rows, bool)
            begins[0] = True
            yield out(ready(rest, begins), "wait")


def keep_bitmaps(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bitmaps of the kept lines: one row per document that loses a line.

    ``doc_id, row_key`` (tells rows with one id but different texts apart),
    ``n_lines, n_dropped`` and ``keep_bitmap``: zlib over the bits of the
    lines, highest bit first, 1 for a kept line. ``lines_kept`` applies them.

    Texts are split at newlines. A line's key is the line without ASCII white
    space at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code
    points found in at least ``min_docs`` documents (by id; all null ids are
    one) lose all their lines, or with ``keep_first`` all but the first by
    (id, row key, position). A null or empty text is one empty line. Equal
    rows count once and get equal bitmaps. An empty table gives no rows. Other
    columns are not read. A line in a third of all documents is spread over
    many partitions like any other rows.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
                       F.col(text_col).alias("text"))
    lines = stored(read.mapInArrow(lambda b: _keys(b, min_chars), LINES), "lines")
    order = ["hi", "lo", "doc_id", "row_key"]
    ranges = lines.repartitionByRange(partitions(spark), "hi", "lo", "doc_id").sortWithinPartitions(*order)
    found = stored(ranges.mapInArrow(lambda b: _stream(b, min_docs, keep_first), STREAMED), "line-runs")
    first = F.struct("doc_id", "row_key", F.element_at("at", 1).alias("at"))
    frequent = (found.where("kind = 'edge'").groupBy(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
                .agg(F.sum("docs").alias("_docs"), F.min(first).alias("_first"))
                .where(F.col("_docs") >= min_docs))
    ends = found.where("kind in ('wait', 'edge')").join(
        frequent, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")))
    columns = ["doc_id", "row_key", "n_lines", "at"]
    dropped = found.where("kind = 'drop'").select(*columns).unionAll(
        ends.where("kind = 'wait'").select(*columns))
    if keep_first:  # a run over several partitions has a head in each, of which one stays
        dropped = dropped.unionAll(ends.where((F.col("kind") == "edge") & (first != F.col("_first")))
                                   .select("doc_id", "row_key", "n_lines", F.slice("at", 1, 1).alias("at")))
    at = F.array_distinct(F.flatten(F.collect_list("at")))
    return (dropped.groupBy("doc_id", "row_key", "n_lines").agg(at.alias("at")).where(F.size("at") > 0)
            .mapInArrow(_bitmaps, "doc_id bigint, row_key bigint, n_lines int, n_dropped int, keep_bitmap binary"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, at in zip(batch.column("n_lines").to_pylist(), batch.column("at").to_pylist()):
            bits = np.ones(n, bool)
            bits[at] = False
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
            dropped.append(len(at))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), batch.column("n_lines"),
             pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
            names=["doc_id", "row_key", "n_lines", "n_dropped", "keep_bitmap"])


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """(kept lines joined by newlines, lines, lines dropped)."""
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines)).astype(bool)
    kept = [lines[k] for k in np.flatnonzero(keep).tolist()]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as (row, bitmap), where a null bitmap keeps all lines."""
    b = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"),
                       F.col("keep_bitmap").alias("bitmap"))
    own = carried(docs, doc=F.col(id_col).cast("bigint"), key=row_key(F.col(text_col)))
    both = own.join(b, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    return both.select("row", "bitmap")


def line_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for every row of ``docs``, from its bitmap."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            rows = [kept_text(data[bounds[k]: bounds[k + 1]].tobytes(), m)
                    for k, m in enumerate(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options)
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return (with_bitmaps(read, bitmaps).select("row.doc_id", "row.text", "bitmap")
            .mapInArrow(digests, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with only the kept lines in their texts; all columns as before (a null text stays null)."""
    @F.pandas_udf("string")
    def applied(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([t if m is None or t is None else kept_text(t.encode(), m)[0].decode()
                          for t, m in zip(text, bitmap)], dtype=object)

    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options)
    text = F.col("row")[text_col]
    text = F.when(F.col("bitmap").isNull(), text).otherwise(applied(text, "bitmap"))
    return (with_bitmaps(docs, bitmaps, id_col=id_col, text_col=text_col)
            .select(F.col("row").withField(text_col, text).alias("row")).select("row.*"))
