"""Legacy ARC archives to WARC.

An ARC file begins with a version block whose header says which fields the
record header lines of that file have; each record is such a line and as many
bytes as the line declares. The converter reads files by these lengths, and
writes WARC records with identifiers, timestamps, types and digests made from
what the ARC record holds. Files are written and read by Spark's own readers
and writers, compressed, in the shared store; a record is one row of a text
writer whose line end completes the record's closing blank lines. Files are
bounded by bytes: long records go to files of few records or of one. A task
unpacks a file as a stream, one record at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.common import stored

#: records per archive file, by their bytes: (from, below, records). No file has more than 128 MB of records, but for
#: files of one record
FILES = ((0, 64 << 10, 2000), (64 << 10, 1 << 20, 128), (1 << 20, None, 1))
#: payloads shorter than this are never revisits
MIN_REVISIT_BYTES = 100

# The field lines of ARC versions 1 and 2, and the fallback type.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
UNKNOWN_TYPE = "application/octet-stream"
#: names identifiers made from an ARC record's place and content
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")

RECORDS = ("url string, ip string, date string, mime string, head binary, body binary, key bigint, "
           "record_id string, payload_bytes bigint, payload_digest string")


def _clean(x: Column, fallback: str) -> Column:
    """A header field: what is null or empty becomes the fallback, white space becomes %20."""
    return F.coalesce(F.nullif(F.regexp_replace(x, r"[\x00-\x20\x7F]", "%20"), F.lit("")), F.lit(fallback))


def _write_files(rows: DataFrame, value: Column, size: Column, path: str) -> None:
    """Writes ``value`` of each row as a record of gzip files below ``path``; FILES says how many to a file, by ``size``."""
    kind = F.lit(0)
    for k, (least, _, _) in enumerate(FILES):
        kind = F.when(size >= least, F.lit(k)).otherwise(kind)
    kinds = [r["kind"] for r in rows.select(kind.alias("kind")).distinct().collect()]  # those of FILES that are there
    for k in sorted(kinds) or [0]:
        (rows.where(kind == k).select(value.alias("value")).write.mode("append").option("compression", "gzip")
         .option("lineSep", "\n").option("maxRecordsPerFile", FILES[k][2]).text(path))


def write_arc(pages: DataFrame, path: str, *, version: int = 1, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", date: str = "20240101000000") -> None:
    """Writes one ARC response record per row (gzip files below ``path``, which FILES bounds).

    The payload is the html in UTF-8 (null: empty) behind an HTTP header that
    carries the row's id as ``X-Record-Key`` (null id: no such line).
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    key = F.coalesce(F.concat(F.lit("X-Record-Key: "), F.col(id_col).cast("string"), F.lit("\r\n")), F.lit(""))
    content = F.concat(F.lit("HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
                       F.octet_length(body).cast("string"), F.lit("\r\n"), key, F.lit("\r\n"), body)
    url = _clean(F.col(url_col), "about:blank")
    if version == 1:
        line = F.concat_ws(" ", url, F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"),
                           F.octet_length(content).cast("string"))
    else:
        line = F.concat_ws(" ", url, F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), F.lit("200"), F.lit("-"),
                           F.lit("-"), F.lit("0"), F.lit("-"), F.octet_length(content).cast("string"))
    # a file has no record of its own to begin with, so each record brings a version block of its version along
    about = f"{version} 0 basketry\n{ARC_FIELDS[str(version)]}\n"
    block = f"filedesc://converted.arc 0.0.0.0 {date} text/plain {len(about)}\n{about}\n"
    _write_files(pages, F.concat(F.lit(block), line, F.lit("\n"), content), F.octet_length(body), path)


def _stream(data: bytes) -> io.BufferedReader:
    """The bytes of a file, gzip or plain, unpacked as they are read."""
    raw = io.BytesIO(data)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw, 1 << 20)


def arc_records(data: bytes, name: str) -> Iterator[dict]:
    """The records of one ARC file (gzip or plain).

    ``name`` and a record's offset identify it. A version block sets the
    fields of the header lines that follow. Raises ValueError where a header
    line does not have these fields, or the file ends inside a record.
    """
    stream, fields, at = _stream(data), ARC_FIELDS["1"].split(), 0
    while ahead := stream.peek(1)[:1]:
        if ahead in (b"\n", b"\r"):  # between records
            at += len(stream.read(1))
            continue
        line = stream.readline()
        if not line.endswith(b"\n"):
            raise ValueError(f"{name}: unfinished ARC header line at {at}")
        values = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        if values[0].startswith("filedesc:"):
            values = [*values[:4], values[-1]]
            names = ARC_FIELDS["1"].split()
        else:
            names = fields
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"{name}: ARC header line at {at} does not have the fields {' '.join(names)}")
        length = int(values[-1])
        content = stream.read(length)
        if len(content) < length:
            raise ValueError(f"{name}: ARC record at {at} declares {length} bytes and has {len(content)}")
        if values[0].startswith("filedesc:"):
            lines = content.split(b"\n")
            version = lines[0].split(b" ")[0].decode()
            declared = lines[1].decode().split() if len(lines) > 1 else []
            fields = declared or ARC_FIELDS.get(version, ARC_FIELDS["1"]).split()
        else:
            yield dict(zip(names, values)) | {"content": content, "at": at}
        at += len(line) + length


def _http(content: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its blank line, payload); no header: all is payload."""
    if content.startswith(b"HTTP/") and (m := re.search(rb"\r?\n\r?\n", content)):
        return content[: m.end()], content[m.end():]
    return b"", content


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string()] * 4 + [pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for k in range(batch.num_rows):
            path, rows, held = batch.column(0)[k].as_py(), [], 0
            for r in arc_records(batch.column(1)[k].as_py(), path):
                head, body = _http(r["content"])
                key = re.search(rb"(?mi)^X-Record-Key: (-?\d+)\r?$", head)
                name = f"{path.rsplit('/', 1)[-1]}:{r['at']}"
                rows.append((r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], head, body,
                             int(key[1]) if key else None, f"urn:uuid:{uuid.uuid5(NAMESPACE, name)}", len(body),
                             hashlib.sha256(body).hexdigest()))
                held += len(body)
                if held > 8 << 20 or len(rows) == 1000:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ARC files below ``path`` (columns RECORDS)."""
    return (spark.read.format("binaryFile").load(path).select("path", "content")
            .mapInArrow(_parsed, RECORDS))


def with_types(records: DataFrame, *, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds ``record_type``, and for revisits ``refers_id`` and ``refers_key``.

    Of records with equal payloads of at least ``min_bytes``, that with the
    smallest key (null last, then by record id) is the response, the others
    revisit it. Counting is done before the shuffle, so a payload that a third
    of all records share is one row per task.
    """
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", "record_id")
    first = stored(records.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("_digest"))
                   .agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "warc-first")
    other = F.col("_first.record_id") != F.col("record_id")
    return (records.join(first, F.col("payload_digest") == F.col("_digest"), "left")
            .withColumn("record_type", F.when(other, "revisit").otherwise("response"))
            .withColumn("refers_id", F.when(other, F.col("_first.record_id")))
            .withColumn("refers_key", F.when(other, F.col("_first.key")))
            .drop("_digest", "_first", "_n"))


def write_warc(typed: DataFrame, path: str) -> None:
    """Writes one WARC/1.1 record per row of ``with_types`` (gzip files below ``path``).

    A revisit has the HTTP header and no payload, names the response it refers
    to, and keeps the digest and length of the payload it stands for.
    """
    stamp = F.date_format(F.coalesce(F.try_to_timestamp(F.col("date"), F.lit("yyyyMMddHHmmss")),
                                     F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("record_type") == "revisit"
    http = F.length("head") > 0
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "body"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    kind = F.when(http, "application/http; msgtype=response").otherwise(F.coalesce("mime", F.lit(UNKNOWN_TYPE)))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(~http & ~revisit, "resource").otherwise(F.col("record_type"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", stamp), line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.concat(F.lit("<"), "refers_id", F.lit(">"))),
        line("X-Refers-To-Key", F.col("refers_key")), line("X-Record-Key", F.col("key")),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("Content-Type", kind), line("Content-Length", F.octet_length(block)), F.lit("\r\n"))
    value = F.concat(header.cast("binary"), block, F.lit("\r\n\r").cast("binary")).cast("string")
    _write_files(typed, value, F.col("payload_bytes"), path)


def warc_records(data: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of one WARC file (gzip or plain)."""
    stream = _stream(data)
    while first := stream.readline():
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b""):
            lines.append(line.rstrip(b"\r\n"))
        if not first.startswith(b"WARC/") or not line:
            raise ValueError(f"{name}: no WARC record begins with {first[:40]!r}")
        fields = dict(x.decode("utf-8", "replace").split(": ", 1) for x in lines)
        fields = {k.lower(): v for k, v in fields.items()}
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{name}: a WARC record declares {length} bytes and does not end there")
        yield fields, block


READ = ("key bigint, warc_type string, record_id string, url string, date string, payload_bytes bigint, "
        "payload_digest string, refers_id string, refers_key bigint")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    for batch in batches:
        for k in range(batch.num_rows):
            path, rows = batch.column(0)[k].as_py(), []
            for f, block in warc_records(batch.column(1)[k].as_py(), path):
                digest, size = f["warc-payload-digest"].removeprefix("sha256:"), int(f["x-payload-length"])
                if f["warc-type"] != "revisit":
                    payload = _http(block)[1]
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: payload of {f['warc-record-id']} is not what its header says")
                rows.append((number(f.get("x-record-key")), f["warc-type"], f["warc-record-id"], f["warc-target-uri"],
                             f["warc-date"], size, digest, f.get("warc-refers-to"), number(f.get("x-refers-to-key"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path`` (columns READ), payloads checked against their digests."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, READ)


def convert(spark: SparkSession, arc_path: str, warc_path: str, *, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Converts the ARC files below ``arc_path`` into WARC files below ``warc_path``.

    Identifiers are made from an ARC file's name and a record's offset, so a
    rerun gives the same ones. Dates that cannot be read become 1970-01-01.
    Content that begins with an HTTP header becomes a response with that
    header, other content a resource. Empty files and payloads, and equal
    records, are ordinary; a long record is held whole, but no more than one. A header line that does not have its version's
    fields, or a length beyond the file's end, raises ValueError.
    """
    records = stored(read_arc(spark, arc_path), "arc-records")  # files are unpacked once
    write_warc(with_types(records, min_bytes=min_bytes), warc_path)
