"""ARC to WARC: round trips, both ARC versions, and archives that are not sound."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from basketry.llm import warc
from basketry.llm.common import shared_path

LONG = "<p>é漢\U0001F600</p>" * 20


def edge_pages():
    return [(1, "http://a/1", LONG), (2, "http://a/ 2\n", LONG), (3, None, "short"), (4, "http://a/4", "short"),
            (5, "", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\nURL 0 0 0 5\nline\r\n\r\n" * 9),
            (8, "u", "HTTP/1.0 200 OK\r\n\r\ninner" * 30), (9, "u", LONG), (0, "v", LONG + "x"), (10, "v", LONG + "x"),
            (12, "z", "y" * 99), (13, "z", "y" * 99), (14, "z", "y" * 100), (15, "z", "y" * 100), (16, "w", "big " * 60000)]


def brute(rows):
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == payload]
        again = len(payload) >= 100 and key != min(same)
        out.append((key, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response",
                    min(same) if again else None))
    return sorted(out)


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    pages = spark.createDataFrame(edge_pages(), "page_id bigint, url string, html string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("key", "body", "head", "date", "mime", "value")}).repartition(3)
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(pages, arc, version=version)
    warc.convert(spark, arc, out)
    got = warc.read_warc(spark, out).collect()
    assert sorted((r.key, r.payload_bytes, r.payload_digest, r.warc_type, r.refers_key) for r in got) == brute(edge_pages())
    by_id = {r.record_id: r for r in got}
    assert len(by_id) == len(got)
    for r in got:
        assert r.date == "2024-01-01T00:00:00Z"
        if r.warc_type == "revisit":
            assert by_id[r.refers_id].key == r.refers_key and by_id[r.refers_id].warc_type == "response"
    # a second conversion gives the same identifiers
    again = shared_path(spark, "warc")
    warc.convert(spark, arc, again)
    assert {r.record_id for r in warc.read_warc(spark, again).collect()} == set(by_id)


def test_long_pages_go_to_files_of_their_own(spark):
    """Pages of 50 MB, twice, and of 200 kB among short ones: no file with more than its bytes."""
    pages = spark.range(300).selectExpr(
        "id AS page_id", "'u' AS url", "CASE WHEN id IN (7, 8) THEN repeat('0123456789', 5000000) "
        "WHEN id >= 100 THEN repeat(CAST(id AS STRING), 70000) ELSE CAST(id AS STRING) END AS html").repartition(2)
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(pages, arc)
    warc.convert(spark, arc, out)
    for path in (arc, out):
        sizes = sorted(len(gzip.open(f.removeprefix("file:"), "rb").read()) for f in spark.read.format("binaryFile").load(path).select("path").toPandas().path)
        # the revisit of the long page has no payload
        assert sum(n > 40 << 20 for n in sizes) == (2 if path == arc else 1)
        assert sorted(n for n in sizes if n < 40 << 20)[-1] < 130 * 220_000 and len(sizes) >= 5
    got = {r.key: r for r in warc.read_warc(spark, out).collect()}
    assert len(got) == 300 and got[7].payload_bytes == 50_000_000 and got[8].warc_type == "revisit" and got[8].refers_key == 7
    assert got[7].payload_digest == got[8].payload_digest == hashlib.sha256(b"0123456789" * 5_000_000).hexdigest()


def test_null_and_repeated_keys_and_empty_table(spark):
    rows = [(None, "u", LONG), (3, "u", LONG), (3, "u", LONG), (None, "u", "s")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(pages, arc)
    warc.convert(spark, arc, out)
    got = warc.read_warc(spark, out).collect()
    assert sorted((str(r.key), r.warc_type, str(r.refers_key)) for r in got) == [
        ("3", "response", "None"), ("3", "revisit", "3"), ("None", "response", "None"), ("None", "revisit", "3")]
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(pages.limit(0), arc)
    warc.convert(spark, arc, out)
    assert warc.read_warc(spark, out).isEmpty()


def arc(version, lines):
    about = f"{version} 0 test\n{warc.ARC_FIELDS[version]}\n"
    return (f"filedesc://t.arc 0.0.0.0 20200101000000 text/plain {len(about)}\n{about}\n".encode()
            + b"".join(line.encode() + b"\n" + body + b"\n" for line, body in lines))


def test_arc_versions_and_lengths():
    one = arc("1", [("http://x 1.2.3.4 19990102030405 text/html 5", b"a\nb c"), ("dns:x 0 1 text/dns 0", b"")])
    assert [(r["URL"], r["content"]) for r in warc.arc_records(one, "f")] == [("http://x", b"a\nb c"), ("dns:x", b"")]
    assert len(list(warc.arc_records(gzip.compress(one), "f"))) == 2
    two = arc("2", [("http://x 1.2.3.4 19990102030405 text/html 200 sum loc 77 file.arc 3", b"abc")])
    r = next(warc.arc_records(two, "f"))
    assert (r["Result-code"], r["Filename"], r["content"]) == ("200", "file.arc", b"abc")
    assert [x["URL"] for x in warc.arc_records(one + two, "f")] == ["http://x", "dns:x", "http://x"]
    assert list(warc.arc_records(b"", "f")) == []


@pytest.mark.parametrize("data", [
    arc("1", [("http://x 1.2.3.4 19990102030405 text/html 50", b"abc")]),
    arc("1", [("http://x 1.2.3.4 19990102030405 text/html 200 - - 0 f 3", b"abc")]),
    arc("1", [("http://x 1.2.3.4 19990102030405 text/html many", b"abc")]),
    b"http://x 1.2.3.4 19990102030405 text/html 3"])
def test_arc_errors(data):
    with pytest.raises(ValueError):
        list(warc.arc_records(data, "f"))


def test_content_without_http_header_is_a_resource(spark):
    path, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    text = arc("1", [("dns:x 0.0.0.0 notadate text/dns 3", b"abc"), ("http://y 0 20200101000000 text/html 0", b"")])
    spark.createDataFrame([(text.decode().rstrip("\n"),)], "value string").write.option("lineSep", "\n").text(path)
    warc.convert(spark, path, out)
    got = {r.url: r for r in warc.read_warc(spark, out).collect()}
    assert got["dns:x"].warc_type == "resource" and got["dns:x"].date == "1970-01-01T00:00:00Z"
    assert got["dns:x"].payload_digest == hashlib.sha256(b"abc").hexdigest() and got["http://y"].payload_bytes == 0
