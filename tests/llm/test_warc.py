import gzip
import random

from pyspark.sql import functions as F

from postlens.llm import warc
from postlens.llm.common import shared_path


def test_chunk_framing():
    for n in (0, 1, 8192, 8193, 50_000):
        data = bytes(range(256)) * (n // 256 + 1)
        assert warc.unchunked(warc.chunked(data[:n])) == data[:n]
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"zz\r\nabc\r\n0\r\n\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX0\r\n\r\n"):
        assert warc.unchunked(broken) is None


def test_parse_gzipped_by_record_or_plain():
    records = [warc.record("response", f"urn:page:{i}:X", warc.HTTP + warc.chunked(b"WARC/1.1\r\n\r\n" * i)) + b"\r\n\r\n" for i in range(4)]
    for content in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))):
        assert [warc.payload_of(block) for _, block in warc.parse(content)] == [b"WARC/1.1\r\n\r\n" * i for i in range(4)]


def put(spark, records, files=3):
    path = shared_path(spark, "warc-test")
    df = spark.createDataFrame([(bytearray(r),) for r in records], "r binary").repartition(files)
    df.select(F.col("r").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
    return path


def test_segments_in_any_order_and_broken_ones(spark):
    rng = random.Random(4)
    payload = bytes(rng.randrange(256) for _ in range(5000))
    digest = warc.base32_sha1(payload)
    make = lambda name, sha=digest: list(warc.records_of(name, "http://a/", payload, sha, None, 700))
    good, missing, cut, wrong, twice, endless = (make("urn:page:0:d"), make("urn:page:1:d"), make("urn:page:2:d"), make("urn:page:3:d", "OTHER"), make("urn:page:4:d"), make("urn:page:5:d"))
    assert len(good) == 8
    del missing[3], endless[-1]
    body = warc.HTTP + warc.chunked(payload)
    cut[-1] = warc.record("continuation", "urn:page:2:d:8", body[4900:-9], WARC_Segment_Number=8, WARC_Segment_Origin_ID="<urn:page:2:d>", WARC_Segment_Total_Length=len(body))
    records = good + missing + cut + wrong + twice + twice[2:5] + endless
    rng.shuffle(records)
    got = {r.record_id: r for r in warc.read_archives(spark, put(spark, records), keep_payload=True).collect()}
    for i in (0, 4):
        r = got[f"urn:page:{i}:d"]
        assert (r.complete, r.payload_bytes, r.payload_digest, bytes(r.payload)) == (True, 5000, digest, payload)
    for i in (1, 2, 3, 5):
        r = got[f"urn:page:{i}:d"]
        assert (r.complete, r.payload_bytes, r.payload) == (False, None, None)


def test_odd_pages(spark):
    long = "long " * 40_000
    rows = [(3, "http://a/\n", None), (2, None, ""), (1, "u", "x"), (5, "u", "x"), (4, "u", "x"), (9, "u", long), (8, "ü ", long), (7, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\n"), (7, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\n"), (None, "u", "x"), (None, "u", "x"), (None, "u", "alone"), (10, "u", "y"), (10, "v", "y"), (11, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("c") for c in ("sha", "first", "n", "record_type", "refers_to")})
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect()), key=str)
    assert got == sorted([
        (1, 1, "response", None), (2, 0, "response", None), (3, 0, "revisit", 2), (4, 1, "revisit", 1), (5, 1, "revisit", 1), (7, 22, "response", None), (7, 22, "revisit", 7),
        (10, 1, "response", None), (10, 1, "revisit", 10), (11, 1, "revisit", 10), (None, 1, "revisit", 1), (8, 200_000, "response", None), (9, 200_000, "revisit", 8), (None, 1, "revisit", 1), (None, 5, "response", None),
    ], key=str)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path, least_bytes=3)
    kinds = [r.record_type for r in warc.read_archives(spark, path).orderBy("record_id").collect()]
    assert kinds == ["response", "response", "response", "revisit"]
