"""WARC archives: writing with segments and chunked payloads, reading with segment reassembly."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import materialise, shared_path

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 32 << 10, 8 << 10, 4096
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORDS = (
    "record_id string, origin_id string, segment long, total long, record_type string, target_uri string, refers_to string, "
    "payload_digest string, complete boolean, payload_bytes long, block binary"
)
NAMES = [x.split()[0] for x in RECORDS.split(", ")]
KINDS = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, chunk extensions and trailers passed over; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16) if end >= 0 else -1
        except ValueError:
            return None
        if n < 0:
            return None
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) < n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(part)
        at = end + 4 + n


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record(kind: str, name: str, block: bytes, **fields: object) -> bytes:
    """A record without its two closing line ends."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE, **{k.replace("_", "-"): v for k, v in fields.items() if v is not None}, "Content-Length": len(block)}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block


def records_of(name: str, uri: str, payload: bytes, digest: str, first: str | None, segment_bytes: int) -> Iterator[bytes]:
    """A revisit of `first`, or a response in as many segments as it needs."""
    uri = "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in uri or "")
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}"}
    kind = "application/http; msgtype=response"
    if first is not None:
        yield record("revisit", name, HTTP, WARC_Refers_To=f"<{first}>", Content_Type=kind, **common)
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", name, block, Content_Type=kind, **common)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record("response", name, parts[0], WARC_Segment_Number=1, Content_Type=kind, **common)
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield record("continuation", f"{name}:{n}", part, WARC_Segment_Number=n, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Total_Length=total, WARC_Target_URI=uri)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, least_bytes: int = 0) -> None:
    """Writes a record per page: of pages with equal payloads of at least `least_bytes` bytes that with the smallest
    page_id as a response, the others as revisits of it; smaller ones all as responses.

    A null html is an empty payload. A null page_id comes last among equal payloads. Of equal payloads with the same smallest
    page_id, that of the first row is the response. Every row has a record id of its own, by its place in the table, so
    `pages` must come in the same order when it is read again, as files do. A payload's record is cut into segments of
    at most `segment_bytes`, and a file has at most `records_per_file` records."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html")).withColumns({"sha": F.sha1("html"), "row": F.monotonically_increasing_id()})
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    sums = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    copies = materialise(sums.where("n > 1").drop("n"))  # a join of two plain shuffles, which splits a payload of very many pages
    rows = rows.join(copies, "sha", "left").select("page_id", "url", "html", "row", F.col("first.page_id").alias("first"), F.col("first.row").alias("first_row"))

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, url, html, row, first, first_row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "row", "first", "first_row")), strict=True):
                page, row, first, first_row, data = page.as_py(), row.as_py(), first.as_py(), first_row.as_py(), html.as_py().encode("utf-8", "surrogatepass")
                digest = base32_sha1(data)
                origin = None if first_row in (None, row) else f"urn:page:{first}:{digest}:{first_row}"
                new = list(records_of(f"urn:page:{page}:{digest}:{row}", url.as_py(), data, digest, origin, segment_bytes))
                out += new
                held += sum(map(len, new))
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # The text writer copies a value's bytes and the separator, which closes a record.
    records = rows.mapInArrow(serialise, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, gzipped as a whole or record by record."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no record at {line[:40]!r}")
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def _bare(name: str | None) -> str | None:
    return name[1:-1] if name and name.startswith("<") else name


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record that has or refers to a payload: record_id, record_type, target_uri, refers_to, payload_digest,
    complete, payload_bytes, and payload if asked for.

    Records without continuation are decoded where they are read. Segments are grouped by the record they continue and
    put in order of their numbers; complete is false, and the payload null, if a number is missing, the total length is absent or
    differs, the chunk framing is broken, or the digest differs. A segment that is there twice counts once. Order and
    file of segments do not matter."""

    def decoded(head: tuple, digest: str | None, block: bytes | None) -> tuple:
        payload = payload_of(block) if block is not None else None
        found = base32_sha1(payload) if payload is not None else None
        sound = found is not None and digest in (None, found)
        return (*head, found or digest, sound, len(payload) if sound else None, payload if sound and keep_payload else None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in parse(content.as_py()):
                    kind, name, number = fields["warc-type"], _bare(fields["warc-record-id"]), fields.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation", "resource"):
                        continue
                    digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
                    total = fields.get("warc-segment-total-length")
                    head = (name, _bare(fields.get("warc-segment-origin-id")) or name, int(number) if number else None, int(total) if total else None, kind, fields.get("warc-target-uri"), _bare(fields.get("warc-refers-to")))
                    if number:
                        rows.append((*head, digest, None, None, block))
                    elif kind == "revisit":
                        rows.append((*head, digest, True, None, None))
                    else:
                        rows.append(decoded(head, digest, block))
                    held += len(block)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[1] != group[0][1]:
                    yield batch_of([whole(group)])
                    group = []
                if not group or group[-1][2] != row[2]:
                    group.append(row)
        if group:
            yield batch_of([whole(group)])

    def whole(group: list[tuple]) -> tuple:
        head = group[0]
        numbers, total = [r[2] for r in group], group[-1][3]
        block = b"".join(r[10] for r in group)
        sound = numbers == list(range(1, len(group) + 1)) and total == len(block)
        return decoded((head[1], head[1], None, total, "response" if head[2] != 1 else head[4], head[5], head[6]), head[7], block if sound else None)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    read = materialise(files.mapInArrow(scan, RECORDS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = read.where("segment IS NOT NULL").repartition(parts, "origin_id").sortWithinPartitions("origin_id", "segment")
    out = read.where("segment IS NULL").unionByName(pieces.mapInArrow(stitch, RECORDS))
    kept = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "complete", "payload_bytes"]
    return out.select(*kept, *([F.col("block").alias("payload")] if keep_payload else []))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages to a new shared folder and gives what reading it back finds, one row per page.

    A revisit's payload_bytes are those of the response that it refers to. Rows that repeat are records of their own: of equal
    rows one is the response, the others revisit it. An empty table gives no rows."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    read = materialise(read_archives(spark, path))
    page = lambda c: F.split_part(c, F.lit(":"), F.lit(3)).try_cast("long")
    sizes = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"))
    visits = read.where("record_type = 'revisit'").join(sizes, "refers_to", "left")
    both = read.where("record_type <> 'revisit'").withColumn("first_bytes", F.col("payload_bytes")).unionByName(visits.select(*read.columns, "first_bytes"))
    return both.select(
        page(F.col("record_id")).alias("page_id"), F.col("first_bytes").alias("payload_bytes"), "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to")
    )


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, first_value(page_id) OVER w AS first, row_number() OVER w AS nth FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: {_DIGIT}), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first END AS refers_to
FROM f
"""
