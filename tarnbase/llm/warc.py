"""WARC archives: writing with revisit records and segments, reading with segment reassembly.

Writing goes through Spark's own text writer, so archives land on any store that Spark writes, by committed task attempts (a lost executor leaves no half
archive). Each record is a gzip member of its own; the writer's line separator is the empty gzip member, which adds nothing to the stream. A file begins
with a warcinfo record. Payloads are sent as HTTP responses in chunked transfer framing; a block above `SEGMENT_BYTES` is cut into a first record and continuation records.

A revisit names the record id of its response. So that only thin rows (digest, page_id, hash of url) are exchanged to find it, that id follows from them;
rows that are equal in all of page_id, url and payload are numbered.

Reading takes whole files from Spark's binary source (`FILE_RECORDS` bounds a file), parses records by Content-Length in one pass, brings continuation records together
by origin identifier in order of segment number, verifies that numbers are complete and the total length is right, decodes
the chunked framing and verifies each payload digest.

Defined cases: a null html is an empty payload; equal payloads of at least `REVISIT_LEAST` bytes have one response, the row with the largest page_id (a null
page_id is the smallest; rows that share that page_id are all responses); an empty table gives an empty table; url may be null, control characters in it are left out;
other columns may have any name (they are not read).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, shared_dir

REVISIT_LEAST = 0
SEGMENT_BYTES = 65_536
CHUNK_BYTES = 8_192
FILE_RECORDS = 2_000
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: A gzip member without content, as the text of its bytes.
_EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without its closing CRLF CRLF."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block


def record_id(page: object, *rest: object) -> str:
    return f"<urn:tarnbase:page:{'' if page is None else quote(str(page), safe='')}:{':'.join(map(str, rest))}>"


def page_records(page: object, url: str | None, payload: bytes, name: str, refers_to: str | None = None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit (if it refers to another), a response, or a first segment and its continuations."""
    clean = "".join(c for c in url or "" if c >= " ")
    common = [("WARC-Target-URI", clean), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to:
        extra = [("WARC-Profile", _REVISIT), ("WARC-Refers-To", refers_to), ("Content-Type", "application/http; msgtype=response")]
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *extra], _HEAD)]
    block = _HEAD + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        return [record(first, block)]
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record([*first, ("WARC-Segment-Number", "1")], cuts[0])]
    for k, part in enumerate(cuts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(cuts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)), *total], part))
    return out


def warcinfo() -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")]
    return record(fields, b"software: tarnbase\r\nformat: WARC File Format 1.1\r\n")


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case header fields, block) of each record of an archive, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + size


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """Payload of a whole HTTP response block, its digest verified."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if stated and stated != base32_sha1(payload):
        raise ValueError(f"the payload of {fields.get('warc-record-id')} doesn't have its digest")
    return payload


def _hash(url: str) -> Column:
    return F.lower(F.hex(F.xxhash64(F.col(url).isNull(), F.col(url))))


def write_archives(pages: DataFrame, path: str, revisit_least: int = REVISIT_LEAST, segment: int = SEGMENT_BYTES) -> str:
    """Writes a record for each row of (page_id, url, html) under `path`."""
    # Equality of payloads: SHA-256. Only payloads that occur again are joined, as thin rows where they are few enough to be sent to all.
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("sha"))
    order = F.struct("page_id", "place")
    again = p.select("page_id", "sha", _hash("url").alias("place")).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max_by(order, order).alias("top"))
    again = cut(again.where("n > 1").select("sha", F.col("top.page_id").alias("of"), F.col("top.place").alias("place"), F.lit(True).alias("again")))
    met = p.join(bounded(again, again.count()), "sha", "left")
    last = F.col("again").isNull() | F.col("page_id").eqNullSafe(F.col("of"))
    small = F.octet_length("html") < revisit_least
    repeated = F.col("again") & last & ~small
    # Rows of one page_id that share a payload which others may refer to: equal ones become one row with their number.
    one = met.where(~F.coalesce(repeated, F.lit(False))).select("page_id", "url", "html", "sha", "of", "place", (last | small).alias("whole"), F.lit(1).cast("long").alias("n"))
    several = met.where(repeated).groupBy("page_id", "url", "sha", "of", "place").agg(F.any_value("html").alias("html"), F.count(F.lit(1)).alias("n"))
    rows = one.unionByName(several.withColumn("whole", F.lit(True))).select("page_id", "url", F.col("html").cast("binary").alias("html"), F.substring("sha", 1, 32).alias("sha"), "of", "place", "whole", "n", _hash("url").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for b in batches:
            for page, url, html, sha, of, place, whole, n, own in zip(*(c.to_pylist() for c in b.columns)):
                out = []
                for k in range(1, n + 1):
                    # Only a response that can be referred to has to have an id that others know.
                    name = record_id(page, sha, own, k) if whole and (len(html) >= revisit_least) else record_id(page, sha, own, uuid.uuid4().hex)
                    for x in page_records(page, url, html, name, None if whole else record_id(of, sha, place, 1), segment):
                        # The writer begins a file at every FILE_RECORDS records of a task.
                        if written % FILE_RECORDS == 0:
                            out.append(warcinfo())
                            written += 1
                        out.append(x)
                        written += 1
                yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x + b"\r\n\r\n", 6, mtime=0) for x in out], pa.binary())], names=["record"])

    text = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    # Bytes pass through the writer as they are; the encoding is that of the separator.
    text.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER).option("maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(path)
    return path


def read_archives(spark: SparkSession, path: str, page_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page; of a revisit they are those it states."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def page_of(name: str) -> str | None:
        return unquote(name.strip("<>").split(":")[3]) or None

    def row(fields: dict[str, str], block: bytes) -> tuple:
        if fields["warc-type"] == "revisit":
            return page_of(fields["warc-record-id"]), int(fields["warc-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), "revisit", page_of(fields["warc-refers-to"])
        payload = payload_of(fields, block)
        return page_of(fields["warc-record-id"]), len(payload), base32_sha1(payload), "response", None

    names, types = ("page", "bytes", "digest", "kind", "refers"), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    part_names, part_types = ("origin", "number", "total", "block"), (pa.string(), pa.int32(), pa.int64(), pa.binary())

    def batch(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                out = []
                for f, x in records_of(data.as_py()):
                    if f["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    if "warc-segment-number" in f:
                        origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
                        out.append((None, None, f.get("warc-payload-digest"), None, None, origin, int(f["warc-segment-number"]), int(f.get("warc-segment-total-length", -1)), zlib.compress(x, 1)))
                    else:
                        out.append((*row(f, x), f["warc-record-id"], 0, -1, None))
                yield batch(out, names + part_names, types + part_types)

    def reassembled(segments: list[tuple]) -> tuple:
        digest, origin, total = segments[0][0], segments[0][1], segments[-1][3]
        block = b"".join(zlib.decompress(s[4]) for s in segments)
        if [s[2] for s in segments] != list(range(1, len(segments) + 1)) or len(block) != total:
            raise ValueError(f"segments of {origin} are missing or their total length isn't {total}")
        return row({"warc-type": "response", "warc-record-id": origin, "warc-payload-digest": digest or ""}, block)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out = []
            for page, size, digest, kind, refers, origin, number, total, block in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][1] != origin:
                    out.append(reassembled(held))
                    held = []
                if kind is None:
                    held.append((digest, origin, number, total, block))
                else:
                    out.append((page, size, digest, kind, refers))
            yield batch(out, names, types)
        if held:
            yield batch([reassembled(held)], names, types)

    schema = "page string, bytes bigint, digest string, kind string, refers string"
    found = files.mapInArrow(parsed, f"{schema}, origin string, number int, total bigint, block binary")
    # Whole records pass as thin rows; segments of one origin come next to each other, in order.
    out = found.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(whole, schema)
    return out.select(
        F.col("page").cast(page_type).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers").cast(page_type).alias("refers_to"),
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives and reads them back. The archives stay under `path`."""
    spark = pages.sparkSession
    path = write_archives(pages, path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    return read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())
