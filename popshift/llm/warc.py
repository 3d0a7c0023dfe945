"""WARC archives: writing segmented records, and reading them back by segment reassembly.

Writing: each page becomes an HTTP response in chunked transfer framing, in a `response` record; equal payloads of at
least min_dedup bytes are kept once, in the record of the largest page_id, and the others are `revisit` records that
refer to it. A block of over SEGMENT bytes is cut into a first segment and `continuation` records that carry the
origin's identifier, their segment number, and in the last one the total length. Spark's text writer ends each record
with the two line ends that the format asks for, so the files are WARC 1.1, gzipped.

Reading: files are parsed by their length fields. Segments meet by origin identifier, are ordered by number and joined,
the total length is verified and the chunked framing decoded; the payload's SHA-1 is compared with the record's digest.

Defined results: a null html is an empty payload; a null url gives no target header; a null page_id stays null and never
wins over a number; repeated pages are one record each, those with the largest page_id all `response`; a record whose
length, framing or digest is wrong raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from popshift.llm.common import column, new_path, read, small_batches

SEGMENT, CHUNK = 16_384, 4_096
#: With segments of at most SEGMENT bytes this bounds a file, which one task reads.
RECORDS_PER_FILE = 2_000
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n"
PAYLOAD = "http-payload"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(END, at)
        if end < 0:
            raise ValueError("chunked framing ends early")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != END:
            raise ValueError("a chunk is short")
        out.append(part)
        at = end + 4 + size


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {re.sub(r'[\r\n]', lambda m: '%%%02X' % ord(m[0]), str(v))}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def _cut(block: bytes, size: int) -> list[bytes]:
    """Pieces of at most size bytes that don't split a character, as the writer's column is text."""
    out, at = [], 0
    while len(block) - at > size:
        end = at + size
        while block[end] & 0xC0 == 0x80:
            end -= 1
        out.append(block[at:end])
        at = end
    return [*out, block[at:]]


def records(name: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The WARC records of one page, without the two line ends that follow each."""
    digest = f"sha1:{base32_sha1(payload)}"
    same = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("Content-Type", "application/http;msgtype=response"), ("WARC-Page-ID", page_id)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:{name}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Payload-Digest", digest)]
        return [_header([*head, *same, ("Content-Length", len(block))]) + block]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = _cut(block, segment)
    out = []
    for i, piece in enumerate(pieces, 1):
        if i == 1:
            head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{name}>"), ("WARC-Payload-Digest", digest)]
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:{name}:{i}>"), ("WARC-Segment-Origin-ID", f"<urn:{name}>")]
        if len(pieces) > 1:
            head.append(("WARC-Segment-Number", i))
            if i == len(pieces):
                head.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_header([*head, *(same if i == 1 else same[:2]), ("Content-Length", len(piece))]) + piece)
    return out


def _originals(pages: DataFrame, min_dedup: int) -> DataFrame:
    """pages with `refers_to`: the largest page_id of those with the same payload, where it isn't the page's own.

    A payload's rows are first reduced by salt, and the answer goes back to each salt, so copies of one payload never
    meet in one task.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("_payload"))
    keyed = pages.select("page_id", F.sha2("_payload", 256).alias("_k"), F.octet_length("_payload").alias("_n")).where(F.col("_n") >= min_dedup)
    salt = F.pmod(F.xxhash64("page_id"), F.lit(64)).alias("_salt")
    parts = keyed.groupBy("_k", salt).agg(F.max("page_id").alias("_top"), F.count("*").alias("_c"))
    copies = Window.partitionBy("_k")
    parts = parts.withColumns({"_best": F.max("_top").over(copies), "_c": F.sum("_c").over(copies)}).where("_c > 1").select("_k", "_salt", "_best")
    own = pages.withColumns({"_k": F.when(F.octet_length("_payload") >= min_dedup, F.sha2("_payload", 256)), "_salt": F.pmod(F.xxhash64("page_id"), F.lit(64))})
    joined = own.join(parts, ["_k", "_salt"], "left")
    return joined.select("page_id", "url", "_payload", F.when(~F.col("page_id").eqNullSafe(F.col("_best")), F.col("_best")).cast("long").alias("refers_to"))


def write(pages: DataFrame, path: str, min_dedup: int = 0, segment: int = SEGMENT) -> None:
    small_batches(pages.sparkSession)
    df = _originals(pages, min_dedup)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page, url, payload, refers in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "_payload", "refers_to")), strict=True):
                out += records(f"record:{task}-{i}", page, url, payload, refers, segment)
                i += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    text = df.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data, data.find(END, at) + 2, end + 2)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is short")
        yield fields, block
        at = end + 8 + size


def payload_of(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP header")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _response(page: str | None, digest: str, block: bytes) -> tuple:
    payload = payload_of(block)
    if (own := base32_sha1(payload)) != digest.removeprefix("sha1:"):
        raise ValueError(f"the payload of page {page} doesn't have its digest")
    return int(page) if page else None, len(payload), own, "response", None


def _table(rows: list[tuple], extra: list[tuple]) -> pa.RecordBatch:
    types = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("block", pa.binary())]
    both = [(*r, None, None, None, None, None) for r in rows] + [(e[0], None, None, None, None, *e[1:]) for e in extra]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in both], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length, piece) rows of one origin."""
    segments = sorted(segments)
    block = b"".join(s[2] for s in segments)
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1][1] != len(block):
        raise ValueError("segments are missing, or the total length isn't theirs")
    return block


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records under path."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in column(batch, "content"):
                rows, segments = [], []
                for f, block in parse(gzip.decompress(data.as_py())):
                    kind, page = f["warc-type"], f.get("warc-page-id")
                    if kind == "revisit":
                        size = int(re.search(rb"(?i)content-length: *(\d+)", block)[1])
                        rows.append((int(page) if page else None, size, f["warc-payload-digest"].removeprefix("sha1:"), kind, int(f["warc-refers-to"].strip("<>").rpartition(":")[2])))
                    elif kind == "response" and "warc-segment-number" not in f:
                        rows.append(_response(page, f["warc-payload-digest"], block))
                    elif kind in ("response", "continuation"):
                        total = f.get("warc-segment-total-length")
                        segments.append((int(page) if page else None, f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), int(total) if total else None, f.get("warc-payload-digest"), block))
                yield _table(rows, segments)

    records_ = files.mapInArrow(parsed, _ROW + ", origin string, number int, total long, digest string, block binary")

    def join(table: pa.Table) -> pa.Table:
        rows = table.select(["number", "total", "block", "page_id", "digest"]).to_pylist()
        block = reassemble([(r["number"], r["total"], r["block"]) for r in rows])
        first = next(r for r in rows if r["number"] == 1)
        return pa.Table.from_batches([_table([_response(first["page_id"] if first["page_id"] is None else str(first["page_id"]), first["digest"], block)], [])]).select(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    whole = records_.where("origin is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    joined = records_.where("origin is not null").groupBy("origin").applyInArrow(join, _ROW)
    return whole.unionByName(joined)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(read(spark, sf_dir, "pages"), path)
    return read_back(spark, path)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS best FROM p),
b AS (SELECT *, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(s || '0000', 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM b
"""
