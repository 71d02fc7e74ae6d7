"""WARC archives of pages, written and read back.

A response goes through chunked transfer framing into records of at most
``segment_bytes``: the first holds segment 1, continuation records name its
identifier and their number, the last one the total length. The reader groups
records by the origin identifier, orders the segments, checks their total length
and takes the chunks apart. Archives are files in the shared folder, so any
executor can read what another one wrote.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.scratch import hot_lookup, settled

#: Bytes of a record's block. No record is larger, so a file is at most
#: RECORDS_PER_FILE times this.
SEGMENT_BYTES = 16_384
RECORDS_PER_FILE = 2_000
#: Bytes of a chunk in the transfer framing.
CHUNK_BYTES = 4_096

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"


class BrokenArchive(ValueError):
    """A record that contradicts its own lengths, numbers or framing."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise BrokenArchive("a chunk without a length")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != CRLF:
            raise BrokenArchive("a chunk longer or shorter than it says")
        parts.append(body[at:at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the two line ends after the block, which the writer's line separator is."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + CRLF + block


def record_id(page: str, digest: str, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}:{segment}')}>"


def one_line(text: str | None) -> str:
    return "".join(c if c.isprintable() else " " for c in text or "")


def records_of(page, url: str | None, payload: bytes, first, copy: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page. ``first``: the page whose equal payload is stored."""
    digest, name = base32_sha1(payload), "" if page is None else str(page)
    own = record_id(name, digest)
    base = [("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)), ("X-Page-Id", name), ("X-Copy", copy),
            ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is not None and first != page:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *base, ("WARC-Profile", PROFILE),
                      ("WARC-Refers-To", record_id(str(first), digest)), ("X-Refers-To-Page", str(first)),
                      ("X-Payload-Length", str(len(payload)))], HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *base], block)
        return
    starts = range(0, len(block), segment_bytes)
    for n, at in enumerate(starts, 1):
        fields = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", record_id(name, digest, n)),
                  *base, ("WARC-Segment-Number", str(n))]
        if n > 1:
            fields.append(("WARC-Segment-Origin-ID", own))
        if n == len(starts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(fields, block[at:at + segment_bytes])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   segment_bytes: int = SEGMENT_BYTES, least_revisit: int = 0) -> None:
    """Writes a record per page as gzip archives below ``path``.

    Of equal payloads of ``least_revisit`` bytes or more, the smallest identifier is
    the response and the others revisit it. A null html is an empty payload, a null
    url an empty one. Rows that repeat an identifier and its payload are responses
    both. Rows without identifier revisit a response that has one, else they are
    responses. Other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    firsts = settled(rows.filter(F.length("payload") >= least_revisit).groupBy("sha")
                     .agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    told = hot_lookup(rows, firsts, "sha", "n").select("page", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page, url, payload, first in zip(*(batch.column(c) for c in ("page", "url", "payload", "first")), strict=True):
                n += 1
                for made in records_of(page.as_py(), url.as_py(), payload.as_py(), first.as_py(), f"{part}-{n}", segment_bytes):
                    out.append(made)
                    size += len(made)
                if size > 4_000_000:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
    made = told.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise BrokenArchive("no record where one should start")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                      for line in data[at:end].decode().split("\r\n")[1:])
        start, size = end + 4, int(fields["Content-Length"])
        if data[start + size:start + size + 4] != b"\r\n\r\n":
            raise BrokenArchive("a record longer or shorter than it says")
        yield fields, data[start:start + size]
        at = start + size + 4


_PARTS = "origin string, copy string, number int, total long, kind string, page string, url string, digest string, refers string, length long, block binary"
_PAGES = "page string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers string"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def page_of(origin: str, block: bytes, f: dict) -> tuple:
    """A page's row from its whole block; f: page, url, digest, refers, length, kind."""
    if f["kind"] == "revisit":
        return f["page"], f["url"], None, f["length"], f["digest"], "revisit", f["refers"]
    payload = unchunked(block[block.index(b"\r\n\r\n") + 4:])
    if base32_sha1(payload) != f["digest"]:
        raise BrokenArchive(f"wrong digest in {origin}")
    return f["page"], f["url"], payload, len(payload), f["digest"], "response", None


def _read_files(segmented: bool):
    """Reads archives: whole records to pages, or else segments, which other records go on with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in parsed(gzip.decompress(content.as_py())):
                    if ("WARC-Segment-Number" in f) != segmented:
                        continue
                    number = lambda k: int(f[k]) if k in f else None
                    told = {"kind": f["WARC-Type"], "page": f["X-Page-Id"], "url": f["WARC-Target-URI"],
                            "digest": f["WARC-Payload-Digest"].removeprefix("sha1:"), "refers": f.get("X-Refers-To-Page"), "length": number("X-Payload-Length")}
                    origin = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
                    rows.append((origin, f["X-Copy"], number("WARC-Segment-Number"), number("WARC-Segment-Total-Length"), *told.values(), block)
                                if segmented else page_of(origin, block, told))
                yield _table(rows, _PARTS if segmented else _PAGES)
    return run


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            segments = r["segments"]
            if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
                raise BrokenArchive(f"segments missing or twice in {r['origin']}")
            block = b"".join(s["block"] for s in segments)
            if r["total"] != len(block):
                raise BrokenArchive(f"wrong total length in {r['origin']}")
            rows.append(page_of(r["origin"], block, r))
        yield _table(rows, _PAGES)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)
    of the archives below ``path``; payload is null for revisits. Only segmented
    records are shuffled, a page's segments to one row. Raises BrokenArchive where
    segments are missing or lengths, framing or digest disagree."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    whole = files.mapInArrow(_read_files(False), _PAGES)
    grouped = files.mapInArrow(_read_files(True), _PARTS).groupBy("origin", "copy").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments"), F.max("total").alias("total"),
        F.lit("response").alias("kind"), *(F.max(c).alias(c) for c in ("page", "url", "digest", "refers", "length")))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(id_type)
    return whole.unionByName(grouped.mapInArrow(_join_segments, _PAGES)).select(
        number("page").alias("page_id"), "url", "payload", "payload_bytes", "payload_digest", "record_type", number("refers").alias("refers_to"))
