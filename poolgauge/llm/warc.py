"""WARC archives: writing with segmented records and chunked framing, reading by segment reassembly.

Writing. A page becomes a ``response`` record whose block is an HTTP head and
the payload in chunked transfer framing, or a ``revisit`` of the page with the
smallest page_id among equal payloads. A block longer than ``segment_bytes``
is cut: the first segment is the record itself (segment number 1), the others
are ``continuation`` records that name it as their origin, and the last of
them gives the total length. Records are gzip members; a task closes an
archive at ``archive_bytes``, and may do so between two segments.

Reading. Archives are read one per row and cut into records. A record that is
whole is decoded where it is read; segments are grouped by origin, put in
order of their numbers, checked against the total length and decoded. Decoding
undoes the chunked framing and checks the payload against the record's digest.

Scale: the smallest page_id of every payload digest is found on (digest,
length, page_id) rows, pre-aggregated and checkpointed; the html is shuffled
once, to meet it, in a join whose hot digests adaptive execution splits.
Segments of one origin and stored copy are all that is ever grouped, and they
make one page, also where a third of all rows repeat a page.

Defined cases: null html is an empty payload; payloads under ``min_bytes`` are
always responses; rows that repeat page_id and payload are all responses if
they are the smallest, and each comes back; a page without page_id revisits one
that has one, and is a response if none has; null urls are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolgauge.llm.common import cut, fresh_folder
from poolgauge.llm.files import write_whole
from poolgauge.shipping import ship_code

SEGMENT_BYTES = 16 << 10
ARCHIVE_BYTES = 16 << 20
CHUNK_BYTES = 4 << 10
MIN_BYTES = 0
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = [b"%x\r\n%s\r\n" % (len(part), part) for part in (payload[a : a + size] for a in range(0, len(payload), size))]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked framing; extensions of a chunk's size and trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        out.append(framed[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment_bytes: int, copy: str = "0") -> Iterator[bytes]:
    """The records of one page; ``first`` is the page that it revisits, or itself.

    ``copy`` names this stored copy of the page: segments of two rows with the
    same page_id and payload are told apart by it.
    """
    plain = [("WARC-Date", "2024-01-01T00:00:00Z"), *([("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))] if url else []), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    name = _urn(page_id, digest)
    if first is not None and first != page_id:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *plain, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(first, digest)), ("Content-Type", "application/http; msgtype=response")]
        yield record(fields, _HEAD + b"\r\n")
        return
    block = _HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), *plain, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield record(fields, block)
        return
    yield record([*fields, ("WARC-Segment-Number", "1"), ("X-Stored-Copy", copy)], block[:segment_bytes])
    for k, a in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if a + segment_bytes >= len(block) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)), ("X-Stored-Copy", copy), *last], block[a : a + segment_bytes])


def with_first(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload (UTF-8), digest (hex) and ``first``: the smallest page_id with the same payload."""
    payload: Column = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keyed = rows.select("page_id", "digest").where(F.octet_length("payload") >= min_bytes)
    firsts = cut(keyed.groupBy("digest").agg(F.min("page_id").alias("first")))
    own = rows.withColumn("big", F.octet_length("payload") >= min_bytes)
    met = own.join(firsts, "digest", "left")
    return met.select("page_id", "url", "payload", "digest", F.when(F.col("big"), F.col("first")).otherwise(F.col("page_id")).alias("first"))


def write(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; a checkpointed manifest: path, n_records, bytes."""
    ship_code(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, rows = TaskContext.get().partitionId(), [], 0
        held, n = [], 0

        def close() -> None:
            nonlocal held, n
            uri = f"{folder}/part-{part:06d}-{len(done):05d}.warc.gz"
            data = b"".join(held)
            write_whole(uri, data)
            done.append({"path": uri, "n_records": len(held), "bytes": len(data)})
            held, n = [], 0

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                rows += 1
                for r in page_records(page_id, url, payload, name, first, segment_bytes, f"{part}-{rows}"):
                    held.append(r)
                    n += len(r)
                    if n >= archive_bytes:
                        close()
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64())]))

    return cut(with_first(pages, min_bytes).mapInArrow(run, "path string, n_records long, bytes long"))


def members(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of an archive of gzip members; names of fields in lower case."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, parts, fed = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if fed >= len(data):
                raise ValueError("an archive ends within a record")
            parts.append(unpack.decompress(view[fed : fed + 65_536]))
            fed += 65_536
        at = min(fed, len(data)) - len(unpack.unused_data)
        yield _record_of(b"".join(parts))


def _record_of(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a record is shorter than it says")
    return fields, rest[:size]


def _page_of(urn: str) -> int | None:
    page = urn.split(":")[2]
    return int(page) if page else None


def decoded(fields: dict[str, str], block: bytes) -> dict:
    """A row of a whole record."""
    head, _, body = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].partition(":")[2]
    row = {"page_id": _page_of(fields["warc-record-id"]), "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": None, "payload_bytes": int(fields["x-payload-length"]), "payload": None}
    if fields["warc-type"] == "revisit":
        return row | {"refers_to": _page_of(fields["warc-refers-to"])}
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if base32_sha1(payload) != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its digest says")
    return row | {"payload_bytes": len(payload), "payload": payload}


_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ROW_ARROW = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def read(spark: SparkSession, folder: str, html: bool = False) -> DataFrame:
    """One row per page of the archives in ``folder``; ``html`` adds the payload of responses as text."""
    ship_code(spark)
    schema = _ROW + (", html string" if html else "")
    out_arrow = pa.schema([*_ROW_ARROW, *([("html", pa.string())] if html else [])])
    segment_arrow = pa.schema([("origin", pa.string()), ("copy", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("fields", pa.string()), ("block", pa.binary())])

    def finished(row: dict) -> dict:
        payload = row.pop("payload")
        return row | ({"html": None if payload is None else payload.decode("utf-8")} if html else {})

    def segment(fields: dict[str, str], block: bytes) -> dict:
        first, total = fields["warc-type"] != "continuation", fields.get("warc-segment-total-length")
        return {"origin": fields["warc-record-id" if first else "warc-segment-origin-id"], "copy": fields.get("x-stored-copy", ""), "number": int(fields["warc-segment-number"]), "total": None if total is None else int(total), "fields": "\n".join(f"{k}:{v}" for k, v in fields.items()) if first else None, "block": block}

    def cutter(parts: bool):
        """Rows of whole records, or of segments: archives are inflated for either rather than kept between."""
        arrow, row = (segment_arrow, segment) if parts else (out_arrow, lambda f, b: finished(decoded(f, b)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    rows, size = [], 0
                    for fields, block in members(content.as_buffer().to_pybytes()):
                        if ("warc-segment-number" in fields) == parts:
                            rows.append(row(fields, block))
                            size += len(block)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        return run

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for segments in batch.column(0):
                rows += [finished(r) for r in reassembled(segments.as_py())]
            yield pa.RecordBatch.from_pylist(rows, schema=out_arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    whole = files.mapInArrow(cutter(False), schema)
    parts = files.mapInArrow(cutter(True), "origin string, copy string, number int, total long, fields string, block binary")
    segments = parts.groupBy("origin", "copy").agg(F.collect_list(F.struct("number", "total", "fields", "block")).alias("segments"))
    return whole.unionByName(segments.select("segments").mapInArrow(join, schema))


def reassembled(segments: list[dict]) -> list[dict]:
    """Rows of the pages that the segments of one origin make: more than one only if an archive stores a page again without naming its copies."""
    copies = sum(s["number"] == 1 for s in segments)
    by_number = {s["number"]: s for s in segments}
    if sorted(by_number) != list(range(1, len(by_number) + 1)) or len(segments) != copies * len(by_number):
        raise ValueError("segments of a record are missing")
    block = b"".join(by_number[k]["block"] for k in sorted(by_number))
    if by_number[len(by_number)]["total"] != len(block):
        raise ValueError("segments do not add up to the record's length")
    fields = dict(x.split(":", 1) for x in by_number[1]["fields"].split("\n"))
    return [dict(decoded(fields, block)) for _ in range(copies)]


def digest(spark: SparkSession, pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write all pages to a fresh shared folder and describe what its archives hold."""
    folder = fresh_folder(spark, f"warc-{uuid.uuid4().hex[:6]}")
    if write(pages, folder, segment_bytes).isEmpty():
        return spark.createDataFrame([], _ROW)
    return read(spark, folder)
