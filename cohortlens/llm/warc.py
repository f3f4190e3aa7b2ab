"""WARC archives: writing with segments, and reassembly of segments on reading.

A payload goes into an HTTP response with chunked transfer framing. A block longer than
``segment`` bytes is divided: the first record keeps the type, continuation records name it as
their origin, and the last one states the total length. Archives are ordinary gzip-compressed
WARC files, written through Spark's text writer (the record separator is the line separator), so
any file system that Spark reaches will do.

On reading, every archive is parsed by content lengths. Whole records are decoded where they are
read; segments are grouped by their origin, ordered by number, checked against the total
length, joined, and then decoded. A payload that does not match its digest, a missing segment or
a wrong length is an error.

Among pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id
is a response, the others are revisits that refer to it. Defined results: null html counts as
empty; null page ids are never referred to and their rows are responses unless another page has
the payload; rows equal in page id and payload share a record id and each come back; an empty
table gives an archive without records and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh_path

SEGMENT = 1 << 15  # bytes of a block in one record
CHUNK = 1 << 13  # bytes of a chunk of the transfer framing
RECORDS_PER_FILE = 2_000
FLUSH = 1 << 22  # bytes of payloads or segments in one output batch
END = b"\r\n\r\n"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def framed(payload: bytes) -> bytes:
    parts = [HEAD]
    for at in range(0, len(payload), CHUNK):
        own = payload[at : at + CHUNK]
        parts += [b"%X\r\n" % len(own), own, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def unframed(block: bytes) -> bytes:
    """The payload of an HTTP response with chunked transfer framing."""
    head, found, at = block.partition(END)[0], [], 0
    if b"transfer-encoding: chunked" not in head.lower():
        return block[len(head) + len(END) :]
    at = len(head) + len(END)
    while True:
        line_end = block.index(b"\r\n", at)
        size = int(block[at:line_end].split(b";")[0], 16)
        at = line_end + 2
        if size == 0:
            return b"".join(found)
        if block[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        found.append(block[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the separator behind it."""
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines)).encode() + END + block


def page_records(page: int | None, url: str | None, payload: bytes, first: int | None, segment: int, revisit: bool) -> list[bytes]:
    digest = digest_of(payload)
    # A line break would end the header, so addresses are kept to one line.
    url = None if url is None else " ".join(url.split())
    name = f"<urn:x-page:{page}:{digest}>"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-ID", page)]
    common += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:x-page:{page}:{digest}:again>"), *common]
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{first}:{digest}>"), kind]
        return [record([*fields, ("X-Refers-To-Page", first)], HEAD)]
    block = framed(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, kind]
    if len(block) <= segment:
        return [record(fields, block)]
    out = [record([*fields, ("WARC-Segment-Number", 1)], block[:segment])]
    starts = range(segment, len(block), segment)
    for number, at in enumerate(starts, 2):
        last = ("WARC-Segment-Total-Length", len(block) if at + segment >= len(block) else None)
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{number}>"), ("WARC-Date", DATE)]
        fields += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number), last]
        out.append(record(fields, block[at : at + segment]))
    return out


def _write(segment: int, min_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column("payload")
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "first")), strict=True)
            out, size = [], 0
            for (page, url, first), value in zip(rows, payloads, strict=True):
                payload = value.as_py() or b""
                revisit = first is not None and first != page and len(payload) >= min_bytes
                out += page_records(page, url, payload, first, segment, revisit)
                size += len(payload)
                if size > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write_archives(
    df: DataFrame,
    path: str | None = None,
    segment: int = SEGMENT,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> str:
    """Write one record per page (more for long ones); returns the archives' folder."""
    path = path or fresh_path(df.sparkSession, "warc")
    pages = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    # One row per payload that several pages have; a payload on its own needs no partner.
    firsts = pages.groupBy("digest").agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")
    ).where("n > 1").select(F.col("digest").alias("d"), "first")
    joined = pages.join(firsts, F.col("digest") == F.col("d"), "left")
    records = joined.select("page_id", "url", "payload", "first").mapInArrow(
        _write(segment, min_bytes), "record binary"
    )
    writer = records.select(F.col("record").cast("string")).write.option("lineSep", END.decode())
    writer = writer.option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip")
    writer.text(path)
    return path


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        fields = {k.lower(): v for k, v in fields.items()}
        begin, size = stop + len(END), int(fields["content-length"])
        if data[begin + size : begin + size + len(END)] != END:
            raise ValueError("a record does not end where its length says")
        yield fields, data[begin : begin + size]
        at = begin + size + len(END)


NAMES = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
SCHEMA = (
    "page_id long, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)
SEGMENT_NAMES = ["origin", "number", "total", "page_id", "digest", "block"]
SEGMENT_SCHEMA = (
    "origin string, number long, total long, page_id long, digest string, block binary"
)


def _row(page: int | None, block: bytes, digest: str, keep: bool) -> tuple:
    payload = unframed(block)
    if digest_of(payload) != digest:
        raise ValueError(f"the payload of page {page} does not match its digest")
    return page, payload if keep else None, len(payload), digest, "response", None


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _read(keep: bool) -> Callable:
    """Rows of whole records, and of segments to be joined, in one table."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"{SCHEMA}, part struct<{_as_struct(SEGMENT_SCHEMA)}>"))

    def rows_of(archive: bytes) -> Iterator[tuple[tuple, int]]:
        """Rows and the bytes they hold."""
        for fields, block in parsed(archive):
            page, digest = _number(fields.get("x-page-id")), fields.get("warc-payload-digest", "")[5:]
            kind, number = fields["warc-type"], _number(fields.get("warc-segment-number"))
            if number is not None:
                origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                total = _number(fields.get("warc-segment-total-length"))
                part = dict(zip(SEGMENT_NAMES, (origin, number, total, page, digest, block), strict=True))
                yield (None,) * len(NAMES) + (part,), len(block)
            elif kind == "revisit":
                n, to = int(fields["x-payload-length"]), _number(fields.get("x-refers-to-page"))
                yield (page, None, n, digest, kind, to, None), 0
            else:
                yield (*_row(page, block, digest, keep), None), len(block) if keep else 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                unzip = zlib.decompressobj(31)
                for row, held in rows_of(unzip.decompress(content.as_py()) + unzip.flush()):
                    out.append(row)
                    size += held
                    if size > FLUSH or len(out) >= RECORDS_PER_FILE:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)

    return run


def _as_struct(ddl: str) -> str:
    return ", ".join(": ".join(f.split()) for f in ddl.split(", "))


def reassembled(segments: list[dict]) -> tuple[list[int | None], bytes, str]:
    """Page ids of the copies, block and digest of one origin's segments."""
    held: dict[int, dict] = {}
    for s in segments:
        held.setdefault(s["number"], s)
    numbers = sorted(held)
    block = b"".join(held[k]["block"] for k in numbers)
    if numbers != list(range(1, len(numbers) + 1)) or held[numbers[-1]]["total"] != len(block):
        raise ValueError(f"segments of {segments[0]['origin']} are missing or too short")
    return [s["page_id"] for s in segments if s["number"] == 1], block, held[1]["digest"]


def _join(keep: bool) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segments in batch.column("parts"):
                pages, block, digest = reassembled(segments.as_py())
                rows = [dict(zip(NAMES, _row(p, block, digest, keep), strict=True)) for p in pages]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per page: page_id, (payload,) payload_bytes, payload_digest, record_type, refers_to.

    A revisit has no payload of its own; its length and digest are those its record states.
    """
    schema = f"{SCHEMA}, part struct<{_as_struct(SEGMENT_SCHEMA)}>"
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_read(keep_payload), schema)
    from cohortlens.llm.common import stored

    rows = stored(rows, "records")
    # An origin's segments are one page's own bytes.
    parts = rows.where("part IS NOT NULL").groupBy("part.origin").agg(F.collect_list("part").alias("parts"))
    joined = parts.select("parts").mapInArrow(_join(keep_payload), SCHEMA)
    out = rows.where("part IS NULL").select(NAMES).union(joined)
    return out if keep_payload else out.drop("payload")
