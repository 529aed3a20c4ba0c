"""WARC archives of pages: writing with segments and revisits, reading with reassembly.

Archives are the files of a Spark text writer whose line separator is the empty line pair that ends a record.
Blocks are cut into segments between characters, so every record is text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .common import attach, if_small, stored

#: Fixed values of the format.
VERSION = "WARC/1.1"
GAP = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

#: Bytes of a record's block and of a chunk at most; records of a file at most, which bounds a file.
SEGMENT_BYTES = 65_536
CHUNK_BYTES = 16_384
FILE_RECORDS = 1024
DATE = "2000-01-01T00:00:00Z"
NO_ID = (1 << 63) - 1

SEGMENTS = "origin string, number int, total bigint, kind string, target string, refers_to string, digest string, block binary"
RECORDS = (
    "record_id string, page_id bigint, record_type string, url string, refers_to bigint, payload_digest string, "
    "payload binary, complete boolean"
)


# ---------------------------------------------------------------- bytes


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing, cut between characters."""
    return b"".join([b"%x\r\n%s\r\n" % (len(part), part) for part in _cut(payload, size)]) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """What chunked transfer framing holds; ValueError if it is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        parts.append(body[at:at + size])
        at += size + 2


def _cut(data: bytes, size: int) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> str:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n{block.decode()}"


def page_records(
    page: str, url: str, payload: bytes, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES
) -> Iterator[str]:
    """The records of one page: a response in as many segments as it takes, or a revisit."""
    digest = sha1_base32(payload)
    target = quote(url, safe="".join(map(chr, range(33, 127))))
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", target or "about:blank")]
    named = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        yield _record([
            ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{page}>"), ("WARC-Refers-To", f"<{refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *shared, *named,
        ], HTTP.replace(b"Transfer-Encoding: chunked\r\n", b""))
        return
    block = HTTP + chunked(payload)
    parts = list(_cut(block, segment_bytes))
    for number, part in enumerate(parts, 1):
        first = number == 1
        fields = [
            ("WARC-Type", "response" if first else "continuation"),
            ("WARC-Record-ID", f"<{page}>" if first else f"<{page}:{number}>"), *shared,
        ]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", str(number)))
        if not first:
            fields.append(("WARC-Segment-Origin-ID", f"<{page}>"))
        if number == len(parts) > 1:
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(fields + (named if first else []), part)


def inflated(data: bytes) -> bytes:
    """An archive's bytes, whether plain or any number of gzip members; ValueError if the last one is cut."""
    parts, at = [], 0
    view = memoryview(data)
    while data[at:at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut")
            parts.append(member.decompress(view[at:at + 65_536]))
            at = min(at + 65_536, len(data)) - len(member.unused_data)
    return b"".join([*parts, data[at:].lstrip(b"\0")]) if parts else data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of an archive.

    Empty lines before a record are passed over; header bytes that are not UTF-8 become U+FFFD.
    """
    at = 0
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        if at == len(data):
            return
        end = data.index(GAP, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
        start = end + len(GAP)
        stop = start + int(fields["content-length"])
        if data[stop:stop + len(GAP)] != GAP:
            raise ValueError("a record does not end where its length says")
        yield fields, data[start:stop]
        at = stop + len(GAP)


def _inner(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _page_of(record_id: str | None) -> int | None:
    found = re.match(r"urn:page:(-?\d+):", record_id or "")
    return int(found[1]) if found else None


# ---------------------------------------------------------------- writing


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with the name of each row's record and, for revisits, of the response it refers to.

    Of rows whose payloads are equal and have at least ``least_bytes`` the one with the smallest ``page_id`` is the
    response. Rows without an id come last. Of rows that repeat id and payload one is the first, the others revisit
    the same response as it does, or it.
    """
    pages = pages.select("page_id", "url", "html")
    html = F.coalesce(F.col("html"), F.lit(""))
    key = F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID))
    facts = stored(pages.select(key.alias("page"), F.sha1(html).alias("sha"), F.octet_length(html).alias("n")), "facts")
    again = stored(facts.groupBy("page", "sha").count().filter("count > 1").select("page", "sha"), "again")
    groups = facts.filter(F.col("n") >= least_bytes).groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("size"))
    groups = stored(groups.filter("size > 1"), "groups")
    members = attach(facts, groups, "sha", "size", facts.count())
    revisits = stored(members.filter("page <> first").select("page", "sha", "first").distinct(), "revisits")
    rows = pages.withColumns({"page": key, "sha": F.sha1(html)})
    rows = rows.join(if_small(revisits), ["page", "sha"], "left")
    if again.count():
        again = if_small(again)
        order = Window.partitionBy("page", "sha").orderBy("url")
        repeated = rows.join(again, ["page", "sha"], "left_semi").withColumn("turn", F.row_number().over(order))
        rows = rows.join(again, ["page", "sha"], "left_anti").withColumn("turn", F.lit(1)).unionByName(repeated)
    else:
        rows = rows.withColumn("turn", F.lit(1))
    name = lambda page, turn: F.concat(F.lit("urn:page:"), page.cast("string"), F.lit(":"), F.col("sha"), F.lit(":"), turn.cast("string"))
    own_first = F.when((F.col("turn") > 1) & (F.octet_length(html) >= least_bytes), F.col("page"))
    refers = F.coalesce(F.col("first"), own_first)
    return rows.select(
        name(F.col("page"), F.col("turn")).alias("record"), F.coalesce(F.col("url"), F.lit("")).alias("url"),
        html.cast("binary").alias("payload"),
        F.when(refers.isNotNull(), name(refers, F.lit(1))).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS
) -> None:
    """Write a record per row of ``pages`` (``page_id, url, html``) as gzipped archives under ``path``. NULL html is an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in whole.slice(at, 256).columns))
                records = [r for page, url, payload, to in rows for r in page_records(page, url, payload, to, segment_bytes)]
                yield pa.record_batch([pa.array(records, pa.string())], ["value"])

    plan_records(pages, least_bytes).mapInArrow(run, "value string").write.option("lineSep", GAP.decode()).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", file_records).text(path)


# ---------------------------------------------------------------- reading


def _decoded(kind: str, block: bytes) -> tuple[bytes | None, bool]:
    if kind != "response":
        return None, True
    head, gap, body = block.partition(GAP)
    try:
        return (dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body), bool(gap)
    except ValueError:
        return None, False


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _finish(origin, kind, target, refers_to, digest, block, whole) -> tuple:
    payload, fine = _decoded(kind, block) if whole else (None, False)
    if payload is not None and digest != sha1_base32(payload):
        fine = False
    known = lambda page: None if page == NO_ID else page
    return (origin, known(_page_of(origin)), kind, target, known(_page_of(refers_to)), digest, payload, fine)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of the archives under ``path`` (``RECORDS``).

    Segments are grouped by origin, ordered by number and joined if they are all there and as long together as the last
    one says; then the transfer framing is undone. Where segments lack, lengths or digests differ or framing is
    broken, ``complete`` is false; a payload that cannot be had is NULL.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def segments(alone: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    data = inflated(content.as_py())
                    rows, size = [], 0
                    for fields, block in parse(data):
                        if ("warc-segment-number" not in fields) != alone:
                            continue
                        origin = _inner(fields.get("warc-segment-origin-id") or fields["warc-record-id"])
                        kind, target = fields["warc-type"], fields.get("warc-target-uri")
                        refers_to = _inner(fields.get("warc-refers-to"))
                        digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                        if alone:
                            rows.append(_finish(origin, kind, target, refers_to, digest, block, True))
                        else:
                            total = fields.get("warc-segment-total-length")
                            rows.append((
                                origin, int(fields["warc-segment-number"]), total and int(total), kind, target, refers_to, digest, block,
                            ))
                        size += len(block)
                        if size > 4_000_000:
                            yield out(rows)
                            rows, size = [], 0
                    yield out(rows)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            if alone:
                return _batch(rows)
            names = [f.split()[0] for f in SEGMENTS.split(", ")]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        return run

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def finish() -> tuple:
            numbers, blocks, total = [r[1] for r in held], b"".join([r[7] for r in held]), held[-1][2]
            whole = numbers == list(range(1, len(held) + 1)) and total == len(blocks)
            origin, _, _, kind, target, refers_to, digest, _ = held[0]
            return _finish(origin, kind, target, refers_to, digest, blocks, whole)

        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    done.append(finish())
                    held.clear()
                held.append(row)
            yield _batch(done)
        if held:
            yield _batch([finish()])

    parts = files.mapInArrow(segments(False), SEGMENTS).repartition("origin").sortWithinPartitions("origin", "number")
    return files.mapInArrow(segments(True), RECORDS).unionByName(parts.mapInArrow(joined, RECORDS))


def archive_report(pages: DataFrame, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the pages, read them back, and name per page what its record is.

    Columns: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A revisit's bytes and digest are
    those of the response it refers to. A record that does not come back whole raises an error.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, least_bytes, segment_bytes)
    kept = stored(read_archives(spark, path).select(
        "record_id", "page_id", "record_type", "refers_to", "payload_digest",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.col("complete"), True).otherwise(F.raise_error(F.concat(F.lit("broken record "), "record_id"))).alias("complete"),
    ), "records")
    responses = kept.filter("record_type = 'response'")
    revisits = kept.filter("record_type = 'revisit'")
    sizes = revisits.groupBy("payload_digest").agg(F.count("*").alias("size"))
    # equal payloads have one response
    targets = responses.select("payload_digest", "payload_bytes").dropDuplicates(["payload_digest"]).join(sizes, "payload_digest")
    found = attach(revisits.drop("payload_bytes"), stored(targets, "targets"), "payload_digest", "size", revisits.count())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(found.select(*columns))
