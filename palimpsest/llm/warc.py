"""WARC archives: a writer, and a reader that salvages damaged files.

The writer gives one record per page. Of pages with equal payloads the one with the smallest id is a
``response``, the others are ``revisit`` records that refer to it. Archives are plain files of the text
sink (UTF-8, records ended by two line ends), so Spark's commit protocol guards them on any file system.

The reader takes each file's bytes, plain or as gzip members, and checks every record: version line,
headers, length, the two line ends after it, and the payload's digest. After a failed check it searches
for the next member or version line that starts a valid record, goes on from there, and reports the
bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialise

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of an archive at most, so that a reader can hold one, unless one record is larger; records beyond
#: ``LARGE`` bytes have archives of their own.
ARCHIVE = 1 << 28
LARGE = 1 << 20
#: Records in an archive at most.
RECORDS = 20_000
#: Bytes that a gzip member may inflate to; a larger one is quarantined.
MEMBER = 1 << 30
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
ENDS = b"\r\n\r\n"
#: Bytes of a record's headers at most, but for its address.
HEADERS = 1024


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes."""
    digest = F.sha1(payload)
    parts = []
    for k in range(0, 40, 10):  # 10 hex digits are 8 base32 digits
        n = F.conv(F.substring(digest, k + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(ALPHABET), (F.shiftright(n, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def _clean(c: Column) -> Column:
    """A header value without line ends."""
    return F.regexp_replace(c, r"[\r\n]+", " ")


def records(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2020-01-01T00:00:00Z", least: int = 0) -> DataFrame:
    """The columns ``value``, the text of one record per row of ``df`` without its closing line ends, and
    ``large``.

    Payloads of fewer than ``least`` bytes always make a response. A null html is an empty payload; a
    null url gives no target; a row without id is named ``-`` and is a revisit if its payload has a row
    with id. Rows that repeat the smallest id with its payload are all responses.
    """
    page = F.coalesce(F.col(f"`{page_id}`").cast("string"), F.lit("-"))
    rows = df.select(F.col(f"`{page_id}`").cast("long").alias("id"), page.alias("page"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("same", F.sha2("payload", 256))
    groups = rows.where(F.col("bytes") >= least).groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("same", "first")
    rows = rows.join(materialise(groups, "payloads"), "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(ENDS.decode()))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:x-page:"), F.col("page"), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), _clean(F.col("url")))).otherwise(""),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:x-page:"), F.col("first"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(ENDS.decode()),
    )
    return rows.select(F.concat(head, block).alias("value"), (F.col("bytes") > LARGE).alias("large"))


def write(df: DataFrame, path: str, compression: str | None = None, **names) -> None:
    """Writes the records of ``df`` as archives into the folder ``path``.

    ``compression="gzip"`` makes each file one gzip member. No rows give an empty folder. Archives are
    bounded by bytes: the largest record says how many go into one, for large and other records apart.
    """
    rows = records(df, **names)
    html = F.octet_length(F.coalesce(F.col(f"`{names.get('html', 'html')}`"), F.lit("")))
    large = html > LARGE
    sizes = df.select(html.alias("n"), large.alias("large"), F.octet_length(F.coalesce(F.col(f"`{names.get('url', 'url')}`").cast("string"), F.lit(""))).alias("url"))
    most = {r["large"]: r["most"] for r in sizes.groupBy("large").agg(F.max(F.col("n") + F.col("url")).alias("most")).collect()}
    for k, kind in enumerate(sorted(most) or [False]):
        per_file = max(1, min(RECORDS, ARCHIVE // (most.get(kind, 0) + HEADERS)))
        part = rows if len(most) < 2 else rows.where(F.col("large") == kind)
        sink = part.select("value").write.mode("append" if k else "errorifexists").option("lineSep", ENDS.decode()).option("maxRecordsPerFile", per_file)
        (sink.option("compression", compression) if compression else sink).text(path)


class Record(NamedTuple):
    """A record, or a quarantined gap (``reason`` is set)."""

    offset: int
    length: int
    reason: str | None
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


class Damaged(ValueError):
    """What a check found; ``end`` is where the record ends if its frame is whole."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in raw.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Damaged("bad header line")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _check_digest(headers: dict[str, str], payload: bytes, end: int) -> None:
    kind, _, want = headers.get("warc-payload-digest", "").partition(":")
    if kind.lower() == "sha1" and headers.get("warc-type") != "revisit" and want != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise Damaged("payload digest differs", end)


def parse(data: bytes, at: int) -> Record:
    """The plain record at ``at``; raises ``Damaged``."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    stop = data.find(ENDS, version.end())
    if stop < 0:
        raise Damaged("headers do not end")
    headers = _headers(data[version.end() : stop])
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    start = stop + len(ENDS)
    end = start + int(length)
    whole = data[end : end + 4] == ENDS
    if missing := [h for h in ("warc-type", "warc-record-id") if not headers.get(h)]:
        raise Damaged(f"no {missing[0]}", end + 4 if whole else None)
    if not whole:
        raise Damaged("the record does not end where its length says")
    block = data[start:end]
    http: dict[str, str] = {}
    if headers.get("content-type", "").startswith("application/http"):
        top, found, block = block.partition(ENDS)
        if not found:
            raise Damaged("no end of HTTP headers", end + 4)
        http = _headers(top.partition(b"\r\n")[2]) if b"\r\n" in top else {}
    _check_digest(headers, block, end + 4)
    return Record(at, end + 4 - at, None, headers, http, block)


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and where it ends."""
    unzip = zlib.decompressobj(31)
    try:
        content = unzip.decompress(memoryview(data)[at:], MEMBER)
    except zlib.error as e:
        raise Damaged(f"bad gzip member: {e}") from e
    if unzip.unconsumed_tail:
        raise Damaged(f"the gzip member holds more than {MEMBER} bytes")
    if not unzip.eof:
        raise Damaged("the gzip member does not end")
    return content, len(data) - len(unzip.unused_data)


def _unit(data: bytes, at: int) -> tuple[list[Record], int]:
    """The record, or all records of the gzip member, at ``at`` and where it ends."""
    if data[at : at + 3] != b"\x1f\x8b\x08":
        record = parse(data, at)
        return [record], at + record.length
    content, end = _member(data, at)
    inner = list(salvage(content))
    if not any(r.reason is None for r in inner):
        raise Damaged(f"gzip member without a valid record: {inner[0].reason if inner else 'empty'}", end)
    # offsets of records within a member are its own; so is the length of all but gaps
    return [r._replace(offset=at, length=end - at) for r in inner], end


def salvage(data: bytes) -> Iterator[Record]:
    """All valid records of an archive's bytes and, between them, the gaps, in order."""
    at, n = 0, len(data)
    while at < n:
        try:
            found, end = _unit(data, at)
            yield from found
            at = end
            continue
        except Damaged as e:
            reason, end = str(e), e.end
        gap, seek = at, end if end is not None else at + 1
        while True:
            if end is not None and (end == n or START.match(data, end)):
                at = end  # the frame is whole, and what follows it looks like a record
                break
            end = None
            start = START.search(data, seek)
            if not start:
                at = n
                break
            try:
                _unit(data, start.start())
                at = start.start()
                break
            except Damaged as e:
                if e.end is not None:
                    at = start.start()  # its own fault is reported as a gap of its own
                    break
                seek = start.start() + 1
        yield Record(gap, at - gap, reason, {}, {}, b"")


SCHEMA = "file string, offset long, length long, gap string, record_type string, record_id string, refers_to string, target string, payload_digest string, payload_bytes long, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (``gap`` holds the reason) of all archives under ``path``.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload: counted for responses, and
    as the record states for revisits. Each file is read whole by one task; the writer bounds files. An
    empty file has no records; a folder without files gives an empty table.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for r in salvage(data.as_py()):
                h = r.headers
                revisit = h.get("warc-type") == "revisit"
                size = int(r.http.get("content-length") or 0) if revisit else len(r.payload)
                digest = h.get("warc-payload-digest", "").rpartition(":")[2] if revisit else base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
                gap = r.reason is not None
                rows.append((name, r.offset, r.length, r.reason, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), None if gap else digest, None if gap else size, r.payload if payloads and not gap else None))
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return arrow_map(files, run, SCHEMA)


def page_of(record_id: Column) -> Column:
    """The page id in a record id of this writer; null for rows without one."""
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
