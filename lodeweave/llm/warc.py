"""WARC archives: a writer with revisit records, and a salvage reader.

Archives go through Spark's own file writer, so its commit protocol covers lost executors and any
file system that Spark reaches will do. Each record is a gzip member of its own. The text writer puts
a separator behind each row; a member's last byte is the top byte of its length and is zero below
16 MB, so the row is the member without it and the separator is that zero byte (a longer record gets
an empty member behind it).

The reader checks each member and record. Where a check fails it looks for the next valid member or
version line, goes on from there, and gives the bytes that it skipped as a quarantined gap. Inside a
member of several records it looks in the decompressed data; what a member gives before the byte that
can't be decompressed is kept. Whatever the damage, headers included, it costs no more than its record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import scratch_path

#: Payloads shorter than this are never revisited.
LEAST_REVISITED = 100
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
#: Bytes decompressed at a time.
_STEP = 1 << 16
#: A version line is no longer than this.
_LINE = 32
#: A record's block is no longer than what a binary column holds.
_MOST = (1 << 31) - 1
_LENGTH = re.compile(r"[0-9]{1,10}")
_NUMBER = re.compile(r"-?[0-9]{1,19}")
#: Bytes of members in one row of the text writer (or else one larger member), and of an archive (or else one row).
_ROW, _ARCHIVE = 1 << 20, 64 << 20


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record, uncompressed; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        headers.insert(3, f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    if page_id is not None:
        headers.append(f"X-Page-Id: {page_id}")
    if revisit:
        headers.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        headers.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member; its last byte is zero."""
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = coder.compress(data) + coder.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page with its payload's digest and size and, for a revisit, the page it refers to.

    The smallest id of each repeated digest is found with partial sums, so a digest that a third of
    all pages share is a row for each task; the join that brings it back can be split by AQE.
    Pages that share the smallest id are all responses; null ids revisit, unless all are null.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("link"), payload.alias("html"), F.octet_length(payload).cast("long").alias("n"), F.sha2(payload, 256).alias("digest"))
    first = base.where(F.col("n") >= LEAST_REVISITED).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = base.join(first, "digest", "left")
    refers = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    # a revisit's payload isn't written
    return joined.select("page", "link", "digest", "n", refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html"))


def write(pages: DataFrame, path: str, archive_bytes: int = _ARCHIVE, **columns: str) -> None:
    """Write one record for each row of ``pages`` to gzipped archives below ``path``.

    No archive is larger than ``archive_bytes``, unless a single row of the writer is: about 1 MB of members,
    or one record beyond that. For this bound the largest payload is looked up before the pages are written.
    Null html is an empty payload; a null url has no target URI; an empty table gives no records.
    Other columns are ignored.
    """
    planned = plan_records(pages, **columns)
    html = F.col(columns.get("html_col", "html"))
    largest = pages.agg(F.max(F.octet_length(html))).first()[0] or 0
    target = min(_ROW, archive_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for r in batch.slice(at, 500).to_pylist():
                    one = member(record(r["page"], r["link"], (r["html"] or "").encode("utf-8"), r["digest"], r["n"], r["refers_to"], r["refers_to"] is not None))
                    if held and size + len(one) > target:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                        held, size = [], 0
                    held.append(one)
                    size += len(one)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    # deflate never adds more than a few bytes a block to what can't be compressed; 64 KB leave room for headers and long URLs
    rows = max(1, archive_bytes // max(target, largest + largest // 1000 + (1 << 16)))
    # the cast keeps the bytes as they are; the separator is each row's last byte
    planned.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", rows).text(path)


class _Bad(Exception):
    pass


def _parse(data: bytes | bytearray, at: int) -> tuple[dict, bytes, int] | None:
    """The record at ``at`` and where it ends; None if ``data`` ends first."""
    end = data.find(b"\r\n\r\n", at)
    if not (_VERSION.match(data, at) or b"WARC/1.1\r\n".startswith(data[at : at + 10])):
        raise _Bad("no version line")
    if end < 0:
        if len(data) - at > 1 << 20:
            raise _Bad("no end of the header")
        return None
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("a header line without a colon")
        headers[key.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not _LENGTH.fullmatch(length) or int(length) > _MOST:
        raise _Bad("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if len(data) < stop + 4:
        return None
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise _Bad("the record doesn't end where its length says")
    block = bytes(data[start:stop])
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        raise _Bad("block digest")
    return headers, block, stop + 4


class _Starts:
    """Where members and version lines stand in an archive; what has been searched isn't searched again."""

    def __init__(self, data: bytes):
        self.data, self.line, self.magic = data, -1, -1

    def after(self, at: int) -> int:
        """Where the next member that begins a record, or the next version line, stands; the end if none does."""
        data = self.data
        if self.line < at:
            line = _VERSION.search(data, at)
            self.line = line.start() if line else len(data)
        if self.magic < at:
            self.magic = self._member(at)
        return min(self.line, self.magic)

    def _member(self, at: int) -> int:
        data = self.data
        magic = data.find(_MAGIC, at)
        while 0 <= magic < self.line:
            try:
                if zlib.decompressobj(31).decompress(data[magic : magic + 4096], 16).startswith(b"WARC/"):
                    return magic
            except zlib.error:
                pass
            magic = data.find(_MAGIC, magic + 1)
        return max(at, self.line)  # none before the line; later ones are looked for from there


class Found(NamedTuple):
    """A record, or with a fault and no headers a gap: bytes of the archive, and in a member bytes of its data."""

    offset: int
    length: int
    inner: int | None
    span: int | None
    fault: str | None
    headers: dict | None
    block: bytes | None


def _good(data: bytes, at: int, until: int, had: int) -> tuple[bytes, int]:
    """What the damaged member at ``at`` gives beyond its first ``had`` bytes, and where in data[at:until] it can't be decompressed."""
    coder, pos, out, seen = zlib.decompressobj(31), at, bytearray(), 0
    for step in (1 << 12, 1):
        while pos < until:
            before = coder.copy()
            try:
                piece = coder.decompress(data[pos : min(until, pos + step)])
            except zlib.error:
                coder = before
                break
            pos = min(until, pos + step)
            out += piece[max(0, had - seen) :]
            seen += len(piece)
    return bytes(out), pos


def _member(data: bytes, at: int, starts: _Starts) -> tuple[list[tuple[int, int, str | None, dict | None, bytes | None]], int, int]:
    """(inner, span, fault, headers, block) of what the member at ``at`` holds, how far it is good, and where what follows begins.

    Behind a bad record the next version line of the decompressed data is looked for. A damaged member
    gives what can be decompressed and ends where the next one begins.
    """
    coder, pos, rest, out = zlib.decompressobj(31), at, bytearray(), []
    past, broken, lost = 0, None, None  # decompressed bytes before ``rest``; the member's fault; the open gap's fault and begin

    while not (broken or coder.eof):
        piece = coder.unconsumed_tail or data[pos : pos + _STEP]
        if not coder.unconsumed_tail:
            pos += len(piece)
        try:
            if piece:
                rest += coder.decompress(piece, 1 << 22)
            else:
                broken = "the member is cut off"
        except zlib.error as e:
            broken = str(e)
            more, pos = _good(data, at, pos, past + len(rest))
            rest += more
        last, done = bool(broken or coder.eof), 0
        while done < len(rest):
            got, fault = None, broken or "the record is cut off"
            try:
                got = _parse(rest, done)
                if got is None and not last:
                    break
            except _Bad as e:
                fault = str(e)
            if got is not None:
                if lost:
                    out.append((lost[1], past + done - lost[1], lost[0], None, None))
                    lost = None
                out.append((past + done, got[2] - done, None, *got[:2]))
                done = got[2]
                continue
            lost = lost or (fault, past + done)
            line = _VERSION.search(rest, done + 1)
            if line is None and not last:
                done = max(done, len(rest) - _LINE)
                break
            done = line.start() if line else len(rest)
        del rest[:done]
        past += done
    if lost and past > lost[1]:
        out.append((lost[1], past - lost[1], lost[0] if not broken or lost[0] == broken else f"{lost[0]}; {broken}", None, None))
    if not broken:
        end = pos - len(coder.unused_data)
        return out, end, end
    end = starts.after(at + 1)
    return out + [(past, 0, broken, None, None)] * (not lost), min(pos, end), end


def salvage(data: bytes) -> Iterator[Found]:
    """The records of an archive, and the gaps between them.

    Records of one member share its offset and length, as do the gaps between them; ``inner`` and ``span`` say
    which bytes of its decompressed data they are. The bytes of a damaged member behind the one that can't be
    decompressed are a gap of the archive. Gaps and members together cover the archive.
    """
    at, n, starts = 0, len(data), _Starts(data)
    while at < n:
        if data.startswith(_MAGIC, at):
            found, good, end = _member(data, at, starts)
            if end > good and (good == at or not any(headers for *_, headers, _ in found)):
                yield Found(at, end - at, None, None, found[-1][2], None, None)
            else:
                for x in found:
                    if x[1] or end == good:
                        yield Found(at, good - at, *x)
                if end > good:
                    yield Found(good, end - good, None, None, found[-1][2], None, None)
            at = end
            continue
        try:
            got = _parse(data, at)
            if got is None:
                fault = "the record is cut off"
            else:
                yield Found(at, got[2] - at, None, None, None, got[0], got[1])
                at = got[2]
                continue
        except _Bad as e:
            fault = str(e)
        end = starts.after(at + 1)
        yield Found(at, end - at, None, None, fault, None, None)
        at = end


RECORDS = (
    "file string, offset bigint, length bigint, inner bigint, span bigint, fault string, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, payload binary"
)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records and quarantined gaps (``fault`` set, no record type) of the archives below ``path``.

    ``offset`` and ``length`` are bytes of the archive, ``inner`` and ``span`` of the decompressed data of a
    compressed member. A record whose payload digest or page number is damaged has a ``fault`` and is given all
    the same. An archive is read whole by one task, so its bytes should be bounded, as ``write`` does.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                for x in salvage(batch.column(1)[i].as_py()):
                    row = {"file": name, "offset": x.offset, "length": x.length, "inner": x.inner, "span": x.span, "fault": x.fault}
                    if x.headers is not None:
                        row |= _fields(x.headers, x.block, with_payload)
                        held += len(row.get("payload") or b"")
                    rows.append(row)
                    if len(rows) == 1000 or held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, RECORDS)


def _number(text: str | None, faults: list[str], what: str) -> int | None:
    """The 64-bit number that a header holds; a damaged one is a fault."""
    if text is None:
        return None
    if _NUMBER.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    faults.append(what)
    return None


def _fields(headers: dict, block: bytes, with_payload: bool) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = headers.get("warc-type")
    size, digest, faults = len(payload), hashlib.sha256(payload).hexdigest(), []
    said = headers.get("warc-payload-digest", "").partition(":")[2].lower()
    if kind == "revisit":  # the payload is elsewhere; its length is in the HTTP header
        length = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", head)
        size, digest = int(length[1]) if length else None, said or None
    elif said and said != digest:
        faults.append("payload digest")
    page, refers = (_number(headers.get(x), faults, x) for x in ("x-page-id", "x-refers-to-page-id"))
    return {
        "page_id": page, "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": refers,
        "payload_bytes": size, "payload_digest": digest, "payload": payload if with_payload and kind != "revisit" else None, "fault": "; ".join(faults) or None,
    }


_SCHEMA = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner", pa.int64()), ("span", pa.int64()), ("fault", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string())]
    + [("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = read(spark, path, with_payload=False)
    return found.where("record_type is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT p.page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN g.first IS NULL OR g.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
