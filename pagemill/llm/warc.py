"""WARC archives: a writer with revisit records and a salvaging reader.

Writer: one gzip member per record, files rolled at ``ROLL`` bytes.  Of pages with equal payloads of at least ``least``
bytes that with the smallest id is a response and the others revisit it; smaller payloads are all responses.

Reader: takes files of gzip members or of plain records (also mixed).  A record counts if its member's checksum, its
version line, header, length, closing lines and digests all hold.  Where one fails, the reader searches on from the
next byte for a member or version line that starts a sound record, reads on from there, and logs the bytes between
as a quarantined gap with the first reason.  Bytes are read in chunks; a record is held whole, a file never.

Defined cases: a null html is an empty payload; a null url leaves the target out; control characters and spaces in a
url are percent-encoded; rows that repeat the smallest id are all responses; a null id refers to nothing and is never
referred to; an empty table writes no file; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import files
from pagemill.llm.scratch import Scratch

ROLL = 32 << 20
CHUNK = 1 << 18
#: What is read of a plain record in search of its header's end; doubled until that is found.
HEADER_READ = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_URN = "urn:page:"
#: Fields whose values may end like a version line.
_FREE = {"warc-target-uri", "warc-refers-to-target-uri", "warc-filename"}


class Record(NamedTuple):
    offset: int
    length: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


class Damaged(Exception):
    pass


# ---- writing


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One record before compression; a ``payload`` of None makes a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    pressed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pressed.compress(data) + pressed.flush()


def _write(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, digest, length, refers = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4, 5))
                html = batch.column(2)[i]
                payload = html.as_buffer().to_pybytes() if html.is_valid else None
                if out is None:
                    out, uri = files.create(folder, f"part-{TaskContext.get().partitionId():06d}-{{}}.warc.gz")
                data = member(record_bytes(page_id, url, payload, digest, length, refers, date))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= ROLL:
                    out.close()
                    done.append({"uri": uri, "bytes": size, "records": records})
                    out, size, records = None, 0, 0
        if out is not None:
            out.close()
            done.append({"uri": uri, "bytes": size, "records": records})
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return write


def write(pages: DataFrame, scratch: Scratch, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``pages(page_id, url, html)`` to archives; returns the manifest (uri, bytes, records) of the tasks that succeeded."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html")).select("*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("bigint").alias("size"))
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    said = rows.join(first, "digest", "left").withColumn("refers", F.when((F.col("size") >= least) & (F.col("page_id") != F.col("first")), F.col("first")))
    payload = F.when(F.col("refers").isNull(), F.col("html"))
    return scratch.write("manifest", said.select("page_id", "url", payload.alias("html"), "digest", "size", "refers").mapInArrow(_write(scratch.path("warc"), date), "uri string, bytes bigint, records bigint"))


# ---- reading


class Bytes:
    """A file read in chunks, with the last few kept."""

    def __init__(self, file):
        self.file, self.size, self.kept = file, file.size(), {}

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if n > CHUNK:
            return bytes(self.file.read_at(n, at))
        parts, first = [], at // CHUNK
        for k in range(first, (at + n - 1) // CHUNK + 1 if n else first):
            if k not in self.kept:
                while len(self.kept) >= 4:
                    self.kept.pop(next(iter(self.kept)))
                self.kept[k] = bytes(self.file.read_at(min(CHUNK, self.size - k * CHUNK), k * CHUNK))
            parts.append(self.kept[k])
        data = b"".join(parts)
        return data[at - first * CHUNK : at - first * CHUNK + n]


def _fields(lines: list[bytes], once: bool = False) -> dict[str, str]:
    """Fields by lower-case name; with ``once`` a second field of a name is damage (two headers run together)."""
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("header line")
        key = name.strip().decode("utf-8", "replace").lower()
        if once and (key not in _FREE and line.endswith((b"WARC/1.0", b"WARC/1.1")) or key in found and key != "warc-concurrent-to"):
            raise Damaged("header run together with another")
        found.setdefault(key, value.strip().decode("utf-8", "replace"))
    return found


def _digest_holds(said: str | None, data: bytes) -> bool:
    kind, _, value = (said or "").partition(":")
    if kind.lower() == "sha256":
        return hashlib.sha256(data).hexdigest() == value.lower()
    if kind.lower() == "sha1" and re.fullmatch("[0-9a-fA-F]{40}", value):
        return hashlib.sha1(data).hexdigest() == value.lower()
    if kind.lower() == "sha1":
        import base64

        return base64.b32encode(hashlib.sha1(data).digest()).decode() == value.upper()
    return True


def _checked(offset: int, length: int, headers: dict[str, str], block: bytes) -> Record:
    if not _digest_holds(headers.get("warc-block-digest"), block):
        raise Damaged("block digest")
    http, payload = {}, block
    if headers.get("content-type", "").lower().startswith("application/http"):
        head, cut, payload = block.partition(b"\r\n\r\n")
        if not cut:
            raise Damaged("HTTP header")
        http = _fields(head.split(b"\r\n")[1:])
    if headers.get("warc-type") != "revisit" and not _digest_holds(headers.get("warc-payload-digest"), payload):
        raise Damaged("payload digest")
    return Record(offset, length, headers, http, payload)


def _header(data: bytes) -> tuple[dict[str, str], int, int]:
    """Fields, where the block starts and its length."""
    if not _VERSION.match(data):
        raise Damaged("version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header")
    headers = _fields(data[:end].split(b"\r\n")[1:], once=True)
    if "warc-type" not in headers or "warc-record-id" not in headers:  # the rest of a header after a value that ends like a version line
        raise Damaged("mandatory field")
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", length):
        raise Damaged("Content-Length")
    return headers, end + 4, int(length)


def _plain(source: Bytes, at: int) -> Record:
    data, wide = source.read(at, HEADER_READ), HEADER_READ
    while _VERSION.match(data) and b"\r\n\r\n" not in data and at + len(data) < source.size:
        _fields(data.split(b"\r\n")[1:-1], once=True)  # damage shows before all of the file is read
        wide *= 2
        data = source.read(at, wide)
    headers, start, length = _header(data)
    if at + start + length + 4 > source.size:
        raise Damaged("truncated record")
    block = source.read(at + start, length + 4)
    if block[length:] != b"\r\n\r\n":
        raise Damaged("record end")
    return _checked(at, start + length + 4, headers, block[:length])


def _member(source: Bytes, at: int) -> Record:
    opened, parts, used, begun = zlib.decompressobj(31), [], at, False
    while not opened.eof:
        data = source.read(used, CHUNK)
        if not data:
            raise Damaged("truncated member")
        try:
            parts.append(opened.decompress(data))
        except zlib.error as e:
            raise Damaged("gzip member") from e
        used += len(data) - len(opened.unused_data)
        if not begun and sum(map(len, parts)) >= 10:
            begun = True
            if not _VERSION.match(b"".join(parts)[:10]):
                raise Damaged("version line")
    data = b"".join(parts)
    headers, start, length = _header(data)
    if len(data) != start + length + 4 or not data.endswith(b"\r\n\r\n"):
        raise Damaged("record end")
    return _checked(at, used - at, headers, data[start : start + length])


_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _candidates(source: Bytes, at: int) -> Iterator[int]:
    while at < source.size:
        data = source.read(at, CHUNK)
        for m in _STARTS.finditer(data):
            yield at + m.start()
        if at + len(data) >= source.size:
            return
        at += len(data) - 9  # a start across two chunks; one found twice is skipped by the caller


def records(source: Bytes) -> Iterator[Record | Gap]:
    """All sound records in order of offset and the gaps between them."""
    at = 0
    while at < source.size:
        try:
            found = _member(source, at) if source.read(at, 2) == b"\x1f\x8b" else _plain(source, at)
        except Damaged as e:
            reason, found, last = str(e), None, at
            for start in _candidates(source, at + 1):
                if start <= last:
                    continue
                last = start
                try:
                    found = _member(source, start) if source.read(start, 2) == b"\x1f\x8b" else _plain(source, start)
                    break
                except Damaged:
                    continue
            yield Gap(at, (found.offset if found else source.size) - at, reason)
            if found is None:
                return
        yield found
        at = found.offset + found.length


SCHEMA = "uri string, offset bigint, length bigint, gap string, record_type string, record_id string, target_uri string, date string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def _read(payloads: bool):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def row(uri: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return (uri, x.offset, x.length, x.reason, *[None] * 8)
        h, revisit = x.headers, x.headers.get("warc-type") == "revisit"
        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(x.payload).hexdigest()
        size = x.http.get("content-length", "") if revisit else str(len(x.payload))
        return (uri, x.offset, x.length, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), int(size) if size.isdigit() else None, digest, x.payload if payloads and not revisit else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input(uri) as file:
                    for x in records(Bytes(file)):
                        rows.append(row(uri, x))
                        held += len(rows[-1][-1] or b"")
                        if len(rows) == 5000 or held > 16 << 20:
                            yield told(rows)
                            rows, held = [], 0
                if rows:
                    yield told(rows)

    return read


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """``archives(uri)`` to one row per record, and per gap (``gap`` holds the reason, the rest of the row is null)."""
    # a task a file: a number given by the caller isn't coalesced, however short the rows are
    return archives.select("uri").repartition(max(1, archives.count())).mapInArrow(_read(payloads), SCHEMA)


def page_number(urn):
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes all pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A gap is an error: every page written must come back.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = write(pages, scratch, least)
    scratch.settle()
    sound = F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("gap in an archive just written: "), "gap", F.lit(" in "), "uri")).cast("boolean"))
    found = read(manifest, payloads=False).where(sound)
    return found.select(page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", page_number(F.col("refers_to"))).alias("refers_to"))
