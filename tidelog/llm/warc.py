"""Write pages as WARC archives and read archives back, damaged ones too.

Archives are ordinary gzip WARC files with a member for each record, written
by Spark's own text writer, so that a lost task is written again and commits
once. A member ends with the four bytes of its length, the last of which is 0
for records of less than 16 MiB; that byte is given to the writer as its line
separator. A larger record is followed by an empty member that ends alike.

The reader checks each member (its CRC, the WARC version line, the length of
its block and the payload digest). After a failed check it searches for the
next member, or in plain archives for the next version line, that reads well,
goes on from there, and logs the gap it left as a quarantined range of bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import shared

#: Bytes of html of an archive file, about, and shares into which the rows of one payload are dealt.
FILE_BYTES = 128 << 20
SALT = 64
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000" + "0000")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"


def digest(payload: bytes) -> str:
    """Base32 SHA-1 in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record with its payload, or a revisit record without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is 0."""
    out = gzip.compress(data, 6, mtime=0)
    return out if out[-1:] == b"\0" else out + _EMPTY_MEMBER


def _members(date: str):
    """``(page_id, hash of the payload, member of a response record, its revisit's parts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, pages = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for page_id, url, html in zip(ids, urls, pages, strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                out.append((member(record(page_id, url, payload, None, date))[:-1], hashlib.sha1(payload).hexdigest(), len(payload)))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
                ["page_id", "url", "member", "sha1", "n_bytes"],
            )

    return run


def _revisits(date: str):
    """Swap the member of a repeated payload for that of a revisit record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, members, sha1, size, first = (c.to_pylist() for c in batch.columns)
            for k, to in enumerate(first):
                if to is not None and (ids[k] is None or ids[k] > to):
                    http = _revisit(ids[k], urls[k], sha1[k], size[k], to, date)
                    members[k] = member(http)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["value"])

    return run


def _revisit(page_id, url, sha1: str, size: int, to: int, date: str) -> bytes:
    """As :func:`record` for a payload of which only digest and length are at hand."""
    plain = record(page_id, url, b"", to, date).decode("utf-8", "surrogatepass")
    empty = digest(b"")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    head = plain[: plain.index("\r\n\r\n")]
    head = head.replace(f"WARC-Payload-Digest: sha1:{empty}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(), 1)
    head = re.sub(r"WARC-Block-Digest: sha1:\w+", "WARC-Block-Digest: sha1:" + digest(block.encode()), head, count=1)
    head = head.replace("X-Payload-Length: 0", f"X-Payload-Length: {size}", 1)
    head = head[: head.rindex("Content-Length: ")] + f"Content-Length: {len(block)}"
    return (head + "\r\n\r\n" + block + "\r\n\r\n").encode("utf-8", "surrogatepass")


def write(pages: DataFrame, path: str, least: int = 0, date: str | None = None) -> None:
    """Write a record for each row of ``pages (page_id, url, html)`` under ``path``.

    Of records with equal payloads of at least ``least`` bytes, that with the
    smallest id is the response and the others are revisits of it. A null html
    is an empty payload. A row without an id never is the first one, unless no
    row with that payload has an id: then all of them are responses. Rows that
    repeat the first one's id and payload are responses too. Other columns are
    not written.
    """
    stamp = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # Only payloads that occur twice matter; rows of one payload are dealt by a salt, each share with its first row.
    narrow = source.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    again = narrow.groupBy("sha1").agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("first")).where("copies > 1 and first is not null")
    again = again.select(F.col("sha1").alias("again"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("share"))
    made = source.mapInArrow(_members(stamp), "page_id long, url string, member binary, sha1 string, n_bytes long")
    made = made.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    joined = made.join(again, (F.col("sha1") == F.col("again")) & (F.col("salt") == F.col("share")), "left").select("page_id", "url", "member", "sha1", "n_bytes", "first")
    mean = source.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0
    records = max(1, int(FILE_BYTES / (mean + 500)))  # headers and all
    joined.mapInArrow(_revisits(stamp), "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "surrogatepass").strip()
    return out


def parse(data: bytes) -> tuple[dict, bytes, int] | str:
    """``(headers, payload, length)`` of the record at the start of ``data``, or what is wrong with it."""
    if not (m := _VERSION.match(data)):
        return "no version line"
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        return "headers do not end"
    try:
        head = _headers(data[:end])
        n = int(head["content-length"])
    except (KeyError, ValueError):
        return "no content length"
    block = data[end + 4 : end + 4 + n]
    if n < 0 or len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        return "block does not end"
    if "warc-block-digest" in head and head["warc-block-digest"] != "sha1:" + digest(block):
        return "block digest differs"
    payload = block
    if head.get("content-type", "").startswith("application/http"):
        _, _, payload = block.partition(b"\r\n\r\n")
    if head.get("warc-type") == "response" and "warc-payload-digest" in head and head["warc-payload-digest"] != "sha1:" + digest(payload):
        return "payload digest differs"
    return head, payload, end + 8 + n


def _inflate(view: memoryview) -> tuple[bytes, int, bool]:
    """What a gzip member holds, up to the first damage, the bytes that were read, and whether it is whole; zlib checks CRC and length."""
    d, parts, at = zlib.decompressobj(31), [], 0
    while not d.eof and at < len(view):
        before = d.copy()
        try:
            parts.append(d.decompress(view[at : at + (1 << 16)]))
            at += 1 << 16
        except zlib.error:
            # up to the damage, in small steps
            try:
                while at < len(view):
                    parts.append(before.decompress(view[at : at + 64]))
                    at += 64
            except zlib.error:
                pass
            return b"".join(parts), min(at, len(view)), False
    return b"".join(parts), min(at, len(view)) - len(d.unused_data), d.eof


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """``("record", start, end, (headers, payload))`` and ``("gap", start, end, reason)`` of one archive, in order.

    Of a member with several records those that read well are kept, whatever
    its others are like and wherever it is damaged; a gap inside a member
    stands with the member's bytes, and its reason tells the bytes inside.
    """
    view, at, bad, why = memoryview(data), 0, None, ""
    while at < len(data):
        found, end, reason = _at(data, view, at)
        if any(kind == "record" for kind, _ in found) or (end is not None and not found):
            if bad is not None:
                yield "gap", bad, at, why
                bad = None
            for kind, what in found:
                yield kind, at, end or len(data), what
            if end is not None:
                at = end
                continue
        if bad is None:
            bad, why = at, reason
        places = [x for x in (data.find(_MAGIC, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
        at = min(places, default=len(data))
    if bad is not None:
        yield "gap", bad, len(data), why


def _inside(data: bytes) -> tuple[list[tuple[str, object]], str]:
    """Records of an inflated member and what lies between them, and the first problem."""
    found, k, first = [], 0, ""
    while k < len(data):
        r = parse(data[k:] if k else data)
        if isinstance(r, str):
            first = first or r
            nxt = data.find(b"WARC/1.", k + 1)
            nxt = len(data) if nxt < 0 else nxt
            found.append(("gap", f"{r}, bytes {k} to {nxt} of the member"))
            k = nxt
        else:
            found.append(("record", r[:2]))
            k += r[2]
    return found, first


def _at(data: bytes, view: memoryview, at: int) -> tuple[list[tuple[str, object]], int | None, str]:
    """Records and inner gaps that stand at a place, where they end if that is known, and a problem."""
    if data.startswith(_MAGIC, at):
        inside, size, whole = _inflate(view[at:])
        found, reason = _inside(inside)
        records = sum(kind == "record" for kind, _ in found)
        if not whole:
            return [x for x in found if x[0] == "record"], None, f"member does not inflate, after {records} records" if records else "member does not inflate"
        return (found, at + size, reason) if records or not found else ([], None, reason)
    if data.startswith(b"WARC/1.", at):
        # a plain record: its length is in its headers, so no more than the record is copied
        end = data.find(b"\r\n\r\n", at)
        try:
            n = int(_headers(data[at:end])["content-length"]) if end >= 0 else -1
        except (KeyError, ValueError):
            n = -1
        if n < 0:
            return [], None, "no content length"
        r = parse(data[at : end + 8 + n])
        return ([], None, r) if isinstance(r, str) else ([("record", r[:2])], at + r[2], "")
    return [], None, "neither a member nor a version line"


def _id(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            path, rows, size = batch.column(0)[k].as_py(), [], 0
            for kind, start, end, what in salvage(batch.column(1)[k].as_py()):
                if kind == "gap":
                    rows.append((path, start, end, what, None, None, None, None, None, None, None))
                else:
                    head, payload = what
                    length = int(head.get("x-payload-length", len(payload)))
                    rows.append((path, start, end, None, head.get("warc-type"), _id(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha1:"), length, _id(head.get("warc-refers-to")), payload))
                    size += len(payload)
                if size > 1 << 24 or len(rows) >= 5000:
                    yield _rows(rows)
                    rows, size = [], 0
            yield _rows(rows)


_TYPES = [("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("problem", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _TYPES, strict=True)], [n for n, _ in _TYPES])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path``.

    A record has its headers' values and its payload; a gap has ``problem``,
    and ``start`` and ``stop`` are the bytes that were passed over. An empty
    archive gives no row. Each file is read by one task, so archives should be
    of moderate size, as :func:`write` makes them.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, "path string, start long, stop long, problem string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of pages that went through archives."""
    spark = pages.sparkSession
    at = shared.path(spark, "warc")
    write(pages, at)
    return read(spark, at).where("problem is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
