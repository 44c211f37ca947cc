"""Legacy archive converter: ARC files of either version to WARC files, and readers and writers of both.

An ARC record is a header line and as many bytes as the line declares. Version 1 lines hold url, IP address, date, type
and length; version 2 lines hold result code, checksum, location, offset and file name as well. The file's first record
(``filedesc:``) says which. Each record becomes a WARC record with synthesised fields: an identifier from the place of the
record in its archive (the same in every rerun), the date in ISO form, the type from the url's scheme, and SHA-256
digests of block and payload. Records whose payloads are equal, and of at least ``least_bytes``, keep the payload once: the
others become ``revisit`` records that refer to it.

Archives are written by Spark's text writer, whose record separator is what ends a record in either format (a line feed
in ARC, two CR LF in WARC), so lost tasks are repeated and committed as in any write; files are compressed by it too.
They are read as whole binary files, one at a time in a task, and unpacked as a stream; an archive's size is bounded by
whoever writes it.

Defined results: a null payload is empty; a null url is written as ``unknown:``; white space inside a url is
percent-encoded; a header line that cannot be read, or a length beyond the end, gives one row with ``problem`` set, and
reading goes on at the next line that is a header; an empty table gives archives with no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import ship_code, table, written

#: Field names of the two header versions, and the identity of revisits.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Up to so many revisits (about 300 bytes each) go to every task; more are joined.
SENT_REVISITS = 20_000
_NAMES = uuid.UUID("6f0d0f3a-5d0e-5c55-9d8c-3f4b1f0a7c11")
#: What the first record of an ARC file holds: its version and the names of the header fields.
_VERSION_BLOCK = re.compile(rb"[12] \S+ [^\n]*\nURL IP-address Archive-date ")
_HEADER = re.compile(rb"^(\S+) ([0-9A-Fa-f.:]+) (\d{14}) (\S+) ((?:\S+ ){0,5})(\d+)$")

ARC_SCHEMA = (
    "archive string, offset long, version int, url string, ip string, date string, content_type string, result_code int, "
    "checksum string, block binary, problem string"
)


def arc_records(pages: DataFrame, url: Column, payload: Column, date: Column, version: int, http_fields: dict[str, Column], ip: str = "0.0.0.0") -> DataFrame:
    """Rows with one ``value``, an ARC record without its end: header line, line feed, HTTP response with ``payload`` (binary)."""
    safe = F.coalesce(url, F.lit("unknown:"))
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), ("\x0b", "%0B"), ("\x0c", "%0C")):
        safe = F.replace(safe, F.lit(char), F.lit(code))
    safe = F.when(safe == "", "unknown:").otherwise(safe)
    body = F.coalesce(payload, F.lit(b""))
    fields = [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n")) for name, value in http_fields.items()]
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n"), *fields, F.lit("\r\n"),
    )
    block = F.concat(http.cast("binary"), body)
    more = [F.lit("200"), F.substring(F.sha2(body, 256), 1, 32), F.lit("-"), F.lit("0"), F.lit("-")] if version == 2 else []
    head = F.concat_ws(" ", safe, F.lit(ip), F.date_format(date, "yyyyMMddHHmmss"), F.lit("text/html"), *more, F.octet_length(block).cast("string"))
    return pages.select(F.concat(head.cast("binary"), F.lit(b"\n"), block).alias("value"))


def _with_first(batches: Iterator[pa.RecordBatch], first: bytes) -> Iterator[pa.RecordBatch]:
    """Puts a record before the others of a task, so that every file begins with it."""
    begun = False
    for batch in batches:
        if batch.num_rows and not begun:
            begun = True
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary())], ["value"])
        yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])


def write_archive(records: DataFrame, path: str, first: bytes, end: str) -> None:
    """``records`` (``value`` binary) as gzip files, each beginning with the record ``first``; ``end`` closes a record."""
    ship_code(records.sparkSession)
    rows = records.mapInArrow(lambda batches: _with_first(batches, first), "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def arc_first(version: int) -> bytes:
    block = f"{version} 0 signalmill\n{FIELDS[version]}\n".encode()
    place = {1: "", 2: "200 - - 0 - "}[version]
    return f"filedesc://signalmill.arc 0.0.0.0 20240101000000 text/plain {place}{len(block)}\n".encode() + block


def unpack(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a plain or gzip file, of any number of gzip members, in pieces."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, reader, view = 0, zlib.decompressobj(31), memoryview(data)
    while at < len(data):
        chunk = view[at:at + step]
        at += len(chunk)
        while chunk:
            yield reader.decompress(chunk)
            if not reader.eof:
                break
            chunk = reader.unused_data
            reader = zlib.decompressobj(31) if chunk else reader
            if reader.eof and at < len(data):
                reader = zlib.decompressobj(31)


class Stream:
    """Reads lines and counted bytes from pieces, holding little more than one record."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.offset = pieces, bytearray(), 0, 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        del self.held[:self.at]
        self.at = 0
        self.held += piece
        return True

    def line(self) -> bytes | None:
        """Up to the next line feed, without it; None at the end."""
        seen = 0
        while (end := self.held.find(b"\n", self.at + seen)) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                end = len(self.held)
                if end == self.at:
                    return None
                break
        out = bytes(self.held[self.at:end])
        step = min(end + 1, len(self.held)) - self.at
        self.at += step
        self.offset += step
        return out

    def take(self, count: int) -> bytes:
        while len(self.held) - self.at < count and self._more():
            pass
        out = bytes(self.held[self.at:self.at + count])
        self.at += len(out)
        self.offset += len(out)
        return out


def parse_arc(pieces: Iterator[bytes]) -> Iterator[dict]:
    """The records of one ARC file, by the header fields of its version and the lengths it declares.

    ``filedesc:`` is the file's header in its first line, or where the version block of a joined file follows; any other
    such url is a record.
    """
    stream, version, lost, begins = Stream(pieces), 1, False, True
    while True:
        offset = stream.offset
        line = stream.line()
        if line is None:
            return
        line = line.rstrip(b"\r")
        if not line:
            continue
        at_start, begins = begins, False
        found = _HEADER.match(line)
        extra = found[5].split() if found else []
        if not found or len(extra) not in (0, 5):
            if not lost:
                yield {"offset": offset, "version": version, "problem": "no header line"}
            lost = True
            continue
        length = int(found[6])
        block = stream.take(length)
        if found[1].startswith(b"filedesc:") and (at_start or _VERSION_BLOCK.match(block)):
            version = int(block[:1]) if block[:1] in (b"1", b"2") else 1
            continue
        lost = False
        if len(block) < length:
            yield {"offset": offset, "version": version, "problem": "shorter than declared"}
            return
        text = lambda x: x.decode("utf-8", "replace")
        yield {
            "offset": offset, "version": 2 if extra else 1, "url": text(found[1]), "ip": text(found[2]), "date": text(found[3]),
            "content_type": text(found[4]), "result_code": int(extra[0]) if extra and extra[0].isdigit() else None,
            "checksum": text(extra[1]) if extra and extra[1] != b"-" else None, "block": block,
        }


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head; the whole block if it has none."""
    if block[:5] != b"HTTP/":
        return block
    cut = block.find(b"\r\n\r\n")
    return block[cut + 4:] if cut >= 0 else b""


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` bytes of blocks."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("block") or b"")
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_ARC_ARROW = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()),
    ("date", pa.string()), ("content_type", pa.string()), ("result_code", pa.int32()), ("checksum", pa.string()),
    ("block", pa.binary()), ("problem", pa.string()),
])
_INDEX_ARROW = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("head", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])


def _files(batches: Iterator[pa.RecordBatch], base: int = 0) -> Iterator[tuple[str, bytes]]:
    """(name, content); a name begins at the folder that holds the archive folders, so that it does not depend on where they are."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield path.as_py(), content.as_py()


def _read_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched(({"archive": p} | r for p, c in _files(batches) for r in parse_arc(unpack(c))), _ARC_ARROW)


def _index_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for path, content in _files(batches):
            for r in parse_arc(unpack(content)):
                if "problem" not in r:
                    payload = payload_of(r["block"])
                    head = r["block"][:len(r["block"]) - len(payload)].decode("utf-8", "replace")
                    yield {
                        "archive": path, "offset": r["offset"], "url": r["url"], "date": r["date"], "head": head,
                        "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(),
                    }

    yield from _batched(rows(), _INDEX_ARROW)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the archives in a folder or of its sub-folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ARC files below ``path``, and one per unreadable place (``problem``)."""
    ship_code(spark)
    return archive_files(spark, path).mapInArrow(_read_arc, ARC_SCHEMA)


def record_id(archive: str, offset: int) -> str:
    """A record's identifier: a name-based UUID of the archive's file name and the record's offset."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{archive.rsplit("/", 1)[-1]}#{offset}')}>"


def iso_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(r: dict) -> bytes:
    """The WARC record of an ARC record; ``first_*`` name the record that it revisits, if any."""
    block, payload = r["block"], payload_of(r["block"])
    http = len(payload) < len(block) or block[:5] == b"HTTP/"
    revisit = r.get("first_archive") is not None
    if revisit:
        block = block[:len(block) - len(payload)]
    scheme = r["url"].split(":", 1)[0].lower()
    kind = "revisit" if revisit else "response" if http or scheme not in ("dns", "warcinfo") else "resource"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(r["archive"], r["offset"])), ("WARC-Date", iso_date(r["date"])),
        ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(r["first_archive"], r["first_offset"])),
            ("WARC-Refers-To-Target-URI", r["first_url"]), ("WARC-Refers-To-Date", iso_date(r["first_date"])),
        ]
    fields += [("Content-Type", "application/http; msgtype=response" if http else r["content_type"]), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(r) for r in batch.slice(at, 256).to_pylist()], pa.binary())], ["value"])


def warc_first() -> bytes:
    block = b"software: signalmill\r\nformat: WARC File Format 1.1\r\n"
    head = (
        "WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000000>\r\n"
        f"WARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block


def convert(spark: SparkSession, arc: str, warc: str, least_bytes: int = 100, first_by: Column | None = None) -> None:
    """Converts all ARC files below ``arc`` to WARC files in ``warc``.

    Of equal payloads the record with the least ``first_by`` (over url, date and ``head``, the HTTP head; null last) stays
    a response, then the one first in archive order.
    """
    ship_code(spark)
    index = written(archive_files(spark, arc).mapInArrow(
        _index_arc, "archive string, offset long, url string, date string, head string, payload_bytes long, payload_digest string"
    ).withColumn("by", F.lit(0) if first_by is None else first_by).drop("head"), "arc-index")
    large = index.where(F.col("payload_bytes") >= least_bytes)
    order = F.struct(F.col("by").isNull().alias("n"), "by", "archive", "offset")
    first = large.groupBy("payload_bytes", "payload_digest").agg(
        F.min_by(F.struct("archive", "offset", "url", "date"), order).alias("first"), F.count("*").alias("copies")
    ).where("copies > 1")
    again = large.join(first, ["payload_bytes", "payload_digest"]).where(
        (F.col("archive") != F.col("first.archive")) | (F.col("offset") != F.col("first.offset"))
    ).select("archive", "offset", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("archive", "offset", "url", "date")])
    again = written(again, "arc-revisits")
    sent = F.broadcast(again) if again.count() <= SENT_REVISITS else again.hint("shuffle_hash")
    records = read_arc(spark, arc).where("problem IS NULL").drop("problem")
    rows = records.join(sent, ["archive", "offset"], "left")
    write_archive(rows.mapInArrow(_to_warc, "value binary"), warc, warc_first(), "\r\n\r\n")


def parse_warc(pieces: Iterator[bytes]) -> Iterator[dict]:
    """The records of one WARC file: ``fields`` (names in lower case) and ``block``."""
    stream = Stream(pieces)
    while True:
        offset = stream.offset
        line = stream.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield {"offset": offset, "fields": fields, "block": stream.take(int(fields.get("content-length", 0)))}


_WARC_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()),
    ("date", pa.string()), ("payload_digest", pa.string()), ("head", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary()),
])


def _read_warc(with_blocks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, content in _files(batches):
                for r in parse_warc(unpack(content)):
                    f, payload = r["fields"], payload_of(r["block"])
                    head = r["block"][:len(r["block"]) - len(payload)]
                    kind = f.get("warc-type")
                    digest = "sha256:" + hashlib.sha256(payload).hexdigest()
                    if kind == "response" and f.get("warc-payload-digest", digest) != digest:
                        raise ValueError(f"payload of {f.get('warc-record-id')} does not match its digest")
                    yield {
                        "record_id": f.get("warc-record-id"), "record_type": kind, "refers_to_id": f.get("warc-refers-to"),
                        "target_uri": f.get("warc-target-uri"), "date": f.get("warc-date"),
                        "payload_digest": f.get("warc-payload-digest"), "head": head.decode("utf-8", "replace"),
                        "payload_bytes": None if kind == "revisit" else len(payload), "block": r["block"] if with_blocks else None,
                    }

        yield from _batched(rows(), _WARC_ARROW)

    return run


def read_warc(spark: SparkSession, path: str, with_blocks: bool = True) -> DataFrame:
    """One row per WARC record below ``path``; digests of responses are verified. A revisit has no payload of its own."""
    ship_code(spark)
    return archive_files(spark, path).mapInArrow(
        _read_warc(with_blocks), "record_id string, record_type string, refers_to_id string, target_uri string, date string, "
        "payload_digest string, head string, payload_bytes long, block binary",
    )


def http_field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)\r\n", 1)


def op1_warc(spark, folder: str) -> DataFrame:
    """Pages as ARC files of both versions, converted to WARC files, which are read back.

    Even pages are archived in version 1 and the others in version 2; the page id is a field of the archived HTTP head.
    """
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    date = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col("page_id"), F.lit(0)) % 86_400)
    even = F.coalesce(F.col("page_id") % 2 == 0, F.lit(False))
    for version, part in ((1, pages.where(even)), (2, pages.where(~even))):
        rows = arc_records(part, F.col("url"), F.col("html").cast("binary"), date, version, {"X-Page-Id": F.col("page_id")})
        write_archive(rows, f"{arc}/v{version}", arc_first(version), "\n")
    page = lambda head: http_field(head, "X-Page-Id").try_cast("long")
    convert(spark, arc, warc, first_by=page(F.col("head")))
    read = written(read_warc(spark, warc, with_blocks=False).where("record_type IN ('response', 'revisit')").select(
        page(F.col("head")).alias("page_id"), "record_id", "record_type", "refers_to_id", "payload_bytes", F.substring("payload_digest", 8, 64).alias("payload_digest"),
    ), "warc-records")
    first = read.where("record_type = 'response'").select(
        F.col("record_id").alias("__id"), F.col("page_id").alias("__page"), F.col("payload_bytes").alias("__bytes")
    )
    whole = read.join(first, read["refers_to_id"] == first["__id"], "left")
    return whole.select(
        "page_id", F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", F.col("__page")).alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
