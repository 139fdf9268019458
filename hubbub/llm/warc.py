"""WARC archives with equal payloads written once.

Headers (id, digest, length) are shuffled by payload digest and give, for each digest, the record that stays
the response. Every other record becomes a revisit of it, with fresh headers that name the response's id, URI and date,
and no payload. Each record is a gzip member of its own, behind a warcinfo record and before a metadata record that tells
how many records its file has. Members are raw bytes of text rows, so Spark commits the files on any store: the text
writer puts a zero byte behind each row, which is the last byte of a member's length where that is below 2**24, and
that of an empty member behind longer ones. The files are plain .warc.gz in all but name.

Reading takes a file as gzip members or as plain text and cuts records by their Content-Length, so archives of
other tools read too. Digests are recomputed from the payloads that were read. A record that is cut short, a file
without its count or with another number of records, and a payload that disagrees with its digest raise ValueError.
A task holds one compressed file and one record.

A null page_id is no key: its record has no WARC-Page-ID, an id named by its payload, and reads back with null. It
revisits the payload's largest id, or is a response if no row with an id shares the payload.
A null payload is empty. A null or odd url loses its control characters. Of rows that share payload and the
largest id, all are responses. Payloads below min_bytes are never revisited. An empty table writes an archive
without records. Digests are SHA-1 as the format wants it; rows are matched by SHA-1, SHA-256 and length. Columns of
pages other than page_id, url and html are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubbub.llm.common import whole_text

_CRLF = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY_MEMBER = zlib.compress(b"", 6, 31)
_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()),
    ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
RECORD_SCHEMA = (
    "page_id long, record_type string, record_id string, url string, date string, payload_digest string, "
    "refers_to_id string, refers_to long, payload_bytes long, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(name: str) -> str:
    """A name-based urn that is the same in every run."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'record:{name}'.encode()).digest())}>"


def resolve_revisits(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """page_id, sha256, original (the id it revisits) and original_url of the rows that are revisits."""
    payload = whole_text(F.col("html")).cast("binary")
    heads = pages.select("page_id", "url", F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).alias("n"))
    heads = heads.where(F.col("n") >= min_bytes)
    same = ["sha1", "sha256", "n"]
    first = F.max(F.struct("page_id", "url"))
    originals = heads.groupBy(same).agg(first.alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first.page_id is not null")
    originals = originals.select(*same, F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url"))
    return heads.join(originals, same).where("not original <=> page_id").select("page_id", "sha256", "original", "original_url").distinct()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + _CRLF * 2


def _member(record: bytes) -> bytes:
    """A gzip member without its last byte, a zero, which the writer adds."""
    out = zlib.compress(record, 4, 31)
    return (out if out[-1] == 0 else out + _EMPTY_MEMBER)[:-1]


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", "", url or "")


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as WARC/1.1 to the folder path."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole_text(F.col("html")).alias("html"))
    # the digest too: rows that share an id may differ in their payload
    named = pages.withColumn("sha256", F.sha2(F.col("html").cast("binary"), 256))
    again = resolve_revisits(pages, min_bytes=min_bytes).withColumnsRenamed({"page_id": "of", "sha256": "digest"})
    rows = named.join(again, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("sha256") == F.col("digest")), "left").drop("of", "digest")
    rows = rows.withColumn("html", F.col("html").cast("binary"))

    def members(batches):
        written, info = 0, None
        for batch in batches:
            out = []
            for page_id, url, payload, sha256, original, original_url in zip(*(c.to_pylist() for c in batch.columns)):
                if info is None:
                    info = _record_id(f"info:{page_id}:{sha256}")
                    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", info), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                    out.append(_member(_record(headers, b"format: WARC File Format 1.1\r\n")))
                headers = [
                    ("WARC-Type", "response" if original is None else "revisit"),
                    ("WARC-Record-ID", _record_id(f"null:{sha256}" if page_id is None else str(page_id))),
                    *([] if page_id is None else [("WARC-Page-ID", str(page_id))]),
                    ("WARC-Warcinfo-ID", info), ("WARC-Target-URI", _clean(url)), ("WARC-Date", date),
                    ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response"),
                ]
                if original is not None:
                    headers += [
                        ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(str(original))), ("WARC-Refers-To-Page-ID", str(original)),
                        ("WARC-Refers-To-Target-URI", _clean(original_url)), ("WARC-Refers-To-Date", date),
                    ]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                out.append(_member(_record(headers, http + (payload if original is None else b""))))
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
        if info:
            headers = [("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id(f"count:{info}")), ("WARC-Refers-To", info), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
            yield pa.RecordBatch.from_arrays([pa.array([_member(_record(headers, f"records: {written}\r\n".encode()))], pa.binary())], ["member"])

    packed = rows.select("page_id", "url", "html", "sha256", "original", "original_url").mapInArrow(members, "member binary")
    packed.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


class _Reader:
    """Lines and blocks of a file of gzip members, or of a plain one."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held = memoryview(raw), 0, b""
        self.inflate = None if raw[:2] != b"\x1f\x8b" else zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at : self.at + (1 << 16)]
        self.at += len(part)
        if self.inflate is None:
            self.held += part
            return True
        self.held += self.inflate.decompress(part)
        while self.inflate.eof:
            rest = self.inflate.unused_data.lstrip(b"\0")
            self.inflate = zlib.decompressobj(31)
            if not rest:
                break
            self.held += self.inflate.decompress(rest)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is taken too; None at the end of the file."""
        at = self.held.find(mark)
        while at < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip(b"\r\n\0"):
                    raise ValueError("the archive is cut short within a header")
                return None
            at = self.held.find(mark, seen)
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, left = [self.held[:n]], n - min(n, len(self.held))
        self.held = self.held[n:]
        while left:
            if not self._more():
                raise ValueError("the archive is cut short within a record")
            parts.append(self.held[:left])
            n = min(left, len(self.held))
            self.held, left = self.held[n:], left - n
        return b"".join(parts)


def records_of(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-cased names, block) of each record of a WARC file."""
    reader = _Reader(raw)
    while (head := reader.until(_CRLF * 2)) is not None:
        version, *lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        block = reader.take(int(headers["content-length"]))
        if reader.take(4) != _CRLF * 2:
            raise ValueError("a record does not end where its Content-Length says")
        yield headers, block


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True, counted: bool = True) -> DataFrame:
    """The response, resource and revisit records at path. payload is null for revisits, and for all if payloads is false.
    counted: each file must have the metadata record with the number of its records, as write_warc writes it."""

    def parse(batches):
        for batch in batches:
            for raw in batch["content"].to_pylist():
                yield from _batches(raw, payloads, counted)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def _batches(raw: bytes, payloads: bool, counted: bool) -> Iterator[pa.RecordBatch]:
    rows, held, n, told = [], 0, 0, None
    for h, block in records_of(raw):
        kind = h.get("warc-type")
        if kind == "metadata" and (m := re.match(rb"records: (\d+)\r\n", block)):
            told = int(m[1])
        if kind not in ("response", "resource", "revisit"):
            continue
        n += 1
        digest = h.get("warc-payload-digest", "")
        digest = digest.removeprefix("sha1:") if digest.startswith("sha1:") else None
        payload = None
        if kind != "revisit":
            payload = block.partition(_CRLF * 2)[2] if h.get("content-type", "").startswith("application/http") else block
            found = base32_sha1(payload)
            if digest not in (None, found):
                raise ValueError(f"record {h.get('warc-record-id')} has another payload than its digest tells")
            digest = found
        number = lambda name: int(h[name]) if name in h else None
        size = None if payload is None else len(payload)
        rows.append((number("warc-page-id"), kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), digest,
                     h.get("warc-refers-to"), number("warc-refers-to-page-id"), size, payload if payloads else None))
        held += size or 0
        if len(rows) >= 4096 or payloads and held > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)
            rows, held = [], 0
    if counted and told != n:
        raise ValueError(f"a file of the archive tells of {told} records and has {n}")
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """Each record with the payload length of the response that it is or refers to. A revisit whose response is missing
    fails. Only headers are joined; of a payload that many rows share, the response is one row for each of its ids."""
    responses = records.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to_id"), F.col("payload_digest"), F.col("payload_bytes").alias("size")
    ).distinct()
    again = records.where("record_type = 'revisit'").drop("payload_bytes").join(responses, ["refers_to_id", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("the archive has no response for "), F.coalesce("record_id", F.lit("a revisit")))).cast("long")
    again = again.withColumn("payload_bytes", F.coalesce("size", lost)).select(records.columns)
    return records.where("record_type <> 'revisit'").unionByName(again)
