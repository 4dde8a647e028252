"""WARC archives: one gzip member per record, written in tasks and read back sequentially.

``archive_pages`` decides in Spark which record of equal payloads is the response, and writes the records
task by task into files of the shared folder. ``read_archives`` deals the files out to tasks; each one is
read front to back in pieces: the gzip member is inflated as far as it is needed, the header ends at its
blank line, ``Content-Length`` frames the block, and block and payload digests are recomputed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import in_tasks, rows_of, shared_folder, written

_PIECE = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Header fields of our own, as the standard allows: the page of a record, and that of the response it revisits.
_PAGE, _SAME_AS = "Page-ID", "Page-Refers-To"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, digests_hold boolean, path string, offset long, record_id string"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record, under an id of its own, as one gzip member. Header values are kept on one line."""
    head = f"WARC/1.1\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n" + "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in headers)
    head += f"WARC-Block-Digest: sha1:{base32_sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    """A record as read: its headers by lower-case name, its block and where its member starts."""

    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    offset: int = 0

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def http_header(self, name: str) -> str | None:
        for line in self.block.partition(b"\r\n\r\n")[0].decode(errors="replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            if key.strip().lower() == name:
                return value.strip()
        return None

    def number(self, name: str) -> int | None:
        """A header that is a whole number, if it is there and is one."""
        text = (self.headers.get(name) or "").strip()
        return int(text) if text.removeprefix("-").isdecimal() and text.isascii() else None

    def digests_hold(self) -> bool:
        """Whether block and payload have the SHA-1 digests that the headers state, if any; a revisit has no payload to check."""
        def differs(name: str, data: bytes) -> bool:
            stated = self.headers.get(name, "")
            return stated.lower().startswith("sha1:") and stated[5:].upper() != base32_sha1(data)

        return not differs("warc-block-digest", self.block) and (
            self.headers.get("warc-type") == "revisit" or not differs("warc-payload-digest", self.payload()))


class _Member:
    """Inflates one gzip member step by step; ``spare`` is what follows it in the file."""

    def __init__(self, source: BinaryIO, spare: bytes):
        self.source, self.spare, self.out = source, spare, bytearray()
        self.inflate, self.consumed = zlib.decompressobj(31), 0

    def more(self) -> bool:
        """Inflate one more piece; False at the member's end."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.spare or self.source.read(_PIECE)
            if not data:
                raise ValueError("the archive ends within a gzip member")
            fresh = not self.inflate.unconsumed_tail
            self.spare = b"" if fresh else self.spare
            got = self.inflate.decompress(data, _PIECE)
            self.consumed += len(data) - len(self.inflate.unconsumed_tail) - len(self.inflate.unused_data)
            if self.inflate.eof:
                self.spare = self.inflate.unused_data + self.spare
            if got:
                self.out += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record's header has no end")
        taken = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return taken

    def exactly(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise ValueError("a record is shorter than its Content-Length")
        taken = bytes(self.out[:n])
        del self.out[:n]
        return taken

    def end(self) -> None:
        while self.more():
            pass
        if self.out:
            raise ValueError("a gzip member holds more than its record")


def read_records(source: BinaryIO) -> Iterator[Record]:
    """The records of one archive in file order. Broken framing raises ValueError."""
    spare, offset = b"", 0
    while spare or (spare := source.read(_PIECE)):
        member = _Member(source, spare)
        version, *lines = member.until(b"\r\n\r\n").decode(errors="replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = member.exactly(int(headers["content-length"]))
        if member.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")
        member.end()
        yield Record(headers, block, offset)
        offset, spare = offset + member.consumed, member.spare


def _page_record(row: dict, date: str) -> bytes:
    payload = row["payload"].encode()
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", date)]
    if row["page_id"] is not None:
        headers.append((_PAGE, str(row["page_id"])))
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", row["url"]))
    if revisit:
        headers += [(_SAME_AS, str(row["refers_to"])), ("WARC-Profile", _PROFILE)]
    headers += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    return record_member(headers, http if revisit else http + payload)


def _writer(folder: str, file_bytes: int, date: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, done = None, "", (0, 0)

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [done[0]], "bytes": [done[1]]})

        for row in rows_of(batches):
            if out is None:
                path, done = f"{uuid.uuid4().hex}.warc.gz", (0, 0)  # a repeated attempt writes files of its own
                out = store.open_output_stream(f"{base}/{path}", compression=None)
                member = record_member([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Filename", path)], b"")
                out.write(member)
                done = (0, len(member))
            member = _page_record(row, date)
            out.write(member)
            done = (done[0] + 1, done[1] + len(member))
            if done[1] >= file_bytes:
                yield close()
                out = None
        if out is not None:
            yield close()

    return write


def archive_pages(pages: DataFrame, min_bytes: int = 0, file_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``page_id, url, html`` as archives in the shared folder; returns a row per finished file.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is the
    response and all others revisit it. A null html is an empty payload. Rows that repeat the smallest
    page_id of a payload are responses too; a row without page_id revisits a response that has one, and is a
    response if none has. A null url has no header. Other columns are not read. An empty table writes no file.

    Payload digests alone are grouped, and what they decide returns by page, so a payload with very many
    pages is one row per task in the grouping and spread by its pages in the join.
    """
    spark = pages.sparkSession
    records = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    ids = records.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest").distinct()
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    revisits = ids.join(first, "digest").where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select(F.col("page_id").alias("id"), F.col("digest").alias("same"), "refers_to")
    planned = records.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("same")), "left")
    folder = shared_folder(spark, "warc")
    planned = planned.select("page_id", "url", "payload", "refers_to")
    return written(in_tasks(planned, _writer(folder, file_bytes, date), MANIFEST), "warc-files")


def _reader(with_payload: bool) -> Callable:
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            store, path = fs.FileSystem.from_uri(row["path"])
            with store.open_input_stream(path, compression=None) as source:
                held, size = [], 0
                for r in read_records(source):
                    if (kind := r.headers.get("warc-type")) not in ("response", "revisit"):
                        continue
                    payload = r.payload()
                    held.append({
                        "page_id": r.number(_PAGE.lower()), "url": r.headers.get("warc-target-uri"),
                        "record_type": kind, "refers_to": r.number(_SAME_AS.lower()),
                        "payload_bytes": len(payload) if kind == "response" else _stated_length(r),
                        "payload_digest": r.headers.get("warc-payload-digest", "").rpartition(":")[2] or (base32_sha1(payload) if kind == "response" else None),
                        "digests_hold": r.digests_hold(), "path": row["path"], "offset": r.offset, "record_id": r.headers.get("warc-record-id", "").strip("<>"),
                    } | ({"html": payload.decode(errors="replace") if kind == "response" else None} if with_payload else {}))
                    size += len(payload) if with_payload else 100
                    if size > 8 << 20:
                        yield _batch(held, with_payload)
                        held, size = [], 0
                if held:
                    yield _batch(held, with_payload)

    return flat


def _stated_length(record: Record) -> int | None:
    """The length that the HTTP header of a revisit states, if it has one."""
    text = record.http_header("content-length") or ""
    return int(text) if text.isdecimal() and text.isascii() else None


def _batch(rows: list[dict], with_payload: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digests_hold", pa.bool_()),
             ("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string())]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds + [("html", pa.string())] * with_payload))


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per response or revisit record of the files in ``manifest`` (column path), html last if asked for.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload for revisits too. ``digests_hold``
    tells whether the recomputed digests agree; a file whose framing is broken ends the job. Archives of other
    writers can be read too: ``page_id`` and ``refers_to`` are header fields of our own and null without them, as
    are length and digest of a revisit that does not state them. A manifest without files gives no rows.
    """
    files = manifest.count()
    dealt = manifest.select("path").repartition(max(1, min(files, 20_000)), "path")
    return in_tasks(dealt, _reader(with_payload), RECORDS + ", html string" * with_payload)
