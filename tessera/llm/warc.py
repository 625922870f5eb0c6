"""WARC archives: a gzip member per record, and a sequential reader.

Writing: a page is a `response` record, or a `revisit` (headers only) where another page with an equal payload of at least `least` bytes
has a larger page_id. The digests decide that in a narrow aggregate; digests that occur once never meet the pages again. Archives are closed at a
bounded size and listed in a manifest, so a lost or repeated task leaves no half-written archive among those that are read.

Reading: an archive is read in small steps through an incremental zlib decompressor; a record's header gives its length, the framing
after it is checked, members must end where records end, and payload digests are computed again.

Rows: null html counts as empty, a null url as ''; a null page_id is always a response; rows that share the largest page_id of a group are all
responses; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import saved, shared_dir

LEAST = 1000
ARCHIVE_BYTES = 32_000_000
STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def _line(text: str) -> str:
    """A header value stays on its line."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def member(page_id: int | None, url: str, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def records(stream) -> Iterator[Record]:
    """Records of an archive in order; raises ValueError where framing, length or block digest is wrong."""
    raw, out, inflate = b"", bytearray(), None
    while True:
        if not raw:
            raw = stream.read(STEP)
        if inflate is None:
            if not raw:
                return
            inflate, out = zlib.decompressobj(31), bytearray()
        elif not raw:
            raise ValueError("the archive ends within a record")
        try:
            out += inflate.decompress(raw)
        except zlib.error as e:
            raise ValueError(f"not a gzip member: {e}") from e
        raw = inflate.unused_data
        if not inflate.eof:
            continue
        inflate = None
        head, found, rest = bytes(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not found or not lines[0].startswith("WARC/1."):
            raise ValueError("a member without a WARC header")
        headers = {}
        for x in lines[1:]:
            name, colon, value = x.partition(":")
            if not colon:
                raise ValueError(f"a header line without a name: {x[:60]}")
            headers[name.lower()] = value.strip(" ")
        n = int(headers["content-length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"a record of {len(rest) - 4} bytes says it has {n}")
        block = rest[:n]
        _verify(headers.get("warc-block-digest"), block)
        yield Record(headers, block)


def _verify(said: str | None, data: bytes) -> str:
    """The SHA-1 of data in hex, if it is the one that a header gives."""
    digest = hashlib.sha1(data)
    if said is not None and said != "sha1:" + base64.b32encode(digest.digest()).decode():
        raise ValueError(f"data doesn't have the digest {said}")
    return digest.hexdigest()


def page(record: Record) -> tuple[int | None, str, bytes | None, int, str, str, int | None]:
    """page_id, url, payload (None in a revisit), payload bytes and digest, record type, refers_to."""
    number = lambda x: int(y) if (y := x[len("<urn:page:") : -1]) else None
    http, found, payload = record.block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("an HTTP message without the end of its header")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, said = record.headers["warc-type"], record.headers["warc-payload-digest"]
    if kind == "revisit":
        digest = base64.b32decode(said.removeprefix("sha1:")).hex()
        refers = number(record.headers["warc-refers-to"])
        if payload or refers is None:
            raise ValueError("a revisit with a payload, or of nothing")
        return number(record.headers["warc-record-id"]), _unline(record.headers["warc-target-uri"]), None, size, digest, kind, refers
    if len(payload) != size:
        raise ValueError(f"a payload of {len(payload)} bytes says it has {size}")
    return number(record.headers["warc-record-id"]), _unline(record.headers["warc-target-uri"]), payload, size, _verify(said, payload), kind, None


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and returns their manifest (file, n_records)."""
    text = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("html") >= least)
    twice = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1").select(F.col("digest").alias("same"), "last")
    twice = saved(twice, "digests")  # its size is then known to the planner, which broadcasts it or else joins by shuffle
    refers = F.when(F.col("page_id") != F.col("last"), F.col("last"))
    marked = rows.join(twice, rows["digest"] == twice["same"], "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            nonlocal size
            file = files.put(f"{path}/pages.warc.gz", b"".join(held))
            out = pa.RecordBatch.from_pydict({"file": [file], "n_records": pa.array([len(held)], pa.int64())})
            held.clear()
            size = 0
            return out

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(member(row[0], row[1], row[2].encode(), row[3]))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    return saved(marked.mapInArrow(archive, "file string, n_records long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Pages of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to; with payloads also url and html."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count, rows, size = 0, [], 0
                with files.opened(file) as stream:
                    for record in records(stream):
                        page_id, url, payload, nbytes, digest, kind, refers = page(record)
                        rows.append((page_id, nbytes, digest, kind, refers, *((url, None if payload is None else payload.decode()) if payloads else ())))
                        count, size = count + 1, size + len(payload or b"")
                        if len(rows) >= 5000 or payloads and size > 16_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)
                if count != n:
                    raise ValueError(f"{file} has {count} records, not {n}")

    kept = manifest.repartition(max(1, min(manifest.count(), 20_000)))  # rows are archive names; an archive is read in one task
    return kept.mapInArrow(unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, html string" * payloads)


_FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = _FIELDS[: len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    return read(spark, write(pages, shared_dir(spark, "warc"), **options))
