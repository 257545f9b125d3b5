"""WARC archives in seekable Zstandard bundles.

A bundle holds records in independent frames, then a skippable frame with the
seek table (compressed and plain size of every frame).  The index maps a record
to (bundle, frame, offset within the plain frame, length), so one record costs
one frame.  Equal payloads are stored once: the others are revisit records.

Bundles go to the shared folder.  A task writes each bundle under a name of its
own attempt, and only rows of attempts that succeeded name bundles, so retries
and lost executors leave unused files at worst.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.llm import scratch

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "page_id long, path string, frame int, offset long, length long"


class BundleWriter:
    """Frames of about ``frame_bytes``; ``close`` appends the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = 0
        self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def _flush(self) -> None:
        data = self.compressor.compress(b"".join(self.held))
        self.sink.write(data)
        self.frames.append((len(data), self.size))
        self.written += len(data)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        table = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Random access to frames by the seek table at the end of the file."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable bundle")
        source.seek(end - 9 - 8 * count)
        sizes = [struct.unpack("<II", source.read(8)) for _ in range(count)]
        self.starts, at = [], 0
        for compressed, plain in sizes:
            self.starts.append((at, compressed, plain))
            at += compressed

    def frame(self, number: int) -> bytes:
        import zstandard

        at, compressed, plain = self.starts[number]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(compressed), max_output_size=max(plain, 1))

    def __len__(self) -> int:
        return len(self.starts)


def _open(uri: str, write: bool):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the payload's digest and length and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of the records of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield head, data[start:stop]
        at = stop + 4


def _number(name: str | None) -> int | None:
    return int(name[10:-1]) if name and name[10:-1] else None


def _written(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    writer, path = None, ""
    rows: list[tuple[int | None, str, int, int, int]] = []

    def index() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "path", "frame", "offset", "length"])
        rows.clear()
        return out

    for batch in batches:
        for i, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if writer is None:
                path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                writer = BundleWriter(_open(path, True))
            data = record(i, url, html.encode(), digest, refers_to)
            frame, offset = writer.add(data)
            rows.append((i, path, frame, offset, len(data)))
            if writer.written >= BUNDLE_BYTES:
                writer.close()
                writer = None
                yield index()
    if writer is not None:
        writer.close()
        yield index()


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path, False) as source:
                reader = BundleReader(source)
                for number in range(len(reader)):
                    out = []
                    for head, body in parse(reader.frame(number)):
                        kind = head["WARC-Type"]
                        if kind == "response":
                            payload = body[body.index(b"\r\n\r\n") + 4 :]
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                        out.append((_number(head["WARC-Record-ID"]), size, digest, kind, _number(head.get("WARC-Refers-To"))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], list(types))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Write all pages and return the index (``INDEX``) of the records.

    Of equal payloads of at least ``least`` bytes, the one with the largest id
    is a response and the others revisit it.  A null payload is empty.  A row
    without an id is always a response.  Rows that repeat id and payload are
    records of their own, all responses if their id is the largest.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    slim = rows.select("id", "digest", F.octet_length("html").alias("size")).filter(F.col("size") >= least)
    kept = scratch.table(slim.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("c")).filter("c > 1 and refers_to is not null").drop("c"), "payloads")
    revisits = scratch.table(slim.join(kept, "digest").filter("id <> refers_to").select("id", "digest", "refers_to").distinct(), "revisits")
    roles = rows.join(revisits, ["id", "digest"], "left").select("id", "url", "html", "digest", "refers_to")
    folder = scratch.fresh(spark, "warc")
    return scratch.table(roles.mapInArrow(partial(_written, folder=folder), INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every
    record, read from the bundles; responses' sizes and digests are computed
    from the payloads read."""
    paths = scratch.table(index.select("path").distinct(), "paths")
    dealt = paths.repartition(max(1, paths.count()), "path")
    return dealt.mapInArrow(_read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(path: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record by its index row."""
    with _open(path, False) as source:
        return next(parse(BundleReader(source).frame(frame)[offset : offset + length]))
