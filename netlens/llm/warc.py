"""WARC records in seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames of about FRAME_BYTES each, then a skippable frame with the seek
table (sizes of every frame, number of frames, magic number at the very end). The index maps a record to its bundle,
frame and offset inside the frame, so one record costs one footer and one frame. Of records with equal payloads that
with the largest page_id is a response, others are revisits that carry its id and digest but no payload.

A bundle's name is unique to its attempt and only bundles in the written index exist for readers: a task that runs
again leaves an orphan, never a torn archive. Defined cases: null html is an empty payload; a null page_id is smaller
than all others; rows that repeat the response's page_id and payload are responses too, with one record id; a page_id with
several payloads has a record, and a record id, of each; a null url writes no target; other columns are ignored; an empty
table gives an empty index. A very long page is one record in a frame of its own and takes some copies of its size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import Scratch, bounded, small_batches

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 26, 3
#: The date of records, where none is given, so that runs agree.
DATE = "1970-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, offset long, length long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _ident(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{payload_digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; refers_to makes it a revisit."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block, own = http if revisit else http + payload, digest(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_ident(page_id, own)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []),
        f"WARC-Payload-Digest: sha1:{own}",
        *([f"WARC-Refers-To: {_ident(refers_to, own)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record, from its own bytes: a response's size and digest come from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    ident = re.search(r"<urn:page:(-?\d*):", fields["WARC-Record-ID"])[1]
    out = {"page_id": int(ident) if ident else None, "record_type": fields["WARC-Type"], "refers_to": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = int(re.search(r"<urn:page:(-?\d+):", fields["WARC-Refers-To"])[1])
        out["payload_bytes"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
        out["payload_digest"] = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    else:
        out |= {"payload_bytes": len(payload), "payload_digest": digest(payload)}
        if fields["WARC-Payload-Digest"] != f"sha1:{out['payload_digest']}":
            raise ValueError(f"page {ident}: the payload differs from its digest")
    return out


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, sink):
        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=LEVEL)
        self.sizes, self.frame, self.written = [], bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset inside it) of the record."""
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self._end()
        at = len(self.sizes), len(self.frame)
        self.frame += data
        return at

    def _end(self) -> None:
        packed = self.zip.compress(bytes(self.frame))
        self.sink.write(packed)
        self.sizes.append((len(packed), len(self.frame)))
        self.written += len(packed)
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._end()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Frames by number through the seek table; the last one read is kept."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", source.read(8 * count)))
        self.at, self.sizes, self.last = [0], sizes, (-1, b"")
        for packed, _ in sizes:
            self.at.append(self.at[-1] + packed)

    def close(self) -> None:
        self.source.close()

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            self.source.seek(self.at[frame])
            packed, plain = self.sizes[frame]
            self.last = frame, zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        return self.last[1][offset : offset + length]


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        bundle, name, rows = None, "", []
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(4)]
            for page_id, url, html, refers_to in zip(*cols, strict=True):
                if bundle is None or bundle.written >= BUNDLE_BYTES:
                    if bundle is not None:
                        bundle.close()
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None))
                data = record(page_id, url, html or b"", refers_to, date)
                rows.append((page_id, name, *bundle.add(data), len(data)))
        if bundle is not None:
            bundle.close()
        for lo in range(0, len(rows), 10_000):
            part = list(zip(*rows[lo : lo + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "bundle", "frame", "offset", "length"])

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        name, reader = None, None
        for b in batches:
            got = []
            for bundle, frame, offset, length in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if bundle != name:
                    if reader is not None:
                        reader.close()
                    name, reader = bundle, BundleReader(fs.open_input_file(f"{root}/{bundle}"))
                got.append(parse(reader.read(frame, offset, length)))
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], t) for c, t in kinds.items()], list(kinds))
        if reader is not None:
            reader.close()

    return run


def write_archives(pages: DataFrame, folder: str, index: str, least: int = 0, date: str = DATE) -> None:
    """Bundles of all pages into folder (which all executors see) and the index table at index. Payloads of fewer
    than `least` bytes are never revisits. Digests that occur twice are found by partial aggregates of ids; the pages
    themselves are written from their scan, unless those digests are too many to broadcast."""
    from pyarrow.fs import FileSystem

    s = Scratch(pages.sparkSession)
    small_batches(pages.sparkSession)
    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha1("html")))
    first = rows.where(F.length("html") >= least).groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1").select("key", "top")
    rows = rows.join(bounded(s.cut(first, "again", True)), "key", "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    rows.select("page_id", "url", "html", F.when(again, F.col("top")).alias("refers_to")).mapInArrow(_write(folder, date), INDEX).write.parquet(index)
    s.clear()


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the index."""
    return index.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives in the shared folder, read back and removed."""
    spark = pages.sparkSession
    s = Scratch(spark)
    folder, index = s.path("warc"), s.path("warc-index")
    write_archives(pages, folder, index)
    return s.finish(read_archives(spark.read.parquet(index), folder))
