"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC/1.1 records. Two
skippable frames follow: a record index (record id, frame number, offset in the frame, length) and
the seek table of the Zstandard seekable format (compressed and plain size of each frame). A record
is found by reading the footer, the two tables and one frame.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import look_up, open_store, parallelism, rows_of, scratch, stored, text_of

# Fixed values of the Zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
SEEK_FOOTER = struct.Struct("<IBI")

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_frames long, n_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, frame long, frame_offset long, record_bytes long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = urn[len("<urn:page:") : -1] if urn else ""
    return int(found) if found else None


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; control characters of the URL are percent-encoded."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    block = b"\r\n".join(http) + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record that starts at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : body - 4].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    end = body + int(headers["Content-Length"])
    return headers, data[body:end], end + 4


class BundleWriter:
    """Writes one bundle; at most one frame of plain records is held."""

    def __init__(self, path: str, frame_bytes: int, level: int):
        self.path, self.frame_bytes = path, frame_bytes
        self.store, self.at = open_store(path)
        self.store.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.at, compression=None)
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.plain = self.written = 0

    def add(self, key: str, record: bytes) -> None:
        self.index.append((key, len(self.frames), self.plain, len(record)))
        self.open.append(record)
        self.plain += len(record)
        if self.plain >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.put(frame)
            self.frames.append((len(frame), self.plain))
            self.open, self.plain = [], 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def close(self) -> tuple[str, int, int, int]:
        self.flush()
        index = self.packer.compress("\n".join(json.dumps(x) for x in self.index).encode())
        self.put(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = b"".join(struct.pack("<II", *x) for x in self.frames) + SEEK_FOOTER.pack(len(self.frames), 0, SEEKABLE_MAGIC)
        self.put(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.out.close()
        return self.path, len(self.index), len(self.frames), self.written


class Bundle:
    """Reads a bundle through its footer; frames are read one at a time."""

    def __init__(self, path: str):
        self.path = path
        store, at = open_store(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        n, _, magic = SEEK_FOOTER.unpack(self.read(size - SEEK_FOOTER.size, SEEK_FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.read(size - SEEK_FOOTER.size - 8 * n, 8 * n)
        self.frames, start = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((start, packed, plain))
            start += packed
        self.index_at = start

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        start, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.read(start, packed), max_output_size=plain)

    def index(self) -> list[tuple[str, int, int, int]]:
        magic, length = struct.unpack("<II", self.read(self.index_at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"{self.path} has no record index")
        packed = zstandard.ZstdDecompressor().decompressobj().decompress(self.read(self.index_at + 8, length))
        return [tuple(json.loads(x)) for x in packed.decode().splitlines()]

    def record(self, key: str) -> tuple[dict, bytes] | None:
        """The first record with this id, read from its frame alone."""
        for found, frame, offset, _ in self.index():
            if found == key:
                return parse_record(self.frame(frame), offset)[:2]
        return None

    def close(self) -> None:
        self.file.close()


def payload_key(html: str) -> Column:
    payload = text_of(html).cast("binary")
    return F.struct(F.octet_length(payload).alias("n"), F.sha1(payload).alias("a"), F.sha2(payload, 256).alias("b"))


def revisit_plan(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """page_id, _key and _best of the pages that revisit another: the largest page_id with the same
    payload.

    Payloads of fewer than ``min_bytes`` bytes form no groups. Equal payloads are those with equal
    length, SHA-1 and SHA-256. Groups are combined before the shuffle (a group is one row a task),
    and only digests, not payloads, meet by key; those of large groups (an empty page) do not.
    """
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), payload_key("html").alias("_key")).where(F.col("_key.n") >= min_bytes)
    groups = stored(keys.groupBy("_key").agg(F.max("page_id").alias("_best"), F.count(F.lit(1)).alias("_n")), "payloads")
    return look_up(keys, groups.where("_n > 1"), ["_key"], count="_n").where("page_id <> _best").select("page_id", "_key", "_best").distinct()


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 28, level: int = 3) -> DataFrame:
    """Write a record for every row (page_id, url, html) and return the manifest of the bundles.

    A null html is an empty payload, a null url is left out. Of equal payloads of at least
    ``min_bytes`` bytes the one with the largest page_id is a response, the others revisit it; rows
    that repeat that page_id with that payload are all responses. One page_id with several payloads
    gives a record for each, judged by its own payload. A row without page_id is a response with an
    empty record number. A very long payload is one record of one frame. An empty table gives an
    empty manifest; other columns are not read. Bundles get new names, and the manifest lists those
    of tasks that succeeded, so a task that runs twice does no harm.
    """
    plan = revisit_plan(pages, min_bytes=min_bytes)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"), payload_key("html").alias("_key"))
    rows = rows.join(plan, ["page_id", "_key"], "left").select("page_id", "url", "html", "_best")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, size = None, [], 0
        for batch in batches:
            for page_id, url, html, best in zip(*rows_of(batch, "page_id", "url", "html", "_best"), strict=True):
                if out is None:
                    out, size = BundleWriter(f"{path}/{uuid.uuid4().hex}.warc.zst", frame_bytes, level), 0
                record = build_record(page_id, url, html.encode(), best, best is not None)
                out.add(record_id(page_id), record)
                size += len(record)
                if size >= bundle_bytes:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "n_records", "n_frames", "n_bytes"])

    return stored(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row per record of the bundles listed, with its place; digests are checked on the way."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for path in rows_of(batch, "path")[0]:
                bundle = Bundle(path)
                for k in range(len(bundle.frames)):
                    data, at, rows = bundle.frame(k), 0, []
                    while at < len(data):
                        head, block, end = parse_record(data, at)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (sha1_base32(payload), len(payload)) != (digest, size):
                            raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} is damaged")
                        rows.append((page_of(head["WARC-Record-ID"]), size, digest, kind, page_of(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), path, k, at, end - at))
                        at = end
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                bundle.close()

    n = parallelism(manifest.sparkSession)
    return manifest.repartition(n).mapInArrow(read, RECORDS)


def archive_pages(spark: SparkSession, pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to new bundles in the shared folder and read every record back."""
    return read_warc(write_warc(pages, scratch(spark, "warc"), min_bytes=min_bytes))
