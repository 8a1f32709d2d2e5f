"""Large files by byte ranges: the features of a collection, and digests.

A collection is one JSON value, so whether a byte range begins inside a text or how deep it lies depends on
all that stands before. Ranges are read twice. First each tells, for both cases, whether it leaves a text open
and by how many brackets it goes down or up; these few numbers, put together in order, give the state in
which every range begins. Then each range gives the features that begin in it, reading on to the end of the last.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a range, and what is held of it at once.
RANGE, CHUNK, LEAST = 32 << 20, 1 << 20, 1 << 12
#: Features lie in an array of the outermost object.
DEPTH = 2
#: Features that are passed on together.
BATCH = 500


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path or URI, and the path within it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _chunks(path: str, first: int, last: int | None = None, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """The bytes from ``first`` to before ``last``, or to the end, with their places, ``size`` at a time."""
    store, inner = open_store(path)
    with store.open_input_file(inner) as f:
        f.seek(first)
        at = first
        while last is None or at < last:
            data = f.read(size if last is None else min(size, last - at))
            if not data:
                return
            yield at, np.frombuffer(data, dtype=np.uint8)
            at += len(data)


def _slashes_before(path: str, first: int) -> int:
    """How many backslashes end just before ``first``."""
    n = 0
    while first - n > 0:
        low = max(0, first - n - 1024)
        data = b"".join(x.tobytes() for _, x in _chunks(path, low, first - n))
        run = len(data) - len(data.rstrip(b"\\"))
        n += run
        if run < len(data):
            break
    return n


def _marks(data: np.ndarray, slashes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each byte whether the quotes before it, within these bytes, are odd; its step in depth if it is no text; and how
    many backslashes end the bytes."""
    place = np.arange(len(data))
    last = np.maximum.accumulate(np.r_[-1 - slashes, np.where(data != 92, place, -1 - slashes)])  # of other bytes, before each
    quotes = (data == 34) & ((place - 1 - last[:-1]) % 2 == 0)
    odd = (np.cumsum(quotes) - quotes) % 2 == 1
    step = ((data == 123) | (data == 91)).astype(np.int64) - ((data == 125) | (data == 93))
    return odd, step, int(len(data) - 1 - last[-1])


def _summary(path: str, first: int, last: int) -> tuple[bool, int, int]:
    """Whether a range turns text into no text and back, and how much deeper it ends if it begins outside a text, or inside."""
    odd, depths, slashes = False, [0, 0], _slashes_before(path, first)
    for _, data in _chunks(path, first, last):
        inside, step, after = _marks(data, slashes)
        quoted = bool(inside[-1]) ^ bool(data[-1] == 34 and _closes(data, slashes))
        inside = inside ^ odd
        depths[0] += int(step[~inside].sum())
        depths[1] += int(step[inside].sum())
        odd, slashes = odd ^ quoted, after
    return odd, depths[0], depths[1]


def _closes(data: np.ndarray, slashes: int) -> bool:
    """Whether the last byte, a quote, is not escaped."""
    body = data[:-1].tobytes()
    run = len(body) - len(body.rstrip(b"\\"))
    return (run + (slashes if run == len(body) else 0)) % 2 == 0


def _features(path: str, first: int, last: int, inside: bool, depth: int) -> Iterator[bytes]:
    """The objects that begin in a range at the depth of features."""
    held: list[bytes] | None = None  # of an object that is open
    slashes = _slashes_before(path, first)
    for at, data in _chunks(path, first, size=min(CHUNK, max(LEAST, last - first))):  # not far beyond the range
        if at >= last and held is None:
            return
        odd, step, after = _marks(data, slashes)
        text = odd ^ inside
        deep = depth + np.cumsum(np.where(text, 0, step))
        begins = np.flatnonzero((data == 123) & ~text & (deep == DEPTH + 1))
        ends = np.flatnonzero((data == 125) & ~text & (deep == DEPTH))
        raw, done = data.tobytes(), 0
        for end in ends.tolist():
            if held is not None:
                yield b"".join([*held, raw[done : end + 1]])
                held = None
            else:
                here = begins[(begins >= done) & (begins < end)]
                if len(here) and at + here[0] < last:
                    yield raw[int(here[0]) : end + 1]
            done = end + 1
        if held is not None:
            held.append(raw[done:])
        else:
            open_ = begins[begins >= done]
            if len(open_) and at + open_[0] < last:
                held = [raw[int(open_[0]) :]]
        quoted = bool(odd[-1]) ^ bool(data[-1] == 34 and _closes(data, slashes))
        inside, depth, slashes = inside ^ quoted, int(deep[-1]), after


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def files_of(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of the files below ``path``; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def collection_features(spark: SparkSession, path: str, *, size: int = RANGE) -> DataFrame:
    """``value``: every feature of the collections below ``path``, as text, read by ranges of about ``size`` bytes. A task takes as many
    ranges as have RANGE bytes, or fewer where that leaves fewer tasks than shuffles have.

    The driver gets three numbers of each range."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            odd, outside, inside = _summary(r["path"], r["first"], r["last"])
            yield pa.RecordBatch.from_pylist([r | {"odd": odd, "outside": outside, "inside": inside}])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            found = []
            for x in _features(r["path"], r["first"], r["last"], r["text"], r["depth"]):
                found.append(x.decode("utf-8", "replace"))
                if len(found) == BATCH:
                    yield pa.RecordBatch.from_pydict({"value": found})
                    found = []
            yield pa.RecordBatch.from_pydict({"value": pa.array(found, pa.string())})

    files = files_of(spark, path).where("length > 0").collect()
    parts = [(f.path, at, min(at + size, f.length)) for f in files for at in range(0, f.length, size)]
    if not parts:
        return spark.createDataFrame([], "value string")
    tasks = min(len(parts), max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(f.length for f in files) // RANGE))
    ranges = spark.createDataFrame(parts, "path string, first long, last long").repartition(tasks)
    told = {(r.path, r.first): r for r in ranges.mapInArrow(summarise, "path string, first long, last long, odd boolean, outside long, inside long").collect()}
    begun, text, depth = [], False, 0
    for name, first, last in parts:
        text, depth = (False, 0) if first == 0 else (text, depth)
        begun.append((name, first, last, text, depth))
        r = told[name, first]
        depth += r.inside if text else r.outside
        text ^= r.odd
    begun = spark.createDataFrame(begun, "path string, first long, last long, text boolean, depth long").repartition(tasks)
    return begun.mapInArrow(cut, "value string")


def joined(spark: SparkSession, parts: str, target: str) -> None:
    """One file ``target`` of the files in the folder ``parts``, in order of their names, copied a piece at a time by one task."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(target)
        store.create_dir(os.path.dirname(inner))
        with store.open_output_stream(inner) as out:
            for path in sorted(r["path"] for r in _rows(batches)):
                for _, data in _chunks(path, 0):
                    out.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({"n": [1]})

    files_of(spark, parts, "part-*").select("path").coalesce(1).mapInArrow(copy, "n long").collect()


def streamed_digests(files: DataFrame) -> DataFrame:
    """path, length and sha256 of ``files`` (path, length), each read through in one task, a piece at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            h = hashlib.sha256()
            for _, data in _chunks(r["path"], 0):
                h.update(data.tobytes())
            yield pa.RecordBatch.from_pylist([{"path": r["path"], "length": r["length"], "sha256": h.hexdigest()}])

    return files.repartition("path").mapInArrow(digest, "path string, length long, sha256 string")
