"""Token ids of documents in sorted-string-table shards.

Documents are dealt to shards by ranges of their id. A shard is one file: blocks of entries in
ascending key order with prefix-compressed keys, a sparse index with the first key of every block,
a Bloom filter over all keys and a footer of fixed size. A document is found by its shard's key
range, the Bloom filter, a binary search of the index and one block.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_store, parallelism, rows_of, stored, text_of
from .tokens import encoder, sliced_array

MAGIC = b"LRSSTAB1"
FOOTER = struct.Struct("<QQQQQQII8s")  # index at, size; filter at, size; documents; ids; id width; hashes; magic
BLOCK_HEAD = struct.Struct("<II")  # entries, crc32 of what follows
INDEX_ENTRY = struct.Struct("<QI")  # block at, size
MANIFEST = "shard int, part int, path string, n_docs long, n_ids long, first_key binary, last_key binary"


def key_of(doc_id: int | str | None) -> bytes:
    """Keys sort as bytes just as ids do; a null id sorts first."""
    if doc_id is None:
        return b""
    return b"\x01" + (doc_id.encode() if isinstance(doc_id, str) else struct.pack(">Q", doc_id + (1 << 63)))


def id_of(key: bytes, text_ids: bool) -> int | str | None:
    if not key:
        return None
    return key[1:].decode() if text_ids else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _filter_bits(points: bytes, hashes: int, bits: int) -> np.ndarray:
    """The bits of keys by their 16-byte hashes, ``hashes`` for each."""
    a, b = (np.frombuffer(points, dtype="<u8")[k::2] % np.uint64(bits) for k in range(2))
    return ((a[None] + np.arange(hashes, dtype=np.uint64)[:, None] * (b[None] + np.uint64(1))) % np.uint64(bits)).astype(np.int64).ravel()


class ShardWriter:
    """Writes one shard; at most one block of entries is held, besides index and hashes of keys."""

    def __init__(self, path: str, width: int, block_bytes: int, bits_per_key: int = 10, hashes: int = 7):
        self.path, self.width, self.block_bytes, self.bits_per_key, self.hashes = path, width, block_bytes, bits_per_key, hashes
        store, at = open_store(path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(at, compression=None)
        self.index: list[tuple[bytes, int, int]] = []
        self.points: list[bytes] = []
        self.block: list[bytes] = []
        self.entries = self.size = self.at = self.n_docs = self.n_ids = 0
        self.first = self.last = b""

    def add(self, key: bytes, value: bytes) -> None:
        """An entry: its key and its ids, little-endian, ``width`` bytes each."""
        if not self.n_docs:
            self.first = key
        elif key < self.last:
            raise ValueError("keys must ascend")
        if self.size >= self.block_bytes:
            self.flush()
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.block_key = key
        self.block += [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self.size += len(value) + len(key)
        self.entries += 1
        if key != self.last or not self.n_docs:
            self.points.append(hashlib.blake2b(key, digest_size=16).digest())
        self.last = key
        self.n_docs += 1
        self.n_ids += len(value) // self.width

    def flush(self) -> None:
        if self.entries:
            body = b"".join(self.block)
            data = BLOCK_HEAD.pack(self.entries, zlib.crc32(body)) + body
            self.index.append((self.block_key, self.at, len(data)))
            self.put(data)
            self.block, self.entries, self.size = [], 0, 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[str, int, int, bytes, bytes]:
        self.flush()
        index_at = self.at
        self.put(b"".join(_varint(len(k)) + k + INDEX_ENTRY.pack(at, n) for k, at, n in self.index))
        filter_at, bits = self.at, max(64, len(self.points) * self.bits_per_key)
        bloom = np.zeros(bits, dtype=bool)
        bloom[_filter_bits(b"".join(self.points), self.hashes, bits)] = True
        self.put(struct.pack("<Q", bits) + np.packbits(bloom).tobytes())
        self.put(FOOTER.pack(index_at, filter_at - index_at, filter_at, self.at - filter_at, self.n_docs, self.n_ids, self.width, self.hashes, MAGIC))
        self.out.close()
        return self.path, self.n_docs, self.n_ids, self.first, self.last


class Shard:
    """Reads a shard: in order, a block at a time, or one document."""

    def __init__(self, path: str):
        store, at = open_store(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        self.index_at, index_size, self.filter_at, self.filter_size, self.n_docs, self.n_ids, self.width, self.hashes, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        data, at = self.read(self.index_at, index_size), 0
        self.keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.keys.append(data[at : at + n])
            self.blocks.append(INDEX_ENTRY.unpack_from(data, at + n))
            at += n + INDEX_ENTRY.size

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self.read(*self.blocks[k])
        entries, crc = BLOCK_HEAD.unpack_from(data)
        if zlib.crc32(memoryview(data)[BLOCK_HEAD.size :]) != crc:
            raise ValueError(f"block {k} is damaged")
        at, key = BLOCK_HEAD.size, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, dtype="<u2" if self.width == 2 else "<u4", count=size // self.width, offset=at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_have(self, key: bytes) -> bool:
        data = self.read(self.filter_at, self.filter_size)
        bits = struct.unpack_from("<Q", data)[0]
        return all(data[8 + (b >> 3)] >> (7 - (b & 7)) & 1 for b in _filter_bits(hashlib.blake2b(key, digest_size=16).digest(), self.hashes, bits).tolist())

    def get(self, key: bytes) -> np.ndarray | None:
        """The ids of the first document with this key."""
        if not self.may_have(key):
            return None
        k = max(0, bisect.bisect_left(self.keys, key) - 1)
        while k < len(self.keys) and self.keys[k] <= key:
            for found, ids in self.block(k):
                if found == key:
                    return ids
            k += 1
        return None

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, width: int = 2, shards: int | None = None, block_bytes: int = 1 << 16, shard_bytes: int = 1 << 28) -> DataFrame:
    """Encode whole texts, write them in ascending id order, and return the manifest of the shards.

    A null text is empty; ``end_id`` is appended to each document. Rows that repeat an id stand next
    to each other, ordered by their text's hash, and are spread over ranges by it. A null id comes
    first. Ids of more than ``width`` bytes are an error. A very long text is one entry of one block,
    whatever its length. A range is closed and goes on in a new file at ``shard_bytes``, so a writer
    holds the index of that much. An empty table gives an empty manifest. Other columns are not read.
    A file's name is new, so a task that runs twice does no harm: the manifest has the file of the
    attempt that counted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    # Text is dealt out, not ids: these take about as many bytes, and the sample for the ranges would encode.
    rows = rows.repartitionByRange(shards or parallelism(spark), "_id", "_tie").sortWithinPartitions("_id", "_tie")
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, encode = None, [], encoder(tokenizer).encode_array
        for batch in batches:
            keys, texts = rows_of(batch, "_id")[0], batch.column(1).cast(pa.large_string())
            for a, b in sliced_array(texts):
                ids, sizes = encode(texts.slice(a, b - a))
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                if width == 2 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("an id needs more than two bytes")
                data = ids.astype("<u2" if width == 2 else "<u4").tobytes()
                ends = (width * np.cumsum(sizes)).tolist()
                for key, start, end in zip(keys[a:b], [0, *ends], ends, strict=False):
                    out = out or ShardWriter(f"{path}/{uuid.uuid4().hex}.sst", width, block_bytes)
                    out.add(key_of(key), data[start:end])
                    if out.at >= shard_bytes:
                        done.append(out.close())
                        out = None
        if out is not None:
            done.append(out.close())
        shard = TaskContext.get().partitionId()
        for part, row in enumerate(done):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, part, *row), kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return stored(rows.mapInArrow(write, MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame, *, id_col: str = "doc_id", text_ids: bool = False) -> DataFrame:
    """One row per document, read from the files a block at a time: its id, start (ids of all
    documents before it), n_tokens, ids_crc32 and path."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row is a whole file
    places = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "base")
    kind, arrow = ("string", pa.string()) if text_ids else ("long", pa.int64())
    kinds = (arrow, pa.int64(), pa.int64(), pa.int64(), pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*rows_of(batch, "path", "base"), strict=True):
                shard = Shard(path)
                for k in range(len(shard.blocks)):
                    rows = []
                    for key, ids in shard.block(k):
                        rows.append((id_of(key, text_ids), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32", "path"])
                shard.close()

    return places.repartition(parallelism(manifest.sparkSession)).mapInArrow(read, f"{id_col} {kind}, start long, n_tokens long, ids_crc32 long, path string")


def look_up(manifest: DataFrame, doc_id: int | str) -> list[int] | None:
    """The ids of one document, read from the one block that can have it."""
    key = key_of(doc_id)
    for row in manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("shard", "part").toLocalIterator():
        shard = Shard(row["path"])
        ids = shard.get(key)
        shard.close()
        if ids is not None:
            return ids.tolist()
    return None
