"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if it is covered by a string of ``span`` bytes that also starts in a document with a
smaller id. The suffixes of all documents are dealt to buckets and sorted a bucket at a time:

1. Anchor of a suffix: the least hash of the 16-byte strings in its first ``span`` bytes. Equal
   strings share it, and so do most neighbours, so a run of neighbouring suffixes is one segment of
   text, not one row a suffix. A first pass sends only anchors: what no second document has cannot
   repeat. Segments with shared anchors are dealt to buckets by anchor. Before the shuffle, of equal
   segments of one batch of documents only that of the smallest id is sent, as in any partial
   aggregate; the others are repeats of it. The bucket combines those of several batches alike.
2. A bucket is sorted by itself. The positions of a difference cover modulo 8 (half of all) are
   ranked first, by prefix doubling. Suffixes are sorted by their first 8 bytes; ties that span
   documents are resolved by the ranks: of any two suffixes some shift below 8 leads both to the
   cover. Strings of ``span`` bytes repeat where neighbours in this order share so many. Memory is
   bounded by the bucket, whose size is a parameter.
3. The repeated runs of each document are merged and cut out of its text.

Everything is exact: hashes only choose buckets and what to leave out of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, rows_of, text_of

SPAN = 50
ANCHOR = 16
PERIOD = 8
COVER = np.array([True, True, True, False, True, False, False, False])  # 0, 1, 2, 4: each difference modulo 8 occurs
NO_ID = np.iinfo(np.int64).max
BLOCK = 1 << 18
BATCH = 8 << 20
BUCKET = 12 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def words_at(data: bytes) -> np.ndarray:
    """The eight bytes at each position as a number; after the end stand zeros."""
    n = len(data)
    padded = data + bytes(16)
    out = np.empty((n + 7) // 8 * 8, dtype="<u8")
    for r in range(8):
        out[r::8] = np.frombuffer(padded, dtype="<u8", count=len(out) // 8, offset=r)
    return out[:n]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _A) ^ (b * _B)
    h ^= h >> np.uint64(29)
    h *= _C
    return h ^ (h >> np.uint64(32))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def anchors(data: bytes, span: int) -> np.ndarray:
    """For each suffix of at least ``span`` bytes the least hash of an ANCHOR in its beginning."""
    w = words_at(data)
    return _least(_mixed(w[: len(w) - 15], w[8 : len(w) - 7]), span - ANCHOR + 1)


# ---- packing of numbers and texts -----------------------------------------------------------


def packed(*columns: np.ndarray, text: bytes = b"") -> bytes:
    """Columns of equal length as differences, by bytes, and a text; compressed."""
    n = len(columns[0])
    parts = [np.array([n, len(columns), len(text)], dtype="<i8").tobytes()]
    for c in columns:
        parts.append(np.ascontiguousarray(np.diff(c.astype("<i8"), prepend=0).view(np.uint8).reshape(n, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*parts, text]))


def unpacked(data: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, k, _ = np.frombuffer(raw, dtype="<i8", count=3)
    columns = [np.cumsum(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=8 * n, offset=24 + 8 * n * i).reshape(8, n).T).view("<i8").ravel()) for i in range(k)]
    return columns, raw[24 + 8 * n * k :]


# ---- segments -------------------------------------------------------------------------------


def segments_of(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of some texts: anchor, place of the text, start, number of suffixes."""
    out: list[tuple] = []

    def block(part: list[tuple[int, int, bytes]]) -> None:
        data = b"".join(t for *_, t in part)
        if len(data) < span:
            return
        least = anchors(data, span)
        begin = np.cumsum([0, *(len(t) for *_, t in part)])
        owner = np.repeat(np.arange(len(part)), np.diff(begin))[: len(least)]
        at = np.flatnonzero(np.arange(len(least)) + span <= begin[owner + 1])
        if not len(at):
            return
        who, value = owner[at], least[at]
        first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (who[1:] != who[:-1])])
        start, who = at[first], who[first]
        out.append((value[first], np.array([p[0] for p in part], dtype=np.int64)[who], start - begin[who] + np.array([p[1] for p in part], dtype=np.int64)[who], np.diff(np.r_[first, len(at)])))

    part, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - span + 1), BLOCK):  # suffixes of long texts in blocks
            part.append((i, at, text[at : at + BLOCK + span - 1]))
            size += len(part[-1][2])
            if size >= BLOCK:
                block(part)
                part, size = [], 0
    block(part)
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def short_anchors(anchor: np.ndarray) -> np.ndarray:
    """Anchors as 40-bit numbers; that two may meet costs work, never results."""
    return ((anchor * _A) >> np.uint64(24)).astype(np.int64)


def repeated_here(ids: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Segments that an earlier one equals whose id is smaller; ids ascend."""
    first: dict[bytes, int] = {}
    owner = np.fromiter(map(first.setdefault, pieces, range(len(pieces))), dtype=np.int64, count=len(pieces))
    return ids[owner] < ids


# ---- one bucket -----------------------------------------------------------------------------


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins; rows stand in order."""
    first = np.zeros(len(sorted_columns[0]), dtype=bool)
    first[:1] = True
    for c in sorted_columns:
        first[1:] |= c[1:] != c[:-1]
    return first


def _back(first: np.ndarray) -> np.ndarray:
    """For each row the place where its run begins."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _several(first: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Rows in whose run stands more than one document."""
    begin = np.flatnonzero(first)
    if not len(begin):
        return first
    more = np.minimum.reduceat(docs, begin) < np.maximum.reduceat(docs, begin)
    return more[np.cumsum(first) - 1]


def cover_place(at: np.ndarray) -> np.ndarray:
    """The number of a position of the cover among all of them; eight bytes on is four places on."""
    return at // PERIOD * COVER.sum() + (np.cumsum(COVER) - 1)[at % PERIOD]


def cover_ranks(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the positions of the cover, in order of place, by at least ``depth`` bytes from there.

    Only places in the first ``depth`` bytes of the suffixes at ``at`` are ranked; others have 0 and
    can decide only what lies beyond. ``words`` are in the order of their bytes. Eight bytes are
    sorted, then ties by the ranks found so far of what follows, twice as far in each round. A text
    that ends first is less.
    """
    n = len(words)
    near = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + depth, n), minlength=n + 1))[:n] > 0
    cover = np.flatnonzero(COVER[np.arange(n) % PERIOD])
    head = words[cover]
    order = np.flatnonzero(near[cover])
    order = order[np.argsort(head[order])]
    first = _starts(head[order])
    rank = np.zeros(len(head), dtype=np.int64)
    rank[order] = _back(first)
    left, reach, n = order[~(first & np.r_[first[1:], True])], PERIOD, len(head)
    while len(left) and reach < depth:
        ahead = left + reach // PERIOD * COVER.sum()
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n - 1 - ahead)
        by = np.argsort(rank[left] * (2 * n + depth) + after)
        left, after = left[by], after[by]
        own = rank[left]
        group, first = _starts(own), _starts(own, after)
        rank[left] = own + _back(first) - _back(group)
        left = left[~(first & np.r_[first[1:], True])]
        reach *= 2
    return rank


def suffix_order(at: np.ndarray, block: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The order of the suffixes at ``at``, whose first 8 bytes ``block`` has in order.

    Suffixes of one residue modulo 8 are sorted by block and the rank at their next place of the
    cover. The eight lists are merged by counting: of two residues some shift below 8 leads both to
    the cover. Suffixes alike to the depth of the ranks stand together, in any order.
    """

    def key(rows: np.ndarray, shift: int) -> np.ndarray:
        return block[rows] * (len(ranks) + 1) + ranks[cover_place(at[rows] + shift)]

    lists, place = [], np.empty(len(at), dtype=np.int64)
    for r in range(PERIOD):
        rows = np.flatnonzero(at % PERIOD == r)
        own = key(rows, next(x for x in range(PERIOD) if COVER[(r + x) % PERIOD]))
        lists.append(rows[np.argsort(own)])
        place[lists[r]] = np.arange(len(rows))
    for r in range(PERIOD):
        for q in range(r):
            shift = next(x for x in range(PERIOD) if COVER[(r + x) % PERIOD] and COVER[(q + x) % PERIOD])
            mine, other = key(lists[r], shift), key(lists[q], shift)
            place[lists[r]] += np.searchsorted(np.sort(other), mine)
            place[lists[q]] += np.searchsorted(np.sort(mine), other)
    return np.argsort(place)


def alike(words: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Whether the common prefix of the texts at ``a`` and ``b`` has at least ``span`` bytes."""
    same = words[a] == words[b]
    for k in [span - 8, *range(8, span - 8, 8)]:
        on = np.flatnonzero(same)
        same[on] = words[a[on] + k] == words[b[on] + k]
    return same


def repeated_suffixes(data: bytes, at: np.ndarray, docs: np.ndarray, span: int) -> np.ndarray:
    """Which of the suffixes at ``at`` begin with ``span`` bytes that a smaller document also has.

    Suffixes that may are put in order, where equal beginnings are neighbours.
    """
    words = words_at(data).byteswap()  # in the order of the bytes
    hit = np.zeros(len(at), dtype=bool)
    # what shares its first and last 8 bytes with no second document cannot repeat
    ends = _mixed(words[at], words[at + span - 8])
    order = np.argsort(ends)
    several = _several(_starts(ends[order]), docs[order])
    order = order[several]
    if not len(order):
        return hit
    order = order[np.argsort(words[at[order]])]
    block = np.cumsum(_starts(words[at[order]])) - 1
    order = order[suffix_order(at[order], block, cover_ranks(words, at[order], span))]
    where = at[order]
    begin = np.flatnonzero(np.r_[True, ~alike(words, where[1:], where[:-1], span)])
    least = np.minimum.reduceat(docs[order], begin)
    hit[order] = docs[order] > np.repeat(least, np.diff(np.r_[begin, len(order)]))
    return hit


def bucket_repeats(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, text: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments of one bucket that have repeats: place of the segment, start and end."""
    size = counts + span - 1
    begin = np.cumsum(size) - size
    order = np.argsort(ids, kind="stable")
    pieces = [text[a : a + n] for a, n in zip(begin[order].tolist(), size[order].tolist(), strict=True)]
    old = repeated_here(ids[order], pieces)  # what several batches sent is combined once more
    whole, left = order[old], order[~old]
    text = b"".join([pieces[k] for k in np.flatnonzero(~old).tolist()])
    begin = np.cumsum(size[left]) - size[left]
    owner = np.repeat(np.arange(len(left)), counts[left])
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts[left]) - counts[left], counts[left])
    hit = np.flatnonzero(repeated_suffixes(text, begin[owner] + step, ids[left][owner], span))
    first = np.flatnonzero(_starts(hit - np.arange(len(hit)), owner[hit]))
    last = np.r_[first[1:], len(hit)][: len(first)] - 1
    who = left[owner[hit[first]]]
    return np.r_[whole, who], np.r_[starts[whole], starts[who] + step[hit[first]]], np.r_[starts[whole] + size[whole], starts[who] + step[hit[last]] + span]


# ---- Spark ----------------------------------------------------------------------------------

MOVED = "bucket int, kind int, slice long, blob binary"
DATA, FOUND, NAMES = range(3)  # for a bucket; found for rows of a slice; ids and ties of a slice


def _record(bucket: int, kind: int, piece: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([piece], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "kind", "slice", "blob"])


def _target(piece: int, targets: int) -> int:
    return (piece * 0x9E3779B97F4A7C15 >> 24 & 0xFFFFFFFF) % targets


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
    return zip(cuts, [*cuts[1:], len(keys)], strict=False)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Batches of documents of about BATCH bytes, ordered by id and tie, with a number that any run
    of the same task gives them."""
    held, size, number = [], 0, 0
    for batch in batches:
        plain = [batch.column(k).to_pylist() for k in range(2)]
        more = [[x.as_buffer().to_pybytes() for x in batch.column(k)] for k in range(2, batch.num_columns)]
        for row in zip(*plain, *more, strict=True):
            held.append(row)
            size += len(row[2])
            if size >= BATCH:
                yield TaskContext.get().partitionId() << 32 | number, sorted(held, key=lambda x: x[:2])
                held, size, number = [], 0, number + 1
    if held:
        yield TaskContext.get().partitionId() << 32 | number, sorted(held, key=lambda x: x[:2])


def _columns(rows: list[tuple]) -> list[np.ndarray]:
    return [np.array([x[k] for x in rows], dtype=np.int64) for k in range(2)]


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Records with equal keys, which stand together."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        for r in zip(*rows_of(batch, "bucket", "kind", "slice", "blob"), strict=True):
            key = tuple(r[{"bucket": 0, "slice": 2}[k]] for k in keys)
            if key != now and held:
                yield held
                held = []
            now = key
            held.append(r)
    if held:
        yield held


def _by_slice(df: DataFrame) -> DataFrame:
    return df.repartition(parallelism(df.sparkSession), "bucket").sortWithinPartitions("bucket", "slice")


def shared_anchors(rows: DataFrame, span: int, buckets: int, targets: int) -> DataFrame:
    """_id, _tie and _shared (short anchors, packed) of texts with anchors that others have."""

    width = (((1 << 40) // buckets).bit_length() + 7) // 8  # bytes of what the bucket leaves open

    def short(numbers: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, docs in _sliced(batches):
            target = _target(number, targets)
            yield _record(target, NAMES, number, packed(*_columns(docs)))
            anchor, row, *_ = segments_of([x[2] for x in docs], span)
            anchor = short_anchors(anchor)
            order = np.lexsort((row, anchor))
            anchor, row = anchor[order], row[order]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
            anchor, row = anchor[new], row[new]
            first = np.r_[True, anchor[1:] != anchor[:-1]] if len(row) else np.zeros(0, bool)
            several = ~first
            several[:-1] |= ~first[1:]
            if several.any():
                yield _record(target, FOUND, number, packed(row[several], anchor[several]))
            anchor, row = anchor[first], row[first]
            bucket = anchor % buckets
            order = np.lexsort((row, bucket))
            anchor, row, bucket = anchor[order] // buckets, row[order], bucket[order]
            for a, b in _runs(bucket):
                yield _record(int(bucket[a]), DATA, number, packed(row[a:b], text=short(anchor[a:b]).tobytes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "bucket"):
            data = [r for r in group if r[1] == DATA]
            yield from (_record(*r) for r in group if r[1] != DATA)
            if len(data) < 2:
                continue
            parts = [unpacked(r[3]) for r in data]
            raw = [np.frombuffer(p[1], dtype=np.uint8).reshape(-1, width) for p in parts]
            row = np.concatenate([p[0][0] for p in parts])
            anchor = np.pad(np.concatenate(raw), ((0, 0), (0, 8 - width))).view("<i8").ravel() * buckets + group[0][0]
            source = np.repeat(np.arange(len(data)), [len(x) for x in raw])
            _, at, n = np.unique(anchor, return_inverse=True, return_counts=True)
            hit = np.flatnonzero(n[at] > 1)  # a slice sends an anchor once
            for a, b in _runs(source[hit]):
                number = data[source[hit[a]]][2]
                yield _record(_target(number, targets), FOUND, number, packed(row[hit[a:b]], anchor[hit[a:b]]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "bucket", "slice"):
            names = next(unpacked(r[3])[0] for r in group if r[1] == NAMES)
            found = [unpacked(r[3])[0] for r in group if r[1] == FOUND]
            if not found:
                continue
            row, anchor = (np.concatenate([f[k] for f in found]) for k in range(2))
            order = np.lexsort((anchor, row))
            row, anchor = row[order], anchor[order]
            cuts = list(_runs(row))
            own = row[[a for a, _ in cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(names[0][own]), pa.array(names[1][own]), pa.array([packed(anchor[a:b]) for a, b in cuts], pa.binary())], names=["_id", "_tie", "_shared"])

    dealt = rows.mapInArrow(deal, MOVED).repartition(parallelism(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    found = _by_slice(dealt.mapInArrow(count, MOVED)).mapInArrow(merge, "_id long, _tie long, _shared binary")
    return found.dropDuplicates(["_id", "_tie"])  # equal rows have equal anchors


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _tie, _text: all that is needed of documents, so that one shuffle by id serves two joins."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("_id"), F.xxhash64(text_of(text_col)).alias("_tie"), text_of(text_col).cast("binary").alias("_text"))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Runs to remove: doc_id, tie (the hash that tells texts with one id apart), starts and ends
    (arrays of byte offsets), for texts that have any. ``span`` is at least ANCHOR bytes."""
    if span < ANCHOR:
        raise ValueError(f"span must be at least {ANCHOR} bytes")
    spark = docs.sparkSession
    rows = _texts(docs, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    buckets = max(parallelism(spark), 4 * total // BUCKET)
    targets = max(parallelism(spark), total // BUCKET)
    shared = shared_anchors(rows, span, buckets, targets)
    # in order, as slices are numbered by it: a task that runs again after a join may get its rows in another
    marked = rows.join(shared, ["_id", "_tie"]).select("_id", "_tie", "_text", "_shared").sortWithinPartitions("_id", "_tie")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _sliced(batches):
            target = _target(number, targets)
            names = _columns(held)
            yield _record(target, NAMES, number, packed(*names))
            texts = [x[2] for x in held]
            anchor, row, start, count = segments_of(texts, span)
            known = np.concatenate([unpacked(x[3])[0][0] | k << 40 for k, x in enumerate(held)])
            key = short_anchors(anchor) | row << 40
            at = np.searchsorted(known, key)
            live = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == key)) if len(known) else np.zeros(0, dtype=np.int64)
            if not len(live):
                continue
            anchor, row, start, count = anchor[live], row[live], start[live], count[live]
            pieces = [texts[i][a : a + n] for i, a, n in zip(row.tolist(), start.tolist(), (count + span - 1).tolist(), strict=True)]
            old = repeated_here(names[0][row], pieces)
            if old.any():
                yield _record(target, FOUND, number, packed(row[old], start[old], start[old] + count[old] + span - 1))
            left = np.flatnonzero(~old)
            bucket = (anchor[left] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for a, b in _runs(bucket[order]):
                mine = left[order[a:b]]
                yield _record(int(bucket[order[a]]), DATA, number, packed(names[0][row[mine]], row[mine], start[mine], count[mine], text=b"".join([pieces[k] for k in mine.tolist()])))

    def sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "bucket"):
            data = [r for r in group if r[1] == DATA]
            yield from (_record(*r) for r in group if r[1] != DATA)
            if not data:
                continue
            parts = [unpacked(r[3]) for r in data]
            ids, row, start, count = (np.concatenate([p[0][k] for p in parts]) for k in range(4))
            source = np.repeat(np.arange(len(data)), [len(p[0][0]) for p in parts])
            who, begin, end = bucket_repeats(ids, start, count, b"".join(p[1] for p in parts), span)
            order = np.argsort(who, kind="stable")
            who, begin, end = who[order], begin[order], end[order]
            for a, b in _runs(source[who]):
                number = data[source[who[a]]][2]
                yield _record(_target(number, targets), FOUND, number, packed(row[who[a:b]], begin[a:b], end[a:b]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "bucket", "slice"):
            names = next(unpacked(r[3])[0] for r in group if r[1] == NAMES)
            found = [unpacked(r[3])[0] for r in group if r[1] == FOUND]
            if not found:
                continue
            row, start, end = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            far = int(end.max()) + 1
            reach = np.maximum.accumulate(end + row * far) - row * far  # the farthest end in its text so far
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1])])
            last = np.r_[first[1:], len(row)] - 1
            own = np.flatnonzero(np.r_[True, row[first[1:]] != row[first[:-1]]])
            cuts = pa.array(np.r_[own, len(first)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(names[0][row[first[own]]]), pa.array(names[1][row[first[own]]]), pa.ListArray.from_arrays(cuts, pa.array(start[first])), pa.ListArray.from_arrays(cuts, pa.array(reach[last]))], names=["doc_id", "tie", "starts", "ends"])

    dealt = marked.mapInArrow(deal, MOVED).repartition(parallelism(spark), "bucket").sortWithinPartitions("bucket")
    found = _by_slice(dealt.mapInArrow(sort_bucket, MOVED)).mapInArrow(merge, "doc_id long, tie long, starts array<long>, ends array<long>")
    return found.dropDuplicates(["doc_id", "tie"])  # equal rows lose the same bytes


def cut_out(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the
    remaining bytes, which may cut a character), starts and ends of the removed runs.

    A null text is empty. Strings are judged on the input. A row without id stands after all ids;
    rows with the same id, or without, remove nothing from each other. Texts below ``span`` bytes
    stay whole; very long texts are cut into blocks of suffixes. An empty table gives an empty
    result. Other columns are not read. The largest long is no id.
    """
    gone = repeats(docs, id_col=id_col, text_col=text_col, span=span).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "starts", "ends")
    rows = _texts(docs, id_col, text_col).join(gone, ["_id", "_tie"], "left")
    rows = rows.select(F.when(F.col("_id") != int(NO_ID), F.col("_id")).alias("doc_id"), "_text", "starts", "ends")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, ends array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept, begins, stops = [], [], [], [], [], [], []
            for text, starts, ends in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                text = text.as_buffer().to_pybytes()
                runs = list(zip(starts.as_py() or [], ends.as_py() or [], strict=True))
                edges = [0, *(x for run in runs for x in run), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else text
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                spans.append(len(runs))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
                begins.append([a for a, _ in runs])
                stops.append([b for _, b in runs])
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), pa.array(kept, pa.binary()), pa.array(begins, long), pa.array(stops, long)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "starts", "ends"])

    return rows.mapInArrow(cut, schema)
