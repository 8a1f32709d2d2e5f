"""SimHash near-deduplication with deletion-variant signatures.

Fingerprints of 64 bits that differ in at most ``distance`` bits are linked. They are cut into
fewer segments than an exact match would need: with ``distance // 2 + 1`` segments one of them
differs in at most one bit. Each segment is therefore indexed under as many variants as it has
bits, each with one bit deleted: two segments that differ in one bit share the variant without it.
Candidates are found by an equality join on the variants and verified on all 64 bits.

Documents with equal fingerprints are one node, so copies cost nothing. Within a bucket no pairs
are written: each bucket gives a forest that connects what is linked in it, at most one edge a
node. Nodes are then joined into components by rounds of star contraction over stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, parallelism, stored, text_of, unused

BITS = 64
SEED = 42
#: Members from which on a bucket is divided before it is compared.
REFINE = 64


# ---- fingerprints ---------------------------------------------------------------------------


def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of a text's shingles of ``width`` words; A-Z count as a-z; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), dtype=np.uint64, count=len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_key, which tells texts of one id
    apart; a null text is empty. Texts may be of any length: hashes are added up in blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes(), width) for x in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(1)], names=["doc_id", "fp", "text_key"])

    text = text_of(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("_text"))
    return slim.mapInArrow(work, "doc_id long, fp long, text_key long")


# ---- candidates and links -------------------------------------------------------------------


def segments_of(distance: int) -> list[tuple[int, int]]:
    """Lowest bit and length of each segment: as few as leave one with at most one differing bit."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def deletion_variants(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For every variant of every fingerprint: its number among the variants, and what is left of
    the segment; both shaped (variants, fingerprints)."""
    numbers, left = [], []
    for start, length in segments_of(distance):
        segment = (fps >> np.uint64(start)) & np.uint64((1 << length) - 1)
        for bit in range(length):
            numbers.append(np.full(len(fps), len(numbers), dtype=np.uint64))
            left.append(segment & ~np.uint64(1 << bit))
    return np.array(numbers), np.array(left)


def linked_forest(nodes: np.ndarray, fps: np.ndarray, distance: int, block: int = 4096) -> list[tuple[int, int]]:
    """Edges (larger node, smaller node) that connect what is linked within one bucket.

    Breadth first: each node still unreached is compared with the front once, in blocks, so memory
    is bounded and every link is seen, while a bucket of m nodes gives at most m - 1 edges.
    """
    edges: list[tuple[int, int]] = []
    open_ = np.arange(len(nodes))
    while len(open_) > 1:
        front, open_ = open_[:1], open_[1:]
        while len(front) and len(open_):
            reached = []
            for at in front.tolist():
                near = np.concatenate([np.bitwise_count(fps[open_[k : k + block]] ^ fps[at]) <= distance for k in range(0, len(open_), block)]) if len(open_) else np.zeros(0, bool)
                if near.any():
                    hit = open_[near]
                    edges += [(max(a, b), min(a, b)) for a, b in zip(nodes[hit].tolist(), [int(nodes[at])] * len(hit), strict=True)]
                    reached.append(hit)
                    open_ = open_[~near]
                if not len(open_):
                    break
            front = np.concatenate(reached) if reached else np.zeros(0, dtype=np.int64)
    return edges


def bucket_forest(nodes: np.ndarray, fps: np.ndarray, distance: int, start: int, length: int) -> list[tuple[int, int]]:
    """Edges as by :func:`linked_forest` for a bucket of fingerprints alike but for one bit in the
    ``length`` bits from ``start`` on.

    A large bucket is divided first: of distance + 1 pieces of the other bits, linked fingerprints
    have one in common, so only members with an equal piece are compared.
    """
    if len(nodes) <= REFINE:
        return linked_forest(nodes, fps, distance)
    low = fps & np.uint64((1 << start) - 1)
    rest = low | (fps >> np.uint64(length) & ~np.uint64((1 << start) - 1))
    cuts = [(BITS - length) * k // (distance + 1) for k in range(distance + 2)]
    edges: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = rest >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)
        order = np.argsort(piece, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(piece[order]) != 0])
        for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
            if y - x > 1:
                edges += linked_forest(nodes[order[x:y]], fps[order[x:y]], distance)
    return list(set(edges))


def links(nodes: DataFrame, *, distance: int = 4) -> DataFrame:
    """Edges (a, b), a > b, that connect nodes (node long, fp long) with linked fingerprints.

    The edges are verified links; two nodes that are linked in a bucket are connected by edges of
    that bucket. Nodes with a null number take no part.
    """

    shift = max(length for _, length in segments_of(distance))
    segment_of = [(start, length) for start, length in segments_of(distance) for _ in range(length)]

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(node), 4096):
                own = fps[at : at + 4096]
                number, left = deletion_variants(own, distance)
                n = len(number)
                key = (left | (number << np.uint64(shift))).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.tile(node[at : at + 4096], n)), pa.array(np.tile(own.view(np.int64), n))], names=["key", "node", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 3

        def edges(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            out: list[tuple[int, int]] = []
            two = starts[sizes == 2]
            good = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            out += [(max(a, b), min(a, b)) for a, b in zip(node[good].tolist(), node[good + 1].tolist(), strict=True)]
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                start, length = segment_of[int(key[at]) >> shift]
                out += bucket_forest(node[at : at + n], fp[at : at + n], distance, start, length)
            return out

        def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.unique(np.array(found, dtype=np.int64).reshape(-1, 2), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            rest = [np.concatenate([old, batch.column(k).to_numpy(zero_copy_only=False)]) for k, old in enumerate(rest)]
            last = np.searchsorted(rest[0], rest[0][-1]) if len(rest[0]) else 0
            if last:
                if found := edges(rest[0][:last], rest[1][:last], rest[2][:last].view(np.uint64)):
                    yield table(found)
                rest = [x[last:] for x in rest]
        if len(rest[0]) > 1 and (found := edges(rest[0], rest[1], rest[2].view(np.uint64))):
            yield table(found)

    # stored nodes may be few files, and each node becomes as many rows as it has variants
    dealt = nodes.where("node is not null").select("node", "fp").repartition(parallelism(nodes.sparkSession), "node")
    rows = dealt.mapInArrow(variants, "key long, node long, fp long")
    rows = rows.repartition(parallelism(nodes.sparkSession), "key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(compare, "a long, b long").distinct()


# ---- components -----------------------------------------------------------------------------


def are_stars(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, without repeats, lead every u straight to a v that leads nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node that has an edge (a, b).

    Alternating large-star and small-star steps, until the edges are stars; stars take no round. Every
    round is a stored table, so a lost executor costs one round at most. Labels move as (node, label)
    rows, never as lists of neighbours. Repeated edges count once, an edge from a node to itself not at all.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not are_stars(now):
        # large star: each node's larger neighbours go to its smallest neighbour (or itself)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node and its smaller neighbours go to the smallest of these
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, text_key, component_id (the smallest doc_id reachable over links).

    Texts without words have fingerprint 0 and are linked like others. Repeated rows, and documents
    with equal fingerprints, share a component. A row without id gets the component of its
    fingerprint, null if no other row has it. An empty table gives an empty result; other columns
    are not read.
    """
    marked = stored(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_n")), "nodes")
    joined = components(links(nodes, distance=distance))
    classes = stored(nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "_n"), "classes")
    return look_up(marked, classes, ["fp"], count="_n").select("doc_id", "fp", "text_key", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without id stay only if
    no row of their component has one, and then they all stay. One id with several texts is judged
    by each text."""
    classes = stored(near_classes(docs, id_col=id_col, text_col=text_col, width=width, distance=distance), "near-classes")
    drop_id, drop_key = unused(docs, "_drop_id", "_drop_key")
    dropped = classes.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias(drop_id), F.col("text_key").alias(drop_key)).distinct()
    return docs.join(dropped, docs[id_col].cast("long").eqNullSafe(F.col(drop_id)) & (F.xxhash64(text_of(text_col)) == F.col(drop_key)), "left_anti")
