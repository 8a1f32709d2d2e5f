"""Near-duplicates by the Jaccard coefficient of shingle sets, found without loss.

Two documents are linked if their sets of ``width``-word shingles have a coefficient of at least
``similarity``. Candidates come from prefixes: put every set into one common order; linked sets
then share one of their first n - ceil(similarity * n) + 1 shingles. Any order is right; here the
rare come first by a table of counts of fixed size, so a common passage is nobody's prefix. Each
candidate is verified on both whole sets.

A bucket (one shingle with the documents that have it in their prefix) has its smallest member as
lead. Each document is first compared with the LEADS leads that it shares most buckets with. After these
links are joined, only pairs of a bucket whose ends are still in different components are left, so a
group of m near copies costs about m comparisons. Of these pairs only those come out of the join whose
parity bitmaps can belong to similar sets: two bitmaps differ in at most as many bits as the sets do in
shingles, so this loses none, and documents that share one frequent passage make no pairs. A pair that
shares many buckets comes out of few of them: each member brings the keys of its EARLIER buckets before
this one, and a pair with one of these in common has come out of that one already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import look_up, parallelism, stored, text_of, unused
from .memory import lean
from .simhash import SEED, components

#: Counters of the tables that order shingles and that tell candidates from others.
SLOTS = 1 << 20
#: Longs of a parity bitmap.
WORDS = 16
#: Leads that a document is compared with first.
LEADS = 8
#: Keys of a member's buckets before the one at hand that tell pairs which came out already.
EARLIER = 8


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle; A-Z
    count as a-z; nothing without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    found = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), dtype=np.uint64, count=len(words) - width + 1))


def node_of(own: np.ndarray) -> int:
    """One number for all equal sets."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes % np.uint64(slots)).astype(np.int64)


def prefix(own: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which every linked set shares one."""
    size = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
    return own[np.argsort(counts[slot_of(own, len(counts))], kind="stable")[:size]]


def linked(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets are similar enough; two empty ones are."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def parity(own: np.ndarray) -> np.ndarray:
    """The bitmap of a set: a bit is 1 if an odd number of the hashes fall on it."""
    bits = np.bincount((own >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def texts_of(docs: DataFrame, text_col: str, *more) -> DataFrame:
    return docs.select(text_of(text_col).cast("binary").alias("_text"), *more)


def counted(slots: DataFrame) -> np.ndarray:
    """How often each slot occurs, from partial counts (slot int, n long); SLOTS numbers whatever the data."""
    rows = slots.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, dtype=np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def shingle_counts(docs: DataFrame, *, text_col: str = "text", width: int = 5) -> np.ndarray:
    slots = SLOTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(slots, dtype=np.int64)
        for batch in lean(batches, 0):
            sets = [shingles(x.as_buffer().to_pybytes(), width) for x in batch.column(0)]
            own += np.bincount(slot_of(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), slots), minlength=slots)
        at = np.flatnonzero(own)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(own[part])], names=["slot", "n"])

    return counted(texts_of(docs, text_col).mapInArrow(work, "slot int, n long"))


def marks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, text_key, node, n (shingles), bits (its bitmap) and keys (its prefix)."""
    counts = shingle_counts(docs, text_col=text_col, width=width)
    counts = np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches, 0):
            sets = [shingles(x.as_buffer().to_pybytes(), width) for x in batch.column(0)]
            keys = [prefix(x, counts, similarity).view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([node_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([parity(x) for x in sets], pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "node", "n", "bits", "keys"],
            )

    slim = texts_of(docs, text_col, F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"))
    return slim.mapInArrow(work, "doc_id long, text_key long, node long, n int, bits array<long>, keys array<long>")


def buckets(marked: DataFrame) -> DataFrame:
    """key, node, n, lead, lead_n for the members of each bucket of at least two; lead is its smallest node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, node, n of the last row; lead, lead_n of its bucket; whether the row was sent
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if last is not None:
                key, node, n = np.r_[last[0], key], np.r_[last[1], node], np.r_[last[2], n]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node, n = key[fresh], node[fresh], n[fresh]
            first = np.r_[True, key[1:] != key[:-1]]
            start = np.flatnonzero(first)[np.cumsum(first) - 1]
            lead, lead_n = node[start], n[start]
            sizes = np.diff(np.r_[np.flatnonzero(first), len(key)])
            shared = (sizes > 1)[np.cumsum(first) - 1]
            if last is not None:
                mine = key == last[0]
                lead[mine], lead_n[mine] = last[3], last[4]
                if last[5]:
                    shared[0] = False  # sent with the batch before
            if shared.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in (key, node, n, lead, lead_n)], names=["key", "node", "n", "lead", "lead_n"])
            sent = bool(shared[-1]) or (last is not None and bool(last[5]) and len(key) == 1)
            last = (key[-1], node[-1], n[-1], lead[-1], lead_n[-1], sent)

    rows = marked.select(F.explode("keys").alias("key"), "node", "n").repartition(parallelism(marked.sparkSession), "key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(work, "key long, node long, n int, lead long, lead_n int")


def sets_of(docs: DataFrame, nodes: DataFrame, *, text_col: str, width: int) -> DataFrame:
    """node and own (its sorted hashes) of the nodes asked for."""
    asked = counted(nodes.select(F.pmod("node", F.lit(SLOTS)).cast("int").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))) > 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches, 0):
            sets = [shingles(x.as_buffer().to_pybytes(), width) for x in batch.column(0)]
            some = [(k, x.tobytes()) for x in sets if asked[(k := node_of(x)) % len(asked)]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], names=["node", "own"])

    found = texts_of(docs, text_col).mapInArrow(work, "node long, own binary")
    return found.join(nodes, "node").groupBy("node").agg(F.first("own").alias("own"))


def verified(pairs: DataFrame, docs: DataFrame, *, text_col: str, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(sets_of(docs, nodes, text_col=text_col, width=width), "shingle-sets")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches, 2):
            own = [[np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(k)] for k in (2, 3)]
            good = [linked(x, y, similarity) for x, y in zip(*own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    rows = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    return rows.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, text_key and component_id, the smallest doc_id reachable over links.

    component_id is null where no reachable document has an id. Texts with equal sets of shingles
    share a component, repeated rows and ids as well; null, empty and other texts without words are one.
    Texts of any length are read whole. An empty table gives an empty result; other columns are not
    read, so none can clash.
    """
    marked = stored(marks(docs, id_col=id_col, text_col=text_col, width=width, similarity=similarity), "marks")
    members = stored(buckets(marked), "buckets")
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * similarity - 1e-9
    shared = members.where((F.col("node") > F.col("lead")) & fits(F.col("n"), F.col("lead_n"))).groupBy("node", "lead").agg(F.count(F.lit(1)).alias("k"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("k"), "lead"))
    stars = stored(shared.withColumn("r", best).where(F.col("r") <= LEADS).select(F.col("node").alias("a"), F.col("lead").alias("b")), "star-pairs")
    edges = stored(verified(stars, docs, text_col=text_col, width=width, similarity=similarity), "star-links")
    labels = stored(components(edges), "star-components")
    placed = members.select("key", "node", "n").join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    bits = marked.groupBy("node").agg(F.first("bits").alias("bits"))  # equal nodes have equal bitmaps
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1))
    left = placed.join(mixed, "key").select("key", "node", "n", "c").join(bits, "node")
    left = stored(left.withColumn("earlier", before), "mixed-buckets")
    # sizes of linked sets lie in one band or in two neighbours: a bucket's pairs are made by bands
    left = left.withColumn("band", F.floor(F.log("n") / math.log((1 + 1e-6) / similarity)))
    x, y = left.withColumn("meet", F.col("band")).alias("x"), left.withColumn("meet", F.explode(F.array("band", F.col("band") + 1))).alias("y")
    apart = sum((F.bit_count(F.col("x.bits")[k].bitwiseXOR(F.col("y.bits")[k])) for k in range(WORDS)), F.lit(0))
    most = (F.col("x.n") + F.col("y.n")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    once = (F.col("x.band") != F.col("y.band")) | (F.col("x.node") > F.col("y.node"))
    near = once & (F.col("x.c") != F.col("y.c")) & fits(F.col("x.n"), F.col("y.n")) & (apart <= most)
    # the smallest key that two nodes share is among no earlier keys of both, so every pair comes out once at least
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.meet") == F.col("y.meet")) & near & ~F.arrays_overlap("x.earlier", "y.earlier"))
    cross = cross.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = verified(stored(cross, "cross-pairs"), docs, text_col=text_col, width=width, similarity=similarity)
    joined = components(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    classes = stored(marked.select("doc_id", "text_key", "node").join(joined, "node", "left").withColumn("c", F.coalesce("component", "node")), "set-components")
    least = stored(classes.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_n")), "least")
    return look_up(classes, least, ["c"], count="_n").select("doc_id", "text_key", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the smallest of its component; rows
    without id stay only if no row of their component has one. Null and empty texts are one
    component; repeated rows share one verdict, so repeats of the smallest id all stay; an id with several texts is
    judged by each; an empty table gives an empty result; clashing columns are kept as they are."""
    classes = stored(near_classes(docs, id_col=id_col, text_col=text_col, width=width, similarity=similarity), "near-classes")
    drop_id, drop_key = unused(docs, "_drop_id", "_drop_key")
    dropped = classes.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias(drop_id), F.col("text_key").alias(drop_key)).distinct()
    return docs.join(dropped, docs[id_col].cast("long").eqNullSafe(F.col(drop_id)) & (F.xxhash64(text_of(text_col)) == F.col(drop_key)), "left_anti")
