"""Ranked lexical search: a document FP-tree, searched depth first with bounds for each item.

Every text is read once and reduced to its vector restricted to the items' terms. Terms are ordered by
document frequency (rarest first, so paths part and bounds fall early); the vectors of a task's documents,
written in that order, share the paths of a trie. Each of its nodes holds the largest tf of its terms
and the smallest m of all documents below it. What an item can still gain below a node is at most what
its later terms gain anywhere in the tree; the root's children are bands of m (by powers of two), which
keeps that bound close. A branch whose bound is below the item's tenth score so far is left out, and
with it only documents that cannot be among the ten. Unbranched tails are no nodes: what survives is scored exactly.

Items are taken in blocks of about BLOCK_TERMS (item, term) pairs, dealt by hash, so what a task holds of them
is bounded whatever their number; each block reads the documents once. A tree is built of at most
CHUNK terms of documents (or one document) at a time. Tasks give ten rows an item, which are merged in two steps.

A missing text has no terms, and neither has an empty one; such documents are in no ranking. Repeated rows are ranked
each by itself; equal scores are in order of doc_id, a missing one first. Rows of one item_id (a missing one
is an id too) are one item with the terms of all; an item without terms, or whose terms no document has,
has no rows. Empty tables give no rows. Other columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, stored, text_of

#: Terms are what is left between these bytes of UTF-8; A-Z fold to a-z, other letters stay as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: About so many terms of items are searched for at once.
BLOCK_TERMS = 200_000
#: A tree has so many terms of documents at most (but for a single document with more).
CHUNK = 1 << 21
#: Documents that are scored at once.
SCORED = 512
#: Groups in which each item's rows are merged first.
MERGE = 64


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms ``n``, and the vocabulary's terms among them with their tf."""

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            ids, ns, found, tfs = [], [], [], []
            for doc_id, text in zip(*rows_of(batch, "doc_id", "text"), strict=True):
                words = terms_of(text)
                if words:
                    counts = Counter(words)
                    here = counts.keys() & known
                    ids.append(doc_id)
                    ns.append(len(words))
                    found.append([vocabulary[w] for w in here])
                    tfs.append([counts[w] for w in here])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(restrict, "doc_id long, n long, terms array<int>, tfs array<int>")


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a weight is multiplied by; rises with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """The trie of some documents: ``ranks``, ``tfs`` and ``begins`` are their vectors, each in order of rank."""

    def __init__(self, ids: list, m: np.ndarray, begins: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, n_terms: int) -> None:
        band = (4 * np.log2(m)).astype(int)
        big_endian, width = ranks.astype(">u4").tobytes(), 4
        order = sorted(range(len(ids)), key=lambda d: (band[d], big_endian[width * begins[d] : width * begins[d + 1]]))
        sizes = np.diff(begins)[order]
        starts = np.r_[0, np.cumsum(sizes)]
        at = np.repeat(begins[:-1][order] - starts[:-1], sizes) + np.arange(starts[-1])
        # every document has a term: others are not sent here
        self.ids, self.m, self.band = [ids[d] for d in order], m[order], band[order]
        self.begins, self.ranks, self.tfs = starts, ranks[at], tfs[at].astype(np.int64)
        doc = np.repeat(np.arange(len(order)), sizes)
        self.gain = gains(self.tfs, self.m[doc])
        self.bands, band_no = np.unique(self.band, return_inverse=True)
        self.most = np.zeros((len(self.bands), n_terms), dtype=np.int64)  # of each term in each band
        np.maximum.at(self.most, (band_no[doc], self.ranks), self.gain)
        self.shared = self._shared()
        self._nodes()

    def _shared(self) -> np.ndarray:
        """How many terms each document shares with the one before, -1 in another band."""
        out = np.where(self.band[1:] == self.band[:-1], 0, -1)
        sizes, left = np.diff(self.begins), np.flatnonzero(out == 0)
        k = 0
        while len(left):
            left = left[(sizes[left] > k) & (sizes[left + 1] > k)]
            left = left[self.ranks[self.begins[left] + k] == self.ranks[self.begins[left + 1] + k]]
            k += 1
            out[left] = k
        return out

    def _nodes(self) -> None:
        """Nodes in depth-first order: what they cover, their parents, where to go on without them."""
        n, nodes = len(self.ids), []
        tops = [0, *(np.flatnonzero(self.shared < 0) + 1).tolist(), n]
        for a, b in zip(tops, tops[1:], strict=False):
            open_ = [(0, a)]  # depth and first document
            for d, common in enumerate([*self.shared[a : b - 1].tolist(), -1], a + 1):
                first = d - 1
                while open_ and open_[-1][0] > common:
                    k, first = open_.pop()
                    nodes.append((first, k, d))
                if open_ and open_[-1][0] < common:
                    open_.append((common, first))
        self.low, self.depth, self.high = zip(*sorted(nodes), strict=True)
        self.parent, self.skip, owner, open_ = [], [0] * len(nodes), np.zeros(n, dtype=np.int64), []
        for k, (a, b) in enumerate(zip(self.low, self.high, strict=True)):
            while open_ and self.high[open_[-1]] <= a:
                self.skip[open_.pop()] = k
            self.parent.append(open_[-1] if open_ else -1)
            open_.append(k)
            owner[a:b] = k
        for k in open_:
            self.skip[k] = len(nodes)
        ends, edge_ranks, edge_gains = [0], [], []
        for k, (a, b) in enumerate(zip(self.low, self.high, strict=True)):
            above = self.depth[self.parent[k]] if self.parent[k] >= 0 else 0
            here, least = self.begins[a], self.m[a:b].min()
            for level in range(above, self.depth[k]):
                edge_ranks.append(self.ranks[here + level])
                edge_gains.append(gains(self.tfs[self.begins[a:b] + level].max(), least))
            ends.append(len(edge_ranks))
        self.edge_ends, self.edge_ranks, self.edge_gains = np.array(ends), np.array(edge_ranks, dtype=np.int64), np.array(edge_gains, dtype=np.int64)
        self.last = np.array([self.ranks[self.begins[a] + k - 1] if k else -1 for a, k in zip(self.low, self.depth, strict=True)], dtype=np.int64)
        self.node_band = np.searchsorted(self.bands, self.band[list(self.low)])
        # documents by the node that they hang on, and the first term of their tails
        self.hung = np.argsort(owner, kind="stable")
        self.hung_ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(nodes)))]
        self.hung_list = self.hung_ends.tolist()
        tail = self.begins[:-1] + np.array(self.depth)[owner]
        self.tail = np.where(tail < self.begins[1:], self.ranks[np.minimum(tail, max(len(self.ranks) - 1, 0))] if len(self.ranks) else 0, np.iinfo(np.int64).max)
        self.doc_band = self.node_band[owner]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        low, high = int(docs.min()), int(docs.max()) + 1
        if high - low <= 2 * len(docs):  # nearly all between them: no need to gather
            begin = self.begins[low]
            parts = weights[self.ranks[begin : self.begins[high]]] * self.gain[begin : self.begins[high]]
            return np.add.reduceat(parts, self.begins[low:high] - begin)[docs - low]
        begin, size = self.begins[docs], self.begins[docs + 1] - self.begins[docs]
        ends = np.cumsum(size)
        at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
        return np.add.reduceat(weights[self.ranks[at]] * self.gain[at], ends - size)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Adds to ``best`` what this tree has for the item of ``terms`` (sorted ranks); ``weights`` by
        rank are 0 for all others. Returns how many documents were scored."""
        later = np.zeros((len(self.bands), len(terms) + 1), dtype=np.int64)  # what terms from the k-th on can gain
        later[:, :-1] = np.cumsum((weights[terms] * self.most[:, terms])[:, ::-1], axis=1)[:, ::-1]
        sums = np.r_[0, np.cumsum(weights[self.edge_ranks] * self.edge_gains)]
        own = (sums[self.edge_ends[1:]] - sums[self.edge_ends[:-1]]).tolist()
        rest = later[self.node_band, np.searchsorted(terms, self.last, "right")].tolist()
        tails = later[self.doc_band, np.searchsorted(terms, self.tail, "left")]
        gained, met, waiting, scored = [0] * len(own), [], 0, 0
        parent, ends, skip = self.parent, self.hung_list, self.skip
        k, n = 0, len(own)
        while k < n or waiting:
            if waiting >= SCORED or k >= n:
                nodes = np.array(met)
                begin, size = self.hung_ends[nodes], self.hung_ends[nodes + 1] - self.hung_ends[nodes]
                docs = self.hung[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(waiting)]
                docs = docs[tails[docs] + np.repeat([gained[x] for x in met], size) >= best.least]
                if len(docs):
                    best.add(self.scores(docs, weights), docs, self.ids)
                scored, met, waiting = scored + len(docs), [], 0
                continue
            above = parent[k]
            gained[k] = now = own[k] + (gained[above] if above >= 0 else 0)
            if now + rest[k] < best.least:
                k = skip[k]
                continue
            if here := ends[k + 1] - ends[k]:
                met.append(k)
                waiting += here
            k += 1
        return scored


class Best:
    """The rows with the highest scores above 0, equal ones by id, a missing id first."""

    def __init__(self, top: int) -> None:
        self.top, self.rows, self.least = top, [], 1

    def add(self, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        """Takes the ``scores`` of ``docs``, which are places in ``ids``."""
        new = [(-int(scores[k]), ids[docs[k]] is not None, ids[docs[k]] or 0) for k in np.flatnonzero(scores >= self.least).tolist()]
        if new:
            self.rows = sorted([*self.rows, *new])[: self.top]
            if len(self.rows) == self.top:
                self.least = -self.rows[-1][0]


def chunks(batches: Iterator[pa.RecordBatch], rank_of: np.ndarray, scale: tuple[int, int]) -> Iterator[tuple]:
    """Vectors of documents (ids, m, begins, ranks, tfs), terms in order of rank, CHUNK terms at a time."""
    count, length = scale
    held, size = [], 0
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        n = np.asarray(batch.column("n"))
        terms, tfs = batch.column("terms"), batch.column("tfs")
        sizes = np.diff(np.asarray(terms.offsets))
        ranks, freqs = rank_of[np.asarray(terms.flatten())], np.asarray(tfs.flatten())
        doc = np.repeat(np.arange(len(ids)), sizes)
        use = ranks >= 0  # terms that weigh nothing are left out
        doc, ranks, freqs = doc[use], ranks[use], freqs[use]
        order = np.lexsort((ranks, doc))
        sizes = np.bincount(doc, minlength=len(ids))
        some = np.flatnonzero(sizes)
        m = 10 + (90 * n.astype(np.int64) * count) // length
        begins = np.r_[0, np.cumsum(sizes[some])]
        at = 0
        while at < len(some):  # a batch may fill more than one tree
            upto = max(at + 1, int(np.searchsorted(begins, begins[at] + CHUNK - size, "right")) - 1)
            part = order[begins[at] : begins[upto]]
            held.append(([ids[d] for d in some[at:upto].tolist()], m[some[at:upto]], sizes[some[at:upto]], ranks[part], freqs[part]))
            size, at = size + len(part), upto
            if size >= CHUNK:
                yield _together(held)
                held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list[tuple]) -> tuple:
    ids, m, sizes, ranks, tfs = zip(*held, strict=True)
    return sum(ids, []), np.concatenate(m), np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(ranks), np.concatenate(tfs)


def searched(vectors: DataFrame, items: list[np.ndarray], weights: np.ndarray, rank_of: np.ndarray, scale: tuple[int, int], top: int) -> DataFrame:
    """Each task's ``top`` rows of every item (its place in ``items``, which are arrays of sorted ranks)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        for chunk in chunks(batches, rank_of, scale):
            tree = Tree(*chunk, len(weights))
            mine = np.zeros(len(weights), dtype=np.int64)
            for terms, found in zip(items, best, strict=True):
                mine[terms] = weights[terms]
                tree.search(terms, mine, found)
                mine[terms] = 0
        for k, found in enumerate(best):
            if found.rows:
                yield pa.RecordBatch.from_pydict(
                    {"item": pa.array([k] * len(found.rows), pa.int32()), "doc_id": pa.array([i if known else None for _, known, i in found.rows], pa.int64()), "score": pa.array([-s for s, _, _ in found.rows], pa.int64())}
                )

    return vectors.mapInArrow(search, "item int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, *, top: int = 10) -> DataFrame:
    """The ``top`` documents (doc_id, text) for each item (item_id, text): item_id, rank, doc_id, score."""
    session = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = rows_of(batch, "item_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([list(set(terms_of(t))) for t in texts], pa.list_(pa.binary()))], names=["item_id", "terms"])

    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").alias("text")).mapInArrow(cut, "item_id long, terms array<binary>")
    wanted = stored(wanted.select("item_id", F.explode("terms").alias("term")).distinct(), "items")
    n_blocks = max(1, math.ceil(wanted.count() / BLOCK_TERMS))
    found = None
    for block in range(n_blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for r in mine for t in r.terms}))}
        vectors = stored(restricted(docs, vocabulary), "vectors")
        count, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not count or not mine:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each of the block's terms at most
            df[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        order = np.lexsort((np.arange(len(df)), df))
        order = order[(weight[order] > 0) & (df[order] > 0)]
        rank_of = np.full(len(df), -1, dtype=np.int64)
        rank_of[order] = np.arange(len(order))
        terms = [np.sort(x[x >= 0]) for x in (rank_of[[vocabulary[bytes(t)] for t in r.terms]] for r in mine)]
        rows = searched(vectors, terms, weight[order], rank_of, (count, length), top)
        names = session.createDataFrame([(k, r.item_id) for k, r in enumerate(mine)], "item int, item_id long")
        rows = rows.join(F.broadcast(names), "item").drop("item")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return session.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_first("doc_id")]
    first = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))).orderBy(*best)
    found = found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= top).drop("_n")
    ranks = F.row_number().over(Window.partitionBy("item_id").orderBy(*best))
    return found.withColumn("rank", ranks).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
