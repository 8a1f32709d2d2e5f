"""Best-fit packing of documents into sequences of fixed capacity by large-item matching.

Pieces over a third of the capacity are matched greedily: the longest with the longest partner that
fits, at most two in a sequence (three never fit). Then the others, longest first, go where they
leave the least room. All pieces of one length are alike, so the plan is made from the histogram of
lengths, which has at most ``capacity`` entries however many documents there are, and is a list of
groups of equally filled sequences. Every piece then finds its place from its rank among the pieces
of its length, which Spark counts in salted groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of, unused
from .memory import lean
from .tokens import encoder, ranges

CAPACITY = 2048
#: Pieces of one length that are ranked together, on average at most.
WINDOW_ROWS = 250
#: Bytes of text that are encoded at a time.
BATCH = 2_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Group = tuple[int, list[tuple[int, int]]]  # sequences, and in each how many pieces of which length


def plan_groups(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Groups of equally filled sequences that hold all pieces of the histogram."""
    left = dict(histogram)
    by_gap: dict[int, list[Group]] = {}

    def put(n: int, gap: int, filled: list[tuple[int, int]]) -> None:
        if n:
            by_gap.setdefault(gap, []).append((n, filled))

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for size in large:
        while left[size]:
            partner = next((x for x in large if x <= capacity - size and x <= size and left[x] > (x == size)), None)
            if partner is None:
                put(left[size], capacity - size, [(size, 1)])
                left[size] = 0
            elif partner == size:
                put(left[size] // 2, capacity - 2 * size, [(size, 2)])
                left[size] %= 2
            else:
                n = min(left[size], left[partner])
                put(n, capacity - size - partner, [(size, 1), (partner, 1)])
                left[size] -= n
                left[partner] -= n
    for size in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[size]
        for gap in sorted(g for g in by_gap if g >= size):
            fit, groups = gap // size, by_gap.pop(gap)
            while groups and n:
                sequences, filled = groups.pop()
                full, rest = min(sequences, n // fit), 0
                put(full, gap - fit * size, [*filled, (size, fit)])
                n -= full * fit
                if full < sequences and n:  # fewer than fit them are left
                    rest = 1
                    put(1, gap - n * size, [*filled, (size, n)])
                    n = 0
                put(sequences - full - rest, gap, filled)
            if groups:
                by_gap.setdefault(gap, []).extend(groups)
            if not n:
                break
        if n:
            fit = capacity // size
            put(n // fit, capacity - fit * size, [(size, fit)])
            put(int(n % fit > 0), capacity - n % fit * size, [(size, n % fit)])
    return [g for groups in by_gap.values() for g in groups]


def plan_slots(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Slots in order of length and rank: the pieces of a length with ranks from ``first`` on go to
    the sequences from ``sequence`` on, ``each`` to a sequence, from ``offset`` on."""
    ranks, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for sequences, filled in plan_groups(histogram, capacity):
        offset = 0
        for size, each in filled:
            rows.append((size, ranks[size], each, sequence, offset))
            ranks[size] += sequences * each
            offset += size * each
        sequence += sequences
    rows.sort()
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return dict(zip(("length", "first", "each", "sequence", "offset"), (np.array(x, dtype=np.int64) for x in columns), strict=True))


def place(slots: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and rank."""
    at = np.empty(len(length), dtype=np.int64)
    for size in np.unique(length):
        mine, (a, b) = length == size, np.searchsorted(slots["length"], [size, size + 1])
        at[mine] = a + np.searchsorted(slots["first"][a:b], rank[mine], "right") - 1
    k, each = rank - slots["first"][at], slots["each"][at]
    return slots["sequence"][at] + k // each, slots["offset"][at] + k % each * length


def pack(pieces: DataFrame, *, keys: tuple[str, ...], length_col: str = "length", capacity: int = CAPACITY, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    ``keys`` name a piece; they order pieces of one length, so that every run agrees; pieces with
    equal keys and length may change places. Pieces that are empty or have no length get nulls; a
    longer one than ``capacity`` is an error. Columns of ``pieces`` with the two new names are
    replaced, all others kept, whatever their names. An empty table gives an empty result. Pieces of
    one length are ranked in groups of about ``window_rows`` by the hash of their keys, as many as
    that length needs. ``pieces`` is read more than once and should be stored.
    """
    pieces = pieces.drop("sequence_id", "offset")
    size, salt, n, before, own, rank = unused(pieces, "_length", "_salt", "_n", "_before", "_own", "_rank")
    sized = F.col(length_col) > 0
    histogram = {r[0]: r[1] for r in pieces.where(sized).groupBy(F.col(length_col).cast("long")).count().orderBy(F.col(length_col).cast("long")).limit(capacity + 1).collect()}
    if histogram and max(histogram) > capacity:
        raise ValueError(f"a piece of {max(histogram)} is longer than the capacity {capacity}")
    slots = plan_slots(histogram, capacity)
    salts = [1 + histogram.get(k, 0) // window_rows for k in range(1, max(histogram, default=1) + 1)]
    rows = pieces.withColumn(size, F.when(sized, F.col(length_col).cast("long")))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*keys), F.get(F.array(*map(F.lit, salts)), (F.col(size) - 1).cast("int")).cast("long")))
    counts = rows.groupBy(size, salt).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(size).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    # About one row for window_rows pieces. The ranked side is dealt by the same keys, so the join moves only these.
    starts = counts.select(size, salt, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    ranked = rows.withColumn(own, F.row_number().over(Window.partitionBy(size, salt).orderBy(*keys))).join(starts.where(F.col(size).isNotNull()), [size, salt], "left")
    ranked = ranked.withColumn(rank, (F.col(own) + F.col(before) - 1).cast("long"))
    names = pieces.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            known = pc.is_valid(columns[-1]).to_numpy(zero_copy_only=False)
            sequence = np.zeros(len(known), dtype=np.int64)
            offset = np.zeros(len(known), dtype=np.int64)
            if known.any():
                length, ranks = (columns[k].filter(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (-2, -1))
                sequence[known], offset[known] = place(slots, length, ranks)
            yield pa.RecordBatch.from_arrays([*columns[:-2], *(pa.array(x, mask=~known) for x in (sequence, offset))], names=[*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*names, size, rank).mapInArrow(assign, out)


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Token ids of whole texts, ``end_id`` after each, cut into pieces of at most ``capacity``:
    doc_id, piece, start, length, ids_crc32.

    A null text is empty and gives one piece, ``end_id`` alone. Texts may be of any length; a batch
    of about 2 MB, or one longer text, is encoded at a time. Other columns are not read."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, names = encoder(tokenizer).encode_array, [x.split()[0] for x in PIECES.split(", ")]
        for batch in lean(batches, 1, BATCH):
            n_texts = batch.num_rows
            ids, sizes = encode(batch.column(1).cast(pa.large_string()))
            ids = np.insert(ids, np.cumsum(sizes), end_id).tobytes()
            sizes += 1
            pieces = -(-sizes // capacity)
            number = ranges(np.zeros(n_texts, dtype=np.int64), pieces)
            owner = np.repeat(np.arange(n_texts), pieces)
            start = number * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            at = 4 * ((np.cumsum(sizes) - sizes)[owner] + start)
            crc = [zlib.crc32(ids[x : x + 4 * n]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=names)

    return docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack whole documents; see :func:`token_pieces` and :func:`pack`. Repeated rows
    are packed as often as they occur; an empty table gives no sequence."""
    pieces = stored(token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity), "pieces")
    return pack(pieces, keys=("doc_id", "piece"), capacity=capacity)
