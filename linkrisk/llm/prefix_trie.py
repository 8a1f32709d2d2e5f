"""The prefix trie of conversations, with totals of every subtree by parallel tree contraction.

Turns are put in order by dealing them to ranges of (conversation, turn): a range numbers its rows in
one pass, and a table of at most one row a range carries counts and hashes over the borders, so the
turns of one conversation may fill any number of tasks. A prefix is known by the exclusive or of its
turns' 128-bit hashes, each taken together with its place; prefixes that agree are one node.

Subtree totals come from tree contraction. Each round *rakes* the leaves (their totals go to their
parents) and then *compresses* unary chains: a node with one child left is taken out, and what it
holds is hung on the child's link to the next node above. No two neighbours go in one round: a node
goes if its colour is 1 and its child's 0, the colour being that bit of the depth, or of a hash,
that takes out most (a quarter of the chain nodes expected, half on plain chains). So the rounds grow
with the logarithm of the tree's size, not with its depth. Afterwards the rounds are undone from
the last to the first: a node that was compressed has the total of its child and what stood between.

Rows without a conversation id belong to no conversation and are left out; a missing turn comes
first, a missing role or text is empty; rows of the same turn stand in order of role and text, and
repeated rows count each time. An empty table has no nodes. Other columns are ignored. Texts of any
length are hashed where they are read; only hashes and lengths travel afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import look_up, parallelism, stored, text_of

#: A piece of a list of ids that goes to the digest of the whole list, in characters.
PIECE = 1 << 20
#: Bits of the depth that can colour a round (a deeper tree only takes more rounds).
DEPTH_BITS = 12
#: Bits of a hash that can do so.
HASH_BITS = 8
#: Rounds that are undone in one plan.
UNDONE = 4


def _running(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, with their place in their conversation's part of this range, and the exclusive
    or of both hashes of all rows of that part so far."""
    last, place, a, b = None, 0, np.int64(0), np.int64(0)
    for batch in batches:
        conv = np.asarray(batch.column("conv_id"))
        n = len(conv)
        if n == 0:
            continue
        new = np.r_[last is None or conv[0] != last, conv[1:] != conv[:-1]]
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: goes on from the batch before
        at = np.arange(n) - begin + np.where(begin < 0, place - 1, 0)
        sums = []
        for name, before in (("a", a), ("b", b)):
            total = np.r_[np.int64(0), np.bitwise_xor.accumulate(np.asarray(batch.column(name)))]
            sums.append(total[1:] ^ np.where(begin < 0, before, total[np.maximum(begin, 0)]))
        last, place, a, b = conv[-1], int(at[-1]) + 1, sums[0][-1], sums[1][-1]
        more = {"_part": pa.array(np.full(n, part, dtype=np.int64)), "_at": pa.array(at), "_a": pa.array(sums[0]), "_b": pa.array(sums[1])}
        kept = {c: batch.column(c) for c in batch.schema.names if not c.startswith("_")}
        yield pa.RecordBatch.from_pydict(kept | more)


def scanned(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` (conv_id, a, b and more) with ``at``, their place in their conversation from 0, and
    ``to_a``, ``to_b``, the exclusive or of ``a`` and ``b`` up to and with the row.

    ``order`` names what puts the rows of a conversation in order; columns that begin with an
    underscore serve that only. The ranges come from a sample, so what they gave is stored."""
    session = rows.sparkSession
    kept = [f for f in rows.schema.fields if not f.name.startswith("_")]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _running(batches, TaskContext.get().partitionId())

    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", *order)]
    dealt = rows.repartitionByRange(parallelism(session), *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.mapInArrow(number, f"{names}, _part long, _at long, _a long, _b long"), label)
    # a conversation that goes on in another range is the first or the last of its range
    parts = dealt.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor("a").alias("_xa"), F.bit_xor("b").alias("_xb"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv_id", "_part", F.sum("_n").over(before).alias("_cn"), F.bit_xor("_xa").over(before).alias("_ca"), F.bit_xor("_xb").over(before).alias("_cb"))
    out = dealt.join(F.broadcast(carried.where("_cn is not null")), ["conv_id", "_part"], "left")  # at most a row a range
    zero = F.lit(0).cast("long")
    return out.select(
        *(f.name for f in kept), (F.col("_at") + F.coalesce("_cn", zero)).alias("at"),
        F.col("_a").bitwiseXOR(F.coalesce("_ca", zero)).alias("to_a"), F.col("_b").bitwiseXOR(F.coalesce("_cb", zero)).alias("to_b"),
    )


def placed_turns(rows: DataFrame) -> DataFrame:
    """Of every turn its place in its conversation from 0, hashes ``a`` and ``b`` of role and text, and
    the bytes of its text."""
    role, text = text_of("role"), text_of("text")
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(text, role, F.lit(1)).alias("b"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return scanned(turns, ["_turn", "_role", "_text"], "turns").select("conv_id", F.col("at").alias("place"), "a", "b", "n_bytes")


def shared_openings(turns: DataFrame, *, family: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the opening of their family's first: (conversations, turns).

    The first h turns of conversation c - c % ``family`` stand before c's own turns from the h-th on;
    h is crc32 of the decimal c, modulo ``longest`` + 1. Of an opening that is shorter or absent what
    there is stands. ``turns`` are placed turns; each conversation has ``size`` turns then."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)
    own = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    convs = own.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    opening = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = stored(convs.select("conv_id", "base", "n", "h", opening.alias("opening"), (opening + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    tails = look_up(turns, convs.select("conv_id", "n", "h", "opening", "size"), ["conv_id"], count="n").where("place >= h")
    tails = tails.select("conv_id", (F.col("place") - F.col("h") + F.col("opening")).alias("place"), "a", "b", "n_bytes", "size")
    heads = turns.where((F.col("place") < longest) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where("place < h").select("conv_id", "place", "a", "b", "n_bytes", "size")
    return convs.select("conv_id", "size"), tails.unionByName(heads)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order the ids of each node, comma-joined, in pieces."""
    node, ids, chars = None, [], 0
    for batch in batches:
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "to_a", "to_b", "conv_id")), strict=True):
            if ids and (key != node or chars > PIECE):
                yield pa.RecordBatch.from_pylist([_piece(node, ids)])
                ids, chars = [], 0
            node = key
            ids.append(conv)
            chars += 20
    if ids:
        yield pa.RecordBatch.from_pylist([_piece(node, ids)])


def _piece(node: list[int], ids: list[int]) -> dict:
    return {"depth": node[0], "to_a": node[1], "to_b": node[2], "first": ids[0], "ids": ",".join(map(str, ids))}


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces in order, holding one piece at a time."""
    node, digest, out = None, None, []
    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "to_a", "to_b", "ids")), strict=True):
            if key == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((*node, digest.hexdigest()))
            node, digest = key, hashlib.sha256(ids.encode())
        yield _digests(out)
        out = []
    yield _digests(out if node is None else [(*node, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_pydict({k: pa.array(list(v), t) for k, v, t in zip(("depth", "to_a", "to_b", "ends_sha256"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)})


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ascending ids (``conv_id``) that end at each node (depth, to_a, to_b).

    Ranges join ids to pieces; the pieces of a node then pass one digest in order, one at a time."""
    n, node = parallelism(ends.sparkSession), ["depth", "to_a", "to_b"]
    pieces = ends.select(*node, "conv_id").repartitionByRange(n, *node, "conv_id").sortWithinPartitions(*node, "conv_id")
    pieces = pieces.mapInArrow(_joined, "depth long, to_a long, to_b long, first long, ids string")
    return pieces.repartition(n, *node).sortWithinPartitions(*node, "first").mapInArrow(_digested, "depth long, to_a long, to_b long, ends_sha256 string")


#: Of a chain node all but its colour: it has one child left and a node above.
CHAIN = "not leaf and kids = 1 and up is not null"
COLOURS = [
    *(f"{CHAIN} and getbit(depth, {k}) = 1 and getbit(child.depth, {k}) = 0" for k in range(DEPTH_BITS)),
    *(f"{CHAIN} and getbit(xxhash64(id), {k}) = 1 and getbit(xxhash64(child.id), {k}) = 0" for k in range(HASH_BITS)),
]


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over the subtree of every node, its top included: (id, values).

    ``nodes`` has ``id``, ``up`` (the parent's id, null for a root), ``depth``, ``n_children`` and
    ``values`` (all whole numbers but the ids, which may be of any type that joins); depths only colour.
    A forest of any number of roots will do; without rows there is none.
    """
    lifts = [f"lift_{v}" for v in values]
    live = nodes.selectExpr("id", "up", "cast(depth as long) depth", "n_children kids", *values, *(f"0L {x}" for x in lifts))
    rounds: list[tuple[DataFrame, str]] = []
    while True:
        # rake: leaves give their totals to their parents; their own are final
        gathered = live.where("up is not null").groupBy(F.col("up").alias("id")).agg(
            F.expr("count_if(kids = 0) raked"), F.expr(f"max(case when kids > 0 then struct(id, depth, {', '.join(lifts)}) end) child"),
            *(F.expr(f"sum(case when kids = 0 then {v} + {x} else 0 end) from_{v}") for v, x in zip(values, lifts, strict=True)),
        )
        state = live.join(gathered, "id", "left").selectExpr(
            "id", "up", "depth", "kids = 0 leaf", "kids - coalesce(raked, 0) kids", "child", *(f"{v} + coalesce(from_{v}, 0) {v}" for v in values), *lifts
        )
        seen = Observation()
        state = stored(state.observe(seen, F.expr("count_if(not leaf) left"), *(F.expr(f"count_if({c}) c{k}") for k, c in enumerate(COLOURS))), "round")
        # compress: of each unary chain nodes of which no two are neighbours
        counts = seen.get
        colour = COLOURS[max(range(len(COLOURS)), key=lambda k: counts[f"c{k}"])]
        rounds.append((state, colour))
        if not counts["left"]:
            break
        out = state.where(colour).selectExpr("child.id id", "up new_up", *(f"{v} + {x} more_{x}" for v, x in zip(values, lifts, strict=True)))
        live = state.where(f"not leaf and not coalesce({colour}, false)").join(out, "id", "left").selectExpr(
            "id", "coalesce(new_up, up) up", "depth", "kids", *values, *(f"{x} + coalesce(more_{x}, 0) {x}" for x in lifts)
        )
    totals = None
    for k, (state, colour) in enumerate(reversed(rounds)):
        raked = state.where("leaf").select("id", *values)
        if totals is None:
            totals = raked
            continue
        hung = state.where(colour).selectExpr("child.id id", f"struct(id, {', '.join(f'{v} + child.{x} {v}' for v, x in zip(values, lifts, strict=True))}) over")
        over = f"case when over is not null then struct(over.id id, {', '.join(f'{v} + over.{v} {v}' for v in values)}) end"
        totals = totals.join(hung, "id", "left").selectExpr(f"inline(filter(array(struct(id, {', '.join(values)}), {over}), x -> x is not null))").unionByName(raked)
        if k % UNDONE == 0:
            totals = stored(totals, "totals")
    return totals


def trie_nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie's nodes: depth, smallest member, its parent's, members, children, leaves and saved
    bytes of its subtree, and the digest of the conversations that end there.

    ``convs`` has conv_id and its number of turns, ``size``; ``turns`` has conv_id, place from 0, hashes
    ``a`` and ``b`` of what makes turns equal, ``n_bytes`` and ``size``."""
    here = turns.select("conv_id", "place", "n_bytes", "size", F.xxhash64("place", "a", "b").alias("a"), F.xxhash64("b", "place", "a").alias("b"))
    steps = scanned(here, ["place"], "prefixes").withColumn("depth", F.col("place") + 1)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("to_a"), zero.alias("to_b"), "conv_id", "n_convs", zero.alias("n_bytes"), none.alias("up_a"), none.alias("up_b"))
    nodes = steps.groupBy("depth", "to_a", "to_b").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"),
        F.min(F.col("to_a").bitwiseXOR(F.col("a"))).alias("up_a"), F.min(F.col("to_b").bitwiseXOR(F.col("b"))).alias("up_b"),
    )
    nodes = stored(nodes.unionByName(root), "nodes")
    above = ["depth", "to_a", "to_b"]
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("to_a"), F.col("up_b").alias("to_b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(kids, above, "left").fillna(0, ["n_children"]), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("to_a").alias("up_a"), F.col("to_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = parents.where("n_children > 0").withColumnRenamed("n_children", "_met")
    nodes = stored(look_up(nodes, parents, ["depth", "up_a", "up_b"], count="_met").drop("_met"), "nodes")
    # a conversation has one node at a depth, so its smallest member and depth name a node
    up = F.when(F.col("parent_conv_id").isNotNull(), F.struct(F.col("parent_conv_id").alias("c"), (F.col("depth") - 1).alias("d")))
    tree = nodes.select(
        F.struct(F.col("conv_id").alias("c"), F.col("depth").alias("d")).alias("id"), up.alias("up"), "depth", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"]).select(F.col("id.c").alias("conv_id"), F.col("id.d").alias("depth"), "n_leaves", "saved_tokens")
    ends = steps.where("depth = size").select("depth", "to_a", "to_b", "conv_id")
    ends = ends.unionByName(convs.where("size = 0").select(zero.alias("depth"), zero.alias("to_a"), zero.alias("to_b"), "conv_id"))
    out = nodes.join(end_digests(ends), above, "left").join(totals, ["conv_id", "depth"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations (conv_id, turn, role, text), rebuilt with the
    openings of their families; see ``trie_nodes``."""
    return trie_nodes(*shared_openings(placed_turns(rows)))
