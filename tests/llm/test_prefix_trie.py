"""The prefix trie: totals by contraction against recursion, edge cases of conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkrisk.llm import prefix_trie


def brute_force(rows):
    """(conv_id, depth) to the other columns, from rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append((c, len(turns)))
    out = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)]
        ends = ",".join(str(c) for c, n in sorted(members) if n == len(path))
        out[min(c for c, _ in members), len(path)] = (
            min(c for c, _ in nodes[path[:-1]]) if path else None, len(members), sum(1 for q in nodes if q and len(q) == len(path) + 1 and q[:-1] == path),
            len(leaves), sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"a": F.lit("x"), "place": F.lit(-1), "id": F.lit(0)})
    got = prefix_trie.conversation_trie(df).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    return {(r.conv_id, r.depth): tuple(r)[2:] for r in got}


def test_nulls_ties_repeats_and_empty_texts(spark):
    rows = [(None, 0, "user", "no id"), (0, 1, "b", "late"), (0, None, "a", "early"), (1, 0, None, None), (2, 0, "u", "same"), (2, 0, "u", "same"), (3, 0, "u", "b"), (3, 0, "u", "a")]
    rows += [(c, t, "u" if t % 2 == 0 else "a", "é" * (t % 3) + str(t // 4) * (c % 2)) for c in range(5, 30) for t in range(1 + c % 11)]
    assert trie(spark, rows) == brute_force(rows)


def test_turnless_conversations_end_at_the_root(spark):
    # 6 and 7 have fewer turns than their openings take, and no family
    rows = [(c, 0, "u", "x") for c in (6, 7, 8, 9)]
    got = trie(spark, rows)
    assert got == brute_force(rows) and any(len(k) and k[1] == 0 for k in got)


def test_one_long_conversation_spans_ranges(spark):
    rng = random.Random(5)
    rows = [(10, t, "u", str(t)) for t in range(300)] + [(c, t, "u", rng.choice("ab")) for c in range(15, 40) for t in range(6)]
    rows += [(20, t, "u", str(t)) for t in range(6, 60)]
    assert trie(spark, rows) == brute_force(rows)


def test_empty_table(spark):
    assert trie(spark, []) == {}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar", "forest"])
def test_totals_of_any_tree(spark, shape):
    rng, n = random.Random(shape), 200
    up = {
        "chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rng.randrange(i),
        "caterpillar": lambda i: i - 3 if i % 3 == 0 else i - i % 3, "forest": lambda i: i - 1 if i % 7 else None,
    }[shape]
    parent = [None] + [up(i) for i in range(1, n)]
    depth, kids = [0] * n, [0] * n
    for i in range(1, n):
        if parent[i] is not None:
            depth[i], kids[parent[i]] = depth[parent[i]] + 1, kids[parent[i]] + 1
    total = [[i * i, 1] for i in range(n)]
    for i in range(n - 1, 0, -1):
        if parent[i] is not None:
            total[parent[i]] = [x + y for x, y in zip(total[parent[i]], total[i], strict=True)]
    rows = [(i, parent[i], depth[i], kids[i], i * i, 1) for i in range(n)]
    nodes = spark.createDataFrame(rows, "id long, up long, depth int, n_children long, w long, one long")
    got = prefix_trie.subtree_totals(nodes, ["w", "one"]).collect()
    assert sorted(map(tuple, got)) == [(i, *total[i]) for i in range(n)]


def test_end_digest_streams_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 100)
    ends = spark.range(5000).selectExpr("id * 3 conv_id", "if(id % 10 = 0, id % 3, 7) depth", "5L to_a", "6L to_b")
    got = {r.depth: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    want = defaultdict(list)
    for i in range(5000):
        want[i % 3 if i % 10 == 0 else 7].append(str(i * 3))
    assert got == {d: hashlib.sha256(",".join(v).encode()).hexdigest() for d, v in want.items()}
