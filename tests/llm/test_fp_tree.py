"""Ranked search by the document FP-tree against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkrisk.llm import fp_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, top=10):
    tfs = [(i, Counter(words(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    df = Counter(t for _, c in tfs for t in c)
    n, length = len(tfs), sum(sum(c.values()) for _, c in tfs)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(words(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in tfs:
            m = 10 + 90 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


def search(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("x"), "item_id": F.lit(0)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    rows = fp_tree.ranked_search(d.repartition(3), i, **more).collect()
    assert rows == [] or list(rows[0].asDict()) == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, rows))


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["été", "ß", "日本"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 30, 200]))) for _ in range(n)]
    texts += [texts[0]] * 15 + [texts[5].upper()] * 3  # ties
    return list(enumerate(texts)), [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20])))) for k in range(25)]


@pytest.mark.parametrize("chunk", [fp_tree.CHUNK, 400])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(fp_tree, "CHUNK", chunk)
    monkeypatch.setattr(fp_tree, "SCORED", 8)
    docs, items = corpus(3)
    assert search(spark, docs, items) == brute_force(docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = corpus(4, 80)
    monkeypatch.setattr(fp_tree, "BLOCK_TERMS", 60)
    assert search(spark, docs, items, top=3) == brute_force(docs, items, top=3)


def test_nulls_repeats_empty_and_long_texts(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, " ,;"), (4, "alpha"), (4, "alpha"), (5, "Alpha_BETA-É é"), (6, "beta " * 20_000 + "alpha"), (7, "gamma")]
    items = [(None, "alpha"), (1, "alpha"), (1, "beta É"), (2, None), (3, "--"), (4, "nowhere"), (5, "é")]
    assert search(spark, docs, items) == brute_force(docs, items)


def test_empty_tables(spark):
    assert search(spark, [], [(1, "a")]) == Counter()
    assert search(spark, [(1, "a")], []) == Counter()
    assert search(spark, [(1, "a")], [(1, None)]) == Counter()


def test_bounds_leave_documents_out():
    rng = random.Random(8)
    n_terms, docs = 400, []
    for _ in range(3000):
        docs.append(sorted(rng.sample(range(n_terms), 12)))
    docs += [list(range(0, 20))] * 12  # these hold all the item's terms
    begins = np.r_[0, np.cumsum([len(d) for d in docs])]
    ranks = np.concatenate(docs)
    tree = fp_tree.Tree(list(range(len(docs))), np.full(len(docs), 100), begins, ranks, np.ones(len(ranks), dtype=np.int64), n_terms)
    weights = np.zeros(n_terms, dtype=np.int64)
    weights[:20] = np.arange(9000, 7000, -100)
    best = fp_tree.Best(10)
    scored = tree.search(np.arange(20), weights, best)
    assert scored < len(docs) / 4 and [i for _, _, i in best.rows] == list(range(3000, 3010))
