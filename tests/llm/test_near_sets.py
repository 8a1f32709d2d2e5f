from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from linkrisk.llm import near_sets


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows, similarity=0.8):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= similarity * len(x | y) > 0:
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    return [min((i for i in ids[find(k)] if i is not None), default=None) for k in range(len(rows))]


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = f"new{rnd.random()}"
    return out


def test_near_stage_finds_what_four_bits_miss(spark, docs):
    rnd = random.Random(1)
    rows = []
    for k in range(20):
        base = [f"w{rnd.randrange(3000)}" for _ in range(200)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(edited(rnd, base, 3))), (10 * k + 2, " ".join(edited(rnd, base, 12)))]
    left = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs(rows), "").collect()}
    assert left == set(plain_components(rows)) and not any(i % 10 == 1 for i in left) and sum(i % 10 == 2 for i in left) > 15


@pytest.mark.parametrize(("slots", "leads", "earlier"), [(1 << 20, 8, 8), (7, 8, 8), (1 << 20, 0, 8), (7, 0, 1)])
def test_components_equal_brute_force(docs, monkeypatch, slots, leads, earlier):
    monkeypatch.setattr(near_sets, "SLOTS", slots)
    monkeypatch.setattr(near_sets, "LEADS", leads)  # without leads every link comes out of the buckets' pairs
    monkeypatch.setattr(near_sets, "EARLIER", earlier)
    rnd = random.Random(2)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for _ in range(12):  # chains, whose ends are not similar, around a passage that all share
        now = [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(60, 120))]
        for _ in range(8):
            rows.append((rnd.randrange(10**6), " ".join(now + passage)))
            now = edited(rnd, now, rnd.randint(0, 4))
    rows += [(5, "a b"), (4, "A  b"), (3, ""), (2, None), (None, "a b"), (None, "c d"), (None, rows[0][1]), (9, "x " * 90), (8, "x " * 80), (9, "same id, another text")]
    found = near_sets.near_classes(docs(rows).repartition(3)).collect()
    want = sorted(((i is None, i or 0, c is None, c or 0) for (i, _), c in zip(rows, plain_components(rows), strict=True)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0) for r in found) == want


def test_rows_that_stay(docs):
    table = docs([(2, "a b"), (1, "A b"), (None, "a b"), (None, "c"), (1, "another"), (3, None), (4, "")])
    left = near_sets.keep_first(table)
    assert left.columns == table.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "c"), (1, "A b"), (1, "another"), (3, "")]
    assert near_sets.keep_first(table.limit(0)).count() == 0


def test_a_bucket_may_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(n, 5, [k for k in range(6) if (n + k) % 3 or k > 4]) for n in range(11)] + [(99, 5, [77]), (3, 5, [0, 1])]
        got = near_sets.buckets(spark.createDataFrame(rows, "node long, n int, keys array<long>")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    members = {}
    for node, _, keys in rows:
        for k in keys:
            members.setdefault(k, set()).add(node)
    assert sorted((r.key, r.node, r.lead) for r in got) == sorted((k, n, min(m)) for k, m in members.items() if len(m) > 1 for n in m)


def test_bitmaps_differ_in_no_more_bits_than_the_sets():
    rnd = random.Random(3)
    for n in (1, 30, 400, 3000):
        base = [f"w{rnd.randrange(9000)}" for _ in range(n)]
        for k in (0, 1, n // 10):
            a, b = (near_sets.shingles(" ".join(x).encode()) for x in (base, edited(rnd, base, k)))
            bits = int(np.bitwise_count((near_sets.parity(a) ^ near_sets.parity(b)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(a, b)) and len(near_sets.parity(a)) == near_sets.WORDS


def test_documents_around_one_passage_make_no_pairs(spark, docs):
    rnd = random.Random(4)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([f"w{rnd.randrange(10**6)}" for _ in range(25)] + passage)) for i in range(150)]
    table = docs(rows)
    assert near_sets.keep_first(table).count() == 150


def test_links_across_bands_of_sizes(docs, monkeypatch):
    """Sets whose sizes differ by up to the similarity are linked without leads too, wherever the bands are cut."""
    monkeypatch.setattr(near_sets, "LEADS", 0)
    rnd = random.Random(5)
    rows = []
    for k, n in enumerate((20, 25, 31, 40, 50, 64, 80, 100, 125, 160)):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(n + 4)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[: len(base) - n // 5])), (10 * k + 2, " ".join(base[: len(base) - n // 5 - 1]))]
    found = {r.doc_id: r.component_id for r in near_sets.near_classes(docs(rows)).collect()}
    assert found == {i: c for (i, _), c in zip(rows, plain_components(rows), strict=True)}


def test_components_of_stars_chains_and_repeats(spark):
    from linkrisk.llm.simhash import components

    def of(edges):
        return {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}

    assert of([]) == {} and of([(5, 5)]) == {}
    assert of([(9, 1), (8, 1), (8, 1), (1, 9), (4, 3)]) == {9: 1, 8: 1, 1: 1, 4: 3, 3: 3}
    rnd = random.Random(6)
    chain = [(k + 1, k) for k in range(100)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    root = {x: x for e in chain for x in e}
    for _ in root:
        for a, b in chain:
            root[a] = root[b] = min(root[a], root[b])
    assert of(chain) == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in chain)}


def test_recall_by_band_on_the_stages_own_input(spark):
    """Every pair of 0.8 or more that brute force finds in what the stage gets is one component, in each band."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.exact_stage(spark, corpus_pipeline.quality_stage(spark, docs, ""), "").select("doc_id", "text").collect()
    rnd = random.Random(7)
    more = [(10**9 + 100 * k + e, " ".join(edited(rnd, r.text.split(), min(e, len(r.text.split()))))) for k, r in enumerate(kept[:15]) for e in (1, 2, 3)]
    rows = [(r.doc_id, r.text) for r in kept] + more
    sets = [plain_set(t) for _, t in rows]
    found = {r.doc_id: r.component_id for r in near_sets.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bands = {}
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and (score := both / (len(x) + len(sets[j]) - both)) >= 0.8:
                bands.setdefault(int(score * 20), []).append(found[rows[i][0]] == found[rows[j][0]])
    assert len(bands) >= 2 and all(all(x) for x in bands.values())
    assert found == {i: c for (i, _), c in zip(rows, plain_components(rows), strict=True)}


def test_near_stage_also_drops_what_its_simhash_links(spark, docs, monkeypatch):
    seen, keep = [], corpus_pipeline.simhash.keep_first
    monkeypatch.setattr(corpus_pipeline.simhash, "keep_first", lambda df: seen.append(keep(df)) or seen[-1])
    rnd = random.Random(3)
    rows = [(k, " ".join(f"w{rnd.randrange(3000)}" for _ in range(80))) for k in range(4)]
    rows += [(9, " ".join(reversed(rows[0][1].split()))), (10, "\t".join(rows[1][1].split()))]
    left = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs(rows), "").collect()}
    assert left == {0, 1, 2, 3, 9} and {r.doc_id for r in seen[0].collect()} == {0, 1, 2, 3, 9}
