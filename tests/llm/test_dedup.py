from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from linkrisk.llm import exact_dedup, simhash, suffix_dedup

# ---- exact --------------------------------------------------------------------------------


def test_equal_texts_are_one_class(docs):
    rows = [(5, "a  b"), (3, "a b"), (9, "a\t\nb"), (4, "a b "), (7, None), (6, ""), (8, "A b"), (3, "a b"), (None, "q"), (None, "a b"), (2, " a b")]
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.dedup_classes(docs(rows)).collect()}
    want: dict[str, list] = {}
    for i, t in rows:
        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for norm, ids in want.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            r = got[i, hashlib.sha256(norm.encode()).hexdigest()]
            assert (r.keep_id, r.group_size, r.kept) == (min(known) if known else None, len(ids), i == (min(known) if known else None))


def test_contents_are_compared_not_only_digests(docs):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 7}") for i in range(40)]
    got = exact_dedup.dedup_classes(docs(rows), digest=lambda c: F.substring(F.sha2(c, 256), 1, 0), salts=3).collect()
    assert {r.doc_id: r.keep_id for r in got} == {i: i % 7 for i, _ in rows}


def test_survivors_keep_their_columns(docs):
    table = docs([(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "z")])
    left = exact_dedup.dedup(table)
    assert left.columns == table.columns and sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect()) == [(False, 1, "a"), (False, 3, None), (True, 0, "z")]
    assert exact_dedup.dedup_classes(table.limit(0)).count() == 0 and exact_dedup.dedup(table.limit(0)).count() == 0


def test_one_of_identical_rows_stays(docs):
    left = exact_dedup.dedup(docs([(3, "a"), (3, "a"), (4, "a"), (3, "b"), (None, "z"), (None, "z")]).withColumnRenamed("_id", "_drop_id"))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "z"), (3, "a"), (3, "b")]


def test_a_text_of_most_rows_meets_in_no_task(spark):
    from pyspark.sql import functions as F

    table = spark.range(0, 6000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "the same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    found = exact_dedup.dedup_classes(table)
    counts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 6000 and max(counts) < 3000 and found.where("kept").count() == 601
    assert {(r.keep_id, r.group_size) for r in found.where("doc_id % 10 > 0").distinct().collect()} == {(1, 5400)}
    classes = simhash.near_classes(table)
    counts = [r["count"] for r in classes.groupBy(F.spark_partition_id()).count().collect()]
    assert max(counts) < 3000 and {r.component_id for r in classes.where("doc_id % 10 > 0").collect()} == {1}


# ---- simhash ------------------------------------------------------------------------------


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "a b c d", "A b C d e É f\x0bg h", "x " * 3000, "word" * 30000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_every_close_pair_shares_a_variant():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = rnd.getrandbits(64), 0
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            b ^= 1 << bit
        left = simhash.deletion_variants(np.array([a, b], dtype=np.uint64), 4)[1]
        assert len(left) == 64 and (left[:, 0] == left[:, 1]).any()
    assert len(simhash.segments_of(4)) == 3


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_fingerprints(spark):
    rnd = random.Random(2)
    fps = []
    for _ in range(12):  # chains and clouds
        x = rnd.getrandbits(64)
        for _ in range(25):
            fps.append(x)
            y = x
            for bit in rnd.sample(range(64), rnd.choice([1, 3, 4, 5])):
                y ^= 1 << bit
            x = y
    fps = list(dict.fromkeys(fps))
    nodes = list(range(100, 100 + len(fps)))
    rnd.shuffle(nodes)
    table = spark.createDataFrame([(n, f - (1 << 64) if f >> 63 else f) for n, f in zip(nodes, fps, strict=True)], "node long, fp long")
    want = union([(nodes[i], nodes[j]) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4], nodes)
    got = dict(simhash.components(simhash.links(table)).collect())
    assert {n: got.get(n, n) for n in nodes} == want


def test_one_id_with_two_texts_loses_neither(docs):
    a, b = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    left = simhash.keep_first(docs([(3, a), (7, a), (7, b)]))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(3, a), (7, b)]


@pytest.mark.parametrize("distance", [2, 4])
def test_divided_buckets_lose_no_link(distance):
    rnd = random.Random(9)
    start, length = simhash.segments_of(distance)[1]
    base, fps = rnd.getrandbits(64), []
    for _ in range(60):  # alike but for one bit of the segment
        x = base ^ (rnd.getrandbits(64) & ~(((1 << length) - 1) << start)) ^ (rnd.randint(0, 1) << start)
        for _ in range(6):
            fps.append(x)
            for bit in rnd.sample([k for k in range(64) if not start <= k < start + length], rnd.randint(1, distance)):
                x ^= 1 << bit
    fps = list(dict.fromkeys(fps))
    nodes = np.arange(100, 100 + len(fps))
    want = union([(nodes[i], nodes[j]) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance], nodes.tolist())
    edges = simhash.bucket_forest(nodes, np.array(fps, dtype=np.uint64), distance, start, length)
    assert len(fps) > simhash.REFINE and union(edges, nodes.tolist()) == want


def test_near_classes_of_documents(docs):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [rnd.choice(words) for _ in range(600)]
    near = base[:300] + ["other"] + base[301:]
    rows = [(8, " ".join(base)), (5, " ".join(near)), (6, " ".join(base)), (1, " ".join(rnd.choices(words, k=600))), (2, None), (9, ""), (None, " ".join(base)), (8, " ".join(base))]
    got = [(r.doc_id, r.component_id) for r in simhash.near_classes(docs(rows)).collect()]
    fp = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    want = union([(a, b) for a in fp for b in fp if a > b and (fp[a] ^ fp[b]).bit_count() <= 4], fp)
    assert sorted(x for x in got if x[0] is not None) == sorted((i, want[i]) for i, _ in rows if i is not None)
    assert [c for i, c in got if i is None] == [want[8]]
    left = simhash.keep_first(docs(rows))
    assert {r.doc_id for r in left.collect() if r.doc_id is not None} == set(want.values())
    assert simhash.near_classes(docs(rows).limit(0)).count() == 0


# ---- repeated strings ------------------------------------------------------------------------


def plain_cut(rows, span=50):
    first: dict[bytes, int] = {}
    order = sorted(range(len(rows)), key=lambda k: float("inf") if rows[k][0] is None else rows[k][0])
    marks = {}
    for k in order:
        i, data = float("inf") if rows[k][0] is None else rows[k][0], (rows[k][1] or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - span + 1):
            if first.setdefault(data[p : p + span], i) < i:
                mark[p : p + span] = b"\1" * span
        marks[k] = mark
    out = []
    for k, (i, t) in enumerate(rows):
        data, m = (t or "").encode(), marks[k]
        kept = bytes(c for c, x in zip(data, m, strict=True) if not x)
        out.append((i, len(data), sum(m), sum(1 for p in range(len(m)) if m[p] and (p == 0 or not m[p - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rnd = random.Random(7)
    passages = ["".join(rnd.choices("abcdé ", k=rnd.randint(30, 180))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(0, 120)))]
        for p in rnd.sample(passages, 2):
            a = rnd.randint(0, 20)
            parts += [p[a : len(p) - rnd.randint(0, 20)], "".join(rnd.choices("ijkl", k=rnd.randint(0, 60)))]
        rows.append((i * 3, "".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "ab" * 400), (203, "ab" * 300), (204, "z" * 49), (205, "z" * 49), (206, None), (207, ""), (9, rows[5][1] + "tail"), (9, rows[5][1] + "tail"), (None, rows[1][1]), (None, rows[1][1]), (210, "x" * 50), (211, "x" * 50)]
    got = suffix_dedup.cut_out(docs(rows).repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(plain_cut(rows), key=key)
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_removed


@pytest.mark.parametrize("span", [16, 20, 57, 64, 200])
def test_repeats_of_other_spans_equal_brute_force(docs, span):
    rnd = random.Random(span)
    passage = "".join(rnd.choices("abcd ", k=2 * span + 9))
    rows = []
    for i in range(14):
        p, k = list(passage), rnd.randrange(len(passage))
        p[k] = "X"  # alike up to one byte, wherever it lies
        rows.append((i, "".join(rnd.choices("efgh", k=rnd.randint(0, 40))) + "".join(p)))
    rows += [(50, passage), (51, passage[: span - 1]), (52, passage[:span]), (53, None)]
    got = suffix_dedup.cut_out(docs(rows), span=span).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(plain_cut(rows, span))


def test_a_span_below_an_anchor_is_an_error(docs):
    with pytest.raises(ValueError, match="span"):
        suffix_dedup.cut_out(docs([(1, "a")]), span=15)


def test_repeats_of_nothing(docs):
    assert suffix_dedup.cut_out(docs([(1, "a")]).limit(0)).count() == 0
    assert [tuple(r)[1:4] for r in suffix_dedup.cut_out(docs([(1, "a" * 60)])).collect()] == [(60, 0, 0)]


def test_cover_and_ranks():
    cover = {k for k in range(8) if suffix_dedup.COVER[k]}
    assert {(a - b) % 8 for a in cover for b in cover} == set(range(8))
    rnd = random.Random(1)
    for data in [bytes(rnd.choices(b"ab", k=600)), b"a" * 333, b"ab" * 100 + bytes(40), bytes(rnd.choices(b"ab\0", k=77)) * 5, bytes(range(17))]:
        words = suffix_dedup.words_at(data).byteswap()
        at = [p for p in range(len(data)) if p % 8 in cover]
        ranks = suffix_dedup.cover_ranks(words, np.arange(len(data)), len(data))
        assert ranks[suffix_dedup.cover_place(np.array(at))].tolist() == [sorted(data[p:] for p in at).index(data[p:]) for p in at]
        some = np.array(sorted(rnd.sample(range(len(data) - 8), len(data) * 2 // 3 - 8)))
        order = suffix_dedup.suffix_order(some, np.unique(words[some], return_inverse=True)[1], ranks)
        assert some[order].tolist() == sorted(some.tolist(), key=lambda p: data[p:])


def test_a_passage_of_every_batch_is_found(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 300)
    rnd = random.Random(2)
    passage = "".join(rnd.choices("abcdef ", k=150))
    rows = [(i, "".join(rnd.choices("ghij", k=rnd.randint(0, 90))) + passage + "".join(rnd.choices("klmn", k=rnd.randint(0, 90)))) for i in range(60)]
    got = suffix_dedup.cut_out(docs(rows).repartition(4)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(plain_cut(rows))


def test_packing_of_numbers_round_trips():
    columns = [np.array([5, 3, -(1 << 62), 1 << 62]), np.array([0, 0, 1, 2])]
    got, text = suffix_dedup.unpacked(suffix_dedup.packed(*columns, text=b"abc"))
    assert text == b"abc" and all((a == b).all() for a, b in zip(got, columns, strict=True))


def test_slices_are_numbered_from_ordered_rows(docs):
    plan = suffix_dedup.repeats(docs([(1, "a" * 200), (2, "a" * 200)]))._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[: plan.index("Join Inner")]
    assert "Sort [_id" in dealt and "_tie" in dealt[dealt.index("Sort [_id") :].split("]")[0]
