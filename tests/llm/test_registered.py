"""The registered queries of the training-data operators over the whole smallest tables: against their
SQL, and op1, op4 and op8 against brute force (op7 is in test_text_operators, op11 in test_language_id)."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from test_tokens_and_files import BYTE, WORD, ids_of

from linkrisk.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(tables):
    return tables.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def plain(value):
    return float(f"{value:.8g}") if isinstance(value, float) else value


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    want = tables.sql(queries.ORACLES[name])
    columns = list(want.columns)
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == Counter(tuple(plain(r[k]) for k in order) for r in want.fetchall())


def test_packing_query_equals_brute_force(spark, texts):
    rows = queries.op1_best_fit_packing(spark, SF).collect()
    want, total = Counter(), 0
    for i, t in texts:
        ids = [*ids_of(WORD, t), 0]
        total += len(ids)
        want.update((i, k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    assert len(bins) <= 1.05 * total / 2048 + 1


def test_token_shards_query_equals_the_library(spark, texts):
    start, want = 0, Counter()
    for i, t in texts:
        ids = [*ids_of(BYTE, t), 2]
        want[i, start, len(ids), crc(ids)] += 1
        start += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_shards(spark, SF).collect()) == want


def test_simhash_query_equals_brute_force(spark, texts):
    prints = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op8_simhash_dedup(spark, SF).collect()} == {(i, f"{p:016x}", find(i)) for i, p in prints.items()}
