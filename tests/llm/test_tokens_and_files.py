from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from linkrisk.llm import packing, sstable, tokens, warc
from linkrisk.llm.common import scratch

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = [
    "", None, "  a  b \n\n c", "\t\n x  y \x1c z  w", "It's a test's <|endoftext|> x", "Σας ΟΔΟΣ é é ́x.", "\n", "a \n b\n", "x" * 5000 + " y", "日本 語 テスト。", "a\u0085 b", " lead", "trail  ",
    "​ x ​", "Hey!!! *** x.* don't. 9. a9, é, ß. naïve.", "The the THE, the.", "word " * 4000,
]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_chunks_give_the_ids_of_whole_texts(name):
    e = tokens.Encoder(public.path(name))
    texts = [t or "" for t in ODD]
    for _ in range(2):
        assert e.encode(texts) == [e.whole(t) for t in texts]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_LIMIT", 5)
    e = tokens.Encoder(public.path(BYTE))
    for t in ("a b c d e f g", "h i j k", "a b c"):
        assert e.encode([t]) == [e.whole(t)]


def ids_of(name, text):
    return tokenizers.Tokenizer.from_file(public.path(name)).encode(text or "", add_special_tokens=False).ids


# ---- packing ------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_once(seed):
    rnd = random.Random(seed)
    capacity = 100
    pieces = [rnd.choice([100, 67, 66, 34, 33, 51, 50, 7, 1, rnd.randint(1, 100)]) for _ in range(rnd.choice([1, 5, 400]))]
    slots = packing.plan_slots(dict(Counter(pieces)), capacity)
    length = np.array(pieces)
    rank = np.array([pieces[:k].count(x) for k, x in enumerate(pieces)])
    sequence, offset = packing.place(slots, length, rank)
    bins: dict[int, list] = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
        bins.setdefault(s, []).append((o, n))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in parts) <= 2
    best: list[int] = []  # best-fit decreasing, piece by piece
    for n in sorted(pieces, reverse=True):
        fit = [k for k, room in enumerate(best) if room >= n]
        if fit:
            best[min(fit, key=lambda k: best[k])] -= n
        else:
            best.append(capacity - n)
    assert sorted(bins) == list(range(len(bins))) and len(bins) <= len(best) * 1.1 + 1


def test_documents_are_cut_and_packed(docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, "word " * 4000), (50, "word " * 4000), (None, "x y")]
    got = packing.pack_documents(docs(rows), public.path(WORD), capacity=128).collect()
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    for i, t in rows:
        ids = np.array([*ids_of(WORD, t), 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 128)):
            want[i, k, at, len(ids[at : at + 128]), zlib.crc32(ids[at : at + 128].tobytes())] += 1
    assert pieces == want
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 128
    assert packing.pack_documents(docs(rows).limit(0), public.path(WORD)).count() == 0


def test_pieces_without_length_have_no_place(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 5)], "k int, length int").withColumn("offset", F.lit("clash"))
    got = {r.k: (r.sequence_id, r.offset) for r in packing.pack(df, keys=("k",), capacity=8).collect()}
    assert got[2] == got[3] == (None, None) and {got[1][0], got[4][0]} == {0, 1}
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(df, keys=("k",), capacity=4)


def test_packing_keeps_columns_with_its_own_names(spark):
    df = spark.createDataFrame([(k, 5) for k in range(40)], "k int, length int").withColumns({n: F.lit(n) for n in ("_length", "_salt", "_own", "_rank", "_n", "_before")})
    out = packing.pack(df, keys=("k",), capacity=16, window_rows=4)
    rows = out.collect()
    assert out.columns == [*df.columns, "sequence_id", "offset"] and {r["_own"] for r in rows} == {"_own"}
    assert Counter(r.sequence_id for r in rows) == {k: 3 if k < 13 else 1 for k in range(14)} and {r.offset for r in rows} == {0, 5, 10}


# ---- token shards -------------------------------------------------------------------------


def test_shards_round_trip(spark, docs):
    rows = [(i * 7 - 40, t) for i, t in enumerate(ODD)] + [(5, "b"), (5, "a"), (5, "a"), (None, "n"), (-(1 << 63), "low"), ((1 << 63) - 1, "high")]
    manifest = sstable.write_shards(docs(rows), scratch(spark, "sst"), public.path(BYTE), shards=3, block_bytes=200, shard_bytes=300)
    assert manifest.count() > 3  # ranges go on in new files
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in sstable.read_shards(manifest).collect()), key=lambda r: r[2])
    assert got == sorted(got, key=lambda r: r[:2]) and [r[2] for r in got] == np.cumsum([0, *(r[3] for r in got)])[:-1].tolist()
    coded = Counter((i is not None, i or 0, zlib.crc32(np.array([*ids_of(BYTE, t), 2], dtype="<u4").tobytes())) for i, t in rows)
    assert Counter((r[0], r[1], r[4]) for r in got) == coded
    for i, t in rows:
        if i is not None and i != 5:
            assert sstable.look_up(manifest, i) == [*ids_of(BYTE, t), 2]
    assert sstable.look_up(manifest, 123456) is None
    empty = sstable.write_shards(docs(rows).limit(0), scratch(spark, "sst"), public.path(BYTE))
    assert sstable.read_shards(empty).count() == 0


def test_shard_file_has_index_filter_and_text_keys(tmp_path):
    writer = sstable.ShardWriter(str(tmp_path / "a.sst"), 4, 64)
    keys = [sstable.key_of(f"doc-{k:04}") for k in range(200)]
    for k, key in enumerate(keys):
        writer.add(key, (np.arange(k % 9, dtype="<u4") + 70000).tobytes())
    with pytest.raises(ValueError, match="ascend"):
        writer.add(keys[0], b"")
    writer.close()
    shard = sstable.Shard(str(tmp_path / "a.sst"))
    assert len(shard.blocks) > 10 and [k for k, _ in shard] == keys
    assert all(shard.get(k).tolist() == (np.arange(i % 9) + 70000).tolist() for i, k in enumerate(keys))
    assert sum(shard.may_have(sstable.key_of(f"no-{k}")) for k in range(1000)) < 50
    assert sstable.id_of(keys[3], True) == "doc-0003" and [sstable.id_of(sstable.key_of(i), False) for i in (-5, 0, 7, None)] == [-5, 0, 7, None]
    data = bytearray((tmp_path / "a.sst").read_bytes())
    data[20] ^= 1
    (tmp_path / "b.sst").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Shard(str(tmp_path / "b.sst")))


# ---- web archives -------------------------------------------------------------------------


def test_archives_round_trip(spark):
    rows = [(1, "http://a/é b\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (6, "u", "é\r\n\r\nWARC/1.1"), (7, "u", "same"), (7, "u", "same"), (None, "u", "same"), (None, "v", "own"), (5, "u", "only here"), (5, "w", "same"), (9, "u", "")] + [(k, "u", "many") for k in range(200, 340)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"_key": F.lit(1), "path": F.lit("p")})
    manifest = warc.write_warc(pages, scratch(spark, "warc"), frame_bytes=1000, bundle_bytes=100_000)
    got = warc.read_warc(manifest).collect()
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        best = max(j for j, _, h in rows if j is not None and (h or "") == (html or "")) if any(j is not None and (h or "") == (html or "") for j, _, h in rows) else None
        again = i is not None and i != best
        want[i, len(data), warc.sha1_base32(data), "revisit" if again else "response", best if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.url for r in got if r.page_id == 1} == {"http://a/é%20b%0D%0AX:%20y"} and {r.url for r in got if r.page_id == 2} == {None}
    row = next(r for r in got if r.page_id == 6)
    bundle = warc.Bundle(row.path)
    head, block = bundle.record("<urn:page:6>")
    assert block.endswith("é\r\n\r\nWARC/1.1".encode()) and head["WARC-Type"] == "response" and bundle.record("<urn:page:99>") is None
    assert bundle.index()[0][0].startswith("<urn:page:") and bundle.frame(row.frame)[row.frame_offset :].startswith(b"WARC/1.1\r\n")
    whole = zstandard.ZstdDecompressor().stream_reader(open(row.path, "rb"), read_across_frames=True).read()  # any reader can read it
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(bundle.index())
    assert warc.read_warc(warc.write_warc(pages.limit(0), scratch(spark, "warc"))).count() == 0


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_pages(spark, pages, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
