from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkrisk.llm import mixing


def test_pipeline_mixes_by_topics_of_whole_texts(spark, docs):
    texts = ["zoo " + "apple " * 9, "apple " + "\tZOO\n" * 9, "apple Kiwi kiwi", "zoo apple", "1 2 äx", None, "", " Ink"]
    table = docs(list(enumerate(texts)))
    found = {r.doc_id: r.t for r in table.select("doc_id", mixing.main_topic(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    assert [found[k] for k in range(len(texts))] == ["a-h", "q-z", "i-p", "a-h", mixing.REST, mixing.REST, mixing.REST, "i-p"]
    # Texts that begin alike are told apart: the rare topic is kept whole, the frequent one is thinned.
    rows = [(k, "zoo " + ("apple " if k < 20 else "wood ") * 60) for k in range(4000)]
    table = docs(rows).withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    kept = {r.doc_id for r in corpus_pipeline.mixing_stage(spark, table, "").select("doc_id").collect()}
    assert set(range(20)) <= kept and len(kept) < 3000


def _topic(text):
    counts = [0, 0, 0]
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        if re.match("[A-Za-z]", word):
            counts[0 if word[0].lower() <= "h" else 1 if word[0].lower() <= "p" else 2] += 1
    return mixing.TOPICS[counts.index(max(counts))] if any(counts) else mixing.REST


def test_op7_mixes_by_topics_of_whole_texts_too(spark):
    from linkrisk.llm import queries

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang")
    rows = {r.doc_id: r for r in queries.op7_source_mixing(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in table.collect()}
    assert {k: r.mix_main_topic for k, r in rows.items()} == {k: _topic(t) for k, t in texts.items()}
    assert sum(r.mix_main_topic != r.mix_topic for r in rows.values()) > 20
    # Each sample is that of the operator, which reads whole texts unless told otherwise.
    plain = {r.doc_id: r for r in mixing.mixing_weights(table).collect()}
    for k, r in rows.items():
        assert (r.mix_main_topic, r.mix_tokens, r.main_sampled) == (plain[k].mix_topic, plain[k].mix_tokens, plain[k].sampled)
        assert r.main_probability == pytest.approx(plain[k].probability, abs=1e-8)


def test_both_topics_of_odd_rows(docs):
    rows = [(None, "zoo apple apple"), (None, "zoo apple apple"), (1, None), (2, ""), (3, "zoo apple apple"), (3, "zoo apple apple")]
    table = docs(rows, source="s", lang=None)
    got = mixing.mixed_by_topics(table).collect()
    assert len(got) == 6 and {(r.mix_topic, r.mix_main_topic, r.mix_tokens) for r in got} == {("q-z", "a-h", 3), (mixing.REST, mixing.REST, 0)}
    for k in (None, 3):
        assert len({(r.sampled, r.main_sampled, r.probability, r.main_probability) for r in got if r.doc_id == k}) == 1
    assert mixing.mixed_by_topics(table.limit(0)).count() == 0
