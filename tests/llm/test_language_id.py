"""Kneser-Ney models against plain dictionaries, held-out accuracy, edge cases."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkrisk.llm import language_id, queries

N, SF = language_id.ORDER, "/root/testdata/sf0.01"


def folded(text):
    return " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split())


class Plain:
    """An interpolated Kneser-Ney model in dictionaries of strings."""

    def __init__(self, texts):
        tokens = [" " * (N - 1) + folded(t) + " " for t in texts if folded(t)]
        self.counts = {N: Counter(x[i - N : i] for x in tokens for i in range(N, len(x) + 1))}
        for n in range(N - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discount, self.totals = {}, {}
        for n, c in self.counts.items():
            once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.discount[n] = min(max(once / (once + 2 * twice), 0.1), 0.9) if once and twice else 0.5
            self.totals[n] = defaultdict(lambda: [0, 0])
            for g, v in c.items():
                self.totals[n][g[:-1]][0] += v
                self.totals[n][g[:-1]][1] += 1

    def p(self, gram):
        if not gram:
            return 1 / language_id.LETTERS
        n, lower = len(gram), self.p(gram[1:])
        if gram[:-1] not in self.totals[n]:
            return lower
        total, kinds = self.totals[n][gram[:-1]]
        return max(self.counts[n][gram] - self.discount[n], 0) / total + self.discount[n] * kinds / total * lower

    def entropy(self, text):
        x = " " * (N - 1) + folded(text) + " "
        return -sum(math.log2(self.p(x[i - N : i])) for i in range(N, len(x) + 1)) / (len(x) - N + 1)


def texts_of(seed, letters, n=40):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("piece", [language_id.PIECE, 7])
def test_model_equals_plain_dictionaries(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    known = {"a": texts_of(1, "abcdeÉ"), "b": texts_of(2, "abxyzß") + ["..."], "c": ["one Text only"]}
    model = language_id.Model(sorted(known), [language_id.trained(known[x]) for x in sorted(known)])
    plain = [Plain(known[x]) for x in sorted(known)]
    asked = [*texts_of(3, "abcxyz", 20), "日本語 abc", "Éİx", "a", "  a, 1b?! ", "-- 12", "", None]
    got = model.entropies(asked)
    for text, row in zip(asked, got, strict=True):
        if text is None or not folded(text):
            assert np.isnan(row).all()
        else:
            assert np.allclose(row, [p.entropy(text) for p in plain], rtol=2e-5), text


def test_probabilities_of_a_context_add_up_to_one():
    plain = Plain(texts_of(5, "abc"))
    model = language_id.Model(["x"], [language_id.trained(texts_of(5, "abc"))])
    seen = [g for g in plain.counts[1]]
    for context in ("    ", "ab c", "zzzz"):
        rows = np.array([[ord(c) for c in context + g] for g in seen], dtype=np.uint32)
        p = sum(2.0 ** float(model.log_probabilities(r)[0, 0]) for r in rows)
        unseen = 2.0 ** float(model.log_probabilities(np.array([ord(c) for c in context + "q"], dtype=np.uint32))[0, 0])
        assert abs(p + unseen * (language_id.LETTERS - len(seen)) - 1) < 1e-4


def test_held_out_documents_teach_nothing_and_are_predicted(spark):
    texts = {"aa": texts_of(1, "abcde", 60), "bb": texts_of(2, "vwxyz", 60)}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in texts for t in texts[lang])]
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(i, t, "wrong" if out(i) else lang) for i, t, lang in rows]
    rows += [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", None), (1003, "abcab edcab" * 30_000, None), (None, "vwx yz", None), (0, rows[0][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"order": F.lit("x"), "size": F.lit(1), "bits": F.lit(0)})
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, _, _ in rows[:120]:
        assert by[i].held_out == out(i) and by[i].lang_pred == ("aa" if i < 60 else "bb") and 0.5 < by[i].score <= 1
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "aa", "bb"]
    assert by[1000].score == 0 and by[1000].rejected and by[1000].bits is None
    assert not by[3].rejected


def test_foreign_text_is_rejected():
    known = {"a": texts_of(1, "abcde", 200), "b": texts_of(2, "vwxyz", 200)}
    model = language_id.Model(["a", "b"], [language_id.trained(known[x][:150]) for x in "ab"])
    rest = known["a"][150:] + known["b"][150:]
    model.calibrated(model.entropies(rest), np.repeat([0, 1], 50))
    assert model.predict(["ghi jkl mno ghi"])[3].all() and model.predict(rest)[3].mean() <= 0.02


def test_without_labels_or_rows(spark):
    schema = "doc_id long, text string, lang string"
    assert [tuple(r)[2:4] for r in language_id.identify(spark.createDataFrame([(1, "abc", None)], schema)).collect()] == [("und", 0.0)]
    assert language_id.identify(spark.createDataFrame([], schema)).collect() == []
    one = language_id.identify(spark.createDataFrame([(1, "abc", "x"), (3, "9", "y")], schema)).collect()
    assert {r.lang_pred for r in one} == {"x", "und"}


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGE_BYTES", 2000)
    rows = [(i, "word " * 20, "x") for i in range(3000)] + [(5000, "y" * 9000, "y")]
    got = language_id.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang == "x" for r in got) == 20 and [len(r.text) for r in got if r.lang == "y"] == [9000]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_registered_query_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op11_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    asked = [r for r in got if r.held_out and r.lang is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in asked) >= 0.98 * len(asked)
    assert sum(r.rejected for r in asked) <= 0.03 * len(asked)
