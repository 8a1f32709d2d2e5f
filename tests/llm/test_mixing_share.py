from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkrisk.llm import mixing


def mixed(docs, rows, **more):
    table = docs([(i, t) for i, t, _, _ in rows])
    side = table.sparkSession.createDataFrame([(i, s, x) for i, _, s, x in rows], "doc_id long, source string, lang string")
    return mixing.mixing_weights(table.join(side, "doc_id"), **more)


@pytest.mark.parametrize("source, lang", [("new", "en"), ("s0", "xx")])
def test_one_rare_document_barely_changes_the_sample(docs, source, lang):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("abcjklxyz") + " word" * rnd.randint(50, 150), f"s{min(i % 7, 4)}", ("en", "de", "en")[i % 3]) for i in range(4000)]
    before = {r.doc_id for r in mixed(docs, rows).where("sampled").collect()}
    after = {r.doc_id: r for r in mixed(docs, [*rows, (9999, "a" + " word" * 99, source, lang)]).collect()}
    assert after[9999].probability == pytest.approx(1.0)
    kept = {i for i, r in after.items() if r.sampled} - {9999}
    assert len(before) > 1500 and len(before ^ kept) < 0.03 * len(before)


def test_softened_targets_keep_half_whatever_the_data(docs):
    rows = [(i, "a" + " word" * 50, "large" if i % 20 else f"s{i % 7}", "en") for i in range(4000)]
    out = mixed(docs, rows)
    whole, kept = out.agg(F.sum("mix_tokens"), F.sum(F.col("mix_tokens") * F.col("probability"))).first()
    assert kept == pytest.approx(0.5 * whole, rel=1e-6) and out.agg(F.max("probability")).first()[0] == pytest.approx(1.0)


def test_capped_raking():
    counts = np.random.default_rng(3).uniform(20, 50, (4, 3, 2))
    counts[3] = 1e-4
    shares = [np.array([0.3, 0.3, 0.3, 0.1]), np.array([0.5, 0.25, 0.25]), np.array([0.6, 0.4])]
    keep = mixing.kept_share(counts, mixing.rake(counts, shares), negligible=0.105, least=0.0)
    w = mixing.rake_capped(counts, shares, keep)
    caps = counts / counts.sum() / keep
    assert keep > 0.2 and w.sum() == pytest.approx(1) and (w <= caps * (1 + 1e-6)).all() and w[3] == pytest.approx(caps[3])
    assert w.sum(axis=(0, 2)) == pytest.approx(shares[1], abs=1e-5) and w.sum(axis=(1, 2))[:3] == pytest.approx([1 / 3] * 3, abs=1e-4)
    exact = mixing.rake(counts, shares)
    assert mixing.kept_share(counts, exact, negligible=0.0, least=0.0) == pytest.approx((counts / counts.sum() / exact).min())
