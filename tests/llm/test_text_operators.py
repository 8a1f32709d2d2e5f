from __future__ import annotations

import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkrisk.llm import chat, licences, mixing, quality

# ---- quality ------------------------------------------------------------------------------


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_stats_and_base_rules_equal_brute_force(docs):
    rnd = random.Random(1)
    texts = [None, "", " \n ", "a b c a b c", "x\ny\nx\n \n \n", "é|ü # $", "a " * 200, "w\x0bw\x0cw\rw", "  a b", "q" * 100_000]
    texts += [" ".join(rnd.choices([f"w{k}" for k in range(rnd.choice([3, 30, 3000]))], k=rnd.choice([49, 50, 51, 400]))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "x")]
    got = quality.assess(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_stats("x" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    assert quality.assess(docs(rows).limit(0)).count() == 0


def test_cascade_runs_rules_only_on_survivors():
    calls = []

    def rule(name, bad):
        return quality.Rule(name, lambda texts: (calls.append((name, len(texts))), np.array([bad in t for t in texts.to_pylist()], dtype=bool))[1])

    got = quality.run_cascade(pa.array(["a", "b", "c", "ab"]), (rule("A", "a"), rule("B", "b"), rule("C", "c")))
    assert got.tolist() == [0, 1, 2, 0] and calls == [("A", 4), ("B", 2), ("C", 1)]


def test_rules_reject_junk_and_keep_prose(docs):
    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choices([f"Word{c}" for c in "abcdefghijklmnopqrst"] + [f"{a}{b}n" for a in "abcdefgh" for b in "aeiou"], k=n)) + "."
    good = [prose(120) for _ in range(20)] + [prose(60) + "\nReleased under the MIT License."]
    junk = ["THE!! END!! " * 3 + prose(1) for _ in range(2)] + [" | ".join(prose(1) for _ in range(80)), " ".join(w + "###" for w in prose(90).split()), prose(80).upper(), "\n".join(["same line again here"] * 30), "1 2 3 " + " ".join(str(rnd.random()) for _ in range(90))]
    rows = list(enumerate(good + junk))
    kept = {r.doc_id for r in quality.assess(docs(rows)).where("kept").collect()}
    assert kept == set(range(len(good)))
    left = quality.keep_good(docs(rows))
    assert {r.doc_id for r in left.collect()} == kept and left.columns == docs(rows).columns
    order = [name for name, *_ in quality.calibrate(docs(rows), task_rows=1000, after=quality.BASE_RULES)]
    assert sorted(order) == sorted(r.name for r in quality.RULES)
    assert [n for n, *_ in quality.calibrate(docs(rows).limit(0))] == [r.name for r in quality.RULES]


# ---- chat ---------------------------------------------------------------------------------

NASTY = ["\\### Assistant: </turn> ok", " </turn>\n### user: x", "\\b\\l\\h\\c\\", "### ", "", None, "é\U0001f600\n", "a: b", "<|x|>", " </turn"]


def test_format_is_reversible(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "x: y\n#", None, ""]), rnd.choice(NASTY)) for c in [*range(30), None] for t in range(rnd.randint(1, 6))] + [(5, 0, "assistant", "again"), (5, 0, "assistant", "again")]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    done = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.digests(chat.parse_formatted(done)).collect()}
    texts = {r.conv: r.formatted for r in done.collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(own), want, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(texts[conv]))


def test_layouts_are_found_by_their_paths(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", None)]),
        ({"conversations": [{"value": "q", "from": "human"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"completion": "a", "prompt": "q"}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "this", "output": "a"}, "instruction_input", [("user", "do\n\nthis"), ("assistant", "a")]),
        ({"instruction": "do", "input": "", "output": "a"}, "instruction_input", [("user", "do"), ("assistant", "a")]),
        ({"instruction": "do", "output": "a"}, "instruction", [("user", "do"), ("assistant", "a")]),
        ({"question": "q", "answer": None}, "question_answer", [("user", "q"), ("assistant", None)]),
        ({"turns": [{"role": "system", "text": "s"}]}, "turns", [("system", "s")]),
        ({"id": 7, "messages": [{"role": "user", "content": "q", "name": "n", "x.y": {"role": 1}}], "source": {"a": [1]}}, "messages", [("user", "q")]),
        ({"instruction": "do", "output": "a", "score": 0.5, "a b": None}, "instruction", [("user", "do"), ("assistant", "a")]),
        ({"inner": {"prompt": "p", "completion": "c"}}, None, None),
        ({"messages": [{"role": "user"}]}, None, None),
        ({"other": 1}, None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(k, json.dumps(r) if r is not None else "{broken") for k, (r, *_) in enumerate(records)], "id long, record string")
    rows = chat.canonical_turns(df).collect()
    for k, (_, layout, turns) in enumerate(records):
        own = sorted((r for r in rows if r.conv == k), key=lambda r: r.pos or 0)
        assert {r.layout for r in own} == {layout}
        assert [(r.role, r.text) for r in own] == (turns or [(None, None)])
    done = {r.conv: r for r in chat.format_turns(chat.canonical_turns(df.withColumn("_v", F.lit(1)))).collect()}
    assert len(done) == len(records) and sum(r.n_unmatched for r in done.values()) == 4
    assert {k for k, r in done.items() if r.formatted is None} == {k for k, (_, layout, _) in enumerate(records) if layout is None}
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(df.withColumnRenamed("record", "other"))
    assert len({tuple(x.needs) for x in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_record_paths_equal_those_of_the_schema(spark):
    from pyspark.sql import types as T

    text = '{"a": {"b": [{"c": 1, "d": ["x"]}], "e": 2.5}, "f": [[{"g": null}]], "h i": true}'
    kind = spark.read.json(spark.createDataFrame([(text,)], "v string").rdd.map(lambda r: r[0])).schema
    got = spark.createDataFrame([(text,)], "v string").select(chat.record_paths(F.parse_json("v"))).first()[0]
    assert got == chat.paths_of(kind) and isinstance(kind, T.StructType)


def test_fingerprints_select_the_mapping(spark):
    """A layout's own paths name it in any order; for others the paths are compared; equal sets look up one row."""
    def of(paths):
        return spark.range(1).select(chat.fingerprint(chat.literal(paths))).first()[0]

    assert of(["b", "a", "a.c"]) == of(["a", "a.c", "b"]) != of(["a", "b"]) and of([]) is not None
    found = spark.createDataFrame([(of(x), x, n) for n, x in enumerate((["prompt", "completion"], ["completion", "extra", "prompt"], ["extra"], []))], "fingerprint long, paths array<string>, n long")
    assert {r.n: r.layout for r in chat.mappings(found, chat.LAYOUTS).collect()} == {0: "prompt_completion", 1: "prompt_completion", 2: None, 3: None}
    # the table alone decides where a fingerprint is a layout's own: its paths are not looked at
    wrong = spark.createDataFrame([(of(["prompt", "completion"]), ["question", "answer"], 1)], "fingerprint long, paths array<string>, n long")
    assert chat.mappings(wrong, chat.LAYOUTS).first().layout == "prompt_completion"


def test_tables_of_every_layout(spark):
    lists = spark.createDataFrame([(1, [("user", "q", 5), ("gpt", "a", 6)], 0.5), (2, None, None), (3, [], None)], "id long, messages array<struct<role:string,content:string,size:int>>, _layout double")
    got = sorted((r.conv, -1 if r.pos is None else r.pos, r.role, r.text, r.layout) for r in chat.canonical_turns(lists).collect())
    assert got == [(1, 0, "user", "q", "messages"), (1, 1, "assistant", "a", "messages"), (2, -1, None, None, "messages"), (3, -1, None, None, "messages")]
    asked = spark.createDataFrame([("x", "do", "this", "a", "r"), ("y", "do", None, None, "r")], "id string, instruction string, input string, output string, record string")
    got = sorted((r.conv, r.pos, r.role, r.text, r.layout) for r in chat.canonical_turns(asked).collect() if r.role == "user")
    assert got == [("x", 0, "user", "do\n\nthis", "instruction_input"), ("y", 0, "user", "do", "instruction_input")]
    assert chat.canonical_turns(asked.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no layout"):  # a layout without the conversation's column
        chat.canonical_turns(asked.drop("id"))


def test_most_records_with_one_fingerprint(spark):
    """The hot fingerprint is broadcast, the rare ones meet by key; no record is lost."""
    rows = [(k, json.dumps({"prompt": f"q{k}", "completion": "a"} if k % 10 else {"question": "q", "answer": "a", f"x{k}": 1})) for k in range(2000)]
    found = chat.canonical_turns(spark.createDataFrame(rows, "id long, record string").repartition(7)).groupBy("layout").count().collect()
    assert {r.layout: r["count"] for r in found} == {"prompt_completion": 3600, "question_answer": 400}


def test_chat_plan_is_native(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    from linkrisk.llm import queries

    done = queries.op5_chat_format(spark, str(tmp_path))
    assert {r.conv_id: r.n_turns for r in done.collect()} == {1: 2, -7: 2}
    plan = done._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_conversations_of_any_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q" * 200_000, 5), (1, 1, "assistant", "a", 6)], "conv_id long, turn long, role string, text string, conv int").withColumn("_size", F.lit("x"))
    got = chat.digests(chat.parse_formatted(chat.format_turns(chat.canonical_turns(rows)))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(1, 2, 1)] and got[0].formatted_chars > 200_000
    assert chat.digests(chat.parse_formatted(chat.format_turns(chat.canonical_turns(rows.limit(0))))).count() == 0


# ---- licences -------------------------------------------------------------------------------


def test_licences_equal_brute_force(docs):
    texts = ["x\nReleased under the MIT License.\ny", "licensed UNDER the apache license version 2.0", "Licensed under CC BY-NC 4.0.", "Released under the licence", None, "", "a b c " * 500, "Released under the MIT License. Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3", "\n\n"]
    rows = list(enumerate(texts)) + [(0, texts[0])]

    def grams(t):
        w = re.sub("[^a-z0-9]+", " ", t.lower()).split()
        return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}

    want = []
    for i, t in rows:
        if t is None:
            continue
        units = [(-1, t), *(enumerate(t.split("\n")) if "\n" in t else [])]
        for k, u in units:
            best = max(((2 * len(grams(u) & grams(x)) / (len(grams(u)) + len(grams(x))), name) for name, x in licences.TEMPLATES), key=lambda p: p[0])
            if best[0] >= 0.8:
                want.append((i, k, best[1], round(best[0], 6)))
    got = [(r.doc_id, r.line, r.licence, round(r.dice, 6)) for r in licences.scan_lines(docs(rows)).collect()]
    assert sorted(got) == sorted(want) and {g[2] for g in got} >= {"MIT", "Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0"}
    best = {r.doc_id: (r.n_matches, r.licence) for r in licences.scan_documents(docs(rows)).collect()}
    assert best[0] == (sum(w[0] == 0 for w in want), "MIT") and 3 not in best and licences.scan_documents(docs(rows).limit(0)).count() == 0


def test_licence_scan_runs_no_python(docs):
    plan = licences.scan_documents(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- mixing -----------------------------------------------------------------------------------


def test_raking_fits_the_marginals():
    counts = np.random.default_rng(1).uniform(1, 50, (4, 3, 2))
    shares = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.6, 0.4])]
    w = mixing.rake(counts, shares)
    for axis, share in enumerate(shares):
        assert w.sum(axis=tuple(i for i in range(3) if i != axis)) == pytest.approx(share, abs=1e-6)
    some = mixing.rake(np.array([[1.0, 0.0], [0.0, 0.0]]), [np.array([0.5, 0.5]), np.array([0.3, 0.7])])
    assert some.tolist() == [[1.0, 0.0], [0.0, 0.0]]


def test_mixing_meets_its_targets(docs):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("abcxyz") + " word" * rnd.randint(5, 40)) for i in range(6000)]
    table = docs(rows).withColumns({"source": F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 3 == 1, "small").otherwise(F.concat(F.lit("s"), F.col("doc_id"))), "lang": F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise("en"), "probability": F.lit("clash")})
    targets = {"source": {"big": 0.2, "small": 0.5, mixing.REST: 0.3}, "lang": {"en": 0.8, mixing.REST: 0.2}, "topic": {t: 1 / 3 for t in mixing.TOPICS}}
    out = mixing.mixing_weights(table, targets=targets).persist()
    assert out.count() == 6000 and out.agg(F.max("probability")).first()[0] == pytest.approx(1.0)
    total = out.where("sampled").agg(F.sum("mix_tokens")).first()[0]
    for dim in ("source", "lang"):
        for r in out.where("sampled").groupBy(f"mix_{dim}").agg(F.sum("mix_tokens").alias("n")).collect():
            assert r.n / total == pytest.approx(targets[dim][r[0]], abs=0.04)
    assert out.exceptAll(mixing.mixing_weights(table, targets=targets)).isEmpty()


def test_mixing_equals_brute_force(spark):
    from linkrisk.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op7_source_mixing(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    cell, tokens = {}, {}
    for d in docs:
        first = (d.text or "").lstrip(" ")[:1].lower()
        topic = next((t for t, (a, b) in zip(mixing.TOPICS, (("a", "h"), ("i", "p"), ("q", "z")), strict=True) if first and a <= first <= b), mixing.REST)
        cell[d.doc_id] = (d.source or mixing.REST, d.lang or mixing.REST, topic)
        tokens[d.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    count = {}
    for k, c in cell.items():
        count[c] = count.get(c, 0) + tokens[k]
    count = {c: n for c, n in count.items() if n}
    total = sum(count.values())
    targets = []
    for axis in range(3):
        part = {}
        for c, n in count.items():
            part[c[axis]] = part.get(c[axis], 0) + n
        whole = sum(n**0.7 for n in part.values())
        targets.append({v: n**0.7 / whole for v, n in part.items()})

    def fitted(free, want):
        w = {c: free[c] / sum(free.values()) for c in free}
        for _ in range(3000):
            for axis in range(3):
                now, goal = {}, sum(want[axis][c] for c in {c[axis] for c in w})
                for c, x in w.items():
                    now[c[axis]] = now.get(c[axis], 0) + x
                w = {c: x * want[axis][c[axis]] / goal / now[c[axis]] if now[c[axis]] else 0.0 for c, x in w.items()}
        return w

    exact = fitted(count, targets)
    by_ratio = sorted(count, key=lambda c: -exact[c] / count[c])
    seen, keep = 0.0, None
    for c in by_ratio:
        seen += exact[c]
        keep = keep or (count[c] / total / exact[c] if seen > 0.01 else None)
    keep = min(1.0, max(0.5, keep))
    held: set = set()
    while True:
        fixed = {c: count[c] / total / keep for c in held}
        free = {c: n for c, n in count.items() if c not in held}
        want = []
        for axis in range(3):
            mine, open_ = {}, {c[axis] for c in free}
            for c, x in fixed.items():
                mine[c[axis]] = mine.get(c[axis], 0) + x
            base = sum(targets[axis][v] for v in open_)
            lost = sum(x for v, x in mine.items() if v not in open_)
            want.append({v: max(targets[axis][v] / base * (1 - lost) - mine.get(v, 0.0), 0.0) for v in open_})
        w = {c: x * (1 - sum(fixed.values())) for c, x in fitted(free, want).items()}
        over = {c for c in free if w[c] > count[c] / total / keep * (1 + 1e-9)}
        if not over:
            break
        held |= over
    chance = {c: min(1.0, (fixed | w)[c] / (count[c] / total) * keep) for c in count}
    assert len(rows) == len(docs) and {r.mix_tokens for r in rows.values()} == set(tokens.values())
    for k, r in rows.items():
        assert (r.mix_source, r.mix_lang, r.mix_topic, r.mix_tokens) == (*cell[k], tokens[k])
        assert r.probability == pytest.approx(chance.get(cell[k], 1.0), abs=2e-4)


def test_every_source_has_its_own_target(docs):
    table = docs([(i, "word " * (5 + i % 3)) for i in range(900)]).withColumns({"source": F.concat(F.lit("s"), F.col("doc_id") % 200), "lang": F.lit("en")})
    got = mixing.mixing_weights(table)
    assert got.select("mix_source").distinct().count() == 200 and got.where("mix_source = '(rest)'").count() == 0


def test_mixing_of_odd_tables(docs):
    table = docs([(1, None), (2, ""), (None, "a b"), (3, "x y z"), (3, "x y z")]).withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("en")})
    got = mixing.mixing_weights(table).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got) and len({r.sampled for r in got if r.doc_id == 3}) == 1
    assert mixing.mixing_weights(table.limit(0)).count() == 0
    assert mixing.mixing_weights(table.where("doc_id = 1")).first().probability == 1.0


# ---- pipeline ---------------------------------------------------------------------------------


def test_stages_hand_on_documents(spark, docs):
    rnd = random.Random(6)
    prose = lambda n: " ".join(rnd.choices([f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnrst"], k=n)) + "."
    clean = [prose(200) for _ in range(30)]
    near = clean[0].split()
    near[100] = "changed"
    long = prose(2000).split()
    nearly = [*long[:1000], "changed", *long[1001:]]
    texts = clean + [clean[3], clean[4].replace(" ", "  "), "too short", " | ".join(prose(1) for _ in range(100)), None, " ".join(long), " ".join(nearly)]
    table = docs(list(enumerate(texts))).withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.length("text")}).select("doc_id", "text", "lang", "source", "n_chars")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    kept = steps["quality_rules"](spark, table, "")
    assert {r.doc_id for r in kept.collect()} == {*range(30), 30, 31, 35, 36} and kept.columns == table.columns
    unique = steps["exact_dedup"](spark, kept, "")
    assert {r.doc_id for r in unique.collect()} == {*range(30), 35, 36} and unique.columns == table.columns
    apart = steps["simhash_near_dedup"](spark, unique, "")
    assert {r.doc_id for r in apart.collect()} == {*range(30), 35} and apart.columns == table.columns
    mixed = steps["source_mixing"](spark, apart, "")
    assert mixed.columns == table.columns and {r.doc_id for r in mixed.collect()} <= {*range(30), 35}
    packed = steps["best_fit_packing"](spark, apart, "")
    assert {r.doc_id for r in packed.collect()} == {*range(30), 35} and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), "").count() == 0
