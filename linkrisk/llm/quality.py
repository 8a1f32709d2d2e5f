"""Quality rules as a short-circuit cascade.

Each rule decides on a batch of texts at once. On a sample, of the texts that come to the cascade, its
cost and the share it rejects are measured; rules then run in the order of rejections per second, each only on texts that all rules
before it have passed. The order changes what is computed, never what is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, text_of
from .memory import lean
from .tokens import sliced

SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# ---- statistics of a batch of texts ---------------------------------------------------------


@dataclass
class Words:
    """The words of a batch, one after the other: the text each is in, and the word."""

    n: int
    doc: np.ndarray
    words: pa.Array

    @classmethod
    def of(cls, texts: pa.Array) -> "Words":
        lists = pc.ascii_split_whitespace(texts)
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        full = pc.not_equal(flat, "")
        return cls(len(texts), doc[full.to_numpy(zero_copy_only=False)], flat.filter(full))

    def per_text(self, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc, weights, self.n).astype(np.int64)


def count_matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    full = pc.match_substring_regex(flat, HAS_WORD)
    doc = doc[full.to_numpy(zero_copy_only=False)]
    codes = flat.filter(full).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = max(1, len(texts))
    distinct = np.unique(codes * n + doc) % n
    lines = np.bincount(doc, minlength=len(texts))
    return lines, lines - np.bincount(distinct, minlength=len(texts))


def repeat_words(words: Words) -> np.ndarray:
    """Words in windows of three that occur twice or more in their text, the first included."""
    doc = words.doc
    if len(doc) < 3:
        return np.zeros(words.n, dtype=np.int64)
    codes = words.words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = int(codes.max()) + 1
    whole = doc[:-2] == doc[2:]
    pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)[1]
    windows = np.unique(pairs[:-1] * size + codes[2:], return_inverse=True)[1]
    _, at, n = np.unique((windows * words.n + doc[:-2])[whole], return_inverse=True, return_counts=True)
    hit = np.zeros(len(whole), dtype=bool)
    hit[whole] = n[at] > 1
    covered = np.zeros(len(doc), dtype=bool)
    for k in range(3):
        covered[k : len(doc) - 2 + k] |= hit
    return np.bincount(doc[covered], minlength=words.n)


def stats_of(texts: pa.Array) -> dict[str, np.ndarray]:
    words = Words.of(texts)
    return {
        "n_words": words.per_text(),
        "word_chars": words.per_text(pc.utf8_length(words.words).to_numpy(zero_copy_only=False)),
        "n_symbols": count_matches(texts, SYMBOLS),
        "n_dup_lines": line_counts(texts)[1],
        "n_repeat_words": repeat_words(words),
    }


# ---- rules ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[pa.Array], np.ndarray]


def _too_short(texts: pa.Array) -> np.ndarray:
    return Words.of(texts).per_text() < 50


def _repetitive(texts: pa.Array) -> np.ndarray:
    words = Words.of(texts)
    return 100 * repeat_words(words) > 50 * words.per_text()


def _symbols(texts: pa.Array) -> np.ndarray:
    return 5 * count_matches(texts, SYMBOLS) > Words.of(texts).per_text()


def _shouting(texts: pa.Array) -> np.ndarray:
    return 10 * count_matches(texts, r"\p{Lu}") > 4 * count_matches(texts, r"\p{L}")


def _bangs(texts: pa.Array) -> np.ndarray:
    return 10 * pc.count_substring(texts, "!").to_numpy(zero_copy_only=False).astype(np.int64) > 3 * Words.of(texts).per_text()


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    lines, repeated = line_counts(texts)
    return 2 * repeated > lines


def _word_length(texts: pa.Array) -> np.ndarray:
    words = Words.of(texts)
    n, chars = words.per_text(), words.per_text(pc.utf8_length(words.words).to_numpy(zero_copy_only=False))
    return (2 * chars < 3 * n) | (chars > 20 * n)


def _letterless(texts: pa.Array) -> np.ndarray:
    words = Words.of(texts)
    with_letter = pc.match_substring_regex(words.words, r"\p{L}").to_numpy(zero_copy_only=False)
    return 2 * words.per_text(with_letter) < words.per_text()


BASE_RULES = (Rule("too_short", _too_short), Rule("repetitive", _repetitive))
RULES = (
    Rule("symbols", _symbols), Rule("shouting", _shouting), Rule("bangs", _bangs), Rule("duplicate_lines", _duplicate_lines),
    Rule("word_length", _word_length), Rule("letterless", _letterless),
)


def calibrate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", task_rows: int = 64, after: tuple[Rule, ...] = ()) -> list[tuple[str, float, float]]:
    """Name, seconds per text and share rejected of each rule, in the order in which to run them.

    Measured on the first ``task_rows`` texts of every partition that no rule of ``after`` rejects,
    so that no more than the beginning of each partition is read. A rule that the sample says
    nothing about keeps its given place among those of equal worth.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad, took = 0, [0] * len(rules), [0.0] * len(rules)
        for batch in batches:
            texts = batch.column(0).cast(pa.large_string()).slice(0, 4 * task_rows)
            texts = texts.filter(pa.array(run_cascade(texts, after) < 0)).slice(0, task_rows - seen)
            seen += len(texts)
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                bad[k] += int(rule.rejects(texts).sum())
                took[k] += time.perf_counter() - began
            if seen >= task_rows:
                break
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array([seen] * len(rules), pa.int64()), pa.array(bad, pa.int64()), pa.array(took)], names=["rule", "seen", "bad", "took"])

    rows = docs.select(text_of(text_col).alias("_text")).mapInArrow(measure, "rule int, seen long, bad long, took double").groupBy("rule").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"), F.sum("took").alias("took")).collect()
    found = {r["rule"]: (r["took"] / r["seen"], r["bad"] / r["seen"]) for r in rows if r["seen"]}
    order = sorted(range(len(rules)), key=lambda k: (-(found[k][1] / max(found[k][0], 1e-12)) if k in found else 0.0, k))
    return [(rules[k].name, *found.get(k, (0.0, 0.0))) for k in order]


def ordered(rules: tuple[Rule, ...], calibration: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    by_name = {r.name: r for r in rules}
    return tuple(by_name[name] for name, *_ in calibration)


def run_cascade(texts: pa.Array, rules: tuple[Rule, ...], alive: np.ndarray | None = None) -> np.ndarray:
    """For each text the number of the rule that rejects it first, or -1."""
    verdict = np.full(len(texts), -1, dtype=np.int32)
    left = np.arange(len(texts)) if alive is None else np.flatnonzero(alive)
    for k, rule in enumerate(rules):
        if not len(left):
            break
        bad = rule.rejects(texts.take(pa.array(left)))
        verdict[left[bad]] = k
        left = left[~bad]
    return verdict


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", task_rows: int = 64) -> DataFrame:
    """One row per document: its id, STATS, base_failed, kept and failed_rule.

    base_failed: fewer than 50 words, or more than half of them in repeated windows of three. The
    cascade then judges only the other texts. A null text has no words, so it fails. An empty table
    gives an empty result; repeated rows get the same verdict each; texts of any length are judged
    whole; other columns are not read.
    """
    cascade = ordered(rules, calibrate(docs, rules, text_col=text_col, task_rows=task_rows, after=BASE_RULES))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(k, T.LongType()) for k in STATS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("failed_rule", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), rows_of(batch, "_text")[0]
            for a, b in sliced(texts):
                part = pa.array(texts[a:b], pa.large_string())
                stats = stats_of(part)
                failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
                verdict = run_cascade(part, cascade, ~failed)
                names = pa.array([None if v < 0 else cascade[v].name for v in verdict], pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(stats[k], pa.int64()) for k in STATS), pa.array(failed), pa.array(~failed & (verdict < 0)), names], names=schema.names)

    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(judge, schema)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, *, text_col: str = "text", task_rows: int = 64) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no rule rejects. Nulls and empty texts have
    no words and go; texts of any length are judged whole; repeated rows are judged alike; an empty
    table gives an empty result; no column is added, so none can clash."""
    cascade = ordered(rules, calibrate(docs, rules, text_col=text_col, task_rows=task_rows))
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches, at):
            texts = batch.column(at).cast(pa.large_string()).fill_null("")
            yield batch.filter(pa.array(run_cascade(texts, cascade) < 0))

    return docs.mapInArrow(judge, docs.schema)
