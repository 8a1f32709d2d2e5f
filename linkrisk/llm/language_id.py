"""Language identification by interpolated Kneser-Ney character models, one for each language.

Text becomes lower-case letters with one space between their runs. Each language's n-grams up to ORDER are
counted on a sample of labelled documents that is bounded in bytes (SAMPLE_BYTES for all languages together;
the documents with the smallest hashes of their ids, whole texts); one task trains one language. What
is left of a discounted count goes to the next lower order, whose counts are of distinct letters to the
left; the lowest is mixed with an equal share for every letter there is. Models are kept as sorted arrays of
64-bit hashes, one for each order, with the log probability in every language beside each n-gram
that any language has, and likewise arrays of contexts with what they leave to lower orders.

A text gets the language of the lowest cross-entropy per letter. One in five sampled documents takes
no part in the counts; these set how differences of cross-entropy turn into a score from 0 to 1, and
above which cross-entropy a text of a language is not taken for one (``rejected``).

A missing text, or one without letters, is ``und`` with score 0 and rejected; so are all texts if no document
has a label. Documents without a language teach nothing. A missing id counts as an empty one. Repeated
rows each count; very long texts are read whole, in pieces; an empty table gives an empty one. Other
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, stored

ORDER = 5
#: The labelled text that models are trained on and calibrated with has about so many bytes at most, in
#: equal parts for the languages, of which the most frequent MOST_LANGUAGES are learned.
SAMPLE_BYTES = 6_000_000
MOST_LANGUAGES = 100
#: No language needs more than this.
LANGUAGE_BYTES = 1_500_000
#: Every fifth sampled document calibrates.
CALIBRATE = 5
#: The share of a language's own texts that may be rejected.
REJECT = 0.005
#: Letters that Unicode has, about: the lowest order gives each an equal share.
LETTERS = 1 << 17
UNKNOWN = "und"
#: Letters that are looked up at once.
PIECE = 1 << 18
SPACE = 32
MULTIPLY, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point the letter it folds to, or a space."""
    out = np.full(0x110000, SPACE, dtype=np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """The letters of a text and single spaces after their runs, each piece behind its ORDER - 1
    predecessors (spaces before the first); nothing if there is no letter."""
    before, spaced = np.full(ORDER - 1, SPACE, dtype=np.uint32), True
    for at in range(0, len(text or ""), PIECE):
        x = _letters()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        if at + PIECE >= len(text):
            x = np.append(x, np.uint32(SPACE))
        letter = x != SPACE
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= not spaced
        spaced = not letter[-1]
        x = x[keep]
        if len(x):
            out = np.r_[before, x]
            before = out[len(out) - ORDER + 1 :]
            yield out


def hashes(letters: np.ndarray) -> list[np.ndarray]:
    """For n from 0 to ORDER the hash of the n letters up to each place (wrong before the n-th)."""
    out = [np.zeros(len(letters), dtype=np.uint64)]
    for n in range(ORDER):
        h = (out[-1] ^ np.r_[np.zeros(n, dtype=np.uint64), letters[: len(letters) - n].astype(np.uint64)] * MULTIPLY) * STIR
        out.append(h ^ (h >> np.uint64(32)))
    return out


def _distinct(keys: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted keys once each, how often they stood there, and ``more`` of one of their places."""
    keys, at, counts = np.unique(keys, return_index=True, return_counts=True)
    return keys, counts, *(x[at] for x in more)


def trained(texts: list[str]) -> dict[str, list[np.ndarray]]:
    """The model of one language. By order from 1: n-grams (``keys``), their contexts (``before``) and
    what they end with (``end``), log2 probabilities (``logp``); contexts of that order (``contexts``)
    and the log2 of what these leave to the next lower (``left``)."""
    grams: list[list[np.ndarray]] = [[] for _ in range(ORDER + 1)]
    skip = ORDER - 1
    for text in texts:
        for letters in pieces(text):
            h = hashes(letters)
            for n in range(1, ORDER + 1):  # with its context and what it ends with
                grams[n].append(np.stack([h[n][skip:], h[n - 1][skip - 1 : -1], h[n - 1][skip:]]))
    counted: list[tuple] = [()] * (ORDER + 1)
    counted[ORDER] = _distinct(*np.concatenate(grams[ORDER], axis=1))
    for n in range(ORDER - 1, 0, -1):
        _, _, before, end = _distinct(*np.concatenate(grams[n], axis=1))
        keys, counts = np.unique(counted[n + 1][3], return_counts=True)  # distinct letters to the left
        counted[n] = (keys, counts, before, end)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("keys", "before", "end", "logp", "contexts", "left")}
    lower_keys, lower = np.zeros(1, dtype=np.uint64), np.array([1 / LETTERS])
    for n in range(1, ORDER + 1):
        keys, counts, before, end = counted[n]
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once and twice else 0.5
        contexts, place = np.unique(before, return_inverse=True)
        total, kinds = np.bincount(place, counts), np.bincount(place)
        left = discount * kinds / total
        p = (counts - discount) / total[place] + left[place] * lower[np.searchsorted(lower_keys, end)]
        for name, x in (("keys", keys), ("before", before), ("end", end), ("logp", np.log2(p)), ("contexts", contexts), ("left", np.log2(left))):
            out[name].append(x)
        lower_keys, lower = keys, p
    return out


class Found:
    """A sorted array of hashes, each with a row of values, and for each beginning of a hash the place of the
    first that is not smaller."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        bits = max(1, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rows = np.vstack([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)  # the last row is for those that are absent

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its row, or zeros."""
        at = self.first[hashes >> self.shift]
        keys = self.keys[at]
        below = np.flatnonzero(keys < hashes)
        while len(below):
            at[below] += 1
            keys[below] = now = self.keys[at[below]]
            below = below[now < hashes[below]]
        there = keys == hashes
        at[~there] = len(self.keys) - 1
        return there, self.rows[at]


class Model:
    """The models of all ``languages`` together."""

    def __init__(self, languages: list[str], models: list[dict[str, list[np.ndarray]]]) -> None:
        self.languages = languages
        self.grams: list[Found] = []
        self.contexts: list[Found] = []
        lower_keys, lower = np.zeros(1, dtype=np.uint64), np.full((1, len(languages)), -np.log2(LETTERS))
        for n in range(ORDER if models else 0):
            contexts = functools.reduce(np.union1d, (m["contexts"][n] for m in models))
            left = np.zeros((len(contexts), len(models)))
            for k, m in enumerate(models):
                left[np.searchsorted(contexts, m["contexts"][n]), k] = m["left"][n]
            keys, at = np.unique(np.concatenate([m["keys"][n] for m in models]), return_index=True)
            before, end = (np.concatenate([m[x][n] for m in models])[at] for x in ("before", "end"))
            logp = left[np.searchsorted(contexts, before)] + lower[np.searchsorted(lower_keys, end)]
            for k, m in enumerate(models):
                logp[np.searchsorted(keys, m["keys"][n]), k] = m["logp"][n]
            lower_keys, lower = keys, logp
            self.grams.append(Found(keys, logp))
            self.contexts.append(Found(contexts, left))
        self.temperature, self.limits = 8.0, np.full(len(languages), np.inf)

    def log_probabilities(self, letters: np.ndarray) -> np.ndarray:
        """For each place from the ORDER-th on the log2 probability of its letter in every language."""
        h, skip = hashes(letters), ORDER - 1
        there, out = self.grams[-1].get(h[ORDER][skip:])
        todo = np.flatnonzero(~there)
        for n in range(ORDER - 1, -1, -1):  # what a longer context leaves, and then the shorter n-gram
            out[todo] += self.contexts[n].get(h[n][todo + skip - 1])[1]
            if n:
                there, rows = self.grams[n - 1].get(h[n][todo + skip])
                out[todo] += rows
                todo = todo[~there]
        out[todo] -= np.float32(np.log2(LETTERS))
        return out

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Bits per letter of each text in every language; not a number for texts without letters."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        held, owners, size = [], [], 0
        for k, text in enumerate(texts):
            for letters in pieces(text):
                held.append(letters)
                owners.append(k)
                size += len(letters)
                if size >= PIECE:
                    self._add(held, owners, sums, sizes)
                    held, owners, size = [], [], 0
        if held:
            self._add(held, owners, sums, sizes)
        return -sums / np.where(sizes > 0, sizes, np.nan)[:, None]

    def _add(self, held: list[np.ndarray], owners: list[int], sums: np.ndarray, sizes: np.ndarray) -> None:
        logp = self.log_probabilities(np.concatenate(held))
        begins = np.cumsum([0] + [len(x) for x in held])[:-1]  # the context of all but the first stands between and is left out
        ends = begins + np.array([len(x) for x in held]) - (ORDER - 1)
        cuts = np.stack([begins, ends], axis=1).ravel()
        parts = np.add.reduceat(np.r_[logp, np.zeros((1, logp.shape[1]), dtype=logp.dtype)], np.minimum(cuts, len(logp)), axis=0, dtype=np.float64)[::2]
        np.add.at(sums, owners, parts)
        np.add.at(sizes, owners, ends - begins)

    def calibrated(self, entropies: np.ndarray, right: np.ndarray) -> Model:
        """Sets the temperature of the score and each language's limit from texts whose language is known."""
        some = ~np.isnan(entropies).any(axis=1)
        entropies, right = entropies[some], right[some]
        if len(right):
            grid = 2.0 ** np.arange(-2, 7)
            losses = [-np.log(_shares(entropies, t)[np.arange(len(right)), right] + 1e-12).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(losses))])
        for k in range(len(self.languages)):
            mine = entropies[right == k, k]
            if len(mine):  # a little above what nearly all of them stay under
                self.limits[k] = np.quantile(mine, 1 - REJECT) + mine.std() + 1 / np.sqrt(len(mine))
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its language, score, bits per letter, and whether it is rejected."""
        entropies = self.entropies(texts) if self.languages else np.zeros((len(texts), 1))
        none = np.isnan(entropies).any(axis=1) if self.languages else np.ones(len(texts), dtype=bool)
        filled = np.where(none[:, None], 0.0, entropies)
        best = filled.argmin(axis=1)
        bits = filled[np.arange(len(texts)), best]
        score = np.where(none, 0.0, _shares(filled, self.temperature)[np.arange(len(texts)), best])
        names = [UNKNOWN if x else self.languages[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
        limits = self.limits if self.languages else np.zeros(1)
        return names, score, np.where(none, np.nan, bits), none | (bits > limits[best])


def _shares(entropies: np.ndarray, temperature: float) -> np.ndarray:
    x = np.exp(-temperature * (entropies - entropies.min(axis=1, keepdims=True)))
    return x / x.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame) -> DataFrame:
    """lang, text and fold of whole labelled documents: of each language those with the smallest hashes of
    their ids, until they have its share of SAMPLE_BYTES."""
    known = docs.where("lang is not null and text is not null").select("lang", "text", "doc_id", F.octet_length("text").cast("long").alias("size"))
    of = known.groupBy("lang").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    share = min(LANGUAGE_BYTES, SAMPLE_BYTES // max(1, len(of)))
    # twice what is needed, by hash, and 50 documents at least; the exact cut comes after
    rows = [(r.lang, min(1.0, max(2 * share / max(1, r.bytes), 50 / r.n))) for r in of]
    parts = docs.sparkSession.createDataFrame(rows, "lang string, part double")
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    some = known.join(F.broadcast(parts), "lang").withColumn("order", order).where("(order / 18446744073709551616D + 0.5D) <= part")
    before = Window.partitionBy("lang").orderBy("order", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("_before") < share)
    return some.select("lang", "text", (F.pmod(F.xxhash64("order"), F.lit(CALIBRATE)) == 0).alias("calibrates"))


def _train(group: pd.DataFrame) -> pd.DataFrame:
    texts = group["text"][~group["calibrates"]].tolist()
    model = trained(texts) if any(True for t in texts for _ in pieces(t)) else None
    rows = [(group["lang"].iloc[0], name, n, x.dtype.str, x.tobytes()) for name, by_order in (model or {}).items() for n, x in enumerate(by_order)]
    return pd.DataFrame(rows, columns=["lang", "name", "n", "kind", "data"])


def learned(docs: DataFrame) -> Model:
    """The calibrated model of the labelled ``docs`` (doc_id, text, lang)."""
    sample = stored(labelled_sample(docs), "labelled")
    models: dict[str, dict[str, list]] = {}
    for r in sample.groupBy("lang").applyInPandas(_train, "lang string, name string, n int, kind string, data binary").collect():  # bounded by the sample
        models.setdefault(r.lang, {}).setdefault(r.name, [None] * ORDER)[r.n] = np.frombuffer(r.data, dtype=r.kind)
    languages = sorted(models)
    if not languages:
        return Model([], [])
    model = Model(languages, [models[x] for x in languages])
    seen = sample.where(F.col("calibrates") & F.col("lang").isin(languages)).toPandas()
    return model.calibrated(model.entropies(seen["text"].tolist()), np.array([languages.index(x) for x in seen["lang"]], dtype=int))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits (per letter) and rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = rows_of(batch, "text")
            names, score, bits, rejected = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64(), from_pandas=True), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "bits", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, bits double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """The language of every document, learned from the labels of those that are not held out."""
    found = identified(docs, learned(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits", "rejected")
