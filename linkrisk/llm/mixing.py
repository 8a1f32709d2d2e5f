"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell of (source, language, topic). Values that a target does not name fall
into one cell value. Only the cells that have documents reach the driver, MAX_CELLS at most: more are
an error, not a change of the result. There the token weights are raked to each marginal in turn
until all fit.
The raked weight over the counted one, scaled to the share of tokens to keep, is the probability
with which each document of a cell is kept. No document is kept twice: cells that would need a
probability above 1 are kept whole, and the others are raked again to what is left. The share to keep
is set by the cells that weigh something, so that a rare value does not thin all others.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORDS, stored, text_of

REST = "(rest)"
#: Cells that the driver rakes at most (it holds a few numbers of each).
MAX_CELLS = 1_000_000
BROADCAST_CELLS = 100_000
Marginals = Mapping[str, Mapping[str, float]]

#: Topics stand for a column that ``documents`` does not have: the initials of words.
TOPICS = ("a-h", "i-p", "q-z")
LETTERS = ("abcdefghABCDEFGH", "ijklmnopIJKLMNOP", "qrstuvwxyzQRSTUVWXYZ")
TOKENS = "_tokens"


def topic_of(text: Column) -> Column:
    """The topic by the initial of the first word only; :func:`main_topic` reads whole texts."""
    first = F.lower(F.substring(F.ltrim(text), 1, 1))
    return F.when(first.between("a", "h"), TOPICS[0]).when(first.between("i", "p"), TOPICS[1]).when(first.between("q", "z"), TOPICS[2]).otherwise(REST)


def main_topic(text: Column) -> Column:
    """The topic by the initials of all words: the one that most of them have, of equal ones the first; REST if none has any."""
    initials = F.array_join(F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(SPACES[:-1] + "([A-Za-z])"), F.lit(1)), "")
    counts = [F.length(initials) - F.length(F.translate(initials, letters, "")) for letters in LETTERS]
    ranked = [F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(t).alias("topic")) for k, (n, t) in enumerate(zip(counts, TOPICS, strict=True))]
    return F.array_max(F.array(*ranked, F.struct(F.lit(0).alias("n"), F.lit(1).alias("k"), F.lit(REST).alias("topic"))))["topic"]


def named(column: Column, target: Mapping[str, float]) -> Column:
    """The value, or REST for null and for values without a target."""
    return F.when(column.isin(*(k for k in target if k != REST)), column).otherwise(REST) if set(target) - {REST} else F.lit(REST)


Codes = list[np.ndarray]  # for each dimension the place of every cell's value


def _cells(counts: np.ndarray, codes: Codes | None) -> tuple[np.ndarray, Codes]:
    """Cells as a list; a full table of counts is one too."""
    if codes is not None:
        return counts, codes
    return counts.ravel(), [x.ravel() for x in np.indices(counts.shape)]


def rake(counts: np.ndarray, shares: list[np.ndarray], codes: Codes | None = None, *, rounds: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """Weights with the zeros of ``counts`` and, as far as these allow, the marginal ``shares``.

    ``counts`` has one number for each cell, whose values ``codes`` tell, or is a full table.
    Shares of values without any count are spread over the others in proportion. Zeros may leave no
    weights that fit; that the last round was off is a warning.
    """
    cells, codes = _cells(counts, codes)
    weights, off = cells / cells.sum(), 0.0
    for _ in range(rounds):
        off = 0.0
        for code, share in zip(codes, shares, strict=True):
            now = np.bincount(code, weights, len(share))
            want = np.where(now > 0, share, 0.0)
            if want.sum() == 0:
                continue
            want = want / want.sum()
            off = max(off, float(np.abs(now - want).max()))
            weights = weights * np.divide(want, now, out=np.ones_like(now), where=now > 0)[code]
        if off < tolerance:
            break
    if off > 1e-4:
        warnings.warn(f"raking stopped after {rounds} rounds; a marginal is off by {off:.2g}", stacklevel=2)
    return weights.reshape(counts.shape)


def kept_share(counts: np.ndarray, weights: np.ndarray, *, negligible: float, least: float) -> float:
    """The largest share of tokens that can be kept while the cells which are too small for their
    weight hold at most ``negligible`` of all weight, and ``least`` at least."""
    some = counts > 0
    ratio, weight = weights[some] / (counts[some] / counts.sum()), weights[some]
    order = np.argsort(-ratio, kind="stable")
    above = np.cumsum(weight[order])
    first = min(int(np.searchsorted(above, negligible * weight.sum(), side="right")), len(order) - 1)
    return float(min(1.0, max(least, 1 / ratio[order][first])))


def rake_capped(counts: np.ndarray, shares: list[np.ndarray], keep: float, codes: Codes | None = None) -> np.ndarray:
    """Weights as by :func:`rake`, of which none exceeds its cell's count over ``keep``.

    Cells above that are held there, and the others are raked to what these leave of each share.
    """
    cells, codes = _cells(counts, codes)
    caps = cells / cells.sum() / keep
    held = np.zeros(len(cells), dtype=bool)
    while True:
        fixed = np.where(held, caps, 0.0)
        free = np.where(held, 0.0, cells)
        if free.sum() == 0:
            return fixed.reshape(counts.shape)
        left = []
        for code, share in zip(codes, shares, strict=True):
            mine, open_ = np.bincount(code, fixed, len(share)), np.bincount(code, free, len(share)) > 0
            # what values without a free cell cannot take goes to the others in proportion to their shares
            want = np.where(open_, share, 0.0)
            want = want / want.sum() * (1 - mine[~open_].sum()) if want.sum() > 0 else want
            left.append(np.where(open_, np.maximum(want - mine, 0.0), 0.0))
        weights = rake(free, left, codes) * (1 - fixed.sum())
        over = ~held & (weights > caps * (1 + 1e-9)) & (cells > 0)
        if not over.any():
            return (fixed + weights).reshape(counts.shape)
        held |= over


def softened(docs: DataFrame, dims: Mapping[str, Column], tokens: Column, *, top: int | None = None, power: float = 0.7) -> dict[str, dict[str, float]]:
    """Target shares from the data: each marginal's token share to ``power``, made to sum to 1.

    Every value has a target of its own. Only if ``top`` is given, the values beyond that many share
    one entry; more values than MAX_CELLS without it are an error.
    """
    out = {}
    for name, column in dims.items():
        total = docs.groupBy(F.coalesce(column.cast("string"), F.lit(REST)).alias("v")).agg(F.sum(tokens).alias("n"))
        rows = total.where(F.col("v") != REST).orderBy(F.desc("n"), "v").limit(top if top is not None else MAX_CELLS + 1).collect()
        if len(rows) > MAX_CELLS:
            raise ValueError(f"{name} has more than {MAX_CELLS} values; name some as targets, or set top")
        everything = total.agg(F.sum("n")).first()[0] or 0
        rest = everything - sum(r["n"] or 0 for r in rows)
        share = {r["v"]: float(r["n"]) ** power for r in rows if r["n"]} | ({REST: float(rest) ** power} if rest else {})
        whole = sum(share.values())
        out[name] = {k: v / whole for k, v in share.items()}
    return out


def mixing_weights(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dims: Mapping[str, Column] | None = None,
    targets: Marginals | None = None, tokens: Column | None = None, seed: int = 7, keep_share: float | None = None,
    negligible: float = 0.01, least_share: float | None = None,
) -> DataFrame:
    """``docs`` with its cell (one column mix_<dim> for each dimension), mix_tokens, probability and
    sampled.

    ``targets`` has the wanted share of tokens of each value of each dimension; without it they are
    softened from the data. A document is sampled if the hash of its id (of its text, where the id
    is null) lies below its probability, so runs and repeated rows agree. Documents without words
    weigh nothing in the counts and get the probability of their cell; a cell without tokens has
    probability 1. Clashing columns of ``docs`` are replaced, others kept. Texts of any length are
    counted whole; without ``dims`` their topics are by the initials of all words. An empty table gives an empty result.

    The share of all tokens to keep is the largest that the targets allow, apart from cells that
    together have at most ``negligible`` of the weight and are kept whole. It is at least
    ``least_share``: by default half where targets are softened from the data, and 0 where they are
    given, since more would miss them. ``keep_share`` asks for less.
    """
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": main_topic(text_of(text_col))}
    counted = (tokens if tokens is not None else F.regexp_count(text_of(text_col), F.lit(WORDS))).cast("long")
    slim = docs.select(*(c.cast("string").alias(f"mix_{k}") for k, c in dims.items()), counted.alias("mix_tokens"))
    fine = slim.groupBy(*(f"mix_{k}" for k in dims)).agg(F.sum("mix_tokens").alias("mix_tokens"))
    if least_share is None:
        least_share = 0.5 if targets is None else 0.0
    if targets is None:
        fine = stored(fine, "mix-cells")
        targets = softened(fine, {k: F.col(f"mix_{k}") for k in dims}, F.col("mix_tokens"))
    cell = [named(F.col(f"mix_{k}"), targets[k]).alias(f"mix_{k}") for k in dims]
    cells = fine.select(*cell, "mix_tokens").groupBy(*(f"mix_{k}" for k in dims)).agg(F.sum("mix_tokens").alias("n")).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"there are more than {MAX_CELLS} cells; name fewer values as targets")
    cells = sorted(cells, key=lambda r: [r[f"mix_{k}"] for k in dims])
    values = {k: {v: i for i, v in enumerate(sorted({*targets[k], REST}))} for k in dims}
    counts = np.array([float(r["n"] or 0) for r in cells])
    codes = [np.array([values[k][r[f"mix_{k}"]] for r in cells], dtype=np.int64) for k in dims]
    if counts.sum() > 0:
        shares = [np.array([targets[k].get(v, 0.0) for v in values[k]]) for k in dims]
        keep = kept_share(counts, rake(counts, shares, codes), negligible=negligible, least=least_share)
        if keep_share is not None:
            keep = min(keep, keep_share)
        weights = rake_capped(counts, shares, keep, codes)
        ratio = np.divide(weights, counts / counts.sum(), out=np.zeros_like(weights), where=counts > 0)
        chance = np.where(counts > 0, np.minimum(ratio * keep, 1.0), 1.0)
    else:
        chance = np.ones_like(counts)
    known = [tuple(r[f"mix_{k}"] for k in dims) + (float(x),) for r, x in zip(cells, chance, strict=True)]
    table = docs.sparkSession.createDataFrame(known, ", ".join([f"mix_{k} string" for k in dims] + ["probability double"]))
    rows = docs.drop(*(f"mix_{k}" for k in dims), "mix_tokens", "probability", "sampled")
    rows = rows.withColumns({f"mix_{k}": named(c.cast("string"), targets[k]) for k, c in dims.items()} | {"mix_tokens": counted})
    # A cell is a row of some 50 bytes: broadcast up to BROADCAST_CELLS, beyond that joined by shuffle.
    table = F.broadcast(table) if len(known) <= BROADCAST_CELLS else table
    rows = rows.join(table, [f"mix_{k}" for k in dims], "left")
    key = F.coalesce(F.col(id_col).cast("string"), F.sha2(text_of(text_col), 256))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))
    return rows.withColumn("probability", F.coalesce("probability", F.lit(1.0))).withColumn("sampled", uniform < F.col("probability"))


def mixed_by_topics(docs: DataFrame) -> DataFrame:
    """The columns of :func:`mixing_weights` for two topics of each document: by the initial of its first word (mix_topic, probability, sampled)
    and by those of all its words (mix_main_topic, main_probability, main_sampled), beside doc_id, mix_source, mix_lang and mix_tokens.

    The texts are read once: what both samples need of them is stored. Ids and equal texts without one are drawn by the same hash.
    """
    text, key = text_of("text"), F.coalesce(F.col("doc_id").cast("string"), F.sha2(text_of("text"), 256))
    seen = docs.select("doc_id", "source", "lang", key.alias("key"), topic_of(text).alias("first"), main_topic(text).alias("main"), F.regexp_count(text, F.lit(WORDS)).alias("n"))
    rows = stored(seen, "mix-texts")
    for topic in ("main", "first"):
        dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(topic)}
        rows = mixing_weights(rows, id_col="key", text_col="key", dims=dims, tokens=F.col("n"))
        if topic == "main":
            rows = rows.withColumnsRenamed({"mix_topic": "mix_main_topic", "probability": "main_probability", "sampled": "main_sampled"})
    return rows.drop("source", "lang", "key", "first", "main", "n")
