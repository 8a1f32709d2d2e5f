"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after each run of ASCII white space has become one space.
Three combining steps, each of which groups by digest *and* full content, find the smallest id of
every class of equal texts:

1. local: the partial aggregate of every map task keeps one row per content it has seen;
2. salted: tasks are dealt to ``salts`` groups, so that a digest held by every task of a large
   cluster is merged by ``salts`` reducers, not by one;
3. global: at most ``salts`` winners of a digest meet.

No step gathers the members of a class: a row is one content with its smallest id and a count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import look_up, parallelism, stored, text_of, unused

#: A run of white space that is not just one space already.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, UNEVEN_SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def winners(docs: DataFrame, *, id_col: str, text_col: str, salts: int, digest=sha256) -> DataFrame:
    """One row per distinct content: _digest, _norm, keep_id, group_size."""
    local = docs.select(
        F.col(id_col).alias("_id"),
        normalised(text_of(text_col)).alias("_norm"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"),
    ).withColumn("_digest", digest(F.col("_norm")))
    salted = local.groupBy("_digest", "_salt", "_norm").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_norm").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def dedup_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest=sha256) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the smallest id stays; null ids never win against an
    id, and a class without any id has a null ``keep_id`` and stays. Rows that repeat an id with
    the same text share one verdict; one id with several texts is judged text by text. Very long
    texts are compared in full like any. Other columns of ``docs`` are not read. An empty table gives
    an empty result. ``salts`` is the square root of the shuffle's partitions, 16 at least, unless given.
    """
    salts = salts or max(16, math.isqrt(parallelism(docs.sparkSession)))
    best = stored(
        winners(docs, id_col=id_col, text_col=text_col, salts=salts, digest=digest).select(
            "_digest", "keep_id", "group_size", F.col("_norm").alias("_content")
        )
        if digest is not sha256
        else winners(docs, id_col=id_col, text_col=text_col, salts=salts).select("_digest", "keep_id", "group_size"),
        "dedup-winners",
    )
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_of(text_col)).alias("_norm"))
    rows = rows.withColumn("_digest", digest(F.col("_norm")))
    shared = best.groupBy("_digest").count().where("count > 1").select("_digest")
    if shared.isEmpty():
        # Every digest stands for one content, compared in full above: the digest alone finds it.
        found = look_up(rows.select("_id", "_digest", F.sha2("_norm", 256).alias("text_sha256")), best.drop("_content"), ["_digest"], count="group_size")
    else:
        if "_content" not in best.columns:
            best = winners(docs, id_col=id_col, text_col=text_col, salts=salts).withColumnRenamed("_norm", "_content")
        found = look_up(rows.select("_id", "_digest", F.sha2("_norm", 256).alias("text_sha256"), F.col("_norm").alias("_content")), best, ["_digest", "_content"], count="group_size")
    return found.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see :func:`dedup_classes`.

    Only the ids and digests of dropped rows are joined back. Of rows that repeat an id, or have
    none, with the same text one stays, whichever; those with different texts all do.
    """
    classes = stored(dedup_classes(docs, id_col=id_col, text_col=text_col, salts=salts), "dedup-classes")
    drop_id, drop_key, key = unused(docs, "_drop_id", "_drop_key", "_key")
    same = docs[id_col].eqNullSafe(F.col(drop_id)) & (F.sha2(normalised(text_of(text_col)), 256) == F.col(drop_key))
    dropped = classes.where(~F.col("kept")).select(F.col(id_col).alias(drop_id), F.col("text_sha256").alias(drop_key)).distinct()
    left = docs.join(dropped, same, "left_anti")
    if classes.where("kept").groupBy(id_col, "text_sha256").count().where("count > 1").isEmpty():
        return left
    return left.withColumn(key, F.sha2(normalised(text_of(text_col)), 256)).dropDuplicates([id_col, key]).drop(key)
