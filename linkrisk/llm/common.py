"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text are the runs of characters outside this class (ASCII white space).
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where the setting is missing in a session of one machine (``local[n]``, as in tests) a temporary
    folder is set; on a cluster, whose executors could not read that, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="linkrisk-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and a lost
    executor costs no recomputation of what stands before."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as tell it from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: A key that more than this part of all rows have is hot; so there are at most as many hot keys.
HOT_KEYS = 10_000


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], *, count: str) -> DataFrame:
    """``rows`` with the columns of the one row of ``table`` that has their ``keys``, or nulls.

    ``count`` tells how many rows each key has. Keys with over a HOT_KEYS-th of all these rows (and
    over 100) are broadcast, as no more than HOT_KEYS can have so many, and their rows stay spread
    as they are; only the others meet by key.
    """
    hot_, rest_, salt, none = unused(rows.join(table.limit(0), keys, "left"), "_hot", "_rest", "_salt", "_none")
    total = table.agg(F.sum(count)).first()[0] or 0
    least = max(100, total // HOT_KEYS)
    more = F.struct(*(c for c in table.columns if c not in keys))
    hot = table.where(F.col(count) > least).select(*keys, more.alias(hot_))
    rest = table.where(F.col(count) <= least).select(*keys, more.alias(rest_), F.lit(0).alias(salt))
    out = rows.join(F.broadcast(hot), keys, "left")
    out = out.withColumn(salt, F.when(F.col(hot_).isNotNull(), F.spark_partition_id() + 1).otherwise(0)).join(rest, [*keys, salt], "left")
    out = out.withColumn(hot_, F.coalesce(hot_, rest_))
    return out.select(*rows.columns, *(F.col(hot_)[c].alias(c) for c in table.columns if c not in keys))


def text_of(column: str) -> Column:
    """The text, a missing one being empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path or URI of the shared folder, and the path within it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def rows_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
