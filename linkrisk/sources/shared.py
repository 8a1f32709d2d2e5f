"""The folder that driver and executors share, and tables stored in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

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


def seen_by(observation: Observation) -> dict:
    """What was observed; nothing where Spark ran no plan because it knew that there were no rows."""
    try:
        return observation.get
    except Py4JJavaError:
        return {}


def stored_with(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`stored`, and aggregates of all its rows that are taken while it is written (none without rows, maybe)."""
    seen = Observation()
    out = stored(df.observe(seen, *metrics), label)
    return out, seen_by(seen)
