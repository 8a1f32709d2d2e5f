"""Sinks: partitioned Parquet, GeoJSON features a line, and JSON reports.

Yearly outputs of successive jobs lie side by side in one folder: a job replaces the partitions of its own
years and leaves the others as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import seen_by


def _dealt(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt by ``columns``: small partitions share a task and large ones are split, so that files
    have about the advised size; rows of a file in ``order``."""
    out = df.hint("rebalance", *columns)
    return out.sortWithinPartitions(*columns, *order) if order else out


def write_by(df: DataFrame, path: str, *columns: str, order: Sequence[str] = ()) -> None:
    """Parquet, one folder for each value of ``columns``, in place of all that was there."""
    _dealt(df, columns, order).write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_years(df: DataFrame, path: str, column: str, years: Iterable[int], *, order: Sequence[str] = (), kind: str = "parquet", last: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """The rows of ``years``, in one folder a year (``column``); other years there stay as they are.

    A year without rows has no folder afterwards, even if it had one. ``kind`` is the files' format.
    Rows of years that are not named are not written. ``last`` makes what is written of the rows after they were dealt.
    Text is compressed.
    """
    wanted, seen = sorted(set(years)), Observation()
    rows = df.where(F.col(column).isin(wanted)).observe(seen, *(F.count_if(F.col(column) == y).alias(f"y{k}") for k, y in enumerate(wanted)))
    dealt = _dealt(rows, (column,), order)
    out = (last(dealt) if last else dealt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column)
    more = {"json": {"ignoreNullFields": "false"}, "text": {"compression": "gzip"}}.get(kind, {})
    out.options(**more).format(kind).save(path)
    rows_of = seen_by(seen)
    _drop(df.sparkSession, [f"{path}/{column}={y}" for k, y in enumerate(wanted) if not rows_of.get(f"y{k}")])


def _drop(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_years(like: DataFrame, path: str, column: str, years: Iterable[int]) -> DataFrame:
    """What :func:`write_years` wrote of rows ``like`` these, of ``years`` only; none if there are none."""
    schema = like.schema
    found = like.sparkSession.read.schema(schema).parquet(path).where(F.col(column).isin(sorted(set(years))))
    return found.select(*(F.col(f.name).cast(f.dataType) for f in schema))


def _as_features(joined: DataFrame, columns: Sequence[str], parts: str, keep: Sequence[str]) -> DataFrame:
    """Evidence ``columns`` as properties and ``parts`` as the line."""
    single = F.size(parts) == 1
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.col(parts)[0].alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.col(parts).alias("coordinates")))
    properties = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    value = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.when(single, line).otherwise(many), F.lit("}"))
    return joined.select(value.alias("value"), *keep)


def features(evidence: DataFrame, links: DataFrame, key: str = "segment_id", parts: str = "parts", *, keep: Sequence[str] = ()) -> DataFrame:
    """One GeoJSON feature a row, ``value``: all evidence columns as properties, the link's WGS84 line. The
    columns ``keep`` stand beside it."""
    return _as_features(evidence.join(links.select(key, parts), key), evidence.columns, parts, keep)


def write_features(evidence: DataFrame, links: DataFrame, path: str, *, years: Iterable[int] | None = None, column: str = "source_year") -> None:
    """GeoJSON features a line; of ``years`` if given, beside those of other years and compressed. Rows are dealt as
    columns, which are smaller than their text."""
    if years is None:
        features(evidence, links).write.mode("overwrite").text(path)
    else:
        joined = evidence.join(links.select("segment_id", "parts"), "segment_id")
        write_years(joined, path, column, years, kind="text", last=lambda df: _as_features(df, evidence.columns, "parts", (column,)))


def write_report(report: DataFrame, path: str, *, years: Iterable[int] | None = None, column: str = "source_year") -> None:
    """A report is a few rows: one JSON file, or one for each of ``years`` beside those of other years."""
    if years is None:
        report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        write_years(report, path, column, years, kind="json")
