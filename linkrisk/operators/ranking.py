"""Ranks without gathering rows in one task.

Rows are dealt to ranges of the order and sorted there; a small table of counts by range gives each
range its first rank. Ranges of a group key plus order serve ranks within groups just as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import unused
from ..sources.shared import stored


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", *, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the 1-based rank of each row in ``order``, within groups ``by`` if given.

    ``order`` must name columns and be total to be deterministic. The dealt rows are stored: ranges
    are drawn from a sample, so counts and ranks must come from one dealing.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, first, count, before, own, *groups = unused(df, "_range", "_first", "_n", "_before", "_own", *(f"_group{i}" for i in range(len(by))))
    keys = [F.col(c).asc_nulls_first() for c in by]
    dealt = df.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id())
    dealt = stored(dealt, "ranked")
    counts = dealt.groupBy(part, *by).agg(F.count(F.lit(1)).alias(count))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range (and group in it)
    starts = counts.select(F.col(part).alias(first), *(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    rows = dealt.withColumn(own, F.row_number().over(Window.partitionBy(part, *by).orderBy(*order)))
    same = F.col(part) == F.col(first)
    for c, g in zip(by, groups, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(g))
    return rows.join(starts, same).withColumn(name, (F.col(own) + F.col(before)).cast("long")).drop(part, first, own, before, *groups)
