"""The first k rows of every group, found by histograms instead of sorting.

A group's k-th value lies in one bucket of the histogram between its smallest and largest value; the next
histogram is of that bucket alone, and so on until a bucket has few rows or one value. Equal values go on by
the beginnings of the first tie column, two characters at a time. What is left of a group, FEW rows
at most, is ranked. No row is shuffled but these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored, stored_with

#: Rows of a group that are ranked in one task.
FEW = 10_000
BUCKETS = 1000


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for k, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"_b{k}"))
    return out


def _chosen(counts: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Of counts (``_n``) by group and ``order`` the row of each group that has its ``_k``-th, with what is left of ``_k``."""
    upto = F.sum("_n").over(Window.partitionBy(*(f"_b{k}" for k in range(len(by)))).orderBy(order))
    at = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
    return at.withColumn("_k", F.col("_k") - F.col("_upto") + F.col("_n"))


def flag_first(rows: DataFrame, by: Sequence[str], value: str, k: Column, ties: Sequence[str], *, flag: str = "in_top", size: str = "group_rows") -> DataFrame:
    """``rows`` with ``flag``: among the first k of its group by falling ``value``, then by rising ``ties``, the first
    of which is text (a missing one counts as empty). ``k`` may use ``size``, the rows of a group, which is added too.

    Values without a number (null or not a number) are never among the first. Groups of null are groups. Rows that
    are equal in all named columns are taken in any order, as many as are due.
    """
    rows = stored(rows, "rows")
    groups = [f"_b{i}" for i in range(len(by))]
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    sizes = rows.groupBy(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True))).agg(F.count(F.lit(1)).alias(size), F.min(F.when(~F.isnan(value), F.col(value))).alias("_low"), F.max(F.when(~F.isnan(value), F.col(value))).alias("_high"), F.count_if(F.col(value).isNotNull() & ~F.isnan(value)).alias("_n"))
    goal = sizes.withColumn("_k", F.least(k.cast("long"), F.col("_n")))
    todo = (F.col("_n") > FEW) & (F.col("_low") < F.col("_high"))
    goal, seen = stored_with(goal, "goal", F.count_if(todo).alias("todo"))
    while seen.get("todo"):
        # how far below the highest, in buckets; the scale is halved first so that it cannot overflow
        below = (F.col("_high") / 2 - F.col(value) / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        there = usable.join(F.broadcast(goal.where(todo)) if not by else goal.where(todo), _same(by)).where(F.col(value).between(F.col("_low"), F.col("_high")))
        counts = there.groupBy(*groups, size, "_k", F.least(F.lit(BUCKETS - 1), F.floor(below * BUCKETS)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        goal, seen = stored_with(goal.where(~F.coalesce(todo, F.lit(False))).unionByName(_chosen(counts, by, "_bucket").select(goal.columns)), "goal", F.count_if(todo).alias("todo"))
    text = F.coalesce(F.col(ties[0]).cast("string"), F.lit(""))
    goal = goal.withColumn("_begin", F.lit(""))
    todo = (F.col("_n") > FEW) & ~F.col("_whole")
    goal, seen = stored_with(goal.withColumn("_whole", F.lit(False)), "goal", F.count_if(todo).alias("todo"))
    while seen.get("todo"):
        there = usable.join(goal.where(todo).drop("_n"), _same(by)).where((F.col(value) == F.col("_high")) & F.startswith(text, F.col("_begin")))
        digit = F.expr(f"substring(coalesce(cast(`{ties[0]}` as string), ''), length(_begin) + 1, 2)")
        counts = there.groupBy(*groups, size, "_low", "_high", "_k", "_begin", digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
        step = _chosen(counts, by, "_digit").withColumn("_whole", F.length("_digit") < 2).withColumn("_begin", F.concat("_begin", "_digit"))
        goal, seen = stored_with(goal.where(~F.coalesce(todo, F.lit(False))).unionByName(step.select(goal.columns)), "goal", F.count_if(todo).alias("todo"))
    # above the bounds, within them, or below
    at = rows.join(goal.withColumnRenamed("_n", "_left"), _same(by))
    whole = F.when(F.col("_whole"), text == F.col("_begin")).otherwise(F.startswith(text, F.col("_begin")))
    within = F.coalesce(~F.isnan(value) & F.col(value).between(F.col("_low"), F.col("_high")) & whole, F.lit(False))
    first = F.coalesce(~F.isnan(value) & ((F.col(value) > F.col("_high")) | ((F.col(value) == F.col("_high")) & (F.col("_low") == F.col("_high")) & ~whole & (text < F.col("_begin")))), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(value), text.asc(), *(F.asc(c) for c in ties[1:])))
    extra = [*groups, "_left", "_low", "_high", "_k", "_begin", "_whole"]
    out = at.where(within).withColumn(flag, rank <= F.col("_k")).unionByName(at.where(~within).withColumn(flag, first))
    return out.drop(*extra)
