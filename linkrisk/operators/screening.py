"""Descriptive screening of segments by exposure-normalised rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rates
from .ranking import ranked

METADATA = ("road_number", "road_category", "road_type", "local_authority_name", "local_authority_code", "urban_rural")
STABLE_KSI, STABLE_MVKM = 5, 1.0


def _totals() -> list[Column]:
    return [rates.exact_sum(F.col("annual_vehicle_km")).alias("total_vehicle_km"), F.sum("collision_count").alias("observed_collisions"), F.sum("ksi_count").alias("observed_ksi")]


def _rates(df: DataFrame) -> DataFrame:
    df = df.withColumn("total_million_vehicle_km", F.col("total_vehicle_km") / rates.MILLION)
    return df.withColumns({
        "collision_rate_per_million_vehicle_km": F.col("observed_collisions") / F.col("total_million_vehicle_km"),
        "ksi_rate_per_million_vehicle_km": F.col("observed_ksi") / F.col("total_million_vehicle_km"),
    })


def rollup(panel: DataFrame) -> DataFrame:
    """Each segment's first non-null metadata in order of years, years seen, totals, rates, the
    Poisson proxy of the standard error and the stability label."""
    known = [c for c in METADATA if c in panel.columns]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("year"))).alias(c) for c in known]
    rows = _rates(panel.groupBy("segment_key").agg(*first, F.countDistinct("year").alias("years_observed"), *_totals()))
    stable = (F.col("observed_ksi") >= STABLE_KSI) & (F.col("total_million_vehicle_km") >= STABLE_MVKM)
    return rows.withColumns({
        "ksi_rate_standard_error_proxy": F.sqrt(F.col("observed_ksi")) / F.col("total_million_vehicle_km"),
        "screening_stability": F.when(stable, "more_stable").otherwise("interpret_with_caution"),
    })


def screen(panel: DataFrame) -> DataFrame:
    """The rollup with screening_rank: KSI rate, then collision rate, both falling, then segment key. Exposure is added
    up exactly: equal totals that differ in their last bit, by the order of adding, would be ranked by that bit."""
    order = [F.desc("ksi_rate_per_million_vehicle_km"), F.desc("collision_rate_per_million_vehicle_km"), F.asc("segment_key")]
    return ranked(rollup(panel), order, "screening_rank")


def top_segments(panel: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` by the order of :func:`screen`: a heap of n rows a task, no global sort."""
    rows = rollup(panel).orderBy(F.desc("ksi_rate_per_million_vehicle_km"), F.desc("collision_rate_per_million_vehicle_km"), "segment_key")
    return rows.limit(n)


def subgroup_rates(panel: DataFrame, columns: tuple[str, ...] = ("road_category", "urban_rural", "local_authority_code")) -> DataFrame:
    """Totals and rates of each value of each subgroup column; null values are left out."""
    known = [c for c in columns if c in panel.columns]
    long = panel.select("annual_vehicle_km", "collision_count", "ksi_count", F.explode(F.array(*(F.struct(F.lit(c).alias("subgroup"), F.col(c).cast("string").alias("value")) for c in known))).alias("_s"))
    rows = long.where("_s.value is not null").groupBy(F.col("_s.subgroup").alias("subgroup"), F.col("_s.value").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"), *_totals())
    return _rates(rows)
