"""Evidence of links: matches, traffic, classes, counts and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rates


def accepted_counts(matches: DataFrame, collisions: DataFrame, *, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """collision_count and ksi_count of each segment with accepted matches."""
    accepted = matches.where(F.col("match_status") == "accepted")
    rows = accepted.join(collisions.select("collision_index", "collision_severity"), "collision_index", "left")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("collision_count"), F.count_if(rates.is_ksi(F.col("collision_severity"))).alias("ksi_count"))


def segment_evidence(links: DataFrame, traffic: DataFrame, counts: DataFrame, lookup: DataFrame | None = None, *, keys: tuple[str, ...] = ("count_point_id",), count_keys: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """One row a link: its columns, traffic and class (left joins), counts (0 without matches),
    annual_vehicle_km and collision_rate_per_100m_vehicle_km."""
    rows = links.join(traffic, list(keys), "left")
    rows = rows.join(lookup, list(keys), "left") if lookup is not None else rows.withColumn("urban_rural", F.lit(None).cast("string"))
    rows = rows.join(counts, list(count_keys), "left").fillna(0, ["collision_count", "ksi_count"])
    rows = rows.withColumn("annual_vehicle_km", rates.annual_vehicle_km(F.col("all_motor_vehicles"), F.col("link_length_km")))
    return rows.withColumn("collision_rate_per_100m_vehicle_km", rates.rate_per(F.col("collision_count"), F.col("annual_vehicle_km"), rates.RATE_SCALE))


def match_quality(matches: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by status and the accepted rate, in one pass; of each year, say, by ``by``."""
    n = lambda s: F.count_if(F.col("match_status") == s)
    return matches.groupBy(*by).agg(F.count(F.lit(1)).alias("collision_records"), n("accepted").alias("accepted"), n("ambiguous").alias("ambiguous"), n("out_of_range").alias("out_of_range"), F.round(n("accepted") / F.count(F.lit(1)), 4).alias("accepted_match_rate"))


def method_counts(traffic: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return traffic.groupBy(*by, "estimation_method").agg(F.count(F.lit(1)).alias("n"))


def class_counts(evidence: DataFrame, column: str = "urban_rural") -> DataFrame:
    return evidence.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def network_quality(evidence: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Coverage of links by exposure and class, and the authorities present, of each year or of all."""
    n = F.count(F.lit(1))
    return evidence.groupBy(*by).agg(
        n.alias("road_segments"), F.count("all_motor_vehicles").alias("segments_with_exposure"), F.round(F.count("all_motor_vehicles") / n, 4).alias("exposure_coverage"),
        F.count("urban_rural").alias("segments_with_urban_rural"), F.round(F.count("urban_rural") / n, 4).alias("urban_rural_coverage"),
        F.array_join(F.array_sort(F.collect_set("local_authority_code")), ",").alias("local_authorities"),
    )
