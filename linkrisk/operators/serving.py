"""Queries on evidence: listings, searches, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import is_ksi, matches_term, severity_label


def collision_records(collisions: DataFrame) -> DataFrame:
    """The record view: renamed and typed columns with a severity label."""
    return collisions.select(
        F.col("collision_index").cast("string").alias("collision_id"), F.col("collision_year").cast("int").alias("year"), "longitude", "latitude",
        F.col("collision_severity").cast("int").alias("severity"), severity_label(F.col("collision_severity")).alias("severity_label"),
        F.col("number_of_vehicles").cast("int").alias("vehicles"), F.col("number_of_casualties").cast("int").alias("casualties"),
        F.col("date").cast("string").alias("date"), "time", F.col("speed_limit").cast("int").alias("speed_limit"), F.col("local_authority_highway_current").alias("authority_code"),
    )


def list_collisions(collisions: DataFrame, *, severity: int | None = None, limit: int = 500) -> DataFrame:
    """The first ``limit`` (1 to 5000) collisions by date and id, of one severity if given."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be 1 to 5000")
    rows = collisions.where(F.col("collision_severity") == severity) if severity is not None else collisions
    return rows.orderBy("date", "collision_index").limit(limit)


def search_collisions(collisions: DataFrame, term: str, *, severity: int | None = None) -> DataFrame:
    rows = collisions.where(F.col("collision_severity") == severity) if severity is not None else collisions
    return rows.where(matches_term(term, F.col("collision_index")))


def search_segments(evidence: DataFrame, term: str) -> DataFrame:
    return evidence.where(matches_term(term, F.col("road_number"), F.col("segment_id")))


def collision_summary(collisions: DataFrame) -> DataFrame:
    s = F.col("collision_severity")
    return collisions.agg(
        F.count(F.lit(1)).alias("collisions"), F.count_if(is_ksi(s)).alias("ksi_collisions"), F.coalesce(F.sum("number_of_casualties"), F.lit(0)).cast("long").alias("casualties"),
        F.count_if(s == 1).alias("fatal"), F.count_if(s == 2).alias("serious"), F.count_if(s == 3).alias("slight"),
    )


def network_summary(evidence: DataFrame) -> DataFrame:
    return evidence.agg(
        F.count(F.lit(1)).alias("segments"), F.count("all_motor_vehicles").alias("segments_with_exposure"), F.count_if(F.col("estimation_method") == "Counted").alias("counted_segments"),
        F.count_if(F.col("estimation_method") == "Estimated").alias("estimated_segments"), F.coalesce(F.sum("collision_count"), F.lit(0)).cast("long").alias("matched_collisions"),
        F.coalesce(F.sum("ksi_count"), F.lit(0)).cast("long").alias("matched_ksi"),
    )


def in_box(collisions: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Collisions in a closed box of (left, low, right, high); those without coordinates are out."""
    return collisions.where(F.col("longitude").between(box[0], box[2]) & F.col("latitude").between(box[1], box[3]))


def pilot_quality(source: DataFrame, box: tuple[float, float, float, float], *, year: int | None = None) -> DataFrame:
    """Counts of a pilot build in one pass: missing coordinates are counted over all source years."""
    selected = F.col("collision_year") == year if year is not None else F.lit(True)
    inside = F.col("longitude").between(box[0], box[2]) & F.col("latitude").between(box[1], box[3])
    return source.agg(
        F.count(F.lit(1)).alias("source_records"), F.count_if(selected).alias("selected_source_records"), F.count_if(selected & inside).alias("pilot_records"),
        F.count_if(F.col("longitude").isNull() | F.col("latitude").isNull()).alias("missing_source_coordinates"),
    )


def severity_counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, "collision_severity").agg(F.count(F.lit(1)).alias("n"))
