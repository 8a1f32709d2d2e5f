"""Metrics of predictions, by any groups, in one aggregate after the top share is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import poisson_deviance_term
from .selection import flag_first

TOP_SHARE = 0.1
SUBGROUPS = ("road_category", "urban_rural", "estimation_method")


def error_metrics(predictions: DataFrame, by: str = "evaluation_split") -> DataFrame:
    e = F.col("ksi_count") - F.col("expected_ksi")
    return predictions.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def flag_top(predictions: DataFrame, by: tuple[str, ...], *, share: float = TOP_SHARE, ties: tuple[str, ...] = ("segment_key", "year")) -> DataFrame:
    """``in_top``: among the first max(1, ceil(share * n)) of its group by prediction; n is group_rows."""
    return flag_first(predictions, by, "expected_ksi", F.greatest(F.lit(1), F.ceil(F.col("group_rows") * F.lit(share))), ties)


def detailed_metrics(predictions: DataFrame, by: tuple[str, ...] = ("evaluation_split",), *, share: float = TOP_SHARE) -> DataFrame:
    actual, mu = F.col("ksi_count").cast("double"), F.greatest(F.col("expected_ksi"), F.lit(1e-12))
    needed = predictions.select(*by, "segment_key", "year", "ksi_count", "expected_ksi")
    rows = flag_top(needed, by, share=share).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs(actual - mu)).alias("mae"), F.sqrt(F.avg((actual - mu) * (actual - mu))).alias("rmse"),
        (2 * F.sum(poisson_deviance_term(actual, F.col("expected_ksi")))).alias("poisson_deviance"), F.avg(actual).alias("mean_actual"), F.avg(mu).alias("mean_predicted"),
        F.sum(actual).alias("_actual"), F.sum(mu).alias("_mu"), F.sum(F.when(F.col("in_top"), actual).otherwise(0.0)).alias("_top"), F.count_if("in_top").alias("_k"),
    )
    recall = F.when(F.col("_actual") > 0, F.col("_top") / F.col("_actual")).otherwise(0.0)
    return rows.select(
        *by, "n_rows", "mae", "rmse", "poisson_deviance", "mean_actual", "mean_predicted", F.when(F.col("_mu") > 0, F.col("_actual") / F.col("_mu")).otherwise(0.0).alias("calibration_ratio"),
        (F.col("_top") / F.col("_k")).alias("precision_at_10_percent"), recall.alias("recall_at_10_percent"), (recall / (F.col("_k") / F.col("n_rows"))).alias("lift_at_10_percent"),
    )


def subgroup_metrics(predictions: DataFrame, columns: tuple[str, ...] = SUBGROUPS) -> DataFrame:
    """Detailed metrics of each value of each subgroup column, all splits together."""
    known = [c for c in columns if c in predictions.columns]
    long = predictions.select("segment_key", "year", "ksi_count", "expected_ksi", F.explode(F.array(*(F.struct(F.lit(c).alias("subgroup"), F.col(c).cast("string").alias("value")) for c in known))).alias("_s"))
    return detailed_metrics(long.select("*", "_s.subgroup", "_s.value").drop("_s").where("value is not null"), ("subgroup", "value"))
