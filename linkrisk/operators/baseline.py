"""The exposure-rate baseline: one rate from the training years, times exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import MILLION
from .gates import require_model_rows
from .panel import Contract, labelled


def training_rate(rows: DataFrame) -> DataFrame:
    """One row: total KSI, million vehicle-km, and their ratio."""
    totals = rows.agg(F.sum("ksi_count").alias("training_ksi"), (F.sum("annual_vehicle_km") / MILLION).alias("training_million_vehicle_km"))
    return totals.withColumn("training_rate_per_million_vehicle_km", F.col("training_ksi") / F.col("training_million_vehicle_km"))


def predict_from(rate: DataFrame, scoring: DataFrame) -> DataFrame:
    """``scoring`` with expected_ksi; the rate is one row, so it is broadcast."""
    joined = scoring.join(F.broadcast(rate.select(F.col("training_rate_per_million_vehicle_km").alias("_rate"))))
    return joined.withColumn("expected_ksi", F.col("_rate") * F.col("annual_vehicle_km") / MILLION).drop("_rate")


def exposure_baseline(panel: DataFrame, contract: Contract, *, check: bool = True) -> DataFrame:
    """Validation and test rows with expected_ksi and evaluation_split."""
    rows = labelled(panel, contract)
    if check:
        require_model_rows(rows, F.when(F.col("evaluation_split") == "training", "training").otherwise("scoring"), ("training", "scoring"))
    return predict_from(training_rate(rows.where("evaluation_split = 'training'")), rows.where("evaluation_split <> 'training'"))
