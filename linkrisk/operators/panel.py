"""The segment-year panel, its evaluation contract and its readiness."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rates import blank
from ..sources.shared import stored
from .gates import ValidationError, invalid_exposure, invalid_target, measured, require_columns

PANEL_COLUMNS = (
    "segment_key", "segment_id", "count_point_id", "source_year", "year", "road_number", "road_category", "road_type", "local_authority_id",
    "local_authority_name", "local_authority_code", "estimation_method", "all_motor_vehicles", "link_length_km", "annual_vehicle_km",
    "collision_count", "ksi_count",
)
SUBGROUP_COLUMNS: Mapping[str, str] = {"road_category": "road_category", "urban_rural": "urban_rural", "local_authority": "local_authority_code", "estimation_method": "estimation_method"}


@dataclass(frozen=True)
class Contract:
    """Which years train, validate and test, and which subgroups must be known."""

    training_years: tuple[int, ...]
    validation_years: tuple[int, ...]
    test_years: tuple[int, ...]
    required_subgroups: tuple[str, ...] = ("road_category", "urban_rural", "local_authority")

    def __post_init__(self) -> None:
        years = self.years
        if len(set(years)) != len(years):
            raise ValidationError("Training, validation and test years overlap")
        if not (self.training_years and self.validation_years and self.test_years):
            raise ValidationError("Each split needs a year")
        if max(self.training_years) >= min(self.validation_years) or max(self.validation_years) >= min(self.test_years):
            raise ValidationError("Validation must follow training, and test must follow validation")

    @property
    def years(self) -> list[int]:
        return sorted((*self.training_years, *self.validation_years, *self.test_years))

    def described(self) -> dict[str, str]:
        """The contract in words, and the hash of what it says."""
        said = {k: list(v) for k, v in asdict(self).items()}
        text = json.dumps(said, sort_keys=True)
        return {"contract": text, "contract_sha256": hashlib.sha256(text.encode()).hexdigest()}

    def splits(self, spark: SparkSession) -> DataFrame:
        rows = [(y, "training") for y in self.training_years] + [(y, "validation") for y in self.validation_years] + [(y, "test") for y in self.test_years]
        return spark.createDataFrame(rows, "year int, evaluation_split string")


def labelled(panel: DataFrame, contract: Contract) -> DataFrame:
    """Rows of contract years with evaluation_split; the table of years is a few rows by contract."""
    return panel.join(F.broadcast(contract.splits(panel.sparkSession)), "year")


def _common_type(kinds: Sequence[T.DataType]) -> T.DataType | None:
    if any(isinstance(k, T.StringType) for k in kinds) and any(isinstance(k, T.NumericType) for k in kinds):
        return T.StringType()
    return None


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name: columns missing in one are null there, numbers widen, and a column that is a
    number here and a string there becomes a string."""
    kinds: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema:
            kinds.setdefault(f.name, []).append(f.dataType)
    casts = {k: c for k, v in kinds.items() if (c := _common_type(v)) is not None}
    out = None
    for df in frames:
        df = df.withColumns({k: F.col(k).cast(c) for k, c in casts.items() if k in df.columns})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValidationError("At least one annual evidence table is required")
    return out


def build_panel(frames: Sequence[DataFrame]) -> DataFrame:
    """Yearly evidence, checked and stacked; whoever stores it orders it."""
    for k, df in enumerate(frames):
        require_columns(df, PANEL_COLUMNS, f"evidence {k}")
    panel = union_relaxed(frames)
    n, seen = measured(panel, "segment_key", "year", bad=F.count_if(F.col("year") != F.col("source_year")))
    if seen["bad"]:
        raise ValidationError(f"Found {seen['bad']} rows with inconsistent year fields")
    if n:
        raise ValidationError(f"Found {n} duplicate segment-year rows")
    return panel


def panel_years(panel: DataFrame) -> DataFrame:
    return panel.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("segment_key").alias("segments")).orderBy("year")


def missing_years(panel: DataFrame, contract: Contract) -> DataFrame:
    return contract.splits(panel.sparkSession).select("year").join(panel.select("year").distinct(), "year", "left_anti").orderBy("year")


def subgroup_coverage(panel: DataFrame, contract: Contract) -> DataFrame:
    """subgroup, available, incomplete_rows of each required subgroup, in one pass over the panel."""
    rows = labelled(panel, contract)
    found = [g for g in contract.required_subgroups if SUBGROUP_COLUMNS.get(g) in panel.columns]
    counts = rows.agg(*(F.count_if(blank(F.col(SUBGROUP_COLUMNS[g]))).alias(g) for g in found), F.lit(1).alias("_"))
    parts = [F.struct(F.lit(g).alias("subgroup"), F.lit(g in found).alias("available"), (F.col(g) if g in found else F.lit(0)).cast("long").alias("incomplete_rows")) for g in contract.required_subgroups]
    return counts.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


#: Years that one bitmap holds.
BITS = 62


def year_bits(contract: Contract) -> list[Column]:
    """Of a row the bitmaps of its year among the contract's, in order; none set for other years."""
    maps = []
    for first in range(0, len(contract.years), BITS):
        bit = F.lit(0).cast("long")
        for k, year in enumerate(contract.years[first : first + BITS]):
            bit = F.when(F.col("year") == year, F.lit(1 << k).cast("long")).otherwise(bit)
        maps.append(bit)
    return maps


def _years_in(maps: Sequence[str]) -> Column:
    return sum((F.bit_count(m) for m in maps[1:]), F.bit_count(maps[0]))


def complete_history(panel: DataFrame, contract: Contract) -> DataFrame:
    """Segments with a row in each contract year. Bitmaps of years add up in any order, so partial
    aggregates do most of the work before the shuffle."""
    maps = [f"_y{k}" for k in range(len(year_bits(contract)))]
    years = panel.groupBy("segment_key").agg(*(F.bit_or(b).alias(m) for m, b in zip(maps, year_bits(contract), strict=True)))
    return years.select("segment_key", _years_in(maps).cast("long").alias("years")).where(F.col("years") == len(contract.years))


def readiness(panel: DataFrame, contract: Contract) -> DataFrame:
    """One row: status, blockers in fixed order, the six checks, score, years and counts.

    The panel is read once, into a row for each segment and authority with a bitmap of its contract years;
    everything else comes from these rows.
    """
    found = [g for g in contract.required_subgroups if SUBGROUP_COLUMNS.get(g) in panel.columns]
    lost = [g for g in contract.required_subgroups if g not in found]
    zero, area = F.lit(0).cast("long"), "local_authority_code"
    maps, own = [f"_y{k}" for k in range(len(year_bits(contract)))], F.col("year").isin(contract.years)
    sums = {
        "_rows": own, "invalid_exposure_rows": own & invalid_exposure(F.col("annual_vehicle_km")), "invalid_target_rows": own & invalid_target(F.col("ksi_count")),
        **{f"_g_{g}": own & blank(F.col(SUBGROUP_COLUMNS[g])) for g in found},
    }
    rows = panel.withColumn("_area", F.col(area).cast("string") if area in panel.columns else F.lit(None).cast("string"))
    parts = stored(rows.groupBy("segment_key", "_area").agg(
        *(F.bit_or(b).alias(m) for m, b in zip(maps, year_bits(contract), strict=True)), F.array_sort(F.collect_set("year")).alias("_years"), *(F.count_if(c).alias(k) for k, c in sums.items())
    ), "histories")
    totals = parts.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_years")))).alias("_years"), *(F.coalesce(F.sum(k), zero).alias(k) for k in sums))
    history = parts.groupBy("segment_key").agg(*(F.bit_or(m).alias(m) for m in maps)).agg(F.count_if(_years_in(maps) == len(contract.years)).alias("segments_with_complete_history"))
    groups = parts.where("_rows > 0 and _area is not null").select("_area").distinct().agg(F.count(F.lit(1)).alias("geographic_groups"))
    one = totals.join(history).join(groups)  # single rows
    wanted = F.array(*map(F.lit, contract.years))
    missing = F.array_except(wanted, F.col("_years"))
    incomplete = sum((F.when(F.col(f"_g_{g}") > 0, 1).otherwise(0) for g in found), F.lit(0))
    checks = {
        "contract_years_available": ("missing_contract_years", F.size(missing) == 0), "required_subgroups_available": ("missing_subgroup_fields", F.lit(not lost)),
        "subgroup_values_complete": ("incomplete_subgroup_values", incomplete == 0), "geographic_holdout_possible": ("insufficient_geographic_groups", F.col("geographic_groups") >= 2),
        "exposure_values_valid": ("invalid_exposure_rows", F.col("invalid_exposure_rows") == 0), "target_values_valid": ("invalid_target_rows", F.col("invalid_target_rows") == 0),
    }
    blockers = F.array_compact(F.array(*(F.when(~ok, F.lit(k)) for k, ok in checks.values())))
    passed = sum((F.when(ok, 1).otherwise(0) for _, ok in checks.values()), F.lit(0))
    said = lambda years: F.array_join(years.cast("array<string>"), ",")
    return one.select(
        F.when(F.size(blockers) == 0, "ready-for-evaluation").otherwise("blocked").alias("status"), F.array_join(blockers, ",").alias("blockers"), (passed / len(checks)).alias("readiness_score"),
        *(ok.alias(name) for name, (_, ok) in checks.items()), said(wanted).alias("required_years"), said(F.col("_years")).alias("available_years"),
        said(missing).alias("missing_years"), F.lit(",".join(lost)).alias("missing_subgroups"),
        F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_g_{g}") > 0, F.concat(F.lit(f"{g}="), F.col(f"_g_{g}").cast("string"))) for g in found))), ",").alias("incomplete_subgroup_rows") if found else F.lit("").alias("incomplete_subgroup_rows"),
        "invalid_exposure_rows", "invalid_target_rows", "geographic_groups", "segments_with_complete_history",
    )
