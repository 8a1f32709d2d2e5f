"""Validation gates. Each is a schema check or one aggregate; gates raise with counts, and the
functions beneath them give the counts as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import seen_by

#: Offending values that a message spells out.
NAMED = 1000


class ValidationError(ValueError):
    """A table breaks a rule that the job needs."""


def missing_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return sorted(set(columns) - set(df.columns))


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> None:
    missing = missing_columns(df, columns)
    if missing:
        raise ValidationError(f"{what} is missing columns: {', '.join(missing)}")


def duplicate_rows(df: DataFrame, *keys: str) -> DataFrame:
    """duplicate_rows: all rows of groups with equal keys; nulls are equal to each other."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))


def flag_duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """The rows with ``is_duplicated``; only the keys are grouped, and joined back."""
    groups = df.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias("is_duplicated"))
    same = None
    renamed = groups.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "is_duplicated")
    for i, k in enumerate(keys):
        part = df[k].eqNullSafe(renamed[f"_k{i}"])
        same = part if same is None else same & part
    return df.join(renamed, same).drop(*(f"_k{i}" for i in range(len(keys))))


def require_unique(df: DataFrame, *keys: str, what: str = "rows") -> None:
    n = duplicate_rows(df, *keys).first()[0]
    if n:
        raise ValidationError(f"Found {n} duplicate {what}")


def measured(df: DataFrame, *keys: str, **metrics: Column) -> tuple[int, dict]:
    """The rows of groups with equal ``keys``, and aggregates of all rows, in one read of ``df``."""
    seen = Observation()
    n = duplicate_rows(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), *keys).first()[0]
    return n, seen_by(seen) or dict.fromkeys(metrics, 0)


def outside_domain(column: Column, values: Iterable) -> Column:
    """Not in the domain; null passes."""
    return F.coalesce(~column.isin(*values), F.lit(False))


def invalid_exposure(column: Column) -> Column:
    return column.isNull() | (column <= 0)


def invalid_target(column: Column) -> Column:
    return column.isNull() | (column < 0)


def not_finite(column: Column) -> Column:
    return column.isNull() | F.isnan(column) | (column < 0) | (column == F.lit(float("inf")))


def require_none(df: DataFrame, bad: Column, message: str) -> None:
    n = df.agg(F.count_if(bad)).first()[0]
    if n:
        raise ValidationError(message.format(n=n))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def years_of(df: DataFrame, column: str) -> list[int]:
    """Distinct non-null years: as many as there are years, not rows."""
    return sorted(r[0] for r in distinct_values(df, column).collect())


def single_year(df: DataFrame, column: str = "collision_year") -> int:
    years = years_of(df, column)
    if len(years) != 1:
        raise ValidationError(f"Expected exactly one reporting year, found {years}")
    return years[0]


def year_status(df: DataFrame, year: int, column: str = "collision_year") -> DataFrame:
    """n_years, year (the only one, or null), has_year and is_year_alone, in one pass."""
    years = df.agg(F.array_sort(F.collect_set(column)).alias("_y"))
    one = F.size("_y") == 1
    return years.select(F.size("_y").alias("n_years"), F.when(one, F.col("_y")[0]).alias("year"), F.array_contains("_y", year).alias("has_year"), (one & F.array_contains("_y", year)).alias("is_year_alone"))


def require_years(df: DataFrame, years: Iterable[int], column: str = "collision_year") -> None:
    """Every one of ``years`` has rows; one pass for all of them."""
    have = set(years_of(df.where(F.col(column).isin(list(years))), column))
    for year in sorted(years):
        if year not in have:
            raise ValidationError(f"The source has no rows for {year}")


def require_year(df: DataFrame, year: int, column: str = "collision_year") -> DataFrame:
    found = df.where(F.col(column) == year)
    if found.isEmpty():
        raise ValidationError(f"The source has no rows for {year}")
    return found


def require_years_equal(df: DataFrame, year: int, column: str = "collision_year") -> None:
    years = years_of(df, column)
    if years != [year]:
        raise ValidationError(f"Years {years} do not equal the network year {year}")


def link_uniqueness(links: DataFrame) -> DataFrame:
    return links.agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("segment_id").alias("n_segment_ids"), F.countDistinct("count_point_id").alias("n_count_points"))


def require_yearly_links(links: DataFrame, years: Iterable[int], column: str = "source_year") -> None:
    """The rules of :func:`require_links` for each of ``years``, in one pass."""
    found = {r[column]: r for r in links.where(F.col(column).isin(list(years))).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("segment_id").alias("ids"), F.countDistinct("count_point_id").alias("points")).collect()}
    for year in sorted(years):
        if year not in found:
            raise ValidationError(f"No road links of {year}")
        n, ids, points = (found[year][k] for k in ("n", "ids", "points"))
        if ids != n or points != n:
            raise ValidationError(f"Segment ids or count points of {year} are not unique: {ids} and {points} of {n}")


def require_links(links: DataFrame) -> None:
    n, ids, points = link_uniqueness(links).first()
    if n == 0:
        raise ValidationError("No road links")
    if ids != n:
        raise ValidationError(f"Segment ids are not unique: {ids} of {n}")
    if points != n:
        raise ValidationError(f"Count points are not unique: {points} of {n}")


def require_urban_rural(lookup: DataFrame, column: str = "urban_rural") -> None:
    """All values outside the domain are named; the message has the first NAMED and how many more there are."""
    bad = lookup.where(outside_domain(F.col(column), ("urban", "rural"))).select(column).distinct()
    named = [r[0] for r in bad.orderBy(column).limit(NAMED).collect()]
    if named:
        more = bad.count() - len(named) if len(named) == NAMED else 0
        raise ValidationError(f"Unknown urban_rural values: {', '.join(named)}" + (f" and {more} more" if more else ""))


def row_validity(df: DataFrame, split: Column, *, exposure: str = "annual_vehicle_km", target: str = "ksi_count") -> DataFrame:
    """Rows, invalid exposures and targets, and total exposure of each split, in one pass."""
    return df.groupBy(split.alias("evaluation_split")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(invalid_exposure(F.col(exposure))).alias("invalid_exposure_rows"),
        F.count_if(invalid_target(F.col(target))).alias("invalid_target_rows"), F.sum(exposure).alias("total_exposure"),
    )


def require_model_rows(df: DataFrame, split: Column, needed: Iterable[str], **names: str) -> None:
    rows = {r["evaluation_split"]: r for r in row_validity(df, split, **names).collect()}
    for label in needed:
        if label not in rows:
            raise ValidationError(f"No {label} rows")
        bad = rows[label]["invalid_exposure_rows"] + rows[label]["invalid_target_rows"]
        if bad:
            raise ValidationError(f"Found {bad} invalid exposure or target values in {label} rows")
    if "training" in rows and not (rows["training"]["total_exposure"] or 0) > 0:
        raise ValidationError("Training exposure must be positive")


def source_coverage(df: DataFrame, requested: Iterable[int], *, mode: str = "contains", column: str = "collision_year") -> DataFrame:
    """collision_records, available_year_min, available_year_max, missing_years, valid; of one row.

    exact: the source has the requested year alone; contains: it has all requested years."""
    wanted = F.array(*(F.lit(int(y)) for y in sorted(requested)))
    found = df.agg(F.count(F.lit(1)).alias("collision_records"), F.min(column).cast("int").alias("available_year_min"), F.max(column).cast("int").alias("available_year_max"), F.array_sort(F.collect_set(F.col(column).cast("int"))).alias("_years"))
    missing = F.array_except(wanted, F.col("_years"))
    valid = F.size(missing) == 0
    if mode == "exact":
        valid = F.col("_years") == wanted
    return found.select("collision_records", "available_year_min", "available_year_max", missing.alias("missing_years"), valid.alias("valid"))


def require_coverage(df: DataFrame, requested: Iterable[int], *, mode: str = "contains") -> None:
    row = source_coverage(df, requested, mode=mode).first()
    if row["available_year_min"] is None:
        raise ValidationError("The collision source has no reporting years")
    if not row["valid"]:
        raise ValidationError(f"Collision years lack {row['missing_years']} of the requested {', '.join(map(str, sorted(requested)))}")


def manifest_status(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """filename and status (ok, changed, missing, extra) of files against recorded bytes and SHA-256."""
    old = manifest.select("filename", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    same = (F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha256"))
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("_sha256").isNull(), "extra").when(same, "ok").otherwise("changed")
    return inventory.join(old, "filename", "full_outer").select("filename", status.alias("status"))
