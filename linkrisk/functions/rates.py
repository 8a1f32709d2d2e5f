"""Keys, exposure and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE_SCALE = 1e8
MILLION = 1e6


def segment_key(count_point_id: Column) -> Column:
    return F.concat(F.lit("dft-count-point-"), count_point_id.cast("string"))


def segment_id(year: Column, count_point_id: Column) -> Column:
    return F.concat(F.lit("dft-mrdb-"), year.cast("string"), F.lit("-"), count_point_id.cast("string"))


def annual_vehicle_km(flow: Column, length_km: Column) -> Column:
    return flow * 365 * length_km


def rate_per(count: Column, exposure: Column, scale: float) -> Column:
    """Null unless the exposure is positive."""
    return F.when(exposure > 0, count / exposure * F.lit(scale))


def exact_sum(column: Column) -> Column:
    """The sum of doubles to six decimal places, exact and so the same in whatever order they are added. Where these
    places do not hold the values (not finite, beyond 1e32, smaller than 0.001) it is the plain sum."""
    exact, size = column.try_cast("decimal(38,6)"), F.abs(column)
    fits = (F.count(exact) == F.count(column)) & F.coalesce(F.min(F.when(size > 0, size)) >= 1e-3, F.lit(True))
    return F.coalesce(F.when(fits, F.try_sum(exact).cast("double")), F.sum(column))


def is_ksi(severity: Column) -> Column:
    return severity.isin(1, 2)


def severity_label(severity: Column) -> Column:
    return F.when(severity == 1, "Fatal").when(severity == 2, "Serious").when(severity == 3, "Slight")


def cleaned(column: Column, *sentinels: str) -> Column:
    """Null for sentinel strings."""
    return F.when(~column.isin(*sentinels), column)


def try_date(column: Column) -> Column:
    return F.try_to_date(column, "dd/MM/yyyy")


def blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column.cast("string")) == "")


def matches_term(term: str, *columns: Column) -> Column:
    """Case-insensitive substring in any column; a blank term matches all rows."""
    if not term.strip():
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c.cast("string")).contains(term.strip().lower()), F.lit(False))
    return out


def poisson_deviance_term(actual: Column, predicted: Column) -> Column:
    mu = F.greatest(predicted, F.lit(1e-12))
    return F.when(actual > 0, actual * F.log(actual / mu) - (actual - mu)).otherwise(mu)
