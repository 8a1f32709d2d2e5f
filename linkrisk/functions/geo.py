"""Planar and geodetic expressions.

Longer formulas are chains of named steps, added as columns one after the other, so that no
expression is written out more than once and all stay in generated code. The steps are plain SQL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Steps = Sequence[tuple[str, str]]

# Ellipsoids, datum shift and grid of the public guide to coordinate systems in Great Britain.
WGS84_A, WGS84_B = 6378137.0, 6356752.314245
AIRY_A, AIRY_B = 6377563.396, 6356256.909
SHIFT_M = (-446.448, 125.157, -542.060)
SHIFT_SECONDS = (-0.1502, -0.2470, -0.8421)
SHIFT_PPM = 20.4894
GRID_SCALE, GRID_LAT, GRID_LON, GRID_E, GRID_N = 0.9996012717, 49.0, -2.0, 400000.0, -100000.0


def _num(x: float) -> str:
    return f"cast('{x!r}' as double)"


def _cartesian(lat: str, lon: str, a: float, b: float, to: str) -> Steps:
    e2 = 1 - b * b / (a * a)
    return [
        (f"{to}_nu", f"{_num(a)} / sqrt(1 - {_num(e2)} * sin({lat}) * sin({lat}))"),
        (f"{to}_x", f"{to}_nu * cos({lat}) * cos({lon})"),
        (f"{to}_y", f"{to}_nu * cos({lat}) * sin({lon})"),
        (f"{to}_z", f"{_num(1 - e2)} * {to}_nu * sin({lat})"),
    ]


def _shifted(of: str, to: str, sign: int) -> Steps:
    tx, ty, tz = (sign * v for v in SHIFT_M)
    rx, ry, rz = (sign * math.radians(v / 3600) for v in SHIFT_SECONDS)
    s = 1 + sign * SHIFT_PPM * 1e-6
    return [
        (f"{to}_x", f"{_num(tx)} + {_num(s)} * {of}_x - {_num(rz)} * {of}_y + {_num(ry)} * {of}_z"),
        (f"{to}_y", f"{_num(ty)} + {_num(rz)} * {of}_x + {_num(s)} * {of}_y - {_num(rx)} * {of}_z"),
        (f"{to}_z", f"{_num(tz)} - {_num(ry)} * {of}_x + {_num(rx)} * {of}_y + {_num(s)} * {of}_z"),
    ]


def _geodetic(of: str, to: str, a: float, b: float) -> Steps:
    """Latitude and longitude of a cartesian point near the ellipsoid, in closed form (Bowring)."""
    e2, f2 = 1 - b * b / (a * a), (a * a - b * b) / (b * b)
    return [
        (f"{to}_p", f"sqrt({of}_x * {of}_x + {of}_y * {of}_y)"),
        (f"{to}_t", f"atan2({_num(a)} * {of}_z, {_num(b)} * {to}_p)"),
        (f"{to}_lat", f"atan2({of}_z + {_num(f2 * b)} * power(sin({to}_t), 3), {to}_p - {_num(e2 * a)} * power(cos({to}_t), 3))"),
        (f"{to}_lon", f"atan2({of}_y, {of}_x)"),
    ]


def _arc(lat: str) -> str:
    """Length of the meridian from the grid's latitude to ``lat``."""
    n, lat0 = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B), math.radians(GRID_LAT)
    terms = (
        (1 + n + 1.25 * n**2 + 1.25 * n**3, f"({lat} - {_num(lat0)})"),
        (-(3 * n + 3 * n**2 + 2.625 * n**3), f"sin({lat} - {_num(lat0)}) * cos({lat} + {_num(lat0)})"),
        (1.875 * n**2 + 1.875 * n**3, f"sin(2 * ({lat} - {_num(lat0)})) * cos(2 * ({lat} + {_num(lat0)}))"),
        (-(35 / 24) * n**3, f"sin(3 * ({lat} - {_num(lat0)})) * cos(3 * ({lat} + {_num(lat0)}))"),
    )
    return "(" + " + ".join(f"{_num(AIRY_B * GRID_SCALE * k)} * {x}" for k, x in terms) + ")"


def _radii(lat: str, to: str) -> Steps:
    e2 = 1 - AIRY_B**2 / AIRY_A**2
    return [
        (f"{to}_q", f"1 - {_num(e2)} * sin({lat}) * sin({lat})"),
        (f"{to}_v", f"{_num(AIRY_A * GRID_SCALE)} / sqrt({to}_q)"),
        (f"{to}_r", f"{_num(AIRY_A * GRID_SCALE * (1 - e2))} / (sqrt({to}_q) * {to}_q)"),
        (f"{to}_h", f"{to}_v / {to}_r - 1"),
    ]


def forward_steps(lon: str, lat: str, x: str, y: str) -> Steps:
    """Degrees on WGS84 to metres on the national grid."""
    return [
        ("g0_lat", f"radians({lat})"), ("g0_lon", f"radians({lon})"),
        *_cartesian("g0_lat", "g0_lon", WGS84_A, WGS84_B, "g1"), *_shifted("g1", "g2", 1), *_geodetic("g2", "g3", AIRY_A, AIRY_B), *_radii("g3_lat", "g4"),
        ("g4_s", "sin(g3_lat)"), ("g4_c", "cos(g3_lat)"), ("g4_t2", "(g4_s / g4_c) * (g4_s / g4_c)"), ("g4_l", f"g3_lon - {_num(math.radians(GRID_LON))}"),
        (y, f"{_num(GRID_N)} + {_arc('g3_lat')} + g4_v / 2 * g4_s * g4_c * power(g4_l, 2)"
            " + g4_v / 24 * g4_s * power(g4_c, 3) * (5 - g4_t2 + 9 * g4_h) * power(g4_l, 4)"
            " + g4_v / 720 * g4_s * power(g4_c, 5) * (61 - 58 * g4_t2 + g4_t2 * g4_t2) * power(g4_l, 6)"),
        (x, f"{_num(GRID_E)} + g4_v * g4_c * g4_l + g4_v / 6 * power(g4_c, 3) * (g4_v / g4_r - g4_t2) * power(g4_l, 3)"
            " + g4_v / 120 * power(g4_c, 5) * (5 - 18 * g4_t2 + g4_t2 * g4_t2 + 14 * g4_h - 58 * g4_t2 * g4_h) * power(g4_l, 5)"),
    ]


def inverse_steps(x: str, y: str, lon: str, lat: str) -> Steps:
    """Metres on the national grid to degrees on WGS84; the foot latitude takes six fixed rounds."""
    rounds = [("g5_0", f"{_num(math.radians(GRID_LAT))} + ({y} - {_num(GRID_N)}) / {_num(AIRY_A * GRID_SCALE)}")]
    for k in range(6):
        rounds.append((f"g5_{k + 1}", f"g5_{k} + ({y} - {_num(GRID_N)} - {_arc(f'g5_{k}')}) / {_num(AIRY_A * GRID_SCALE)}"))
    return [
        *rounds, *_radii("g5_6", "g6"), ("g6_t", "tan(g5_6)"), ("g6_t2", "g6_t * g6_t"), ("g6_c", "cos(g5_6)"), ("g6_d", f"{x} - {_num(GRID_E)}"),
        ("g7_lat", "g5_6 - g6_t / (2 * g6_r * g6_v) * power(g6_d, 2) + g6_t / (24 * g6_r * power(g6_v, 3)) * (5 + 3 * g6_t2 + g6_h - 9 * g6_t2 * g6_h) * power(g6_d, 4)"
                   " - g6_t / (720 * g6_r * power(g6_v, 5)) * (61 + 90 * g6_t2 + 45 * g6_t2 * g6_t2) * power(g6_d, 6)"),
        ("g7_lon", f"{_num(math.radians(GRID_LON))} + g6_d / (g6_c * g6_v) - power(g6_d, 3) / (6 * g6_c * power(g6_v, 3)) * (g6_v / g6_r + 2 * g6_t2)"
                   " + power(g6_d, 5) / (120 * g6_c * power(g6_v, 5)) * (5 + 28 * g6_t2 + 24 * g6_t2 * g6_t2)"),
        *_cartesian("g7_lat", "g7_lon", AIRY_A, AIRY_B, "g8"), *_shifted("g8", "g9", -1), *_geodetic("g9", "g10", WGS84_A, WGS84_B),
        (lon, "degrees(g10_lon)"), (lat, "degrees(g10_lat)"),
    ]


def with_steps(df: DataFrame, steps: Steps, keep: Sequence[str]) -> DataFrame:
    before = df.columns
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    # inline() is a barrier: a filter or join condition on the result would else be pushed through
    # the chain and write every step out in full.
    return df.select(*before, F.inline(F.array(F.struct(*keep))))


def to_grid(df: DataFrame, lon: str = "longitude", lat: str = "latitude", x: str = "x", y: str = "y") -> DataFrame:
    """Adds national-grid metres; null coordinates stay null."""
    return with_steps(df, forward_steps(lon, lat, x, y), (x, y))


def to_degrees(df: DataFrame, x: str = "x", y: str = "y", lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    return with_steps(df, inverse_steps(x, y, lon, lat), (lon, lat))


def piece_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a straight piece, which may be a single point."""
    dx, dy = x2 - x1, y2 - y1
    squared = dx * dx + dy * dy
    along = F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / squared))).otherwise(0.0)
    ex, ey = px - (x1 + along * dx), py - (y1 + along * dy)
    return F.sqrt(ex * ex + ey * ey)


def clip_range(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Where along a piece (0 to 1) it enters and leaves a closed box; no part if the first is larger."""
    left, low, right, high = map(F.lit, box)
    dx, dy = x2 - x1, y2 - y1
    enter, leave = F.lit(0.0), F.lit(1.0)
    for d, a, lo, hi in ((dx, x1, left, right), (dy, y1, low, high)):
        first = F.when(d > 0, (lo - a) / d).when(d < 0, (hi - a) / d).when((a >= lo) & (a <= hi), 0.0).otherwise(2.0)
        last = F.when(d > 0, (hi - a) / d).when(d < 0, (lo - a) / d).when((a >= lo) & (a <= hi), 1.0).otherwise(-1.0)
        enter, leave = F.greatest(enter, first), F.least(leave, last)
    return enter, leave


def cells_between(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))
