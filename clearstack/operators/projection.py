"""Coordinates from one system to another, in columns: geographic, UTM and Mercator, all on WGS84.

Each step is a column of its own, so that what later steps read several times is computed once.

UTM by Krueger's series in the third flattening n up to n ** 3, which holds a millimetre within a zone and about it.
Where a system has no coordinates to give (the poles, 80 degrees from a zone's meridian) they are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ellipsoid and the constants of UTM.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EASTING, SOUTHERN = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of the series, forward, back, and from conformal to geodetic latitude.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_GEODETIC = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def zone(crs: str | None) -> tuple[float, float] | None:
    """The central meridian and the false northing of a UTM zone: EPSG:326zz in the north, 327zz in the south."""
    code = (crs or "").removeprefix("EPSG:")
    if len(code) == 5 and code[:3] in ("326", "327") and code[3:].isdigit() and 1 <= int(code[3:]) <= 60:
        return 6.0 * int(code[3:]) - 183, SOUTHERN if code[2] == "7" else 0.0
    return None


def _sum(coefficients: tuple[float, ...]) -> tuple[Column, Column]:
    """The series' shares of northing and easting at _xi and _eta."""
    xi, eta = F.col("_xi"), F.col("_eta")
    north, east = F.lit(0.0), F.lit(0.0)
    for j, c in enumerate(coefficients, 1):
        north += c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east += c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return north, east


def _to_utm(df: DataFrame, x: str, y: str, meridian: float, northing: float) -> DataFrame:
    df = df.withColumns({"_turned": F.radians(F.pmod(F.col(x) - meridian + 180, F.lit(360.0)) - 180), "_s": F.sin(F.radians(y))})
    df = df.withColumn("_t", F.sinh(F.atanh("_s") - _E * F.atanh(_E * F.col("_s"))))
    away, t = F.cos("_turned"), F.col("_t")
    df = df.withColumns({"_xi": F.atan2(t, away), "_eta": F.asinh(F.sin("_turned") / F.sqrt(t * t + away * away))})
    north, east = _sum(_FORWARD)
    there = (F.abs("_turned") < math.radians(80)) & (F.abs(y) < 89.99)
    moved = {x: F.when(there, EASTING + SCALE * _RADIUS * (F.col("_eta") + east)), y: F.when(there, northing + SCALE * _RADIUS * (F.col("_xi") + north))}
    return df.withColumns(moved).drop("_turned", "_s", "_t", "_xi", "_eta")


def _from_utm(df: DataFrame, x: str, y: str, meridian: float, northing: float) -> DataFrame:
    df = df.withColumns({"_xi": (F.col(y) - northing) / (SCALE * _RADIUS), "_eta": (F.col(x) - EASTING) / (SCALE * _RADIUS)})
    north, east = _sum(_BACK)
    df = df.withColumns({"_a": F.col("_xi") - north, "_b": F.col("_eta") - east})
    df = df.withColumn("_conformal", F.asin(F.sin("_a") / F.cosh("_b")))
    lat = F.col("_conformal")
    for j, c in enumerate(_GEODETIC, 1):
        lat += c * F.sin(2 * j * F.col("_conformal"))
    lon = F.pmod(meridian + F.degrees(F.atan2(F.sinh("_b"), F.cos("_a"))) + 180, F.lit(360.0)) - 180
    there = (F.abs("_xi") < math.pi / 2) & (F.abs("_eta") < 1)
    return df.withColumns({x: F.when(there, lon), y: F.when(there, F.degrees(lat))}).drop("_xi", "_eta", "_a", "_b", "_conformal")


def _to_mercator(df: DataFrame, x: str, y: str) -> DataFrame:
    there = F.abs(y) < 89.99
    return df.withColumns({x: F.when(there, AXIS * F.radians(x)), y: F.when(there, AXIS * F.asinh(F.tan(F.radians(y))))})


def _from_mercator(df: DataFrame, x: str, y: str) -> DataFrame:
    there = F.abs(y) < 10 * AXIS
    return df.withColumns({x: F.when(there, F.degrees(F.col(x) / AXIS)), y: F.when(there, F.degrees(F.atan(F.sinh(F.col(y) / AXIS))))})


def known(crs: str | None) -> bool:
    return crs in ("EPSG:4326", "EPSG:3857") or zone(crs) is not None


def between(df: DataFrame, x: str, y: str, source: str | None, goal: str | None) -> DataFrame:
    """df with its coordinates x and y of the source system in the goal's; x is the longitude or easting in each."""
    for crs in (source, goal):
        if not known(crs):
            raise ValueError(f"no formula for {crs}")
    if source == goal:
        return df
    if at := zone(source):
        df = _from_utm(df, x, y, *at)
    elif source == "EPSG:3857":
        df = _from_mercator(df, x, y)
    if at := zone(goal):
        df = _to_utm(df, x, y, *at)
    elif goal == "EPSG:3857":
        df = _to_mercator(df, x, y)
    return df
