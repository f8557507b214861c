"""Distances and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
#: Beyond this the coordinates found in the text are trusted over stored ones.
DISAGREE_KM = 120.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance as an expression, so that it stays in generated code."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def located(lat: str = "lat", lon: str = "lon") -> Column:
    return F.col(lat).isNotNull() & F.col(lon).isNotNull()


def within_box(lat: Column, lon: Column, at: tuple[float, float], km: float) -> Column:
    """A box around a point that holds its circle; a cheap filter that can reach the scan."""
    import math

    d_lat = math.degrees(km / RADIUS_KM)
    d_lon = math.degrees(km / (RADIUS_KM * max(0.01, math.cos(math.radians(min(89.0, abs(at[0]) + d_lat))))))
    return lat.between(at[0] - d_lat, at[0] + d_lat) & lon.between(at[1] - d_lon, at[1] + d_lon)


def spread_km(distance: Column, approximate: Column, by_road: Column) -> Column:
    """How far off a distance may be, to one decimal."""
    d = F.greatest(F.lit(0.1), distance)
    wide = F.when(approximate, F.greatest(F.lit(8.0), d * 0.35)).when(by_road, F.greatest(F.lit(1.0), d * 0.12))
    return F.round(wide.otherwise(F.greatest(F.lit(2.0), d * 0.2)), 1)


def adaptive_candidates(n: Column, k: int, base: int = 25) -> Column:
    """How many of ``n`` rows, ranked by air, get the costly second metric."""
    top = max(k, base)
    few = F.when(n <= top, n).when(n >= 600, max(k, min(top, 2 * k + 4))).when(n >= 200, max(k, min(top, 3 * k + 6))).otherwise(top)
    return F.when(n <= 0, 0).otherwise(F.least(few, n)).cast("long")


def resolve_coords(own: tuple[Column, Column], text: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """(lat, lon, approximate): stored coordinates unless the text's lie more than 120 km away."""
    has_own, has_text = own[0].isNotNull() & own[1].isNotNull(), text[0].isNotNull() & text[1].isNotNull()
    off = haversine_km(own[0], own[1], text[0], text[1]) > DISAGREE_KM
    use_text = has_text & (~has_own | F.coalesce(off, F.lit(False)))
    pick = lambda i: F.when(use_text, text[i]).when(has_own, own[i])
    return pick(0), pick(1), use_text


def register_sql(spark: SparkSession) -> None:
    """haversine_km(lat1, lon1, lat2, lon2) for SQL; Catalyst inlines its body."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN "
        f"2 * {RADIUS_KM}D * asin(least(1.0D, sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + "
        "cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))"
    )
