"""Nearest rows through a grid of cells: counts a cell bound the distance, and only the cells within it are read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Degrees of a cell's sides.
SIZE = 1.0
EARTH_KM = 6371.0


def cell_of(lat: Column, lon: Column, size: float = SIZE) -> Column:
    """The number of the cell of a place, row by row from the south; null without a place."""
    across = math.ceil(360 / size)
    row, col = F.floor((lat + F.lit(90.0)) / F.lit(size)), F.floor((lon + F.lit(180.0)) / F.lit(size))
    return (row * F.lit(across) + col).cast("int")


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    (p, q), (r, s) = ((math.radians(x) for x in at) for at in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def bounds(cell: int, at: tuple[float, float], size: float = SIZE) -> tuple[float, float]:
    """A distance in km that no place of the cell is nearer than, and one that none is farther than."""
    row, col = divmod(cell, math.ceil(360 / size))
    south, west = row * size - 90, col * size - 180
    middle = (south + size / 2, west + size / 2)
    reach = max(_km(middle, (lat, lon)) for lat in (south, south + size / 2, south + size) for lon in (west, west + size))
    way = _km(at, middle)
    return max(0.0, way - reach - 1e-6), way + reach + 1e-6


def near_cells(counts: dict[int, int], at: tuple[float, float], k: int, size: float = SIZE) -> list[int]:
    """The cells that may hold one of the ``k`` nearest rows.

    The cells of least farthest distance that hold ``k`` rows together bound how
    far the k-th may lie; a cell that begins beyond that holds none.
    """
    reach = {c: bounds(c, at, size) for c in counts}
    limit, seen = math.inf, 0
    for c in sorted(counts, key=lambda c: reach[c][1]):
        seen += counts[c]
        if seen >= k:
            limit = reach[c][1]
            break
    return sorted(c for c in counts if reach[c][0] <= limit)


def write_cells(df: DataFrame, path: str, size: float = SIZE) -> None:
    """Located rows in one folder a cell; a crowded cell is dealt to several tasks, sorted by place."""
    celled = df.where(geo.located()).withColumn("cell", cell_of(F.col("lat"), F.col("lon"), size))
    celled.repartitionByRange("cell", "lat", "lon").sortWithinPartitions("cell", "lat", "lon").write.parquet(path, partitionBy=["cell"])


def nearest(celled: DataFrame, at: tuple[float, float], k: int, ties: list[Column], size: float = SIZE) -> DataFrame:
    """The ``k`` rows nearest to a place with their ``air_km``, ties by the given order.

    ``celled``: rows with cell, lat and lon, filtered as the search wants them.  A
    first pass counts the rows of each cell, from the cell and the filter's
    columns alone; what comes to the driver is one number a cell (at most 64,800
    of one degree).  The second reads the cells that the bound leaves.
    """
    counts = {r.cell: r["count"] for r in celled.groupBy("cell").count().collect() if r.cell is not None}
    few = celled.where(F.col("cell").isin(near_cells(counts, at, k, size)))
    return few.withColumn("air_km", geo.haversine_km(F.lit(at[0]), F.lit(at[1]), F.col("lat"), F.col("lon"))).orderBy("air_km", *ties).limit(max(1, k))
