"""Search: which facilities match a text, code or id, nearest first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import geo, text
from ..functions import patterns as P
from ..operators import lookup, rows
from ..schemas import SEARCH_COLUMNS, SEARCH_KEY

TEXT_COLUMNS = ["record_id", "waste_code", "waste_type_name", "owner", "object_name", "address", "phones"]


@dataclass(frozen=True)
class Request:
    query: str = ""
    waste_code: str | None = None
    lat: float | None = None
    lon: float | None = None
    limit: int = 7
    escape: bool = False

    @property
    def located(self) -> bool:
        return self.lat is not None and self.lon is not None


def projected(registry: DataFrame, *, accepts_only: bool = False) -> DataFrame:
    """The search columns, text defaults filled; Parquet reads no payload."""
    df = registry.select(*SEARCH_COLUMNS)
    if accepts_only:
        df = df.where(F.col("accepts_external_waste").eqNullSafe(F.lit(True)))
    blank = ["owner", "object_name", "waste_type_name", "address", "phones"]
    return df.withColumns({**{c: F.coalesce(c, F.lit("")) for c in blank}, "accepts_external_waste": F.coalesce("accepts_external_waste", F.lit(True)), "id": F.coalesce("record_id", "pk")})


def loaded(registry: DataFrame, request: Request) -> DataFrame:
    """One of four scans: by code or id, by text, accepting ones, or all; predicates reach the files and no match is cut off."""
    q = request.query.strip()
    hint = text.record_id_hint(q)
    if request.waste_code or hint is not None:
        df = projected(registry, accepts_only=request.located)
        if request.waste_code:
            df = df.where(F.col("waste_code") == request.waste_code)
        return df.where(F.col("record_id") == hint) if hint is not None else df
    if q:
        return projected(registry, accepts_only=request.located).where(text.like_any(q, TEXT_COLUMNS, request.escape))
    return projected(registry, accepts_only=request.located)


def town_by_postcode(records: DataFrame) -> DataFrame:
    """(post, town): the commonest town beside each postcode in addresses, owners and object names."""
    texts = records.select(F.explode(F.array("address", "owner", "object_name")).alias("t"))
    pairs = texts.select(F.explode(F.arrays_zip(
        F.regexp_extract_all("t", F.lit(P.POSTCODE_LOCALITY), F.lit(1)).alias("post"), F.regexp_extract_all("t", F.lit(P.POSTCODE_LOCALITY), F.lit(2)).alias("town")
    )).alias("p")).select("p.post", F.regexp_replace("p.town", r"(?U)[,\s]+$", "").alias("town"))
    return lookup.mode_per_group(pairs.where(F.length("town") >= 3), "post", "town").select("post", "town")


def repaired(records: DataFrame, towns: DataFrame | None = None) -> DataFrame:
    """Addresses repaired from the record's other texts, then from their postcode's town.

    ``towns`` defaults to the map of the given rows alone.
    """
    fixed = records.withColumn("address", F.when(F.trim("address") != "", X.repair_address(F.col("address"), F.col("owner"), F.col("object_name"))).otherwise(F.col("address")))
    towns = town_by_postcode(records) if towns is None else towns
    known = towns.select(F.col("post").alias("_post"), F.col("town").alias("_town"))
    joined = fixed.join(known, F.regexp_extract("address", P.POSTCODE, 0) == F.col("_post"), "left")
    return joined.withColumn("address", F.when(F.trim("address") != "", X.repair_truncated_town(F.col("address"), F.col("_town"))).otherwise(F.col("address"))).drop("_post", "_town")


def text_coords(records: DataFrame, gazetteer: DataFrame, regions: DataFrame) -> DataFrame:
    """Records with ``text_lat``/``text_lon``: a marked place of the address, else of the owner, else a region or word of all texts."""
    from .gazetteer import loose_coords, strict_coords

    strict = strict_coords(records.select("pk", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.col("address").alias("t")), F.struct(F.lit(1).alias("r"), F.col("owner").alias("t")))).alias("x")).select("pk", "x.r", "x.t"), gazetteer)
    loose = loose_coords(records.select("pk", F.concat_ws(" ", "address", "object_name", "owner").alias("t")), gazetteer, regions)
    both = records.join(strict.select("pk", F.col("lat").alias("_sa"), F.col("lon").alias("_so")), "pk", "left").join(loose.select("pk", F.col("lat").alias("_la"), F.col("lon").alias("_lo")), "pk", "left")
    return both.withColumns({"text_lat": F.coalesce("_sa", "_la"), "text_lon": F.coalesce("_so", "_lo")}).drop("_sa", "_so", "_la", "_lo")


RoadProvider = Callable[[DataFrame], DataFrame]


def hits(df: DataFrame, road: bool) -> DataFrame:
    """The answer's columns: blanks as null, distances rounded, spread and whether it is approximate."""
    none = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias(c)
    air = F.round("air_km", 1)
    by_road = F.col("road_km").isNotNull() if road else F.lit(False)
    used = F.coalesce(F.col("road_km"), F.col("air_km")) if road else F.col("air_km")
    return df.select(
        "rank", "pk", "id", "owner", "object_name", none("waste_code"), "waste_type_name", "accepts_external_waste", none("address"), none("phones"), "lat", "lon",
        air.alias("air_km"), (F.round("road_km", 1) if road else F.lit(None).cast("double")).alias("road_km"), F.round(used, 1).alias("distance_km"),
        F.when(used.isNotNull(), geo.spread_km(used, F.col("approximate"), by_road)).alias("spread_km"), F.coalesce("approximate", F.lit(False)).alias("approximate"),
    )


def search(
    registry: DataFrame, request: Request, geocodes: DataFrame | None = None, gazetteer: DataFrame | None = None, regions: DataFrame | None = None,
    road: RoadProvider | None = None, towns: DataFrame | None = None,
) -> DataFrame:
    """The ``limit`` best records: by id, code and text; nearest first where the request has a place.

    ``road`` adds road_km (null where unknown) to the few rows that it is given.
    Without it, and without a gazetteer, only stored and cached coordinates count.
    """
    from pyspark.sql import Window

    k = max(1, request.limit)
    q = request.query.strip().lower()
    found = repaired(loaded(registry, request), towns)
    if q and not (request.escape is False and ("%" in q or "_" in q)):
        found = found.where(F.contains(text.blob(*TEXT_COLUMNS), F.lit(q)))
    pool = rows.dedupe_records(found, SEARCH_KEY)
    if not request.located:
        w = Window.orderBy("pk")
        few = pool.orderBy("pk").limit(k)
        plain = few.withColumns({"rank": F.row_number().over(w), "air_km": F.lit(None).cast("double"), "approximate": F.lit(False)})
        return hits(plain, road=False)
    at = lookup.with_cached_coords(pool, geocodes) if geocodes is not None else pool
    if gazetteer is not None:
        at = text_coords(at, gazetteer, regions)
        lat, lon, approximate = geo.resolve_coords((F.col("lat"), F.col("lon")), (F.col("text_lat"), F.col("text_lon")))
    else:
        lat, lon, approximate = F.col("lat"), F.col("lon"), F.lit(False)
    at = at.withColumns({"_lat": lat, "_lon": lon, "approximate": approximate}).withColumns({"lat": F.col("_lat"), "lon": F.col("_lon")})
    scored = at.where(geo.located()).withColumn("air_km", geo.haversine_km(F.lit(request.lat), F.lit(request.lon), F.col("lat"), F.col("lon")))
    by_air: list[Column] = [F.col("air_km"), F.col("pk")]
    w_air = Window.orderBy("air_km", "pk")
    if road is None:
        ranked = rows.top_k(scored, by_air, k).withColumn("rank", F.row_number().over(w_air))
    else:
        top = scored.orderBy(*by_air).limit(max(k, 25))  # the most that the adaptive rule ever takes
        n = scored.agg(F.count("*").alias("n"))
        few = top.withColumn("_r", F.row_number().over(w_air)).crossJoin(n).where(F.col("_r") <= geo.adaptive_candidates(F.col("n"), k)).drop("_r", "n")  # n is one row
        used = F.coalesce("road_km", "air_km")
        ranked = road(few).orderBy(used, "air_km", "pk").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce("road_km", "air_km"), "air_km", "pk")))
    filled = rows.backfilled_top_k(ranked, at.withColumn("air_km", F.lit(None).cast("double")), ["pk"], "pk", k)
    return hits(filled, road=road is not None)
