"""Upsert, overlay and replace-part merges as pure functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text
from ..schemas import STORAGE_KEY
from .rows import dedupe_records, keep_first

_TEXT = {"waste_code", "owner", "object_name", "address"}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those that share their keys; the last of ``new`` by order wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [F.col(k) for k in keys], [F.desc("_new"), F.desc(order)]).drop("_new")


def upsert_geocodes(cache: DataFrame, found: DataFrame, order: str) -> DataFrame:
    """Cache upsert; rows without both numbers are left out."""
    good = found.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon")}).where("lat is not null and lon is not null")
    return upsert(cache, good, ["address_key"], order)


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Both tables' rows; where a key is in both, the overlay's."""
    return over.unionByName(base.join(over.select(key), key, "left_anti"))


def replaced_part(stored: DataFrame, incoming: DataFrame, part: int, order: str = "pk") -> DataFrame:
    """The register after a new file for one part: other parts as stored, then the new rows, deduplicated.

    New rows without a coordinate take that of the stored row of the same part
    and storage key (of several the last), latitude and longitude apart.
    """
    keyed = lambda df: df.withColumns({f"_{c}": norm_text(F.col(c)) if c in _TEXT else F.col(c) for c in STORAGE_KEY})
    keys = [f"_{c}" for c in STORAGE_KEY]
    mine, others = stored.where(F.col("source_part") == part), stored.where(~F.col("source_part").eqNullSafe(F.lit(part)))
    last = keep_first(keyed(mine), [F.col(k) for k in keys], [F.desc(order)]).select(*(F.col(k).alias(f"o{k}") for k in keys), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"o{k}"))
        same = eq if same is None else same & eq
    fresh = keyed(incoming).join(last, same, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in ("lat", "lon")}).select(*incoming.columns)
    both = others.withColumn("_block", F.lit(0)).unionByName(fresh.withColumn("_block", F.lit(1)))
    ordered = both.withColumn("_order", F.struct("_block", order))
    return dedupe_records(ordered, STORAGE_KEY, "_order").drop("_block", "_order")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows, repeats counted."""
    off = a.exceptAll(b).union(b.exceptAll(a)).limit(1)
    return off.agg((F.count("*") == 0).alias("equal"))
