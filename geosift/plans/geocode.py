"""The import's geocoding cascade without a sequential loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import address_key_or_null

#: Words that stand for a missing address, and marks of a real one; fixed values.
PLACEHOLDERS = ("не указано", "нет данных", "отсутствует", "—", "-")
ADDRESS_MARK = r"(?iuU)\b(?:г\.|ул\.|улица|д\.|дом|пер\.|просп\.|обл\.|р-н|аг\.|пос\.|дер\.)"


def worth_geocoding(address: Column) -> Column:
    """At least eight characters, no placeholder, and a postcode or an address mark."""
    a = F.lower(F.trim(F.coalesce(address, F.lit(""))))
    return (F.length(a) >= 8) & ~a.isin(*PLACEHOLDERS) & (a.rlike(r"(?U)\b\d{6}\b") | a.rlike(ADDRESS_MARK))


def outcomes(
    records: DataFrame, approximate: Column, worth: Column, budget: int = 0, cached: DataFrame | None = None, order: str = "pk"
) -> DataFrame:
    """Each record with its ``outcome`` in the cascade.

    preset, empty, cache_hit, approx_hit, addr_skipped, cached_miss_skip,
    budget_skip, external (a call is due) or external_memo (its answer is
    awaited by a later row).  ``records``: the order column, address, preset;
    ``approximate`` and ``worth`` are judged on the first row of each address.
    """
    keyed = records.withColumn("_key", address_key_or_null(F.col("address")))
    open_ = keyed.where(~F.col("preset") & F.col("_key").isNotNull() & (F.trim("address") != ""))
    judged = keyed.withColumns({"_approx": F.coalesce(approximate, F.lit(False)), "_worth": F.coalesce(worth, F.lit(False))})
    w = Window.partitionBy("_key").orderBy(order)
    firsts = (
        open_.groupBy("_key").agg(F.min(order).alias("_first"))
        .join(judged.select(F.col(order).alias("_first"), "_approx", "_worth"), "_first")
    )
    if cached is not None:
        firsts = firsts.join(cached.select(F.col("address_key").alias("_key"), F.lit(True).alias("_cached")), "_key", "left")
    else:
        firsts = firsts.withColumn("_cached", F.lit(None).cast("boolean"))
    due = ~F.coalesce("_cached", F.lit(False)) & ~F.col("_approx") & F.col("_worth")
    calls = firsts.where(due).select("_key", "_first")
    granted = calls.orderBy("_first").limit(budget) if budget > 0 else calls
    firsts = firsts.join(granted.select("_key", F.lit(True).alias("_granted")), "_key", "left")
    first = F.col(order) == F.col("_first")
    outcome = (
        F.when(F.col("preset"), "preset")
        .when(F.col("_key").isNull() | (F.trim("address") == ""), "empty")
        .when(F.col("_cached"), "cache_hit")
        .when(F.col("_approx"), F.when(first, "approx_hit").otherwise("cache_hit"))
        .when(~F.col("_worth"), F.when(first, "addr_skipped").otherwise("cached_miss_skip"))
        .when(F.col("_granted"), F.when(first, "external").otherwise("external_memo"))
        .otherwise("budget_skip")
    )
    return keyed.join(firsts, "_key", "left").withColumn("outcome", outcome).drop("_key", "_first", "_approx", "_worth", "_cached", "_granted")
