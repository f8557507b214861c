"""Lookup, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import address_key_or_null, match_words
from .rows import keep_first


def with_cached_coords(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records with the cache's coordinates where they have none of their own.

    An equi-join on the address key; Spark broadcasts the cache if it finds it
    small, and shuffles on the key otherwise.
    """
    hits = cache.select(F.col("address_key").alias("_key"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    joined = records.join(hits, address_key_or_null(F.col("address")) == F.col("_key"), "left")
    return joined.withColumns({c: F.when(own, F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c))) for c in ("lat", "lon")}).drop("_key", "_lat", "_lon")


def cache_subset(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Cache rows whose key is asked for; blank keys ask for nothing."""
    wanted = keys.select(F.trim("address_key").alias("address_key")).where("address_key <> ''").distinct()
    return cache.join(wanted, "address_key", "left_semi")


def override(df: DataFrame, flags: DataFrame, keys: list[str], value: str, by: str) -> DataFrame:
    """``value`` replaced where ``flags`` has a non-null ``by`` for the row's keys."""
    return df.join(flags.select(*keys, F.col(by).alias("_by")), keys, "left").withColumn(value, F.coalesce("_by", value)).drop("_by")


def mode_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """The commonest value of each group; ties to the least, case aside. Counted before it is ranked."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return keep_first(counts, [F.col(group)], [F.desc("n"), F.lower(value), F.col(value)])


def filled_from_mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """Null values filled with their group's commonest."""
    modes = mode_per_group(df, group, value).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    return df.join(modes, F.col(group) == F.col("_g"), "left").withColumn(value, F.coalesce(value, "_v")).drop("_g", "_v")


def last_before(df: DataFrame, keys: list[str], order: str, value: Column, within: int | None = None) -> Column:
    """The last non-null value above a row in its group, at most ``within`` order units above it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    got = F.last(F.when(value.isNotNull(), F.struct(F.col(order).alias("at"), value.alias("v"))), ignorenulls=True).over(w)
    near = F.lit(True) if within is None else F.col(order) - got["at"] <= within
    return F.when(near, got["v"])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int, keys: list[str]) -> DataFrame:
    """Points inside ranges of the same keys, ends included.

    Both sides meet in bins of ``width``: a range is dealt to each bin that it
    touches, a point to its own, so that the join is on equal keys.
    """
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return (
        points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, [*keys, "_bin"])
        .where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_bin")
    )


def nearest_word_place(df: DataFrame, ident: str, text: Column, gazetteer: DataFrame, least: int = 4) -> DataFrame:
    """(ident, place, lat, lon): the longest word of the text that is a place, ties to the least word."""
    words = df.select(ident, F.explode(F.array_distinct(F.split(F.trim(match_words(text)), " "))).alias("place")).where(F.length("place") >= least)
    hits = words.join(gazetteer.select("place", "lat", "lon"), "place")
    return keep_first(hits, [F.col(ident)], [F.desc(F.length("place")), F.col("place")])


def phrases_found(df: DataFrame, ident: str, text: Column, phrases: DataFrame) -> DataFrame:
    """(ident, and the columns of ``phrases``): the phrases, of any length, that the text holds as whole words.

    An index by first word: each place of the text meets the phrases that begin
    with its word, and one holds if the words from there on begin with it.  A text
    is dealt out as its distinct runs of as many words as the longest phrase has.
    """
    longest = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0  # one number
    words = F.split(F.trim(match_words(text)), " ")
    runs = F.transform(words, lambda w, i: F.struct(w.alias("_first"), F.concat(F.array_join(F.slice(words, i + 1, F.lit(max(1, longest))), " "), F.lit(" ")).alias("_run")))
    places = df.select(ident, F.explode(F.array_distinct(runs)).alias("_at")).select(ident, "_at._first", "_at._run")
    index = phrases.where(F.trim("phrase") != "").withColumn("_begin", F.substring_index("phrase", " ", 1))
    hits = places.join(index, (F.col("_first") == F.col("_begin")) & F.startswith("_run", F.concat("phrase", F.lit(" "))))
    return hits.select(ident, *phrases.columns)


def longest_phrase(df: DataFrame, ident: str, text: Column, phrases: DataFrame) -> DataFrame:
    """(ident, phrase, lat, lon): the longest phrase that the text holds as whole words, ties to the least."""
    return keep_first(phrases_found(df, ident, text, phrases), [F.col(ident)], [F.desc(F.length("phrase")), F.col("phrase")])


def changed_rows(draft: DataFrame, saved: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Drafts that differ from the saved rows: the key, and each field only where it changed."""
    old = saved.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in fields))
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = draft.join(old, F.col(key) == F.col("_k")).where(differs)
    return joined.select(key, *(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)).alias(c) for c in fields))
