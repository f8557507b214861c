"""Places and regions with coordinates, and texts looked up in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.extract import let, parts_of, strip
from ..functions.text import clean_text
from ..operators import lookup, merge, rows

#: Phrases that name a region of the register's country, with its centre; fixed values.
REGIONS = (
    ("минская область", 53.75, 27.95),
    ("мінская вобласць", 53.75, 27.95),
    ("минская обл", 53.75, 27.95),
    ("минская вобл", 53.75, 27.95),
    ("брестская область", 52.45, 25.35),
    ("брэсцкая вобласць", 52.45, 25.35),
    ("брестская обл", 52.45, 25.35),
    ("брэсцкая вобл", 52.45, 25.35),
    ("гомельская область", 52.55, 30.95),
    ("гомельская вобласць", 52.55, 30.95),
    ("гомельская обл", 52.55, 30.95),
    ("гомельская вобл", 52.55, 30.95),
    ("гродненская область", 53.65, 24.55),
    ("гродзенская вобласць", 53.65, 24.55),
    ("гродненская обл", 53.65, 24.55),
    ("гродзенская вобл", 53.65, 24.55),
    ("могилёвская область", 53.85, 30.35),
    ("магілёўская вобласць", 53.85, 30.35),
    ("могилёвская обл", 53.85, 30.35),
    ("магілёўская вобл", 53.85, 30.35),
    ("витебская область", 55.15, 29.95),
    ("віцебская вобласць", 55.15, 29.95),
    ("витебская обл", 55.15, 29.95),
    ("віцебская вобл", 55.15, 29.95),
)


def regions(spark: SparkSession) -> DataFrame:
    """(phrase, lat, lon) of the fixed region phrases."""
    return spark.createDataFrame(list(REGIONS), "phrase string, lat double, lon double")


def built(dump: DataFrame) -> DataFrame:
    """(place, lat, lon) from rows of a place-name dump: name, ascii_name, other_names, lat, lon, feature_class, population, ord.

    Populated places only; each name's most populous place, the first of equals.
    """
    names = F.array_distinct(F.filter(F.transform(F.concat(F.array("name", "ascii_name"), F.split(F.coalesce("other_names", F.lit("")), ",")), lambda n: F.lower(clean_text(F.regexp_replace(n, r"(?U)[^\w\s-]", " ")))), lambda n: F.length(n) >= 2))
    each = dump.where("feature_class = 'P'").select(F.explode(names).alias("place"), "lat", "lon", F.coalesce("population", F.lit(0)).alias("population"), "ord")
    return rows.keep_first(each, [F.col("place")], [F.desc("population"), F.col("ord")]).select("place", "lat", "lon")


def merged(dump: DataFrame, own: DataFrame) -> DataFrame:
    """The dump's places with the own list's in their place where both name one."""
    fold = lambda df: df.select(F.lower("place").alias("place"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon")).where("lat is not null and lon is not null")
    return merge.overlay(fold(dump), fold(own), "place")


def loose_coords(texts: DataFrame, gazetteer: DataFrame, phrases: DataFrame) -> DataFrame:
    """(pk, lat, lon): the longest region phrase of the text, else its longest word that is a place."""
    long = texts.where(F.length(clean_text(F.col("t"))) >= 4)
    by_region = lookup.longest_phrase(long, "pk", F.col("t"), phrases).select("pk", "lat", "lon")
    by_word = lookup.nearest_word_place(long, "pk", F.col("t"), gazetteer).select("pk", "lat", "lon")
    return by_region.unionByName(by_word.join(by_region.select("pk"), "pk", "left_anti"))


def strict_coords(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(pk, lat, lon): the first marked place that the gazetteer holds, longest name first.

    ``texts``: pk, r (which text of the record, lowest first), t.  After each town
    mark up to three words count, up to a comma or a stop word.
    """
    quotes = r"\"'«»()\[\]\-–—\s"
    named = F.regexp_extract_all(F.translate("t", " ", " "), F.lit(P.LOCALITY_AFTER_MARK), F.lit(1))

    def candidates(mark):
        plain = F.filter(F.transform(parts_of(strip(mark, quotes), r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\w-]", ""))), lambda w: w != "")
        stop = lambda ws: F.get(F.filter(F.transform(ws, lambda w, i: F.when(w.isin(*P.LOCALITY_STOPS), i)), lambda i: i.isNotNull()), F.lit(0))
        kept = let(plain, lambda ws: F.slice(ws, F.lit(1), F.least(F.lit(3), F.coalesce(stop(ws), F.size(ws)))))
        return let(kept, lambda ws: F.transform(F.filter(F.sequence(F.lit(3), F.lit(1), F.lit(-1)), lambda n: n <= F.size(ws)), lambda n: F.array_join(F.slice(ws, F.lit(1), n), " ")))

    marks = texts.select("pk", "r", F.posexplode(named).alias("m", "mark"))
    tried = marks.select("pk", "r", "m", F.posexplode(candidates(F.col("mark"))).alias("c", "place"))
    return rows.keep_first(tried.join(gazetteer.select("place", "lat", "lon"), "place"), [F.col("pk")], [F.col("r"), F.col("m"), F.col("c")]).select("pk", "lat", "lon")
