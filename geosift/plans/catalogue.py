"""Queries over the given tables, each with the same query in ANSI SQL.

The tables have no coordinates, so ``with_coords`` derives them from keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.display import UNKNOWN
from ..operators import lookup, merge, rows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_coords(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("lat", F.lit(51.0) + (F.col(key) % 500) / F.lit(100.0)).withColumn("lon", F.lit(23.0) + ((F.col(key) * 7) % 900) / F.lit(100.0))


_LAT = "(cast(51 as double) + ({k} % 500) / cast(100 as double))"
_LON = "(cast(23 as double) + (({k} * 7) % 900) / cast(100 as double))"
_HERE = (53.9, 27.56)


def _km(lat: str, lon: str, at: tuple[float, float] = _HERE) -> str:
    a, b = (f"cast({x} as double)" for x in at)
    return (
        f"12742.0::double * asin(least(1.0::double, sqrt(pow(sin((radians({lat}) - radians({a})) / 2), 2) + "
        f"cos(radians({a})) * cos(radians({lat})) * pow(sin((radians({lon}) - radians({b})) / 2), 2))))"
    )


def _air(at: tuple[float, float] = _HERE) -> Column:
    return F.round(geo.haversine_km(F.lit(at[0]), F.lit(at[1]), F.col("lat"), F.col("lon")), 4)


_CUSTOMER_KM = f"round({_km(_LAT.format(k='c_custkey'), _LON.format(k='c_custkey'))}, 4)"
_SUPPLIER_KM = f"round({_km(_LAT.format(k='s_suppkey'), _LON.format(k='s_suppkey'))}, 4)"


@query(f"""
    WITH f AS (SELECT c_custkey, c_name, {_CUSTOMER_KM} AS distance_km FROM customer
               WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1')
               QUALIFY row_number() OVER (PARTITION BY lower(trim(c_name)), c_nationkey ORDER BY c_custkey) = 1)
    SELECT c_custkey, distance_km, round(greatest(2.0::double, greatest(0.1::double, distance_km) * 0.2::double), 1) AS spread_km
    FROM f ORDER BY distance_km, c_custkey LIMIT 7""")
def nearest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest seven customers of a segment whose name holds a text, deduplicated, with spread."""
    found = table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & text.like_any("1", ["c_name"]))
    one = rows.keep_first(found, [text.norm_text(F.col("c_name")), F.col("c_nationkey")], [F.col("c_custkey")])
    near = rows.top_k(with_coords(one, "c_custkey").withColumn("distance_km", _air()), [F.col("distance_km"), F.col("c_custkey")], 7)
    return near.select("c_custkey", "distance_km", geo.spread_km(F.col("distance_km"), F.lit(False), F.lit(False)).alias("spread_km"))


@query(f"""
    WITH c AS (SELECT s_suppkey, {_SUPPLIER_KM} AS air_km FROM supplier ORDER BY air_km, s_suppkey LIMIT 25)
    SELECT s_suppkey, air_km, round(air_km * (cast(1 as double) + (s_suppkey % 7) / cast(10 as double)), 3) AS road_km
    FROM c ORDER BY road_km, air_km, s_suppkey LIMIT 7""")
def two_stage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = with_coords(table(spark, sf_dir, "supplier"), "s_suppkey").withColumn("air_km", _air()).select("s_suppkey", "air_km")
    road = lambda df: df.withColumn("road_km", F.round(F.col("air_km") * (F.lit(1.0) + (F.col("s_suppkey") % 7) / F.lit(10.0)), 3))
    by_air, by_road = [F.col("air_km"), F.col("s_suppkey")], [F.col("road_km"), F.col("air_km"), F.col("s_suppkey")]
    return rows.two_stage_top_k(near, by_air, 25, road, by_road, 7)


@query(f"""
    WITH pool AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN {_CUSTOMER_KM} END AS distance_km
                  FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'),
    located AS (SELECT *, row_number() OVER (ORDER BY distance_km, c_custkey) AS r FROM pool WHERE distance_km IS NOT NULL
                ORDER BY r LIMIT 20),
    rest AS (SELECT p.* FROM pool p ANTI JOIN located l USING (c_custkey) ORDER BY c_custkey LIMIT 20),
    both_ AS (SELECT c_custkey, distance_km, 0 AS b, r FROM located UNION ALL SELECT c_custkey, distance_km, 1, 0 FROM rest)
    SELECT cast(row_number() OVER (ORDER BY b, r, c_custkey) AS int) AS rank, c_custkey, distance_km FROM both_
    QUALIFY row_number() OVER (ORDER BY b, r, c_custkey) <= 20""")
def topk_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located rows by distance, then the others in their order, until twenty."""
    from pyspark.sql import Window

    pool = with_coords(table(spark, sf_dir, "customer").where("c_nationkey = 7 and c_mktsegment = 'BUILDING'"), "c_custkey")
    pool = pool.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, _air()).alias("distance_km"))
    near = rows.top_k(pool.where("distance_km is not null"), [F.col("distance_km"), F.col("c_custkey")], 20)
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy("distance_km", "c_custkey")))  # twenty rows at most
    return rows.backfilled_top_k(ranked, pool, ["c_custkey"], "c_custkey", 20).select("rank", "c_custkey", "distance_km")


@query("""
    WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
    SELECT c_nationkey, n, cast(CASE WHEN n <= 0 THEN 0 ELSE least(CASE WHEN n <= 25 THEN n WHEN n >= 600 THEN 18 WHEN n >= 200 THEN 25 ELSE 25 END, n) END AS bigint) AS candidates FROM n""")
def adaptive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.withColumn("candidates", geo.adaptive_candidates(F.col("n"), 7))


@query("""SELECT p_partkey, p_name, p_brand FROM part
    WHERE p_name ILIKE '%1_%' OR p_brand ILIKE '%1_%' OR p_type ILIKE '%1_%' ORDER BY p_partkey LIMIT 500""")
def text_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-blind substring over several columns, first rows by key; the user's % and _ are wildcards."""
    hits = table(spark, sf_dir, "part").where(text.like_any("1_", ["p_name", "p_brand", "p_type"]))
    return hits.orderBy("p_partkey").limit(500).select("p_partkey", "p_name", "p_brand")


@query("""SELECT p_partkey FROM part
    WHERE contains(lower(concat_ws(' ', cast(p_partkey AS varchar), p_name, p_brand, p_type)), 'brand#1')""")
def blob_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(text.blob("p_partkey", "p_name", "p_brand", "p_type").contains("brand#1")).select("p_partkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7 AND contains(lower(concat_ws(' ', o_orderkey, o_orderstatus)), '7')
    UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7 AND contains(lower(concat_ws(' ', o_orderkey, o_orderstatus)), '007')""")
def id_hint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits typed as a query are also an id; the text must hold them as typed, so "007" finds nothing."""
    orders = table(spark, sf_dir, "orders")
    found = [orders.where((F.col("o_orderkey") == text.record_id_hint(q)) & text.blob("o_orderkey", "o_orderstatus").contains(q)) for q in ("7", "007")]
    return found[0].union(found[1]).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#13'")
def code_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_brand") == "Brand#13").select("p_partkey", "p_brand")


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def accepts_only_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where((F.col("quality") == 1).eqNullSafe(F.lit(True)) & (F.col("toxic") == 0)).select("doc_id")


@query("SELECT o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def pruned_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return df.select("o_orderkey", *(F.coalesce(c, F.lit("")).alias(c) for c in ("o_orderstatus", "o_orderpriority")))


_NORM = r"trim(regexp_replace(lower({c}), '[ \t\n\r\f\v]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.format(c='text')}) AS norm_md5, md5(substring({_NORM.format(c='text')}, 1, 280)) AS key_md5 FROM documents")
def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.norm_text(c)).alias("norm_md5"), F.md5(text.address_key(c)).alias("key_md5"))


@query(f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY {_NORM.format(c='text')} ORDER BY doc_id) = 1")
def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each normalised text; digests stand for the texts, so that they aren't shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(text.norm_text(F.col("text")), 256).alias("key"))
    return rows.keep_first(docs, [F.col("key")], [F.col("doc_id")]).select("doc_id", "lang")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_partkey, l_suppkey, l_quantity, l_discount, l_tax, lower(l_returnflag), lower(l_linestatus) ORDER BY l_orderkey, l_linenumber) = 1""")
def dedupe_seven_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")] + [text.norm_text(F.col(c)) for c in ("l_returnflag", "l_linestatus")]
    return rows.keep_first(table(spark, sf_dir, "lineitem"), keys, [F.col("l_orderkey"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_partkey")


_MODE = """SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE {w} GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, lower(c_mktsegment), c_mktsegment) = 1"""


@query(_MODE.format(w="true"))
def mode_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.mode_per_group(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query(f"""WITH m AS ({_MODE.format(w="c_custkey % 4 <> 0")})
    SELECT c.c_custkey, CASE WHEN c.c_custkey % 4 <> 0 THEN c.c_mktsegment ELSE m.c_mktsegment END AS c_mktsegment
    FROM customer c LEFT JOIN m USING (c_nationkey)""")
def fill_from_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    return lookup.filled_from_mode(known, "c_nationkey", "c_mktsegment").select("c_custkey", "c_mktsegment")


@query(f"""WITH cache AS (SELECT lower(c_name) AS k, {_LAT.format(k='c_custkey')} AS lat, {_LON.format(k='c_custkey')} AS lon FROM customer WHERE c_custkey % 2 = 0)
    SELECT o.o_orderkey, round(CASE WHEN o.o_orderkey % 5 = 0 THEN cast(50 as double) ELSE cache.lat END, 4) AS lat,
           round(CASE WHEN o.o_orderkey % 5 = 0 THEN cast(20 as double) ELSE cache.lon END, 4) AS lon
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN cache ON lower(c.c_name) = cache.k""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at their customers' cached coordinates; rows with their own keep them."""
    customers = table(spark, sf_dir, "customer")
    cache = with_coords(customers.where("c_custkey % 2 = 0"), "c_custkey").select(text.address_key(F.col("c_name")).alias("address_key"), "lat", "lon")
    own = lambda x: F.when(F.col("o_orderkey") % 5 == 0, F.lit(x))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("address"), own(50.0).alias("lat"), own(20.0).alias("lon"))
    return lookup.with_cached_coords(orders, cache).select("o_orderkey", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)")
def key_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a cache whose keys are asked for; each key once."""
    cache = table(spark, sf_dir, "nation").withColumn("address_key", F.col("n_nationkey").cast("string"))
    keys = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").cast("string").alias("address_key"))
    return lookup.cache_subset(cache, keys).select("n_nationkey", "n_name")


@query(f"""SELECT lower(c_name) AS address_key, round(CASE WHEN c_custkey % 3 = 0 THEN {_LAT.format(k='c_custkey')} + 1 ELSE {_LAT.format(k='c_custkey')} END, 4) AS lat
    FROM customer WHERE c_custkey % 2 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 9 <> 0)""".replace("CASE WHEN c_custkey % 3 = 0", "CASE WHEN c_custkey % 3 = 0 AND c_custkey % 9 <> 0"))
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert by key; new rows without numeric coordinates are skipped."""
    at = with_coords(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", text.address_key(F.col("c_name")).alias("address_key"), "lat", "lon")
    new = at.where("c_custkey % 3 = 0").select("c_custkey", "address_key", F.when(F.col("c_custkey") % 9 == 0, "bad").otherwise((F.col("lat") + 1).cast("string")).alias("lat"), F.col("lon").cast("string").alias("lon"))
    return merge.upsert_geocodes(at.where("c_custkey % 2 = 0"), new, "c_custkey").select("address_key", F.round("lat", 4).alias("lat"))


_REGISTER = """SELECT o_orderkey AS pk, cast(o_orderkey % 2 + 1 AS int) AS source_part, cast(o_custkey AS int) AS record_id, o_orderpriority AS waste_code,
    o_orderstatus AS owner, cast(o_custkey % 3 AS varchar) AS object_name, 'x' AS address, CASE WHEN o_orderkey % 3 = 0 THEN {lat} END AS lat FROM orders"""


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of register rows."""
    at = with_coords(table(spark, sf_dir, "orders"), "o_orderkey")
    some = F.col("o_orderkey") % 3 == 0
    return at.select(
        F.col("o_orderkey").alias("pk"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("source_part"), F.col("o_custkey").cast("int").alias("record_id"),
        F.col("o_orderpriority").alias("waste_code"), F.col("o_orderstatus").alias("owner"), (F.col("o_custkey") % 3).cast("string").alias("object_name"),
        F.lit("x").alias("address"), F.when(some, F.col("lat")).alias("lat"), F.when(some, F.col("lon")).alias("lon"),
    )


@query(f"""WITH r AS ({_REGISTER.format(lat=_LAT.format(k='o_orderkey'))}),
    stored AS (SELECT * FROM r WHERE pk % 4 <> 3), incoming AS (SELECT * EXCLUDE (lat), cast(NULL AS double) AS lat FROM r WHERE source_part = 2 AND pk % 5 <> 1),
    last_ AS (SELECT record_id, waste_code, owner, object_name, lat FROM stored WHERE source_part = 2
              QUALIFY row_number() OVER (PARTITION BY record_id, waste_code, owner, object_name ORDER BY pk DESC) = 1),
    fresh AS (SELECT i.pk, i.source_part, i.record_id, i.waste_code, i.owner, i.object_name, l.lat FROM incoming i LEFT JOIN last_ l USING (record_id, waste_code, owner, object_name)),
    both_ AS (SELECT pk, source_part, record_id, waste_code, owner, object_name, lat, 0 AS b FROM stored WHERE source_part <> 2 UNION ALL SELECT *, 1 FROM fresh)
    SELECT pk, source_part, round(lat, 4) AS lat FROM both_
    QUALIFY row_number() OVER (PARTITION BY source_part, record_id, lower(waste_code), lower(owner), object_name ORDER BY b, pk) = 1""")
def replace_part_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = register(spark, sf_dir)
    stored = r.where("pk % 4 <> 3")
    incoming = r.where("source_part = 2 and pk % 5 <> 1").withColumns({c: F.lit(None).cast("double") for c in ("lat", "lon")})
    return merge.replaced_part(stored, incoming, 2).select("pk", "source_part", F.round("lat", 4).alias("lat"))


@query("""SELECT d.doc_id, coalesce(l.quality = 1, true) AS accepts FROM documents d LEFT JOIN labels l USING (doc_id)""")
def flag_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("accepts"))
    flags = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("flag"))
    return lookup.override(docs, flags, ["doc_id"], "accepts", "flag").select("doc_id", "accepts")


@query("SELECT count(*) AS total, count_if(quality = 1)::bigint AS accepting, count_if(quality = 0)::bigint AS own_only FROM labels")
def flag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("quality") == 1
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("total"), F.count_if(flag).alias("accepting"), F.count_if(~flag).alias("own_only"))


@query("""SELECT c_custkey // 1000 AS block, sha256(string_agg(h, chr(10) ORDER BY h)) AS signature FROM (SELECT c_custkey, sha256(c_name) AS h FROM customer) GROUP BY 1""")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature for each thousand keys, so that no task holds all digests."""
    block = F.expr("c_custkey div 1000")
    return table(spark, sf_dir, "customer").groupBy(block.alias("block")).agg(text.signature(F.sha2("c_name", 256)).alias("signature"))


@query("""WITH stored AS (SELECT sha256(c_name) AS h FROM customer), fewer AS (SELECT sha256(c_name) AS h FROM customer WHERE c_custkey > 1)
    SELECT (SELECT count(*) FROM (SELECT h FROM stored EXCEPT ALL SELECT h FROM stored)) = 0 AS equal
    UNION ALL SELECT (SELECT count(*) FROM (SELECT h FROM stored EXCEPT ALL SELECT h FROM fewer)) = 0""")
def set_equal_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and incoming digests agree, whatever their order; they don't once one is missing."""
    customers = table(spark, sf_dir, "customer")
    d = customers.select(F.sha2("c_name", 256).alias("digest"))
    return merge.same_set(d, d.repartition("digest")).union(merge.same_set(d, customers.where("c_custkey > 1").select(F.sha2("c_name", 256))))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_size < 10 OR p_size > 5""")
def overlay_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    over = part.where("p_size < 10").select("p_partkey", F.upper("p_name").alias("p_name"))
    return merge.overlay(part.where("p_size > 5").select("p_partkey", "p_name"), over, "p_partkey")


@query("""SELECT conv_id, turn, md5(said) AS asked FROM (
    SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said
    FROM conversations) WHERE role = 'assistant'""".replace("last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)", "last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)"))
def asof_last_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: the last user text above each assistant turn."""
    chats = table(spark, sf_dir, "conversations")
    said = lookup.last_before(chats, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")))
    return chats.withColumn("said", said).where("role = 'assistant'").select("conv_id", "turn", F.md5("said").alias("asked"))


@query("""SELECT conv_id, turn, coalesce(CASE WHEN turn - place <= 2 THEN place END, -1) AS system_turn FROM (
    SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place
    FROM conversations) WHERE role = 'assistant'""")
def nearest_above_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    at = lookup.last_before(chats, ["conv_id"], "turn", F.when(F.col("role") == "system", F.col("turn")), within=2)
    return chats.withColumn("system_turn", F.coalesce(at, F.lit(-1).cast("bigint"))).where("role = 'assistant'").select("conv_id", "turn", "system_turn")


@query("""SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    AND date_diff('day', DATE '1970-01-01', cast(l.l_shipdate AS date)) BETWEEN date_diff('day', DATE '1970-01-01', cast(o.o_orderdate AS date)) + 10 AND date_diff('day', DATE '1970-01-01', cast(o.o_orderdate AS date)) + 40""")
def range_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join in bins: lines shipped ten to forty days after their order."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_orderkey", "l_linenumber", day("l_shipdate").alias("at"))
    bands = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (day("o_orderdate") + 10).alias("low"), (day("o_orderdate") + 40).alias("high"))
    return lookup.range_join(lines, bands, "at", "low", "high", 30, ["k"]).select("l_orderkey", "l_linenumber")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


@query(f"""WITH l AS ({_LINES}), s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(Licensed|Th)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM l)
    SELECT doc_id, cast(seg AS bigint) AS seg, count(*) AS n_lines, min(pos)::bigint AS first_line FROM s WHERE seg > 0 GROUP BY 1, 2""")
def line_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.segments import segmented

    got = segmented(lines(spark, sf_dir), ["doc_id"], "pos", F.col("line").rlike("^(Licensed|Th)"), "seg")
    return got.groupBy("doc_id", "seg").agg(F.count("*").alias("n_lines"), F.min("pos").cast("long").alias("first_line"))


@query(f"""WITH l AS ({_LINES}), c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 2 AS chunk, pos, line FROM l)
    SELECT doc_id, cast(chunk AS bigint) AS chunk, md5(string_agg(line, ' | ' ORDER BY pos)) AS joined FROM c GROUP BY 1, 2""")
def chunk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rows.chunks(lines(spark, sf_dir), ["doc_id"], "pos", 2, "line", " | ")
    return got.select("doc_id", "chunk", F.md5("line").alias("joined"))


_SCORE = "(CASE WHEN regexp_matches(line, '[0-9]') THEN 70 ELSE 0 END + least(18, length(line) - length(replace(line, ' ', '')) + 1) + least(12, length(line) // 14) - CASE WHEN contains(line, '|') THEN 45 ELSE 0 END)"


def _line_score() -> Column:
    n = F.length("line")
    return (
        F.when(F.col("line").rlike("[0-9]"), 70).otherwise(0) + F.least(F.lit(18), n - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1)
        + F.least(F.lit(12), F.floor(n / 14)) - F.when(F.col("line").contains("|"), 45).otherwise(0)
    )


@query(f"""WITH l AS ({_LINES}) SELECT doc_id, pos::bigint AS pos, cast({_SCORE} AS bigint) AS score FROM l
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_SCORE} DESC, length(line) DESC, lower(line), pos) = 1""")
def line_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best line of each document: by score, then length, then folded text."""
    scored = lines(spark, sf_dir).withColumn("score", _line_score().cast("long"))
    got = rows.argmax(scored, ["doc_id"], F.col("score"), [F.desc(F.length("line")), F.lower("line"), F.col("pos")])
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "score")


@query(f"""WITH l AS ({_LINES}) SELECT doc_id, pos::bigint AS pos, cast({_SCORE} AS bigint) AS score FROM l
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_SCORE} DESC, pos) = 1""")
def first_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lines(spark, sf_dir).withColumn("score", _line_score().cast("long"))
    return rows.argmax(scored, ["doc_id"], F.col("score"), [F.col("pos")]).select("doc_id", F.col("pos").cast("long").alias("pos"), "score")


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), true)""")
def consecutive_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return rows.runs_collapsed(events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    a AS (SELECT user_id, event_id, ts, rn FROM e WHERE rn = 1
          UNION ALL SELECT n.user_id, n.event_id, n.ts, n.rn FROM a JOIN LATERAL (
              SELECT * FROM e WHERE e.user_id = a.user_id AND e.rn > a.rn AND e.ts - a.ts >= INTERVAL 5 MINUTE ORDER BY e.rn LIMIT 1) n ON true)
    SELECT user_id, event_id FROM a""")
def throttle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at least five minutes after the last accepted one of their user."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.throttled(events, "user_id", "ts", "event_id", 300)


@query("""WITH f AS (SELECT user_id, min(event_id) AS first_ FROM events GROUP BY 1 ORDER BY first_ LIMIT 40)
    SELECT e.event_id, f.first_ IS NOT NULL AS granted FROM events e LEFT JOIN f ON e.user_id = f.user_id AND e.event_id = f.first_""")
def budget_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty users, in row order, get one costly call each."""
    return rows.within_budget(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 40).select("event_id", "granted")


@query("""SELECT c_custkey, nullif(regexp_extract(c_name, '[0-9]{1,10}', 0), '') AS code FROM customer""")
def code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.display import object_code

    return table(spark, sf_dir, "customer").select("c_custkey", object_code(F.col("c_name")).alias("code"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '—' ELSE '~' || cast(cast(floor({_CUSTOMER_KM} + 0.5::double) AS bigint) AS varchar) || ' км' END AS shown,
    CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '±' || cast(cast(floor({_CUSTOMER_KM} / 7 + 0.5::double) AS bigint) AS varchar) || ' км' END AS spread FROM customer""")
def display_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.display import distance_text, spread_text

    known = with_coords(table(spark, sf_dir, "customer"), "c_custkey").withColumn("km", F.when(F.col("c_custkey") % 11 != 0, _air()))
    return known.select("c_custkey", distance_text(F.col("km")).alias("shown"), spread_text(F.col("km") / 7).alias("spread"))


@query("""WITH m AS (SELECT doc_id, text, least(coalesce(nullif(strpos(text, ' the '), 0), 9999999), coalesce(nullif(strpos(text, ' de '), 0), 9999999), coalesce(nullif(strpos(text, '|'), 0), 9999999), coalesce(nullif(strpos(text, ' ist '), 0), 9999999)) AS place FROM documents)
    SELECT doc_id, md5(CASE WHEN place = 9999999 THEN text ELSE left(text, place - 1) END) AS head FROM m""")
def earliest_marker_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.display import before_first

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(before_first(F.col("text"), [" the ", " de ", "|", " ist "])).alias("head"))


@query("""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ','), lambda p: trim(p)), lambda p: p <> ''), ',') AS parts_text,
    len(list_distinct(list_filter(list_transform(string_split(text, ','), lambda p: lower(trim(p))), lambda p: p <> '')))::bigint AS n_distinct FROM conversations""")
def comma_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", ","), lambda p: F.trim(p)), lambda p: p != "")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(parts, ",").alias("parts_text"), F.size(F.array_distinct(F.transform(parts, lambda p: F.lower(p)))).cast("long").alias("n_distinct")
    )


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.id') AS bigint), try_cast(json_extract_string(props, '$.k') AS bigint), event_id) AS id FROM events""")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload's id, else its k, else the row's own key."""
    payload = lambda k: F.get_json_object("props", f"$.{k}").try_cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(payload("id"), payload("k"), "event_id").alias("id"))


@query("""SELECT c_custkey AS pk, cast(CASE WHEN c_custkey % 6 = 0 THEN c_custkey + 5 WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey + 1 END AS int) AS id,
    CASE WHEN c_custkey % 3 = 0 THEN 'P ' || c_name ELSE c_name END AS owner, CASE WHEN c_custkey % 3 <> 0 THEN cast(1000000 + c_nationkey AS varchar) END AS waste_code FROM customer""")
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows as records: objects among the payloads win, lists and broken ones don't; ids of payload, record or row."""
    from .catalog import as_records

    key = F.col("pk")
    ident = F.when(key % 2 == 0, (key + 5).cast("string")).otherwise("none")
    payload = F.when(key % 3 == 0, F.to_json(F.struct(ident.alias("id"), F.concat(F.lit("P "), F.col("owner")).alias("owner")))).when(key % 3 == 1, F.when(key % 2 == 0, "[1]").otherwise("{broken"))
    stored = facilities(spark, sf_dir).withColumns({"payload": payload, "record_id": F.when(key % 5 != 0, F.col("record_id") + 1)})
    return as_records(stored).select("pk", "id", "owner", "waste_code")


@query("SELECT 2 AS version, count(*) AS total, count_if(quality = 1)::bigint AS accepting FROM labels")
def meta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("accepting"))
    return stats.select(F.lit(2).alias("version"), "total", "accepting")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%d.%m.%Y %H:%M') AS shown FROM events""")
def iso_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO text, read back, and shown."""
    from ..functions.display import user_time

    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select("event_id", iso.alias("iso"), user_time(iso, "UTC").alias("shown"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_ \t\n\rß-ÿ]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')), ' ')) AS place FROM documents),
    g AS (SELECT DISTINCT lower(regexp_extract(text, '([A-Za-z]{4,})', 1)) AS place FROM benchmark)
    SELECT doc_id, place FROM w JOIN g USING (place) WHERE length(place) >= 4
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(place) DESC, place) = 1""")
def token_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest word of each document that the gazetteer holds."""
    words = table(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "([A-Za-z]{4,})", 1)).alias("place")).distinct()
    gazetteer = words.withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0)})
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "(?U)[^a-zA-Z0-9_ \\t\\n\\rÀ-ÿ]", " ").alias("text"))
    return lookup.nearest_word_place(docs, "doc_id", F.col("text"), gazetteer).select("doc_id", "place")


@query("""WITH r AS (SELECT o_orderkey AS pk, o_orderpriority || ' ' || (o_custkey % 50) AS addr FROM orders), 
    g AS (SELECT addr, min(pk) AS first_ FROM r WHERE pk % 13 <> 0 GROUP BY 1),
    x AS (SELECT addr, first_, CASE WHEN starts_with(addr, '1') THEN 'approx_hit' WHEN starts_with(addr, '5') THEN 'addr_skipped' ELSE 'external' END AS kind FROM g),
    b AS (SELECT addr, row_number() OVER (ORDER BY first_) AS n FROM x WHERE kind = 'external'),
    y AS (SELECT r.pk, x.kind, r.pk = x.first_ AS is_first, b.n FROM r LEFT JOIN x USING (addr) LEFT JOIN b USING (addr))
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN pk % 13 = 0 THEN 'preset' WHEN kind = 'approx_hit' THEN CASE WHEN is_first THEN 'approx_hit' ELSE 'cache_hit' END
        WHEN kind = 'addr_skipped' THEN CASE WHEN is_first THEN 'addr_skipped' ELSE 'cached_miss_skip' END
        ELSE 'external' END AS outcome FROM y) GROUP BY 1""")
def geocode_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the import's cascade: the first row of an address decides, later ones hit its memo."""
    from .geocode import outcomes

    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pk"), F.concat_ws(" ", "o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("address"), (F.col("o_orderkey") % 13 == 0).alias("preset")
    )
    got = outcomes(orders, approximate=F.col("address").startswith("1"), worth=~F.col("address").startswith("5"), budget=0)
    return got.withColumn("outcome", F.when(F.col("outcome").isin("external", "external_memo"), "external").otherwise(F.col("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, regexp_extract(text, '[a-z0-9.]+@[a-z0-9.]+[a-z]', 0) AS email, len(regexp_extract_all(text, '[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}'))::bigint AS n_phones FROM documents""")
def email_phone_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    phones = F.regexp_extract_all("text", F.lit(r"[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"[a-z0-9.]+@[a-z0-9.]+[a-z]", 0).alias("email"), F.size(phones).cast("long").alias("n_phones"))


@query("""SELECT s_suppkey, CASE WHEN a.s_acctbal < 0 THEN 'blocked' END AS role FROM supplier a WHERE a.s_acctbal < 0""")
def changed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft rows that differ from the saved ones, with only the changed fields."""
    saved = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("user").alias("role"))
    draft = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, "blocked").otherwise("user").alias("role"))
    return lookup.changed_rows(draft, saved, "s_suppkey", ["role"])


# Whole plans over data that Spark derives from the tables -------------------------------------------


#: Customer keys that one register text covers; those of one nation among them are its cards.
BLOCK = 5000


def register_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, source_part, text): a register text for each nation and block of customer keys, with a card for each customer."""
    card = F.concat(
        F.lit("Объект "), F.col("c_custkey").cast("string"), F.lit(" Цех "), F.lower("c_mktsegment"), F.lit("\n220030, ул. Мира, "), (F.col("c_custkey") % 90 + 1).cast("string"),
        F.lit(", г. Минск\nСобственник ООО "), F.col("c_mktsegment"), F.lit("\nтел. (017) 2"), F.regexp_replace(F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"), "(..)(..)(..)", "$1-$2-$3"),
    )
    customers = table(spark, sf_dir, "customer").select("c_nationkey", F.expr(f"c_custkey div {BLOCK}").alias("block"), "c_custkey", card.alias("card"))
    cards = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "card"))), lambda x: x["card"])
    head = F.concat((F.lit(1000000) + F.col("c_nationkey")).cast("string"), F.lit(" Отходы "), F.col("c_nationkey").cast("string"), F.lit("\n"))
    return customers.groupBy("c_nationkey", "block").agg(F.array_join(cards, "\n").alias("cards")).select(
        (F.col("block") * 1000 + F.col("c_nationkey")).cast("long").alias("doc"), (F.col("c_nationkey") % 2 + 1).cast("int").alias("source_part"), F.concat(F.lit("шапка\n"), head, F.col("cards")).alias("text")
    )


@query("""SELECT cast(c_custkey AS int) AS id, cast(1000000 + c_nationkey AS varchar) AS waste_code, 'Отходы ' || c_nationkey AS waste_type_name, 'ООО ' || c_mktsegment AS owner,
    'Цех ' || lower(c_mktsegment) AS object_name, '220030, ул. Мира, ' || (c_custkey % 90 + 1) || ', г. Минск' AS address, '(017) 2' || regexp_replace(lpad(cast(c_custkey % 1000000 AS varchar), 6, '0'), '(..)(..)(..)', '\\1-\\2-\\3') AS phones,
    cast(c_nationkey % 2 + 1 AS int) AS source_part, true AS accepts_external_waste FROM customer""")
def register_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register texts written from the customers and read back: segments, cards and fields."""
    from .parse import parse

    got = parse(register_texts(spark, sf_dir))
    return got.select("id", "waste_code", "waste_type_name", "owner", "object_name", "address", "phones", "source_part", "accepts_external_waste")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the shape of the register."""
    at = with_coords(table(spark, sf_dir, "customer"), "c_custkey")
    some = F.col("c_custkey") % 4 != 0
    return at.select(
        F.col("c_custkey").alias("pk"), F.lit(1).alias("source_part"), F.col("c_custkey").cast("int").alias("record_id"), F.col("c_name").alias("owner"), F.col("c_mktsegment").alias("object_name"),
        (F.lit(1000000) + F.col("c_nationkey")).cast("string").alias("waste_code"), F.lit("w").alias("waste_type_name"), (F.col("c_custkey") % 7 != 0).alias("accepts_external_waste"),
        F.concat(F.lit("дом "), F.col("c_custkey").cast("string")).alias("address"), F.lit("").alias("phones"), F.when(some, F.col("lat")).alias("lat"), F.when(some, F.col("lon")).alias("lon"), F.lit(None).cast("string").alias("payload"),
    )


@query(f"""WITH f AS (SELECT c_custkey AS pk, {_km(_LAT.format(k='c_custkey'), _LON.format(k='c_custkey'))} AS km FROM customer
        WHERE c_custkey % 7 <> 0 AND c_custkey % 4 <> 0 AND contains(lower(c_mktsegment), 'build'))
    SELECT pk, cast(row_number() OVER (ORDER BY km, pk) AS int) AS rank, round(km, 1) AS distance_km, round(greatest(2.0::double, greatest(0.1::double, km) * 0.2::double), 1) AS spread_km, false AS approximate
    FROM f ORDER BY km, pk LIMIT 7""")
def search_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: text scan, repair, dedupe, distances, top seven."""
    from .search import Request, search

    got = search(facilities(spark, sf_dir), Request(query="build", lat=_HERE[0], lon=_HERE[1]))
    return got.select("pk", "rank", "distance_km", "spread_km", "approximate")


@query("""SELECT c_custkey AS pk, cast(row_number() OVER (ORDER BY c_custkey) AS int) AS rank FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 7""")
def search_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import Request, search

    return search(facilities(spark, sf_dir), Request(waste_code="1000003")).select("pk", "rank")


@query("""SELECT c_custkey, '+375 (17) ' || substring(p, 1, 3) || '-' || substring(p, 4, 2) || '-' || substring(p, 6, 2) AS shown
    FROM (SELECT c_custkey, cast(2000000 + c_custkey % 1000000 AS varchar) AS p FROM customer)""")
def display_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.display import phones

    raw = F.concat(F.lit("(017) "), (F.lit(2000000) + F.col("c_custkey") % 1000000).cast("string"), F.lit("; (017) "), (F.lit(2000000) + F.col("c_custkey") % 1000000).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", phones(raw).alias("shown"))


@query("""SELECT c.c_custkey AS pk, cast(n.n_nationkey AS double) AS lat FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def marked_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places after town marks in addresses, looked up in a gazetteer of the nations' names."""
    from .gazetteer import strict_coords

    nations = table(spark, sf_dir, "nation")
    places = nations.select(F.lower(F.translate("n_name", "_", " ")).alias("place"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    address = F.concat(F.lit("220030, г. "), F.translate("n_name", "_", " "), F.lit(" район, ул. Мира"))
    texts = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("pk"), F.lit(0).alias("r"), address.alias("t"))
    return strict_coords(texts, places).select("pk", "lat")


@query(_SQL["throttle_events"])
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The throttle as a stream with state, run over the events to its end."""
    from ..streaming.imports import drained
    from ..streaming.throttle import throttle_query

    at = _scratch(spark, "throttle")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*").withColumn("ts", F.col("ts").cast("timestamp"))
    drained(lambda: throttle_query(stream, f"{at}/out", f"{at}/marks"))
    kind = schema["user_id"].dataType.simpleString()
    return spark.read.schema(f"user_id {kind}, event_id long, t long").parquet(f"{at}/out").select("user_id", "event_id")


@query("""SELECT cast(c_custkey AS int) AS record_id, cast(1000000 + c_nationkey AS varchar) AS waste_code, 'Цех ' || lower(c_mktsegment) AS object_name, cast(c_nationkey % 2 + 1 AS int) AS source_part FROM customer""")
def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register texts that arrive as files, imported by a stream into a catalogue of their own; its records at the end."""
    from ..streaming.imports import drained, import_stream
    from .catalog import Catalog

    at = _scratch(spark, "import")
    name = F.concat(F.lit("part "), F.col("doc").cast("string"))
    register_texts(spark, sf_dir).select("doc", name.alias("name"), F.sha2("text", 256).alias("sha256"), "source_part", "text").write.parquet(f"{at}/texts")
    catalog = Catalog(spark, f"{at}/catalogue")
    drained(lambda: import_stream(spark, catalog, f"{at}/texts", f"{at}/marks"))
    return catalog.registry().select("record_id", "waste_code", "object_name", "source_part")


def _k(before: str, after: str = "") -> Column:
    """A text told apart by the number k."""
    return F.concat(F.lit(before), F.col("k").cast("string"), F.lit(after))


#: What a text of each layout holds, in SQL, for the number k.
_LAYOUT_VALUES = {
    "repeated town": "'220020, г. Минск, ул. Мира, ' || k",
    "repeated parts": "'220020, г. Минск, ул. Мира ' || k",
    "town at the end": "'г. Гомель, ул. Мира ' || k",
    "town elsewhere": "'220020, г. Брест, ул. Мира, ' || k",
    "postal lines": "'220030 Минск, ул. Мира ' || k",
    "address after the name": "'220030, ул. Мира, 5 г. Минск'",
    "name before the address": "'Цех ' || k || ' вторая очередь'",
    "name with an address": "'Цех переработки ' || k",
    "name with a service phrase": "'Линия №' || k",
    "name with the waste": "'Установка ' || k",
    "owner among lines": "'ООО \"Лидер ' || k || '\"'",
    "owner's blob": "'ООО Луч ' || k",
    "owner in a part": "'завод \"Луч ' || k",
    "owner among fields": "'ООО \"Дом ' || k",
    "owner without a label": "'ООО \"Луч ' || k || '\"' || chr(10) || 'филиал'",
    "object among lines": "'Мобильная дробильная установка ' || k",
    "tail of a page": "'ул. Мира ' || k",
    "street in a text": "'ул. Мира, ' || k || ', корп. 2, кв. 3'",
    "town that is a number": "'222310, ул. Новая, ' || k",
    "town cut off": "'222310, д.5, ул. Мира, ' || k || ', г. Брест'",
    "phone before a date": "'(029) 5' || lpad(cast(k AS varchar), 6, '0')",
    "ticked box": "CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END",
    "code line": "'1' || lpad(cast(k AS varchar), 6, '0')",
    "code with spaces": "'Бой ' || lpad(cast(k AS varchar), 6, '0')",
}


def _layouts() -> dict[str, Column]:
    """What is read from a text of each layout."""
    from ..functions import extract as X
    from .parse import guessed_owner

    none, six = F.lit(""), F.lpad(F.col("k").cast("string"), 6, "0")
    return {
        "repeated town": X.clean_address(_k("220020, г. Минск, ул. Мира, ", ", г. Минск, г. (не указано), (017) 2345678")),
        "repeated parts": X.collapse_commas(_k("220020, г. Минск, Г. МИНСК,, ул. Мира ")),
        "town at the end": X.dedupe_locality(_k("г. Гомель, ул. Мира ", ", г. Гомель")),
        "town elsewhere": X.with_locality(_k("220020, ул. Мира, "), F.lit("завод в г. Брест, ул. Лесная")),
        "postal lines": X.postal_lines(_k("слова\n220030 Минск\nул. Мира ", "\nещё"), none),
        "address after the name": X.name_and_address(_k("Цех ", " 220030, ул. Мира, 5\nг. Минск\nвторая очередь\nСобственник кто-то\nпотом"))["address"],
        "name before the address": X.name_and_address(_k("Цех ", " 220030, ул. Мира, 5\nг. Минск\nвторая очередь\nСобственник кто-то\nпотом"))["name"],
        "name with an address": X.clean_object_name(_k("Цех переработки ", " 220030, ул. Мира"), none),
        "name with a service phrase": X.clean_object_name(_k("принимает отходы от других Линия №"), none),
        "name with the waste": X.clean_object_name(_k("Бой бетона Установка "), F.lit("Бой бетона")),
        "owner among lines": X.canonical_owner(_k('Управление\nООО "Лидер ', '"\nг. Минск\nтел. 22')),
        "owner's blob": X.clean_owner(_k("ООО\u00a0 Луч\n", "\nтел. 22")),
        "owner in a part": X.owner_hint(_k('просто слова, завод "Луч ', '"; г. Минск')),
        "owner among fields": X.owner_name(F.lit("Управление"), _k('цех, ООО "Дом ', '"'), F.lit("")),
        "owner without a label": guessed_owner(F.array(F.lit("слова"), _k('ООО "Луч ', '"'), F.lit("филиал"), F.lit("Объект"), F.lit("линия"))),
        "object among lines": X.canonical_object(_k("Площадка по хранению\nМобильная дробильная установка ", "\nв соответствии с нормами"), none),
        "tail of a page": X.trim_tail(_k("ул. Мира ", " 3 мая 2024 г. Страница 1 из 9 Луг")),
        "street in a text": X.address_hint(_k("цех, ул. Мира, ", ", корп. 2, кв. 3, этаж 4")),
        "town that is a number": X.repair_address(F.lit("222310, г.8"), _k("ООО ул. Новая, "), none),
        "town cut off": X.repair_truncated_town(_k("222310, д.5, ул. Мира, ", ", г."), F.lit("г. Брест")),
        "phone before a date": X.phones(F.concat(F.lit("(029) 5"), six, F.lit(" 2 апреля")), F.lit(None).cast("string")),
        "ticked box": F.when(X.accepts_external(F.when(F.col("k") % 2 == 0, _k("", " ☐ ☑")).otherwise(_k("", " ☑ ☐"))), "yes").otherwise("no"),
        "code line": X.code_line(F.concat(F.lit("| 1"), six, F.lit("Отходы")))["code"],
        "code with spaces": X.code_line(F.concat(F.lit("1 2 3 4 5 6 7 Бой "), six))["rest"],
    }


@query(" UNION ALL ".join(f"SELECT k, '{name.replace(chr(39), chr(39) * 2)}' AS layout, {want} AS value FROM (SELECT c_custkey AS k FROM customer)" for name, want in _LAYOUT_VALUES.items()))
def register_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single fields in the register's awkward layouts, a text of each layout for each customer; k is its key."""
    each = F.array(*[F.struct(F.lit(name).alias("layout"), value.alias("value")) for name, value in _layouts().items()])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select("k", F.inline(each))


#: What is shown of a text of each kind, in SQL, for the number k.
_SHOWN_VALUES = {
    "waste with a remark": "'Бой бетона ' || k",
    "waste with an address": "'Лом ' || k",
    "object with its waste": "'Мобильная установка ' || k",
    "object in parts": "'Цех ' || k || ', линия'",
    "object without a name": "'{unknown}'",
    "object with its owner": "'Линия ' || k",
    "address with a repeat": "'г. Минск, ул. Мира, ' || k",
    "address with an owner": "'г. Брест, ул. Лесная, ' || k",
    "owner with a page's foot": "'ООО \"Луч ' || k || '\"'",
    "owner of a branch": "'филиал ООО \"Лучистый дом ' || k || '\"'",
    "owner by a general word": "'ООО \"Дом ' || k || '\"'",
    "owner from other fields": "'завод \"Луч ' || k || '\"'",
    "owner with services": "'ОАО \"Камень ' || k || '\"'",
    "phone without marks": "'+375 (29) ' || substring(d, 1, 3) || '-' || substring(d, 4, 2) || '-' || substring(d, 6, 2)",
    "phone in two forms": "'+375 (29) ' || substring(d, 1, 3) || '-' || substring(d, 4, 2) || '-' || substring(d, 6, 2)",
    "phones glued": "'+375 (152) 22-' || substring(d, 4, 2) || '-' || substring(d, 6, 2) || chr(10) || '+375 (152) 33-' || substring(d, 4, 2) || '-' || substring(d, 6, 2)",
    "time left": "(k // 60) || 'м ' || lpad(cast(k % 60 AS varchar), 2, '0') || 'с'",
}


def _shown() -> dict[str, Column]:
    from ..functions import display as D

    digits = F.concat(F.lit("1"), F.lpad(F.col("k").cast("string"), 6, "0"))
    last = F.substring(digits, 4, 4)
    none = F.lit("")
    return {
        "waste with a remark": D.waste_type(_k("Бой бетона ", " (куски)")),
        "waste with an address": D.waste_type(_k("Лом ", " 220030, ул. Мира")),
        "object with its waste": D.object_name(_k("Бой бетона Мобильная установка "), F.lit("Бой бетона")),
        "object in parts": D.object_name(_k("Цех ", ", линия, ООО Луч"), none),
        "object without a name": D.object_name(F.lit("объект"), none),
        "object with its owner": D.object_name(_k("Линия ", " Собственник ООО"), none),
        "address with a repeat": D.address(_k("220030, г. Минск, ул. Мира, ", ", г. Минск")),
        "address with an owner": D.address(_k("г. Брест, ул. Лесная, ", " Собственник ООО")),
        "owner with a page's foot": D.owner(_k('ООО "Луч ', '" 1 мая 2024 г. Страница 3 из 9')),
        "owner of a branch": D.owner(_k('Филиол ООО "Лучистый дом ', '", г. Минск')),
        "owner by a general word": D.owner(F.lit("управление"), _k('цех ООО "Дом ', '"'), none),
        "owner from other fields": D.owner(none, _k('завод "Луч ', '", ул. Мира'), F.lit("г. Брест")),
        "owner with services": D.owner(_k('ОАО "Камень ', '" использует собственные отходы')),
        "phone without marks": D.phones(F.concat(F.lit("8029"), digits)),
        "phone in two forms": D.phones(F.concat(F.lit("(029) "), digits, F.lit("; +375 29 "), digits)),
        "phones glued": D.phones(F.concat(F.lit("(0152) 22"), last, F.lit("33"), last)),
        "time left": D.eta(F.col("k").cast("double")),
    }


@query(" UNION ALL ".join(
    f"SELECT k, '{name.replace(chr(39), chr(39) * 2)}' AS layout, {want} AS value FROM (SELECT c_custkey AS k, '1' || lpad(cast(c_custkey AS varchar), 6, '0') AS d FROM customer)"
    for name, want in _SHOWN_VALUES.items()
).replace("{unknown}", UNKNOWN))
def display_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the pages show them, one of each kind for each customer; k is its key."""
    each = F.array(*[F.struct(F.lit(name).alias("layout"), value.alias("value")) for name, value in _shown().items()])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select("k", F.inline(each))


@query(r"""SELECT c_custkey AS pk, CASE c_custkey % 3 WHEN 0 THEN 52.45::double WHEN 2 THEN 55.15::double ELSE n_nationkey::double END AS lat
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 1 OR regexp_full_match(n_name, '\w{4,}')""")
def loose_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region phrases in texts, longest first, else the longest word that is a place."""
    from .gazetteer import loose_coords, regions

    nations = table(spark, sf_dir, "nation")
    places = nations.select(F.lower("n_name").alias("place"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    kind, named = F.col("c_custkey") % 3, F.concat(F.lit("завод, "), F.col("n_name"))
    said = F.when(kind == 0, F.concat(F.lit("Брестская область, "), named)).when(kind == 2, F.lit("район, Витебская обл., 5")).otherwise(named)
    texts = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("pk"), said.alias("t"))
    return loose_coords(texts, places, regions(spark)).select("pk", "lat")


@query("""WITH named AS (SELECT unnest([lower(c_mktsegment), 'town ' || (c_custkey % 500)]) AS place, c_custkey % 97 AS population, c_custkey AS ord FROM customer WHERE c_custkey % 4 <> 0)
    SELECT place, cast(arg_min(ord, (-population, ord)) AS double) AS lat FROM named GROUP BY place""")
def gazetteer_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer from a place-name dump: each name's most populous place, the first of equals."""
    from .gazetteer import built

    key = F.col("c_custkey")
    dump = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("name"), F.upper("c_mktsegment").alias("ascii_name"), F.concat(F.lit("Town, "), (key % 500).cast("string")).alias("none"), F.concat(F.lit("Town! "), (key % 500).cast("string"), F.lit(",x")).alias("other_names"),
        key.cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.when(key % 4 == 0, "L").otherwise("P").alias("feature_class"), (key % 97).alias("population"), key.alias("ord"),
    )
    return built(dump.drop("none")).select("place", "lat")


@query("""SELECT c_custkey, c_custkey % 4 NOT IN (1, 2) AS flag, cast(CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 1 THEN 2 WHEN c_custkey % 7 = 1 THEN 1 ELSE 2 END AS int) AS part FROM customer""")
def tolerant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags in words of two languages, and the part that a file's name or place tells."""
    key = F.col("c_custkey")
    word = F.when(key % 4 == 0, " Да ").when(key % 4 == 1, "НЕТ").when(key % 4 == 2, "false")
    name = F.when(key % 3 == 0, "реестр Часть II.pdf").when(key % 5 == 1, "part-2.pdf").otherwise("register.pdf")
    return table(spark, sf_dir, "customer").select("c_custkey", text.tolerant_bool(word).alias("flag"), text.part_from_name(name, key % 7).alias("part"))


@query(f"""SELECT c_custkey, {_CUSTOMER_KM} AS distance_km FROM customer ORDER BY distance_km, c_custkey LIMIT 7""")
def nearest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of a table that lies in cells; only the cells within the bound are read."""
    from ..operators import cells

    at = _scratch(spark, "cells")
    cells.write_cells(with_coords(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), at)
    near = cells.nearest(spark.read.parquet(at), _HERE, 7, [F.col("c_custkey")])
    return near.select("c_custkey", F.round("air_km", 4).alias("distance_km"))


@query("""WITH phrases AS (SELECT n_nationkey AS k, array_to_string(list_transform(range(1, 2 + n_nationkey % 6), lambda j: 'w' || (n_nationkey * j) % 7), ' ') AS phrase FROM nation),
    texts AS (SELECT c_custkey, array_to_string(list_transform(range(1, 13), lambda j: 'w' || (c_custkey * j) % 7), ' ') AS t FROM customer)
    SELECT c_custkey, phrase FROM texts, phrases WHERE contains(' ' || t || ' ', ' ' || phrase || ' ')
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(phrase) DESC, phrase) = 1""")
def long_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest phrase, of one to six words, that a text holds as whole words."""
    said = lambda key, upto: F.array_join(F.transform(F.sequence(F.lit(1), upto), lambda j: F.concat(F.lit("w"), (F.col(key) * j % 7).cast("string"))), " ")
    phrases = table(spark, sf_dir, "nation").select(said("n_nationkey", F.col("n_nationkey") % 6 + 1).alias("phrase")).distinct()
    texts = table(spark, sf_dir, "customer").select("c_custkey", said("c_custkey", F.lit(12)).alias("t"))
    return lookup.longest_phrase(texts, "c_custkey", F.upper("t"), phrases)


@query("""SELECT o_orderkey, cast(greatest(50, floor((o_custkey % 2000 + 1)::double * 0.7::double + greatest(50, least(100000, floor(o_orderkey::double / greatest(o_totalprice / 1000, 0.001::double) * 60.0::double)))::double * 0.3::double)) AS bigint) AS step FROM orders""")
def checkpoint_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows between an import's commits: the old step and the one that the rate suggests, smoothed."""
    from ..streaming.progress import next_step_of

    step = next_step_of(F.col("o_custkey") % 2000 + 1, F.col("o_orderkey"), F.col("o_totalprice") / 1000, 60.0, F.lit(50).cast("long"), F.lit(100_000).cast("long"))
    return table(spark, sf_dir, "orders").select("o_orderkey", step.alias("step"))


@query("""SELECT o_orderkey, CASE WHEN done > 0 THEN round(done / secs, 2) ELSE 0.0::double END AS rows_per_second, CASE WHEN done > 0 THEN cast(floor(greatest(0, 10000 - done) / (done / secs)) AS bigint) ELSE -1 END AS eta_seconds
    FROM (SELECT o_orderkey, (o_orderkey % 12000)::double AS done, greatest(o_totalprice / 1000, 0.001::double) AS secs FROM orders)""")
def import_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import's rate so far and the seconds that it still needs; -1 before its first row."""
    from ..streaming.progress import eta_of, rate_of

    done, seconds = F.col("o_orderkey") % 12_000, F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", rate_of(done, seconds).alias("rows_per_second"), F.coalesce(eta_of(done, F.lit(10_000), seconds), F.lit(-1)).alias("eta_seconds"))


@query("""WITH c AS (SELECT c_nationkey AS doc, c_custkey % 5 AS kind, c_custkey % 4 AS size FROM customer)
    SELECT doc, count(*) AS calls, count(*) FILTER (kind >= 2) AS success, count(*) FILTER (kind < 2) AS fail, cast(coalesce(sum(size) FILTER (kind >= 2), 0) AS bigint) AS accepted, count(*) FILTER (kind = 4) AS rejected
    FROM c GROUP BY doc""")
def second_reading_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and rows of second readings by outcome: absent and broken payloads, sound records and one bad one in some."""
    from .fallback import counters, tagged

    key = F.col("c_custkey")
    good, bad = '{"waste_code": "123 4567", "object_id": "5"}', '{"waste_code": "1234567", "object_id": "0"}'
    held = F.concat(F.array_repeat(F.lit(good), (key % 4).cast("int")), F.when(key % 5 == 4, F.array(F.lit(bad))).otherwise(F.array().cast("array<string>")))
    payload = F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, "[1]").otherwise(F.concat(F.lit('{"records": ['), F.array_join(held, ", "), F.lit("]}")))
    calls = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.lit(1).alias("source_part"), key.alias("chunk"), payload.alias("payload"))
    return tagged(calls.drop("payload"), calls.where(key % 10 != 0)).groupBy("doc").agg(*counters())


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder for one run in the shared folder of spark.checkpoint.dir; an own one only in local mode."""
    import tempfile
    import uuid

    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
