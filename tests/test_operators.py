"""Operators on small literal tables."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geosift.functions import display, geo, text
from geosift.operators import cells, lookup, merge, rows
from geosift.plans import gazetteer, geocode, search
from geosift.plans.search import Request
from geosift.schemas import REGISTRY, STORAGE_KEY


def record(pk, **over):
    base = dict(pk=pk, source_part=1, record_id=pk, owner="ООО Луч", object_name=f"Цех {pk}", waste_code="1234567", waste_type_name="Бой", accepts_external_waste=True, address="", phones="", lat=None, lon=None, payload=None)
    return tuple((base | over).values())


def registry(spark, *records):
    return spark.createDataFrame(list(records), REGISTRY)


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def test_text_functions(spark):
    df = spark.createDataFrame([(" А Б\tв ", "нет", "x"), (None, None, None), ("а", "YES", "7")], "a string, b string, c string")
    assert values(df.select(text.norm_text(F.col("a")).alias("x")), "x") == ["а б в", "", "а"]
    assert values(df.select(text.tolerant_bool(F.col("b")).alias("x")), "x") == [False, True, True]
    assert values(df.select(text.safe_int(F.col("c")).alias("x")), "x") == [None, None, 7]
    assert values(df.select(F.length(text.address_key(F.repeat("a", 400))).alias("x")), "x")[1] == 0
    assert text.record_id_hint(" 007 ") == 7 and text.record_id_hint("1234567") is None and text.record_id_hint("x1") is None


def test_part_names(spark):
    df = spark.createDataFrame([("reestr_II.pdf", 1), ("Часть 2.pdf", 1), ("a.pdf", 1), ("b.pdf", 2)], "n string, p int")
    assert values(df.select(text.part_from_name(F.col("n"), F.col("p")).alias("x")), "x") == [2, 2, 1, 2]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.floats(-89, 89), st.floats(-179, 179)), min_size=2, max_size=2))
def test_haversine_is_symmetric(spark, points):
    (a, b), (c, d) = points
    df = spark.range(1).select(
        geo.haversine_km(*map(F.lit, (a, b, c, d))).alias("x"), geo.haversine_km(*map(F.lit, (c, d, a, b))).alias("y"), geo.haversine_km(*map(F.lit, (a, b, a, b))).alias("z")
    ).first()
    assert df.x == pytest.approx(df.y, abs=1e-6) and df.z == 0 and 0 <= df.x <= 20016


def test_spread_and_sql_function(spark):
    geo.register_sql(spark)
    assert spark.sql("select round(haversine_km(53.9, 27.56, 52.1, 23.7), 0) km").first().km == pytest.approx(328, abs=3)
    df = spark.createDataFrame([(0.0, False, False), (100.0, True, False), (100.0, False, True), (100.0, False, False)], "d double, a boolean, r boolean")
    assert values(df.select(geo.spread_km(F.col("d"), F.col("a"), F.col("r")).alias("x")), "x") == [2.0, 35.0, 12.0, 20.0]


def test_candidates_for_the_costly_metric(spark):
    df = spark.createDataFrame([(0,), (10,), (100,), (200,), (700,)], "n long")
    assert values(df.select(geo.adaptive_candidates(F.col("n"), 7).alias("x")), "x") == [0, 10, 25, 25, 18]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 100)), max_size=25))
def test_keep_first_is_first(spark, items):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(items)], "o long, k long, v long")
    got = values(rows.keep_first(df, [F.col("k")], [F.col("o")]), "k", "v")
    want = {}
    for k, v in items:
        want.setdefault(k, v)
    assert dict(got) == want and len(got) == len(want)


def test_dedupe_keys_differ_in_phones(spark):
    r = registry(spark, record(1, phones="1"), record(2, record_id=1, object_name="цех  1", phones="2"), record(3, record_id=1, object_name="Цех 1", phones="1"))
    assert sorted(values(rows.dedupe_records(r, STORAGE_KEY), "pk")) == [1]
    assert sorted(values(rows.dedupe_records(r, [*STORAGE_KEY, "phones"]), "pk")) == [1, 2]


def test_throttle_boundary(spark):
    t = datetime(2024, 1, 1)
    at = [0, 299, 300, 301, 599, 600, 900]
    df = spark.createDataFrame([(1, i, t + timedelta(seconds=s)) for i, s in enumerate(at)], "u long, id long, ts timestamp")
    assert sorted(values(rows.throttled(df, "u", "ts", "id", 300), "id")) == [0, 2, 5, 6]


def test_mode_ties_and_fill(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "X"), ("b", None), ("a", None), (None, "z")], "g string, v string")
    assert values(lookup.mode_per_group(df, "g", "v"), "g", "v") == [("a", "X")]
    assert sorted(map(str, values(lookup.filled_from_mode(df, "g", "v"), "v"))) == ["None", "X", "X", "y", "z"]


def test_last_before_with_tolerance(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["c", None, None, "d", None])], "g long, pos long, v string")
    got = df.withColumn("x", lookup.last_before(df, ["g"], "pos", F.col("v"), within=1)).orderBy("pos")
    assert values(got, "x") == [None, "c", None, None, "d"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=15), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 25)), max_size=8), st.integers(1, 20))
def test_range_join_is_the_nested_loop(spark, points, ranges, width):
    p = spark.createDataFrame([(1, x) for x in points], "k long, at long")
    r = spark.createDataFrame([(1, a, a + n) for a, n in ranges], "k long, low long, high long")
    got = sorted(values(lookup.range_join(p, r, "at", "low", "high", width, ["k"]), "at", "low", "high"))
    assert got == sorted((x, a, a + n) for x in points for a, n in ranges if a <= x <= a + n)


def test_upsert_last_writer_wins_and_bad_numbers_are_left_out(spark):
    old = spark.createDataFrame([("a", 1.0, 1.0, 0), ("b", 2.0, 2.0, 0)], "address_key string, lat double, lon double, o int")
    new = spark.createDataFrame([("a", "5", "5", 1), ("a", "6", "6", 2), ("c", "x", "1", 3), ("d", "7", "7", 4)], "address_key string, lat string, lon string, o int")
    assert sorted(values(merge.upsert_geocodes(old, new, "o"), "address_key", "lat")) == [("a", 6.0), ("b", 2.0), ("d", 7.0)]


def test_replaced_part_keeps_others_and_carries_coordinates(spark):
    stored = registry(spark, record(1, source_part=1), record(2, source_part=2, record_id=5, object_name="О", lat=50.0), record(3, source_part=2, record_id=6), record(4, source_part=2, record_id=5, object_name="о", lat=51.0, lon=20.0))
    new = registry(spark, record(10, source_part=2, record_id=5, object_name=" О "), record(11, source_part=2, record_id=5, object_name="о"), record(12, source_part=2, record_id=9))
    got = sorted(values(merge.replaced_part(stored, new, 2), "pk", "lat", "lon"))
    assert got == [(1, None, None), (10, 51.0, 20.0), (12, None, None)]


def test_same_set(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "d string") for xs in ("abb", "bab"))
    assert merge.same_set(a, b).first().equal and not merge.same_set(a, b.distinct()).first().equal


def test_geocode_cascade(spark):
    rows_ = [(1, "Минск далеко", False), (2, "минск  далеко", False), (3, "", False), (4, "слово другое", True), (5, "220030, ул. Мира", False), (6, "220030, ул. мира", False), (7, "коротко", False), (8, "коротко", False), (9, "220031, ул. Б", False), (10, "в кэше было", False)]
    df = spark.createDataFrame(rows_, "pk long, address string, preset boolean")
    cached = spark.createDataFrame([("в кэше было", 1.0, 1.0)], "address_key string, lat double, lon double")
    got = geocode.outcomes(df, approximate=F.lower("address").contains("минск"), worth=geocode.worth_geocoding(F.col("address")), budget=1, cached=cached)
    assert dict(values(got, "pk", "outcome")) == {1: "approx_hit", 2: "cache_hit", 3: "empty", 4: "preset", 5: "external", 6: "external_memo", 7: "addr_skipped", 8: "cached_miss_skip", 9: "budget_skip", 10: "cache_hit"}


@pytest.mark.parametrize("address,want", [("220030, ул. Мира, 5, г. Минск", True), ("—", False), ("не указано", False), ("ул.", False), ("просто слова тут", False), (None, False)])
def test_worth_geocoding(spark, address, want):
    df = spark.createDataFrame([(address,)], "a string")
    assert df.select(geocode.worth_geocoding(F.col("a")).alias("x")).first().x is want


PLACES = [("минск", 53.9, 27.56), ("брест", 52.1, 23.7), ("новый двор", 53.1, 26.0), ("сквер", 10.0, 10.0)]


def test_strict_and_loose_places(spark):
    g = spark.createDataFrame(PLACES, "place string, lat double, lon double")
    t = spark.createDataFrame([(1, 0, "220030, г. Минск получения, ул. Сквер"), (2, 0, "д. Новый Двор, 4"), (3, 0, "ул. Мира"), (4, 0, "г. Нигде, аг. «Брест»")], "pk long, r int, t string")
    assert dict(values(gazetteer.strict_coords(t, g), "pk", "lat")) == {1: 53.9, 2: 53.1, 4: 52.1}
    loose = spark.createDataFrame([(1, "завод, Брестская обл., у сквера"), (2, "сквер, минск"), (3, "нет")], "pk long, t string")
    assert dict(values(gazetteer.loose_coords(loose, g, gazetteer.regions(spark)), "pk", "lat")) == {1: 52.45, 2: 10.0 if "минск" > "сквер" else 53.9}


def test_gazetteer_build_and_overlay(spark):
    dump = spark.createDataFrame([("Минск", "Minsk", "Менск,Minsk", 1.0, 1.0, "P", 100, 0), ("Минск", None, None, 2.0, 2.0, "P", 100, 1), ("Брест", "Brest", None, 3.0, 3.0, "L", 5, 2)], "name string, ascii_name string, other_names string, lat double, lon double, feature_class string, population long, ord long")
    built = gazetteer.built(dump)
    assert dict(values(built, "place", "lat")) == {"минск": 1.0, "minsk": 1.0, "менск": 1.0}
    own = spark.createDataFrame([("МИНСК", "9", "9"), ("x", "bad", "1")], "place string, lat string, lon string")
    assert dict(values(gazetteer.merged(built, own), "place", "lat")) == {"минск": 9.0, "minsk": 1.0, "менск": 1.0}


def test_search_by_text_id_and_code(spark):
    r = registry(spark, record(1, owner="ООО Сосна"), record(2, record_id=1, owner="ООО  сосна", object_name="цех 1"), record(3, owner="ОАО Дуб", waste_code="7654321"), record(4, accepts_external_waste=False, owner="УП Сосна"))
    ids = lambda **q: values(search.search(r, Request(**q)), "pk")
    assert ids(query="сосна") == [1, 4] and ids(query="сосна", limit=1) == [1]
    assert ids(waste_code="7654321") == [3] and ids(query="3") == [3] and ids(query="003") == []
    assert ids() == [1, 3, 4] and ids(query="нет такого") == []


def test_search_nearest_first_with_backfill(spark):
    r = registry(spark, record(1, lat=52.1, lon=23.7), record(2, lat=53.9, lon=27.5), record(3), record(4, address="г. брест, ул. мира"), record(5, lat=53.9, lon=27.56, accepts_external_waste=False))
    cache = spark.createDataFrame([("г. брест, ул. мира", 52.2, 23.8)], "address_key string, lat double, lon double")
    got = search.search(r, Request(lat=53.9, lon=27.56), geocodes=cache).orderBy("rank")
    assert values(got, "pk") == [2, 4, 1, 3] and got.where("pk = 3").first().distance_km is None
    g = spark.createDataFrame(PLACES, "place string, lat double, lon double")
    wrong = registry(spark, record(1, address="г. Минск, ул. Новая", lat=10.0, lon=10.0))
    hit = search.search(wrong, Request(lat=53.9, lon=27.56), gazetteer=g, regions=gazetteer.regions(spark)).first()
    assert hit.approximate and hit.lat == pytest.approx(53.9, abs=0.2) and hit.air_km < 5


def test_search_ranks_every_text_match(spark):
    far = registry(spark, record(1, owner="ООО Сосна", lat=50.0, lon=20.0)).drop("pk", "record_id").crossJoin(spark.range(1, 5003).select(F.col("id").alias("pk"), F.col("id").cast("int").alias("record_id")))
    r = far.withColumn("lat", F.when(F.col("pk") > 5000, F.lit(53.9)).otherwise(F.col("lat"))).select(*[c.split()[0] for c in REGISTRY.split(", ")])
    assert values(search.search(r, Request(query="сосна", lat=53.9, lon=20.0, limit=2)).orderBy("rank"), "pk") == [5001, 5002]


def test_search_with_a_road_provider_asks_for_few(spark):
    r = registry(spark, *[record(i, lat=53.0 + i / 1000, lon=27.0) for i in range(1, 701)])
    asked = []

    def road(df):
        asked.append(df.count())
        return df.withColumn("road_km", F.when(F.col("pk") % 2 == 0, F.col("air_km") * 3))

    got = search.search(r, Request(lat=53.0, lon=27.0), road=road).orderBy("rank")
    assert asked == [18] and got.count() == 7
    used = [h.road_km if h.road_km is not None else h.air_km for h in got.collect()]
    assert used == sorted(used)


def test_display(spark):
    df = spark.createDataFrame([(0.5, "код 12345678901 x"), (None, None)], "km double, c string")
    assert values(df.select(display.distance_text(F.col("km")).alias("x")), "x") == ["~1 км", "—"]
    assert values(df.select(display.object_code(F.col("c")).alias("x")), "x") == ["1234567890", "—"]
    times = spark.createDataFrame([("2024-03-01T10:05:00Z",), ("x",), (None,)], "t string")
    assert values(times.select(display.user_time(F.col("t"), "UTC").alias("x")), "x") == ["01.03.2024 10:05", "—", "—"]


def test_backfill_of_a_shuffled_pool(spark):
    pool = [(i, float(i % 7) if i % 3 else None) for i in range(30)]
    random.Random(1).shuffle(pool)
    df = spark.createDataFrame(pool, "pk long, d double")
    from pyspark.sql import Window

    ranked = df.where("d is not null and d < 1").orderBy("d", "pk").limit(3).withColumn("rank", F.row_number().over(Window.orderBy("d", "pk")))
    got = rows.backfilled_top_k(ranked, df, ["pk"], "pk", 6).orderBy("rank")
    assert values(got, "pk") == [7, 14, 28, 0, 1, 2]


def test_phrases_of_any_length(spark):
    rows = [(1, "Один два три четыре пять шесть"), (2, "два два три"), (3, "нет"), (4, None), (5, ""), (6, "раз два, ТРИ четыре")]
    phrases = [("два",), ("два три",), ("два три четыре пять шесть",), ("два три четыре",), ("шесть семь",), ("",), ("один дв",)]
    texts, table = spark.createDataFrame(rows, "pk long, t string"), spark.createDataFrame(phrases, "phrase string")
    got = {r.pk: r.phrase for r in lookup.longest_phrase(texts, "pk", F.col("t"), table).collect()}
    assert got == {1: "два три четыре пять шесть", 2: "два три", 6: "два три четыре"}
    every = {(r.pk, r.phrase) for r in lookup.phrases_found(texts, "pk", F.col("t"), table).collect()}
    assert {p for pk, p in every if pk == 6} == {"два", "два три", "два три четыре"}
    assert lookup.longest_phrase(texts, "pk", F.col("t"), table.limit(0)).count() == 0


@pytest.mark.parametrize("at", [(53.9, 27.5), (-89.5, 0.0), (0.0, 179.9), (10.0, -180.0)])
def test_nearest_through_cells(spark, tmp_path, at):
    import random

    rng = random.Random(int(at[1]))
    rows = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(600)] + [(600 + i, at[0] / 2, at[1]) for i in range(9)] + [(700, None, 1.0), (701, 1.0, None)]
    cells.write_cells(spark.createDataFrame(rows, "pk long, lat double, lon double"), str(tmp_path / "c"), 20.0)
    for k in (1, 7, 700):
        got = [r.pk for r in cells.nearest(spark.read.parquet(str(tmp_path / "c")), at, k, [F.col("pk")], 20.0).collect()]
        far = sorted((cells._km(at, (lat, lon)), i) for i, lat, lon in rows if lat is not None and lon is not None)
        assert [cells._km(at, rows_by(rows)[i]) for i in got] == pytest.approx([d for d, _ in far[:k]], abs=1e-6)


def rows_by(rows):
    return {i: (lat, lon) for i, lat, lon in rows}


def test_only_cells_within_the_bound_are_read(spark, tmp_path):
    rows = [(i, 40.0 + i % 20, 20.0 + i // 20 % 20) for i in range(4000)]
    cells.write_cells(spark.createDataFrame(rows, "pk long, lat double, lon double"), str(tmp_path / "c"))
    celled = spark.read.parquet(str(tmp_path / "c"))
    near = cells.nearest(celled, (50.2, 30.3), 5, [F.col("pk")])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    counts = {r.cell: r["count"] for r in celled.groupBy("cell").count().collect()}
    assert len(counts) == 400 and len(cells.near_cells(counts, (50.2, 30.3), 5)) <= 12
    assert cells.near_cells({}, (0.0, 0.0), 5) == [] and cells.nearest(celled.limit(0), (0.0, 0.0), 5, [F.col("pk")]).count() == 0
