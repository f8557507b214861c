"""Numbers of any length in the layouts' texts: a postcode is told by what stands around it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from geosift.functions import display as D
from geosift.functions import extract as X
from geosift.functions import patterns as P
from geosift.plans import catalogue

KEYS = [0, 7, 99_999, 100_000, 123_456, 220_030, 222_310, 375_123, 899_999, 1_234_567, 3_751_234, 10_000_000, 59_014_999, 375_601_631, 3_756_016_317]


@pytest.fixture(scope="module")
def one(spark):
    def run(f, *values):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x

    return run


@pytest.fixture(scope="module")
def differing(spark, tmp_path_factory):
    """Rows that only the query or only its SQL gives, for customers with the keys above."""
    at = str(tmp_path_factory.mktemp("layouts"))
    spark.createDataFrame([(k,) for k in KEYS], "c_custkey long").coalesce(1).write.parquet(f"{at}/customer.parquet")

    def run(name):
        got = {tuple(r) for r in catalogue.queries()[name](spark, at).collect()}
        with duckdb.connect() as db:
            db.sql(f"CREATE VIEW customer AS FROM '{at}/customer.parquet/*.parquet'")
            return got ^ set(db.sql(catalogue.oracle_sql()[name]).fetchall())

    return run


@pytest.mark.parametrize("text,want", [
    ("Цех 123456", ""), ("Цех 220030, линия", ""), ('ООО "Дом 220030", г. Минск', ""), ("Линия 220030 Собственник ООО", ""), ("Лом 123456 220030, ул. Мира", "220030"), ("12345678, г. Минск", ""),
    ("220030 Минск", "220030"), ("Цех, 123456", "123456"), ("слова\n 123456", "123456"), ("Цех 123456, Минская обл.", "123456"), ("Цех 123456 г. Минск", "123456"), ("Цех 220030 Минск", "220030"), ("Цех 123456 районный", ""),
])
def test_postcodes_in_texts(one, text, want):
    assert one(lambda c: F.regexp_extract(c, P.POSTCODE_IN_TEXT, 0), text) == want


def test_shown_texts_as_in_sql(differing):
    assert differing("display_layouts") == set()


@pytest.mark.parametrize("raw,want", [
    ("220030, г. Минск, ул. Мира, 220030, г. Минск", "г. Минск, ул. Мира, 220030"), ("220030, г. Минск, ул. Мира, 5, 220030", "г. Минск, ул. Мира, 5"), ("г. Минск, 375 17 234-56-78", "г. Минск"), ("г. Минск, +375 17 23456", "г. Минск"),
])
def test_shown_addresses(one, raw, want):
    assert one(D.address, raw) == want


def test_postcodes_still_end_shown_texts(one):
    assert one(D.waste_type, "Лом 220030 Минск") == "Лом" and one(D.waste_type, "Лом 375123 220030, ул. Мира") == "Лом 375123"
    assert one(D.object_name, "Цех 123456, Минская обл., д. Луг", "") == "Цех"
    assert one(D.owner, "", 'завод "Луч" 220030, ул. Мира', "") == 'завод "Луч"'


def test_register_texts_as_in_sql(differing):
    assert differing("register_layouts") == set()


def test_postcodes_still_end_register_texts(one):
    assert one(X.clean_object_name, "Цех переработки 220030 Минск", "") == "Цех переработки"
    assert one(X.canonical_owner, 'ООО "Лидер" 220030,\nг. Минск') == "" and one(X.canonical_object, "Установка 123456\nг. Минск\nЦех", "") == "Цех"
    assert one(X.owner_hint, 'завод "Луч" 220030, ул. Мира') == 'завод "Луч'
    assert one(X.postal_lines, "Дом 220030\nг. Минск\nещё") == "Дом 220030, г. Минск" and one(X.postal_lines, "Дом 220030\nещё\n220100 Луг") == "220100 Луг"
    whole, parted = (one(X.name_and_address, t) for t in ("Дробильная установка 123456, линия", "Дробильная установка 220030, г. Минск"))
    assert (whole.name, whole.address) == ("Дробильная установка 123456, линия", "") and (parted.name, parted.address) == ("Дробильная установка", "220030, г. Минск")
    assert one(X.trim_tail, "ул. Мира 123456789 Страница 1 из 9") == "ул. Мира 123456789" and one(X.trim_tail, "ул. Мира 123456789 и ещё") == "ул. Мира"
