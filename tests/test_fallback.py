"""The gate, the chunks and the checks of second readings."""

from pyspark.sql import functions as F

from geosift.plans import fallback

ANSWERS = "source_part int, waste_code string, waste_name string, object_name string, owner_name string, user_address string, user_phone string, object_id string, owner_address string, owner_phone string, accepts_from_others boolean"


def test_gate(spark):
    long = "Объект 1234567 " + "слово " * 300
    docs = spark.createDataFrame([(1, long), (2, "Объект 1234567"), (3, long), (4, "слово " * 400), (5, None)], "doc long, text string")
    read = spark.createDataFrame([(3,)], "doc long")
    assert [r.doc for r in fallback.needed(docs, read).collect()] == [1]


def test_pieces(spark):
    rows = [(1, 1, 0, "a"), (1, 1, 1, "Страница 3 из 9"), (1, 2, 2, "b"), (1, 3, 3, "c")]
    got = fallback.pieces(spark.createDataFrame(rows, "doc long, seg long, pos int, line string")).orderBy("chunk").collect()
    assert [r.text for r in got] == ["a\n---\nb", "c"]


def test_only_sound_answers_hold(spark):
    rows = [
        (1, "123 4567", " Бой ", None, "ООО Луч", "адрес", "22", "5", " ", "22", None), (1, "12345", "x", "x", "x", "x", "x", "5", "x", "x", True),
        (1, "1234567", "x", "x", "x", "x", "x", "1000000", "x", "x", True), (1, "1234567", None, "Цех", "О", "u", "1", "7", "o", "2", False),
    ]
    got = fallback.validated(spark.createDataFrame(rows, ANSWERS)).orderBy("id").collect()
    assert [(r.id, r.object_name, r.address, r.phones, r.accepts_external_waste) for r in got] == [(5, "—", "адрес", "22", True), (7, "Цех", "o", "2 ; 1", False)]
    assert got[0].waste_code == "1234567" and got[0].waste_type_name == "Бой"
    assert fallback.validated(spark.createDataFrame([], ANSWERS)).select(F.count("*")).first()[0] == 0
