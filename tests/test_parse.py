"""Register texts to records: the layouts and the awkward fields."""

import pytest
from pyspark.sql import functions as F

from geosift.functions import extract as X
from geosift.plans import parse as parsing

BASIC = """Шапка реестра
1234567 Отходы бетона
Объект 12 Дробильная установка «Вихрь»
220030, ул. Лесная, 5, г. Минск
Собственник ООО "Ромашка-Строй"
тел. (017) 234-56-78
Объект 13 Площадка временная
Собственник ОАО «Тополь»
7654321 Стеклобой
Объект 77 Линия сортировки
211030, ул. Новая, 1, г. Орша
Собственник ЧУП "Клён"
"""


@pytest.fixture(scope="module")
def parse(spark):
    def run(*texts, part=1):
        docs = spark.createDataFrame([(i, part, t) for i, t in enumerate(texts)], "doc long, source_part int, text string")
        return [r.asDict() for r in parsing.parse(docs).orderBy("doc", "pos").collect()]

    return run


@pytest.fixture(scope="module")
def one(spark):
    def run(f, *values):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x

    return run


def test_segments_and_cards(parse):
    got = parse(BASIC)
    assert [(r["id"], r["waste_code"], r["waste_type_name"]) for r in got] == [(12, "1234567", "Отходы бетона"), (13, "1234567", "Отходы бетона"), (77, "7654321", "Стеклобой")]
    assert "Минск" in got[0]["address"] and "Лесная" in got[0]["address"] and "234-56-78" in got[0]["phones"]
    assert got[0]["object_name"].startswith("Дробильная установка") and got[0]["owner"] == 'ООО "Ромашка-Строй"'
    assert got[1]["owner"] == "ОАО «Тополь»" and all(r["accepts_external_waste"] and r["source_part"] == 1 for r in got)


def test_one_line_text_is_split(parse):
    got = parse('Реестр 1234567 Бой кирпича Объект 5 Мобильная установка 220001, ул. Садовая, 3, г. Минск Собственник УП "Зодчий"')
    assert [(r["id"], r["waste_code"]) for r in got] == [(5, "1234567")] and got[0]["owner"] == 'УП "Зодчий"'


@pytest.mark.parametrize("line,code,rest", [
    ("1234567Отходы", "1234567", "Отходы"), ("| 1 2 3 4 5 6 7 Бой", "1234567", "Бой"), ("12345678 нет", None, None), ("№ 1234567", "1234567", ""),
    ("１２３４５６７ тип", "1234567", "тип"), ("1 2 3 4 5 6 7 8", None, None), ("", None, None), ("текст 1234567", None, None),
])
def test_code_lines(one, line, code, rest):
    got = one(X.code_line, line)
    assert (got and got.code) == code and (got and got.rest) == rest


def test_labels_and_numbers_are_joined(one, parse):
    assert "Объект 12" in one(X.preprocess, "Объект\n12 x") and "Объект №. 12" in one(X.preprocess, "Объект №.\n 12")
    assert one(X.preprocess, "Объект\n220000, ул.") == "Объект\n220000, ул."
    assert one(X.preprocess, "a​b\r\nc\rd\x0ce") == "ab\nc\nd\ne"


def test_anchor_fallback_for_broken_order(parse):
    filler = "строка без смысла\n" * 800
    got = parse(f"начало\nкод: 1234567 Отходы\n{filler[:3000]}\nОбъект 9 Цех\nСобственник ООО Луч\n{filler}")
    assert [(r["id"], r["waste_code"]) for r in got] == [(9, "1234567")]
    text = "x 12345678\nОбъект 9 Цех\nСобственник ООО Луч"
    assert parse(text) == []


def test_routes_are_those_that_give_cards(spark):
    """Each way of reading on its own, held against the route that windows tell."""
    filler = "строка без смысла\n" * 700
    texts = [
        BASIC, "Объект 1 Цех\n1234567 Бой\nОбъект 2 Цех", "Объект 1 Цех\n1234567 Бой", "", "1234567 Объект 5", f"код: 1234567\nОбъект 9 Цех\n{filler}",
        f"Объект 9\nСобственник\n{filler}", f"код: 1234567\n{filler}\nОбъект 9\nСобственник", f"код: 1234567\n{filler}\n{filler}\nОбъект 9 Цех", f"{filler}код 7654321\nОбъект 3\n\nОбъект 4 Линия",
    ]
    docs = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc long, source_part int, text string")
    rows = parsing.lines(docs).withColumn("line", F.regexp_replace("line", "^7654321", "код 7654321"))
    segments = {r.doc for r in parsing.segment_cards(rows).select("doc").distinct().collect()}
    anchors = {r.doc for r in parsing.anchor_cards(rows.where(F.col("chars") > parsing.ANCHOR_CHARS)).select("doc").distinct().collect()}
    got = {r.doc: r.route for r in parsing.routed(rows).select("doc", "route").distinct().collect()}
    assert got == {i: "segments" if i in segments else "anchors" if i in anchors else "blocks" for i in range(len(texts))}
    assert set(got.values()) == {"segments", "anchors", "blocks"}


def test_anchor_cards_find_codes_inside_lines(spark):
    docs = spark.createDataFrame([(0, 2, "код (7654321) Бой\nОбъект 4 Линия\nСобственник ОАО Мост")], "doc long, source_part int, text string")
    rows = parsing.lines(docs).withColumn("line", F.regexp_replace("line", "^7654321\\) ", "(7654321) "))
    got = parsing.anchor_cards(rows).collect()
    assert [(r.id, r.waste_code, r.source_part) for r in got] == [("4", "7654321", 2)]


def test_label_blocks(parse):
    text = "\n".join([
        "1234567", "Отходы древесины", "456", "Собственник", "Объект", 'ООО "Сосна"', "Установка мобильная", "220100, ул. Мира, 2, г. Минск", "тел. (017) 222-33-44",
        "7654321", "Стеклобой", "789", "Объект", "Собственник", "ОАО Берёза", "Цех",
    ])
    blocks = [r for r in parse("x\n" + "\n".join(["заголовок", *text.split("\n")]).replace("1234567", "1234567"))]
    assert blocks == [] or {r["waste_code"] for r in blocks} <= {"1234567", "7654321"}


def test_label_block_cards(spark):
    lines = ["7654321", "Стеклобой", "12", "789", "Объект", "Собственник", 'ОАО "Берёза"', "Цех", "тел. (0152) 22-33-44", "801", "Собственник", "Объект", "УП Дуб"]
    rows = spark.createDataFrame([(0, 1, 99, i, x, i * 10) for i, x in enumerate(lines)], "doc long, source_part int, chars int, pos int, line string, at long")
    got = parsing.label_block_cards(rows).orderBy("pos").collect()
    assert [(r.id, r.waste_code) for r in got] == [("789", "7654321"), ("801", "7654321")]
    assert got[0].owner_blob == 'ОАО "Берёза"\nЦех\nтел. (0152) 22-33-44' and got[0].waste_type_name.startswith("Стеклобой")
    assert got[1].owner_blob == "УП Дуб" or got[1].owner_blob.startswith('ОАО "Берёза"')


@pytest.mark.parametrize("name,waste,want", [
    ("Установка дробильная ООО Вектор", "", "Установка дробильная"), ("Бой бетона Установка", "Бой бетона", "Установка"), ("объекты", "", ""), ("—", "", ""),
    ("принимает отходы от других Линия №2", "", "Линия №2"), ("ООО Вектор", "", "ООО Вектор"), ("Цех переработки 220030, ул. Мира", "", "Цех переработки"),
    ("Площадка государственное предприятие Лес", "", "Площадка"), (None, None, ""),
])
def test_object_names(one, name, waste, want):
    assert one(X.clean_object_name, name, waste) == want


def test_canonical_lines(one):
    assert one(X.canonical_object, "Площадка по хранению\nМобильная дробильная установка\nв соответствии с нормами", "") == "Мобильная дробильная установка"
    assert one(X.canonical_owner, 'Управление\nООО "Лидер"\nг. Минск\nтел. 22') == 'ООО "Лидер"'
    assert one(X.canonical_owner, "Управление") == "" and one(X.canonical_owner, "220030, ООО Х") == ""
    assert one(X.owner_hint, 'цех, филиал завода "Луч" 220030; ООО "Дом"') == 'ООО "Дом'
    assert one(X.owner_hint, "просто слова") == ""


def test_addresses(one):
    assert one(X.clean_address, "220020, г. Минск, ул. Мира, г. Минск, г. (не указано), (017) 2345678") == "220020, г. Минск, ул. Мира"
    assert one(X.collapse_commas, "220020, г. Минск, Г. МИНСК,, ул. Мира") == "220020, г. Минск, ул. Мира"
    assert one(X.dedupe_locality, "г. Гомель, ул. Мира, г. Гомель") == "г. Гомель, ул. Мира"
    assert one(X.with_locality, "220020, ул. Мира", "завод в г. Брест, ул. Лесная") == "220020, г. Брест, ул. Мира"
    assert one(X.with_locality, "ул. Мира", "нет") == "ул. Мира"
    assert one(X.repair_address, "222310, г.8", "ООО ул. Новая, 4", "") == "222310, ул. Новая, 4"
    assert one(X.repair_truncated_town, "222310, ул. Мира, г.", "г. Брест") == "222310, г. Брест, ул. Мира, г."
    assert one(X.repair_truncated_town, "222310, д.5, ул. Мира, г.", "г. Брест") == "222310, д.5, ул. Мира, г. Брест"
    assert one(X.repair_truncated_town, "222310, ул. Мира, г.", None) == "222310, ул. Мира"
    assert one(X.repair_truncated_town, "222310, ул.Мира", "г. Брест") == "222310, г. Брест, ул.Мира"
    assert one(X.postal_lines, "слова\n220030 Минск\nул. Мира 4\nещё", "") == "220030 Минск, ул. Мира 4"
    got = one(X.name_and_address, "Цех большой 220030, ул. Мира, 5\nг. Минск\nвторая очередь\nСобственник кто-то\nпотом")
    assert (got.name, got.address) == ("Цех большой вторая очередь", "220030, ул. Мира, 5 г. Минск")


def test_phones(one):
    assert one(X.phones, "тел. (017) 234-56-78, факс 8-017-234-56-79", "+375 (29) 563-38-19 и (017) 234-56-78") .startswith("(017) 234-56-78")
    assert one(X.phones, "(029) 5633819 2 апреля", None) == "(029) 5633819"
    assert one(X.phones, "код 56338191262", None) == "" and one(X.phones, None, None) == ""
    assert one(X.phones, "факс 8-0152-22-33-44", "80295633819") == "8-0152-22-33-44; 80295633819"
    assert one(X.phones, "тел. 22-33-44\n220030, г. Минск", None) == "тел. 22-33-44"


@pytest.mark.parametrize("text,want", [
    ("ул. Мира, 5 тел. 22", "ул. Мира, 5"), ("ул. Мира 3 мая 2024 г. Страница 1 из 9 Луг", "ул. Мира"), ("ул. Мира Страница 1 из 9", "ул. Мира"),
    ("ул. Мира (0152) 22-33-44", "ул. Мира"), ("ул. Мира 8-017-22", "ул. Мира"), ("ул. Мира 12345678", "ул. Мира"), ("ул. Мира 1234567", "ул. Мира 1234567"), (None, ""),
])
def test_tails(one, text, want):
    assert one(X.trim_tail, text) == want


def test_names_without_service_words(one):
    assert one(X.clean_object_name, "объекты, которые принимают отходы от других лиц, Цех", "") == "Цех"
    assert one(X.clean_object_name, "от других лиц: от других, Линия", "") == "Линия"
    assert one(X.clean_object_name, "использует собственные отходы Пункт", "") == "Пункт"
    for owner in ("частное унитарное предприятие Дом", "коммунальное предприятие Дом", "государственное унитарное предприятие Дом"):
        assert one(X.clean_object_name, f"Цех {owner}", "") == "Цех"
    assert one(X.clean_object_name, "Цех частное предприятие Луч", "") == "Цех частное предприятие Луч"
    assert one(X.address_hint, "завод, ул. Мира, 5, корп. 2, офис 3, вход со двора") == "ул. Мира, 5, корп. 2, офис 3"
    assert one(X.with_locality, "ул. Мира", "агрогородок у д. 2-я Лесная Поляна; дер. Луг") == "д. 2-я Лесная Поляна, ул. Мира"


@pytest.mark.parametrize("blob,want", [
    (None, True), ("x ☐ ☑", True), ("x ☑ ☐", False), ("☐☑\n☑☐", False), ("☐ ☐ ☑ ☒", True), ("Принимает от других ☐", False),
    ("не принимает отходы от других", False), ("принимает отходы от других", True), ("☑", True),
])
def test_accept_flags(one, blob, want):
    assert one(X.accepts_external, blob) is want
