"""Catalogue of versions, sources, and streams."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from geosift.plans.catalog import Catalog, Conflict
from geosift.schemas import REGISTRY
from geosift.sources import files
from geosift.streaming import imports, progress, throttle

TEXT = "1234567 Бой\nОбъект {0} Цех {0}\n220030, ул. Мира, {0}, г. Минск\nСобственник ООО Луч"


def test_stream_import_replaces_parts_and_survives_a_restart(spark, tmp_path):
    catalog, inbox, marks = Catalog(spark, str(tmp_path / "reg")), str(tmp_path / "in"), str(tmp_path / "marks")

    def send(*docs):
        spark.createDataFrame([(i, n, n, p, t) for i, (n, p, t) in enumerate(docs)], imports.DOCUMENTS).coalesce(1).write.mode("append").parquet(inbox)
        imports.drained(lambda: imports.import_stream(spark, catalog, inbox, marks))

    send(("a", 1, TEXT.format(1) + "\n" + TEXT.format(2)), ("b", 2, TEXT.format(7)))
    first = catalog.registry()
    assert sorted((r.source_part, r.record_id) for r in first.collect()) == [(1, 1), (1, 2), (2, 7)]
    send(("c", 2, TEXT.format(8)))
    assert sorted((r.source_part, r.record_id) for r in catalog.registry().collect()) == [(1, 1), (1, 2), (2, 8)]
    meta = catalog.meta().first()
    assert (meta.total, meta.accepting, meta.own_only, meta.sources) == (3, 3, 0, ["c"])
    assert len(catalog.versions("registry")) == 2 and not catalog.same_sources(["c"]) and not catalog.same_sources(["c", "d"])
    catalog.prune("registry", 1)
    assert len(catalog.versions("registry")) == 1 and catalog.registry().count() == 3
    catalog.clear()
    assert catalog.registry().isEmpty() and catalog.meta().isEmpty()


def send_events(spark, into, rows):
    """(user, second) pairs as one more file; the second is the event's id."""
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(u, s, t + timedelta(seconds=s)) for u, s in rows], EVENTS).coalesce(1).write.mode("append").parquet(into)


EVENTS = "user_id long, event_id long, ts timestamp"


def test_throttle_keeps_state_over_restarts(spark, tmp_path):
    into, out, provider = str(tmp_path / "events"), str(tmp_path / "out"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    for part in ([0, 100, 300], [590, 600, 1000], [700, 1299, 1300]):
        send_events(spark, into, [(1, s) for s in part] + [(2, part[0] + 7)])
        imports.drained(lambda: throttle.throttle_query(spark.readStream.schema(EVENTS).parquet(into), out, str(tmp_path / "marks")))
    assert spark.conf.get(provider) == before
    got = spark.read.parquet(out).collect()
    assert sorted(r.event_id for r in got if r.user_id == 1) == [0, 300, 600, 1000, 1300]
    assert sorted(r.event_id for r in got if r.user_id == 2) == [7, 597]


def test_throttle_forgets_keys_that_are_idle(spark, tmp_path):
    """With a life of a second, the state of a key is gone by the next batch, and its next event is accepted anew."""
    into, out, told = str(tmp_path / "events"), str(tmp_path / "out"), []
    for part in ([(u, 0) for u in range(20)], [(3, 100)]):
        send_events(spark, into, part)
        query = throttle.throttle_query(spark.readStream.schema(EVENTS).parquet(into), out, str(tmp_path / "marks"), kept_seconds=1)
        query.awaitTermination()
        told.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(1.5)
    assert sorted((r.user_id, r.event_id) for r in spark.read.parquet(out).collect() if r.user_id == 3) == [(3, 0), (3, 100)]
    assert told[0] == 20 and told[1] == 1  # only the live key is left


def test_throttle_orders_a_key_that_comes_in_many_chunks(spark, tmp_path):
    """One user's events, times in mixed order over two batches, more than Arrow hands over at once."""
    schema = "user_id long, event_id long, ts timestamp"
    mixed = "timestamp_micros((1700000000 + 40 * ((id * 7919) % 1000)) * 1000000L + {0} * 40000000000L)"
    into, want, last = str(tmp_path / "events"), [], None
    for i in sorted(range(2000), key=lambda i: ((i // 1000) * 40000 + 40 * ((i * 7919) % 1000), i)):
        t = (i // 1000) * 40000 + 40 * ((i * 7919) % 1000)
        if last is None or t - last >= 300:
            last = t
            want.append(i)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for n in range(2):
            spark.range(1000 * n, 1000 * (n + 1)).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.expr(mixed.format(n)).alias("ts")).coalesce(1).write.mode("append").parquet(into)
            stream = spark.readStream.schema(schema).parquet(into)
            imports.drained(lambda: throttle.throttle_query(stream, str(tmp_path / "out"), str(tmp_path / "marks")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)


def bare_parse(docs):
    """A stand-in for the parser: a record for each document, its text as the id."""
    fixed = {c: F.lit("x") for c in ("owner", "object_name", "waste_code", "waste_type_name", "address", "phones")}
    return docs.select("doc", "source_part", F.lit(0).alias("pos"), F.col("text").try_cast("int").alias("id")).withColumns(fixed | {"accepts_external_waste": F.lit(True)})


def bytes_of(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


def test_a_commit_writes_the_parts_that_it_touches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imports, "parse", bare_parse)
    cost = []
    for large in (1, 3000):
        root = tmp_path / f"reg{large}"
        catalog = Catalog(spark, str(root))
        imports.import_documents(catalog, spark.range(large).select("id", F.lit("n"), F.lit("s"), F.lit(1), F.col("id").cast("string")).toDF("doc", "name", "sha256", "source_part", "text"))
        before, old = bytes_of(root / "registry"), catalog.manifest("registry")["1"]
        imports.import_documents(catalog, spark.createDataFrame([(0, "m", "t", 2, "5")], imports.DOCUMENTS))
        cost.append(bytes_of(root / "registry") - before)
        assert catalog.manifest("registry")["1"] == old  # the very files
        rows = catalog.registry().groupBy("source_part").count().collect()
        assert {r.source_part: r["count"] for r in rows} == {1: large, 2: 1}
        assert catalog.registry([2]).first().pk == catalog.last_pk() > catalog.registry([1]).agg(F.max("pk")).first()[0]
        assert len(catalog.registry([2]).inputFiles()) == 1
        catalog.prune("registry", 1)
        assert catalog.registry().count() == large + 1
    assert abs(cost[0] - cost[1]) < 200  # but for the number of bytes of a name


def test_an_unchanged_set_of_files_is_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imports, "parse", bare_parse)
    catalog = Catalog(spark, str(tmp_path / "reg"))
    files_ = lambda *digests: spark.createDataFrame([(i, d, d, i % 2 + 1, str(i)) for i, d in enumerate(digests)], imports.DOCUMENTS)
    assert imports.import_documents(catalog, files_("a", "b"))["records"] == 2
    assert imports.import_documents(catalog, files_("b", "a"))["skipped"] and len(catalog.versions("registry")) == 1
    assert imports.import_documents(catalog, files_("a", "b"), again=True)["records"] == 2
    assert imports.import_documents(catalog, files_("a", "c"))["records"] == 2 and len(catalog.versions("registry")) == 3


def test_writers_of_other_parts_agree_and_of_the_same_part_do_not(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "reg"))
    row = lambda part, pk: spark.createDataFrame([(pk, part)], "pk long, source_part int")
    base = catalog.manifest("t")
    catalog.write_parts(row(1, 1), "t", "source_part", [1], base)
    catalog.write_parts(row(2, 2), "t", "source_part", [2], base)  # read before the first, of another part
    assert sorted(catalog.manifest("t")) == ["1", "2"]
    with pytest.raises(Conflict):
        catalog.write_parts(row(1, 3), "t", "source_part", [1], base)
    catalog.write_parts(row(1, 3).limit(0), "t", "source_part", [1], catalog.manifest("t"))
    assert [tuple(r) for r in catalog.read("t", "pk long, source_part int").collect()] == [(2, 2)]
    (tmp_path / "reg" / "t" / "_committed" / "4").write_text('{"1": ')  # a writer that was lost
    monkey = catalog.versions("t")
    assert monkey == [1, 2, 3]
    catalog.write_parts(row(1, 9), "t", "source_part", [1], catalog.manifest("t"))
    assert catalog.versions("t") == [1, 2, 3, 5] and catalog.read("t", "pk long, source_part int").count() == 2


def test_the_step_follows_the_rate(spark):
    rows = [(1000, 600, 10.0, 50, 1_000_000), (1000, 0, 0.0, 50, 1000), (50, 10, 100.0, 50, 1000), (900, 99999, 1.0, 50, 1000), (7, 3, 2.5, 10, 5)]
    df = spark.createDataFrame(rows, "step long, done long, seconds double, least long, most long")
    c = F.col
    got = [r[0] for r in df.select(progress.next_step_of(c("step"), c("done"), c("seconds"), 60.0, c("least"), c("most"))).collect()]
    assert got == [progress.next_step(s, d, t, 60.0, low, high) for s, d, t, low, high in rows] == [1780, 715, 50, 930, 10]


def test_a_stream_commits_by_its_cadence(spark, tmp_path, monkeypatch):
    """Six files, one a micro-batch: the small first step commits often, and the rate draws it up."""
    monkeypatch.setattr(imports, "parse", bare_parse)
    catalog, inbox = Catalog(spark, str(tmp_path / "reg")), str(tmp_path / "in")
    for n in range(6):
        spark.createDataFrame([(n, "n", str(n), n + 1, str(n))], imports.DOCUMENTS).coalesce(1).write.mode("append").parquet(inbox)
    cadence = progress.Cadence(step=1, target=10_000.0, least=1, most=40)
    importer = imports.Importer(catalog, cadence, total=6)
    commits = imports.imported(spark, catalog, inbox, str(tmp_path / "marks"), importer, files_per_batch=1)
    assert catalog.registry().count() == 6 and 2 <= commits < 6  # some batches waited for others
    assert cadence.steps == sorted(cadence.steps) and 1 < cadence.steps[-1] <= 40
    rows = catalog.metrics(progress.METRICS).collect()
    count = lambda stage: [r.rows for r in rows if r.stage == stage]
    assert count("read") == count("parse") == count("batch") == [1] * 6 and len(count("commit")) == commits
    told = sorted((r for r in rows if r.stage == "batch"), key=lambda r: r.batch)
    assert [r.done for r in told] == [1, 2, 3, 4, 5, 6] and told[-1].eta_seconds == 0 and told[0].eta_seconds >= 0
    assert all(r.rows_per_second > 0 and r.total == 6 for r in told)
    assert imports.imported(spark, catalog, inbox, str(tmp_path / "marks"), importer) == 0


def test_staged_batches_outlive_their_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imports, "parse", bare_parse)
    catalog = Catalog(spark, str(tmp_path / "reg"))
    slow = progress.Cadence(step=1000)
    docs = lambda part, *ids: spark.createDataFrame([(i, "n", str(i), part, str(i)) for i in ids], imports.DOCUMENTS)
    lost = imports.Importer(catalog, slow)
    lost.stage(docs(1, 1, 2), 0)
    lost.stage(docs(2, 3), 1)
    lost.stage(docs(1, 4), 2)
    assert catalog.registry().isEmpty()
    assert imports.Importer(catalog).commit() == 2  # by another run
    assert sorted((r.source_part, r.record_id) for r in catalog.registry().collect()) == [(1, 4), (2, 3)]
    assert imports.Importer(catalog).commit() == 0


def test_second_readings_are_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imports, "parse", lambda docs: bare_parse(docs).where("id is not null"))
    hard = "1234567 Бой\nОбъект 5 Цех\n" + "слово " * 300 + "\n2345678 Лом\nслово\n3456789 Шлак\nслово\n4567890 Зола\nслово\n"
    docs = spark.createDataFrame([(1, "a", "a", 1, "7"), (2, "b", "b", 1, hard), (3, "c", "c", 1, hard)], imports.DOCUMENTS)
    good = '{"waste_code": "1234567", "object_id": "%s", "owner_name": "О"}'

    def reader(calls):
        """The first piece gives two sound records and a bad one, the second none, the third of them no JSON."""
        said = F.when(F.col("chunk") > 0, F.when(F.col("doc") == 2, '{"records": []}').otherwise("sorry"))
        return calls.select("doc", "chunk", F.coalesce(said, F.concat(F.lit('{"records": ['), F.lit(good % 8), F.lit(", "), F.lit(good % "x"), F.lit(", "), F.lit(good % 9), F.lit("]}"))).alias("payload"))

    for shadow, left in ((True, {7}), (False, {7, 8, 9})):
        catalog = Catalog(spark, str(tmp_path / f"reg{shadow}"))
        told = imports.import_documents(catalog, docs, reader=reader, shadow=shadow)
        assert told["second_readings"] == {"calls": 4, "success": 3, "fail": 1, "accepted": 4, "rejected": 2, "applied": 0 if shadow else 4}
        assert {r.record_id for r in catalog.registry().collect()} == left
    few = imports.import_documents(Catalog(spark, str(tmp_path / "few")), docs, reader=reader, max_calls=1)
    assert few["second_readings"] == {"calls": 1, "success": 1, "fail": 0, "accepted": 2, "rejected": 1, "applied": 2}


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b_II.txt").write_text("два", encoding="utf-8")
    (tmp_path / "t" / "a.txt").write_text("раз", encoding="utf-8")
    (tmp_path / "t" / "empty.txt").write_text("")
    docs = files.numbered(files.text_documents(spark, str(tmp_path / "t"))).orderBy("doc").collect()
    assert [(d.doc, d.name, d.source_part, d.text) for d in docs] == [(1, "a.txt", 1, "раз"), (2, "b_II.txt", 2, "два")]

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pdf").write_bytes(b"one\x0c \x0ctwo")
    (tmp_path / "p" / "y.pdf").write_bytes(b"bad")

    def pages(raw):
        if raw == b"bad":
            raise ValueError
        return raw.decode().split("\x0c")

    got = files.pdf_documents(spark, str(tmp_path / "p"), pages, lambda raw: ["second"]).orderBy("name").collect()
    assert [(r.pages, r.text) for r in got] == [(2, "one\ntwo"), (1, "second")]

    record = {"id": "5", "owner": "O", "object_name": "N", "waste_code": "1234567", "source_part": 2, "lat": "53.9", "lon": None}
    (tmp_path / "r.json").write_text(json.dumps({"records": [record, {"id": "x"}], "sources": []}))
    rows = files.registry_json(spark, str(tmp_path / "r.json")).orderBy("pk").collect()
    assert [(r.record_id, r.source_part, r.lat, r.lon, r.accepts_external_waste) for r in rows] == [(5, 2, 53.9, None, True), (None, 1, None, None, True)]
    (tmp_path / "g.json").write_text(json.dumps({"a": {"lat": 1.0, "lon": 2.0}, "b": {"lat": None, "lon": 1}}))
    assert [tuple(r) for r in files.geocode_json(spark, str(tmp_path / "g.json")).collect()] == [("a", 1.0, 2.0)]
    (tmp_path / "u.json").write_text(json.dumps([{"email": "A@x", "password_hash": "h", "role": "king"}, {"email": "", "password_hash": "h"}, {"email": "a@x", "password_hash": "h2", "role": "admin"}]))
    assert [(r.email, r.role) for r in files.users_json(spark, str(tmp_path / "u.json")).collect()] == [("a@x", "admin")]
    (tmp_path / "d.tsv").write_text("\t".join(["1", "Минск", "Minsk", "", "53.9", "27.5", "P", *[""] * 7, "100"]) + "\nshort\trow\n", encoding="utf-8")
    assert [(r.name, r.population) for r in files.place_dump(spark, str(tmp_path / "d.tsv")).collect()] == [("Минск", 100)]


def test_boxes_from_page_geometry(spark):
    label = "Объект"
    words = [
        (1, 1, label, 100.0, 50.0), (1, 1, "12", 150.0, 51.0), (1, 1, "77", 200.0, 50.0), (1, 1, "99", 105.0, 50.0), (1, 1, "98", 150.0, 90.0),  # leftmost, more than 10 to the right
        (1, 1, label, 100.0, 200.0), (1, 1, "13", 90.0, 150.0), (1, 1, "14", 80.0, 150.0), (1, 1, "15", 300.0, 190.0),  # above: nearest, then leftmost, not beyond 280
        (1, 1, label, 100.0, 400.0), (1, 1, "16", 90.0, 400.5), (1, 1, label, 100.0, 600.0), (1, 1, "17", 150.0, 600.0), (1, 1, "0", 120.0, 600.0),
        (2, 1, label, 100.0, 50.0), (2, 1, "12", 150.0, 50.0), (2, 1, "объект", 100.0, 300.0), (2, 1, "18", 150.0, 300.0),
    ]
    box = lambda doc, x, y, w=5.0, h=4.0: (doc, 1, x - w / 2, y - h / 2, x + w / 2, y + h / 2)
    strokes = [
        box(1, 702.0, 54.5), box(1, 755.0, 61.5), box(1, 702.0, 208.0), box(1, 755.0, 220.0), box(1, 755.0, 404.5),
        box(1, 730.0, 604.5), box(1, 755.0, 604.5, 9.0), box(1, 755.0, 604.5, 5.0, 1.0),  # between the columns, too large, too thin
        box(2, 702.0, 54.5), box(2, 702.0, 304.5),
    ]
    got = files.checked_boxes(
        spark.createDataFrame(words, "doc long, page int, text string, x double, y double"), spark.createDataFrame(strokes, "doc long, page int, x0 double, y0 double, x1 double, y1 double")
    )
    assert {(r.doc, r.object_id): r.accepts for r in got.collect()} == {(1, 12): True, (1, 14): False, (1, 16): True, (2, 12): False}


def test_an_import_reports_what_it_read(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "reg"))
    texts = [TEXT.format(1), TEXT.format(2) + "\n" + "слова " * 3000]
    docs = spark.createDataFrame([(i, "n", str(i), 1, t) for i, t in enumerate(texts)], imports.DOCUMENTS)
    told = imports.import_documents(catalog, docs)
    assert (told["records"], told["chars"], told["long_text"], told["long_import"]) == (2, sum(map(len, texts)), True, False)
    assert told["seconds"] >= told["parse_seconds"] > 0 and not (tmp_path / "reg" / "_staged").exists()


def test_payloads_win_as_a_whole(spark):
    from geosift.plans.catalog import as_records

    row = lambda pk, record_id, payload: (pk, 1, record_id, "O", "N", "1234567", "W", True, "A", "P", 1.0, 2.0, payload)
    rows = [row(1, 5, None), row(2, None, "not json"), row(3, 6, '{"id": 9, "owner": "X"}'), row(4, 7, '{"id": null, "lat": 3.5}'), row(5, None, '{"id": "x"}'), row(6, 8, '["id"]'), row(7, 9, '{"id": ')]
    order = ["pk", "source_part", "record_id", "owner", "object_name", "waste_code", "waste_type_name", "accepts_external_waste", "address", "phones", "lat", "lon", "payload"]
    kinds = dict(c.split() for c in REGISTRY.split(", "))
    stored = spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in order))
    got = {r.pk: (r.id, r.owner, r.lat) for r in as_records(stored).collect()}
    assert got == {1: (5, "O", 1.0), 2: (2, "O", 1.0), 3: (9, "X", None), 4: (7, None, 3.5), 5: (5, None, None), 6: (8, "O", 1.0), 7: (9, "O", 1.0)}


def test_pk_continues(spark):
    parsed = spark.createDataFrame([(2, 0, 7), (1, 5, 9), (1, 1, 8)], "doc long, pos int, id int")
    for c in ("owner", "object_name", "waste_code", "waste_type_name", "address", "phones"):
        parsed = parsed.withColumn(c, F.lit("x"))
    parsed = parsed.withColumns({"accepts_external_waste": F.lit(True), "source_part": F.lit(1)})
    got = imports.as_registry(parsed, 11)
    assert got.columns == [c.split()[0] for c in REGISTRY.split(", ")]
    assert sorted((r.pk, r.record_id) for r in got.collect()) == [(11, 8), (12, 9), (13, 7)]
