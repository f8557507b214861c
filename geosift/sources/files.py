"""Sources and sinks: documents, JSON bootstraps, place-name dumps, page geometry.

PDF reading is a plug-in: a function from bytes to pages' texts that runs in
tasks.  Without one, text files are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REGISTRY
from ..functions.text import part_from_name, safe_double, safe_int

#: Bytes that an upload may have.
UPLOAD_BYTES, PREVIEW_BYTES = 120 << 20, 20 << 20

Extractor = Callable[[bytes], list[str]]


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, text) of whole text files."""
    raw = spark.read.format("binaryFile").load(path).where(F.col("length").between(1, UPLOAD_BYTES))
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def pdf_documents(spark: SparkSession, path: str, extract: Extractor, fallback: Extractor | None = None) -> DataFrame:
    """(name, sha256, pages, text) of PDF files.

    Blank pages are left out, the others joined by line ends.  ``fallback`` is
    tried when ``extract`` raises, or gives nothing for over 500 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = []
            for raw in b.column(2).to_pylist():
                got = None
                try:
                    got = extract(raw)
                except Exception:  # noqa: BLE001  a file that one reader can't take goes to the other
                    if fallback is None:
                        raise
                if fallback is not None and (got is None or (len(raw) > 500 and not any(p.strip() for p in got))):
                    got = fallback(raw)
                pages.append([p for p in got if p.strip()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pages, pa.list_(pa.string()))], ["name", "sha256", "page_texts"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).where(F.col("length").between(1, UPLOAD_BYTES))
    files = raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "content")
    read = files.mapInArrow(run, "name string, sha256 string, page_texts array<string>")
    return read.select("name", "sha256", F.size("page_texts").alias("pages"), F.array_join("page_texts", "\n").alias("text"))


def numbered(files: DataFrame) -> DataFrame:
    """Files with doc, source_part and their place in name order; there are few of them."""
    from pyspark.sql import Window

    placed = files.withColumn("position", F.row_number().over(Window.orderBy("name", "sha256")))
    return placed.withColumns({"doc": F.col("position").cast("long"), "source_part": part_from_name(F.col("name"), F.col("position"))})


def registry_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON bootstrap {records, sources, source_signature}, in its order, whole rows as payload."""
    schema = "records array<struct<id: string, owner: string, object_name: string, waste_code: string, waste_type_name: string, accepts_external_waste: boolean, address: string, phones: string, source_part: string, lat: string, lon: string>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("records").alias("pos", "r"))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    return each.select(
        (F.col("pos") + 1).cast("long").alias("pk"), F.coalesce(safe_int(F.col("r.source_part")), F.lit(1)).alias("source_part"), safe_int(F.col("r.id")).alias("record_id"), text("owner").alias("owner"), text("object_name").alias("object_name"),
        F.col("r.waste_code").alias("waste_code"), F.col("r.waste_type_name").alias("waste_type_name"), F.coalesce("r.accepts_external_waste", F.lit(True)).alias("accepts_external_waste"),
        F.col("r.address").alias("address"), F.col("r.phones").alias("phones"), safe_double(F.col("r.lat")).alias("lat"), safe_double(F.col("r.lon")).alias("lon"), F.to_json("r").alias("payload"),
    ).select(*[c.split()[0] for c in REGISTRY.split(", ")])


def geocode_json(spark: SparkSession, path: str) -> DataFrame:
    """(address_key, lat, lon) of a JSON map from key to {lat, lon}."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string, struct<lat: double, lon: double>>")).alias("address_key", "at"))
    return pairs.select("address_key", "at.lat", "at.lon").where("lat is not null and lon is not null")


def users_json(spark: SparkSession, path: str) -> DataFrame:
    """Users with an e-mail and a hash; unknown roles become plain users, the last of an e-mail counts."""
    from ..operators.rows import keep_first

    users = spark.read.schema("email string, password_hash string, role string, blocked boolean, created_at string").json(path, multiLine=True).withColumn("_o", F.monotonically_increasing_id())
    good = users.where("trim(email) <> '' and trim(password_hash) <> ''").withColumns({"email": F.lower(F.trim("email")), "role": F.when(F.col("role").isin("user", "admin"), F.col("role")).otherwise("user")})
    return keep_first(good, [F.col("email")], [F.desc("_o")]).drop("_o")


def place_dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tab-separated place-name dump of at least fifteen columns."""
    fields = F.split("value", "\t", -1)
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(F.size(fields) >= 15)
    at = lambda i: F.get(fields, F.lit(i))
    return rows.select(at(1).alias("name"), at(2).alias("ascii_name"), at(3).alias("other_names"), safe_double(at(4)).alias("lat"), safe_double(at(5)).alias("lon"), at(6).alias("feature_class"), at(14).try_cast("long").alias("population"), "ord")


#: Centres of the two boxes' columns, from and to; the height of the boxes below a label's top, and how far off a mark may lie; a mark's sides.
OWN_BOX, EXTERNAL_BOX = (697.0, 706.5), (751.0, 760.5)
BOX_BELOW, BOX_NEAR = 4.5, 7.0
MARK_SIDES = (2.0, 7.2)


def checked_boxes(words: DataFrame, strokes: DataFrame, label: str = "Объект") -> DataFrame:
    """(doc, object_id, accepts) from page geometry.

    ``words``: doc, page, text, x, y (left and top); ``strokes``: doc, page, x0,
    y0, x1, y1 of stroked drawings.  An object's number is the leftmost one that
    stands right of its label on the row, or else the nearest above it.  Small
    strokes in the two columns of boxes are marks; the ones on a label's row say
    whether the second box is ticked, and an object without any has no row.
    Labels, numbers and marks meet page by page of one document, then by nearness.
    """
    from ..operators.rows import keep_first

    page = ["doc", "page"]
    said = F.trim("text")
    labels = words.where(said == label).select(*page, F.col("x").alias("lx"), F.col("y").alias("ly"))
    numbers = words.where(said.rlike(r"^[0-9]{1,6}$") & (said.cast("int") > 0)).select(*page, said.cast("int").alias("object_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    near = labels.join(numbers, page).withColumn("up", F.col("ly") - F.col("ny"))
    on_row = (F.abs("up") <= 3.5) & (F.col("nx") > F.col("lx") + 10)
    above = (F.col("up") >= -1.0) & (F.col("up") <= 90.0) & (F.col("nx") <= 280.0)
    first = [F.when(on_row, 0).otherwise(1), F.when(on_row, F.col("nx")).otherwise(F.col("up")), F.col("nx"), F.col("object_id")]
    chosen = keep_first(near.where(on_row | above), [*map(F.col, page), F.col("lx"), F.col("ly")], first)
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    small = (F.col("x1") - F.col("x0")).between(*MARK_SIDES) & (F.col("y1") - F.col("y0")).between(*MARK_SIDES)
    marks = strokes.where(small).select(*page, mid("x0", "x1").alias("mx"), mid("y0", "y1").alias("my"))
    marks = marks.withColumn("external", F.when(F.col("mx").between(*EXTERNAL_BOX), True).when(F.col("mx").between(*OWN_BOX), False)).where("external is not null")
    ticked = chosen.join(marks, page).where(F.abs(F.col("my") - F.col("ly") - BOX_BELOW) <= BOX_NEAR)
    return ticked.groupBy("doc", "object_id").agg(F.max("external").alias("accepts"))
