"""Versioned tables: each commit is a manifest that names the files of every part of a table.

A write adds files and then a manifest, so readers see the old version whole
until then, and a failed write changes nothing.  A commit that touches some parts
writes those parts only and names the others' files again.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import signature
from ..schemas import META, REGISTRY, STORAGE_KEY
from ..operators.rows import dedupe_records

#: Seconds that a manifest may take to be written before it counts as left behind by a lost writer.
MANIFEST_SECONDS = 5.0
WHOLE = "all"


class Conflict(RuntimeError):
    """Another writer has committed a part since this one read it."""


class Catalog:
    """A register, its meta row, its geocode cache and the metrics of imports under one root, in any store that Spark writes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, name: str) -> list[str]:
        fs, at = self._fs(), self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _put(self, name: str, text: str) -> bool:
        """Create a small file; False if there is one of that name."""
        try:
            out = self._fs().create(self._path(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _manifest(self, table: str, version: int) -> dict | None:
        """Part to {"at": folder, "last": greatest key}; None while the manifest is not whole."""
        stream = self._fs().open(self._path(f"{table}/_committed/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def versions(self, table: str) -> list[int]:
        """Committed versions, oldest first."""
        return [v for v in sorted(int(n) for n in self._names(f"{table}/_committed") if n.isdigit()) if self._manifest(table, v) is not None]

    def manifest(self, table: str) -> dict:
        """The parts of the current version; none before the first."""
        for v in sorted((int(n) for n in self._names(f"{table}/_committed") if n.isdigit()), reverse=True):
            if (parts := self._manifest(table, v)) is not None:
                return parts
        return {}

    def _commit(self, table: str, change: dict[str, dict | None], base: dict | None) -> int:
        """Add a manifest with ``change``; parts that others have committed meanwhile stay theirs.

        ``base``: the manifest that the change was worked out from; if one of the
        changed parts is another by now, ``Conflict``.  None replaces all parts.
        """
        waited = 0.0
        while True:
            numbers = sorted(int(n) for n in self._names(f"{table}/_committed") if n.isdigit())
            latest = max(numbers, default=0)
            if latest and self._manifest(table, latest) is None and waited < MANIFEST_SECONDS:
                time.sleep(0.1)
                waited += 0.1
                continue
            now = self.manifest(table)
            if base is not None and any(now.get(p) != base.get(p) for p in change):
                raise Conflict(f"{table}: {sorted(change)}")
            parts = {p: f for p, f in ((now if base is not None else {}) | change).items() if f}
            if self._put(f"{table}/_committed/{latest + 1}", json.dumps(parts)):
                return latest + 1

    def write(self, df: DataFrame, table: str) -> int:
        """A new version of a table without parts."""
        at = f"commit=w{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{table}/{at}")
        return self._commit(table, {WHOLE: {"at": at}}, None)

    def write_parts(self, df: DataFrame, table: str, by: str, parts: list[int] | None, base: dict | None, key: str = "pk") -> int:
        """A new version in which the given parts (None: all) hold the rows of ``df``; only these are written."""
        at, seen = f"commit=w{uuid.uuid4().hex}", Observation("written")
        last = {str(p): F.max(F.when(F.col(by) == p, F.col(key))).alias(f"p{p}") for p in parts or []}
        df.observe(seen, F.max(key).alias("any"), *last.values()).write.parquet(f"{self.root}/{table}/{at}", partitionBy=[by])
        known = seen.get
        written = {n.split("=", 1)[1]: {"at": f"{at}/{n}", "last": known.get(f"p{n.split('=', 1)[1]}", known["any"])} for n in self._names(f"{table}/{at}") if n.startswith(f"{by}=")}
        change = written if parts is None else {str(p): written.get(str(p)) for p in parts}
        return self._commit(table, change, base if parts is not None else None)

    def read(self, table: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        """The current version, or some parts of it; an empty table where there is none."""
        found = [f["at"] for p, f in self.manifest(table).items() if parts is None or p in map(str, parts)]
        if not found:
            return self.spark.createDataFrame([], schema)
        names = [c.name for c in self.spark.createDataFrame([], schema).schema]
        paths = [f"{self.root}/{table}/{at}" for at in found]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*names)

    def clear(self) -> None:
        for table in ("registry", "meta", "geocodes"):
            self._fs().delete(self._path(f"{table}/_committed"), True)

    def prune(self, table: str, keep: int = 2) -> None:
        """Delete all but the last versions, and the files that only they name."""
        versions = self.versions(table)
        old, live = versions[:-keep], {f["at"] for v in versions[-keep:] for f in self._manifest(table, v).values()}
        gone = {f["at"] for v in old for f in self._manifest(table, v).values()} - live
        for v in old:
            self._fs().delete(self._path(f"{table}/_committed/{v}"), False)
        for at in gone:
            self._fs().delete(self._path(f"{table}/{at}"), True)

    def add_metrics(self, rows: list[dict]) -> None:
        """Append metrics of an import, a small file for each call."""
        self._put(f"metrics/{time.time_ns()}-{uuid.uuid4().hex}.json", "".join(json.dumps(r) + "\n" for r in rows))

    def metrics(self, schema: str) -> DataFrame:
        if not self._names("metrics"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/metrics")

    def staged(self, df: DataFrame) -> DataFrame:
        """``df`` written beside the tables and read back, until ``unstage``."""
        return self.stage(df, f"_own/{uuid.uuid4().hex}")

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written under a name of its own beside the tables, over what was there, and read back."""
        at = f"{self.root}/_staged/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def read_staged(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_staged/{name}")

    def staged_batches(self, name: str) -> list[int]:
        """Numbers of the batches that are staged whole, in order."""
        found = (n.split("=", 1)[1] for n in self._names(f"_staged/{name}") if n.startswith("batch="))
        return sorted(int(n) for n in found if "_SUCCESS" in self._names(f"_staged/{name}/batch={n}/records"))

    def unstage(self) -> None:
        self._fs().delete(self._path("_staged"), True)

    def registry(self, parts: list[int] | None = None) -> DataFrame:
        return self.read("registry", REGISTRY, parts)

    def last_pk(self) -> int:
        """The greatest key of the register, from its manifest."""
        return max((f.get("last") or 0 for f in self.manifest("registry").values()), default=0)

    def replace_registry(self, records: DataFrame, details: DataFrame, deduped: bool = False, parts: list[int] | None = None, base: dict | None = None) -> None:
        """Replace all records, or those of some parts, and the meta row; ``details``: sha256, part, name of each source.

        ``base`` is the manifest that ``records`` were worked out from, for a replacement of parts.
        """
        rows = records if deduped else dedupe_records(records, STORAGE_KEY)
        shaped = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in REGISTRY.split(", ")])
        self.write_parts(shaped, "registry", "source_part", parts, (self.manifest("registry") if base is None else base) if parts is not None else None)
        by_part = F.array_sort(F.collect_list(F.struct("part", "name", "sha256")))
        meta = details.agg(signature(F.col("sha256")).alias("source_signature"), by_part.alias("d"))
        self.write(
            meta.select(
                F.lit(1).alias("id"), F.lit(2).alias("version"), "source_signature", F.array_sort(F.array_distinct(F.transform("d", lambda x: x["name"]))).alias("sources"),
                F.transform("d", lambda x: F.struct(x["sha256"].alias("sha256"), x["part"].alias("part"), x["name"].alias("name"))).alias("import_sources_detail"),
                F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("updated_at"),
            ),
            "meta",
        )

    def meta(self) -> DataFrame:
        """The meta row with the counts of all, accepting and own-only records, in one pass; no row before an import."""
        flag = F.col("accepts_external_waste")
        stats = self.registry().agg(F.count("*").alias("total"), F.count_if(flag).alias("accepting"), F.count_if(~flag).alias("own_only"))
        return self.read("meta", META).crossJoin(stats)  # two single rows

    def same_sources(self, digests: list[str]) -> bool:
        """Whether an import of several files would bring nothing new: their digests are the stored ones."""
        if len(digests) < 2 or self.registry().isEmpty():
            return False
        stored = self.read("meta", META).select(F.inline("import_sources_detail")).select("sha256")
        return sorted(r.sha256 for r in stored.collect()) == sorted(digests)  # one row for each source file


#: Fields of a record, as a payload holds them.
RECORD = "id string, owner string, object_name string, waste_code string, waste_type_name string, accepts_external_waste boolean, address string, phones string, source_part int, lat double, lon double"


def as_records(registry: DataFrame) -> DataFrame:
    """(pk and the fields of a record): a payload that is a JSON object wins over the columns, as a whole.

    The id is the payload's if it is a whole number, else record_id, else pk.
    What a payload lacks is null; any other payload counts as none.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]
    given = F.col("payload")
    whole = F.when(given.rlike(r"^\s*\{") & F.try_parse_json(given).isNotNull(), F.from_json(given, RECORD))
    columns = F.struct(*[(F.col("record_id").cast("string") if c == "id" else F.col(c)).cast(t).alias(c) for c, t in (f.split() for f in RECORD.split(", "))])
    record = F.coalesce(whole, columns)
    rows = registry.select("pk", "record_id", record.alias("r"))
    number = F.when(F.trim("r.id").rlike(r"^[+-]?[0-9]+$"), F.trim("r.id").try_cast("int"))
    ident = F.coalesce(number, F.col("record_id"), F.col("pk").cast("int"))
    return rows.select("pk", ident.alias("id"), *[F.col(f"r.{c}").alias(c) for c in names[1:]])
