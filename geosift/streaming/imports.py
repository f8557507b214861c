"""Incremental imports as streams: every micro-batch is staged, and the register is committed by a cadence."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import replaced_part
from ..plans import fallback
from ..plans.catalog import Catalog
from ..plans.parse import parse
from ..schemas import REGISTRY
from .progress import Cadence, ProgressListener

DOCUMENTS = "doc long, name string, sha256 string, source_part int, text string"


def placed(parsed: DataFrame) -> DataFrame:
    """``parsed`` in order of document and position, with its place: ``_part`` and ``_row`` within it.

    The order is dealt out by ranges, so no task holds all rows; the place counts
    once the rows are written.
    """
    ordered = parsed.repartitionByRange("doc", "pos", "id").sortWithinPartitions("doc", "pos", "id")
    return ordered.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})


def as_registry(parsed: DataFrame, first_pk: int = 1) -> DataFrame:
    """Parsed records in the stored shape; pk follows document and position, from ``first_pk`` on.

    A record's key is its place in its range after the records of the ranges
    before, of which there are as many as partitions.
    """
    rows = parsed if "_row" in parsed.columns else placed(parsed)
    sizes = rows.groupBy("_part").agg((F.max("_row") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = rows.join(F.broadcast(starts), "_part").withColumn("pk", F.col("start") + F.col("_row") + first_pk)  # one row for each partition
    shown = ["id", "owner", "object_name", "waste_code", "waste_type_name", "accepts_external_waste", "address", "phones", "source_part"]
    none = F.lit(None).cast("double")
    return numbered.withColumns({"record_id": F.col("id"), "lat": none, "lon": none, "payload": F.to_json(F.struct(*shown))}).select(*[c.split()[0] for c in REGISTRY.split(", ")])


#: Characters from which one text, or all of an import, count as long.
LONG_TEXT, LONG_IMPORT = 15_000, 20_000


class Importer:
    """Stages batches of documents and commits them to a catalogue's register.

    A batch is written and parsed once; its records wait in the staging folder
    until ``commit``, which replaces each part that they hold by the last batch
    that held it and writes no other part.  Batches are named by number, so one
    that is run again overwrites its own files, and a commit that is run again
    puts the same records in place.

    ``reader`` reads again what the parser could not, at most ``max_calls`` pieces
    a batch; in ``shadow`` it is asked and counted, and its records are left out.
    ``total`` documents, where known, give the time left.
    """

    def __init__(
        self, catalog: Catalog, cadence: Cadence | None = None, reader: fallback.Reader | None = None, max_calls: int = 60, shadow: bool = False,
        total: int | None = None, name: str = "import",
    ) -> None:
        self.catalog, self.cadence, self.reader, self.max_calls, self.shadow, self.total, self.name = catalog, cadence, reader, max_calls, shadow, total, name
        self.counts: dict[str, int] = dict.fromkeys([*fallback.COUNTS, "applied"], 0)

    def _at(self, number: int, what: str) -> str:
        return f"{self.name}/batch={number}/{what}"

    def _note(self, number: int, stage: str, rows: int, seconds: float, done: int | None = None, spent: float | None = None) -> None:
        done, spent = rows if done is None else done, max(seconds if spent is None else spent, 1e-3)
        left = None if self.total is None or not done else int(max(0, self.total - done) / (done / spent))
        self.catalog.add_metrics([{
            "batch": number, "stage": stage, "rows": rows, "seconds": round(seconds, 3), "done": done, "total": self.total, "rows_per_second": round(done / spent, 2), "eta_seconds": left,
        }])

    def observed(self, number: int, rows: int, seconds: float, done: int, spent: float) -> None:
        """A micro-batch has ended: its documents and seconds, and those so far."""
        self._note(number, "batch", rows, seconds, done, spent)
        if self.cadence:
            self.cadence.observed(done, spent)

    def stage(self, docs: DataFrame, number: int = 0) -> dict:
        """Write and parse a batch; what it read, and how long that took."""
        began = time.monotonic()
        read, parsed = Observation("documents"), Observation("parse")
        sizes = [F.count("*").alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("longest")]
        kept = self.catalog.stage(docs.observe(read, *sizes), self._at(number, "documents"))
        at = time.monotonic()
        self._note(number, "read", read.get["rows"], at - began)
        records = parse(kept)
        extra = None
        if self.reader is not None:
            first = self.catalog.stage(records, self._at(number, "first"))
            extra, counts = fallback.second_readings(kept, first, self.reader, lambda df: self.catalog.staged(df), self.max_calls)
            counts["applied"] = 0 if self.shadow else counts["accepted"]
            for c, n in counts.items():
                self.counts[c] += n
            self._note(number, "second reading", counts["calls"], time.monotonic() - at)
            records, at = (first if self.shadow else first.unionByName(extra)), time.monotonic()
        self.catalog.stage(placed(records).observe(parsed, F.count("*").alias("rows")), self._at(number, "records"))
        rows, seconds = parsed.get["rows"], max(time.monotonic() - at, 1e-3)
        self._note(number, "parse", rows, seconds)
        if self.cadence:
            self.cadence.staged(rows)
        told = read.get
        return {
            "records": rows, "documents": told["rows"], "chars": told["chars"], "long_text": told["longest"] > LONG_TEXT, "long_import": told["chars"] > LONG_IMPORT,
            "parse_seconds": seconds, "records_per_second": rows / seconds,
        }

    def commit(self) -> int:
        """Commit all staged batches; how many parts they replaced."""
        began = time.monotonic()
        batches = self.catalog.staged_batches(self.name)
        if not batches:
            return 0
        base = self.catalog.manifest("registry")
        docs = {n: self.catalog.read_staged(self._at(n, "documents")) for n in batches}
        of: dict[int, int] = {}
        for n in batches:
            for r in docs[n].select("source_part").distinct().collect():  # a few parts
                of[r.source_part] = n
        last, merged, details = self.catalog.last_pk(), [], []
        for part, n in sorted(of.items()):
            own = F.col("source_part") == part
            fresh = as_registry(self.catalog.read_staged(self._at(n, "records")).where(own), last + 1)
            merged.append(replaced_part(self.catalog.registry([part]), fresh, part))
            details.append(docs[n].where(own).select("sha256", F.col("source_part").alias("part"), "name"))
            last += 1 << 33  # numbers of different parts never meet, whatever they hold
        self.catalog.replace_registry(reduce(DataFrame.unionByName, merged), reduce(DataFrame.unionByName, details), deduped=True, parts=list(of), base=base)
        self.catalog.unstage()
        self._note(batches[-1], "commit", len(of), time.monotonic() - began)
        if self.cadence:
            self.cadence.committed()
        return len(of)


def import_documents(catalog: Catalog, docs: DataFrame, again: bool = False, **options) -> dict:
    """Parse documents and commit them: each part that they hold is replaced, the others' files stay.

    A set of several files that is the one last imported brings nothing new and is
    skipped, unless ``again`` is set; its report is {"skipped": True, "seconds"}.

    Returns what an import reports: records and characters read, seconds and
    records a second of the parse, seconds in all, whether any text, or all of
    them, are long, and the counts of second readings.  ``options`` are the
    importer's.
    """
    began = time.monotonic()
    if not again and catalog.same_sources([r.sha256 for r in docs.select("sha256").collect()]):  # one row for each source file
        return {"skipped": True, "seconds": time.monotonic() - began}
    importer = Importer(catalog, **options)
    told = importer.stage(docs)
    importer.commit()
    return told | {"seconds": time.monotonic() - began, "second_readings": importer.counts}


def import_stream(
    spark: SparkSession, catalog: Catalog, path: str, checkpoint: str, available_now: bool = True, importer: Importer | None = None, files_per_batch: int | None = None
) -> StreamingQuery:
    """Import Parquet files of documents as they come, and a restart repeats none.

    Each micro-batch commits one version, unless the importer has a cadence: then
    batches are staged, and committed when it says so; what waits at the end is
    for ``importer.commit()``, and nothing is lost if that never comes, since the
    next run of an importer of that name commits it.
    """
    importer = importer or Importer(catalog)
    stream = spark.readStream.schema(DOCUMENTS)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    docs = stream.parquet(path).observe("read", F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))

    def take(batch: DataFrame, number: int) -> None:
        if importer.stage(batch, number)["documents"] and (importer.cadence is None or importer.cadence.due):
            importer.commit()

    writer = docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    run: list[str] = []
    listener = ProgressListener(lambda: run[0] if run else "", importer)
    spark.streams.addListener(listener)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    run.append(query.runId)
    query._progress_listener = listener
    return query


def imported(spark: SparkSession, catalog: Catalog, path: str, checkpoint: str, importer: Importer, files_per_batch: int | None = None) -> int:
    """Run an import to the end of the files there are now, and commit what is left; the number of commits."""
    before = len(catalog.versions("registry"))
    drained(lambda: import_stream(spark, catalog, path, checkpoint, importer=importer, files_per_batch=files_per_batch))
    importer.commit()
    return len(catalog.versions("registry")) - before


def drained(query_of: Callable[[], StreamingQuery]) -> None:
    """Run an available-now query to its end, and take off its listener once all its progress is told."""
    query = query_of()
    query.awaitTermination()
    if listener := getattr(query, "_progress_listener", None):
        spark = SparkSession.active()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        spark.streams.removeListener(listener)
    if query.exception():
        raise query.exception()

