"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A space after a character that no tokenizer pattern takes for white space.
_SAFE_CUT = re.compile(r"(?<=\S) ")
#: Rows up to which a table of keys is joined plainly: a filter before the join would save less than it costs.
FEW = 1 << 12
#: Bits of a filter at least and at most (8 MB); one too full for its keys lets more rows through, it drops none.
FILTER_BITS = 1 << 15, 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the texts that one Arrow batch holds in a worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as --py-files would; once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_shipped_llm", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for name in [top / "__init__.py", *sorted(Path(__file__).parent.glob("*.py"))]:
            z.write(name, name.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._shipped_llm = True


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, null text as empty; other columns stay unread."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where a column has it already; Spark's names don't tell case apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one only in local mode."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table outlives lost executors; ``drop_stored`` removes it once nothing
    depends on it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # nothing reads the shuffle files of the write once it is over
    try:
        df.select("*").write.parquet(path, partitionBy=list(by) or None)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def maybe_in(keys: DataFrame) -> Callable[[Column], Column]:
    """A filter (Bloom) for the only column of ``keys``: true of every key, null ones too, and of about one in seventy others.

    Spark sets the bits in bitmaps of 32,768; what is broadcast has 16 to 32
    bits a key, and 8 MB at most.  Joins move only the rows that it lets through.
    """
    spark = keys.sparkSession
    small_batches(spark)
    bits = min(max(1 << (16 * keys.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    h = F.xxhash64(keys.columns[0])
    at = keys.select(F.explode(F.array(*(x.bitwiseAND(F.lit(bits - 1)) for x in (h, F.shiftrightunsigned(h, 32))))).alias("at"))
    maps = at.groupBy(F.expr("at div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("at % 32768")).alias("bits"))
    held = np.zeros(bits // 8, np.uint8)
    for part, found in maps.collect():
        held[part * 4096 : (part + 1) * 4096] = np.frombuffer(found, np.uint8)
    shared = spark.sparkContext.broadcast(held.tobytes())

    @F.pandas_udf("boolean")
    def known(hashes: pd.Series) -> pd.Series:
        table, h = np.frombuffer(shared.value, np.uint8), hashes.to_numpy().view(np.uint64)
        low, high = (x & np.uint64(bits - 1) for x in (h, h >> np.uint64(32)))
        return pd.Series((table[low >> np.uint64(3)] >> (low & np.uint64(7)) & table[high >> np.uint64(3)] >> (high & np.uint64(7)) & 1).astype(bool))

    return lambda key: known(F.xxhash64(key))


def attached(docs: DataFrame, found: DataFrame, key: Column, of: str, how: str = "left") -> DataFrame:
    """``docs`` left (or left_anti) joined to ``found`` where ``key`` equals its column ``of``, null ids too; rows that can't meet one stay where they are.

    Where ``found`` has few rows this is the plain join, whose side Spark ships if it is small.
    """
    key = key.cast(found.schema[of].dataType)
    on = lambda rows: rows.join(found, key.eqNullSafe(F.col(of)), how)
    if found.count() <= FEW:
        return on(docs)
    hit = maybe_in(found.select(of))(key)
    none = [] if how == "left_anti" else [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema]
    return docs.where(~hit).select("*", *none).union(on(docs.where(hit)))


def safe_chunks(text: str, limit: int) -> Iterator[str]:
    """Cut a long text at places that the pre-splitting pattern never crosses.

    Between a character that is no white space and a space a match always ends,
    so each chunk yields the same matches as it does inside the whole text.  A
    text without such a place stays whole.
    """
    start = 0
    while len(text) - start > limit:
        cut = _SAFE_CUT.search(text, start + limit)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]
