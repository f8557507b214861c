"""Deduplication, top-k and other row-ordered operators.

Spark keeps no row order, so each takes the columns that order its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text

_TEXT_KEYS = {"waste_code", "owner", "object_name", "address", "phones"}


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key; ``row_number() = 1`` is cut within partitions before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_records(df: DataFrame, key: list[str], order: str = "pk") -> DataFrame:
    """Keep-first by the storage or the search key; text fields are normalised for the comparison."""
    keys = [norm_text(F.col(c)) if c in _TEXT_KEYS else F.col(c) for c in key]
    return keep_first(df, keys, [F.col(order)])


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(max(1, k))


def two_stage_top_k(df: DataFrame, cheap: list[Column], candidates: int, costly: Callable[[DataFrame], DataFrame], final: list[Column], k: int) -> DataFrame:
    """Rank by a cheap measure, add the costly one to ``candidates`` rows only, rank those again."""
    return top_k(costly(top_k(df, cheap, candidates)), final, k)


def backfilled_top_k(ranked: DataFrame, pool: DataFrame, identity: list[str], order: str, k: int) -> DataFrame:
    """``ranked`` (with column rank from 1), filled up to ``k`` from ``pool`` by its order."""
    rest = pool.join(ranked.select(*identity), identity, "left_anti").orderBy(order).limit(k)
    w = Window.orderBy("_block", F.coalesce(F.col("rank"), F.lit(0)), order)  # over 2k rows at most
    both = ranked.withColumn("_block", F.lit(0)).unionByName(
        rest.withColumn("rank", F.lit(None).cast("int")).withColumn("_block", F.lit(1)), allowMissingColumns=True
    )
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_block")


def argmax(df: DataFrame, keys: list[str], score: Column, ties: list[Column]) -> DataFrame:
    """The row of the highest score in each group, ties by the given order."""
    return keep_first(df, [F.col(c) for c in keys], [score.desc(), *ties])


def chunks(df: DataFrame, keys: list[str], order: str, size: int, text: str, sep: str) -> DataFrame:
    """Consecutive rows of a group joined ``size`` at a time: keys, chunk, text."""
    w = Window.partitionBy(*keys).orderBy(order)
    placed = df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return placed.groupBy(*keys, "chunk").agg(F.array_join(items, sep).alias(text))


def runs_collapsed(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before in their group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_last", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_last"))).drop("_last")


def accepted(timed: DataFrame, key: str, ident: str, seconds: int) -> DataFrame:
    """(key, ident, t) of the rows at least ``seconds`` after the last accepted one of their key.

    ``timed``: key, ident, t (microseconds), seed.  A seed row is an earlier
    accepted time of its key; it is no answer itself.  Rows stream through
    sorted partitions, so a key of any size needs the memory of one time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), None
        for b in batches:
            kept = []
            keys, times, seeds = (b.column(i).to_pylist() for i in (0, 2, 3))
            for i, (k, t, seed) in enumerate(zip(keys, times, seeds)):
                if k != now:
                    now, last = k, None
                if seed:
                    last = t
                elif last is None or (t is not None and t - last >= seconds * 1_000_000):
                    last = t
                    kept.append(i)
            yield b.select([0, 1, 2]).take(pa.array(kept, pa.int64()))

    kind = timed.schema[key].dataType.simpleString()
    dealt = timed.select(key, ident, "t", "seed").repartition(key).sortWithinPartitions(key, F.desc("seed"), "t", ident)
    return dealt.mapInArrow(run, f"`{key}` {kind}, `{ident}` long, t long")


def throttled(df: DataFrame, key: str, at: str, ident: str, seconds: int) -> DataFrame:
    """Events at least ``seconds`` after the last *accepted* one of their key.

    Which event is accepted hangs on all before it, so each key's events are
    folded in order of time, ties by id, as they stream through sorted
    partitions.
    """
    timed = df.select(key, F.col(ident).cast("long").alias(ident), F.unix_micros(F.col(at)).alias("t"), F.lit(False).alias("seed"))
    return accepted(timed, key, ident, seconds).select(key, ident)


def within_budget(df: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """Marks (``granted``) the first row of each of the first ``budget`` keys in row order; 0 grants all."""
    firsts = df.groupBy(key).agg(F.min(order).alias("_first"))
    if budget > 0:
        allowed = firsts.orderBy("_first").limit(budget)
    else:
        allowed = firsts
    allowed = allowed.select(F.col(key).alias("_k"), F.col("_first"))
    return df.join(allowed, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_first")), "left").withColumn("granted", F.col("_first").isNotNull()).drop("_k", "_first")
