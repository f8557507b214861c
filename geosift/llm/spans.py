"""Span columns that the scanning operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans as stored: code points, end exclusive; kind is the place in the operator's list of kinds.
SPANS = "array<struct<start: int, kind: int, end: int>>"


def rendered(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == F.lit(kind))).cast("long")


def summary(parsed: DataFrame, added: DataFrame, kinds: tuple[str, ...], n_base: int) -> DataFrame:
    """A row per document: counts and digest of the base spans, and all spans.

    ``parsed``: row_id, doc_id, base; ``added``: row_id, start, kind, end of spans
    that the method found besides.  A document's own spans are gathered, which
    its text bounds; nothing wider is.
    """
    extra = added.groupBy("row_id").agg(F.collect_set(F.struct("start", "kind", "end")).alias("extra"))
    both = parsed.select("row_id", "doc_id", "base").join(extra, "row_id", "left")
    base = F.col("base")
    everything = F.array_distinct(F.concat(base, F.coalesce("extra", F.array().cast(SPANS))))
    return both.select(
        "doc_id",
        *(counted(base, i).alias(f"n_{kinds[i]}") for i in range(n_base)),
        F.sha2(rendered(base, kinds), 256).alias("base_sha256"),
        rendered(everything, kinds).alias("spans"),
    )
