"""Secret scans with multipart credential linking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attached, fresh, stored, texts
from .spans import SPANS, summary

#: The base kinds, then those that linking adds.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT = range(6)

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Parts that count only beside complementary ones.  A weak secret has 32 characters or more: digits, capitals and small letters.
_IDENTIFIER = re.compile(r"""(?i:client_?id|account_?id|user(?:name)?|login)["']? *[:=] *["']?([A-Za-z0-9_.@-]{4,})""", re.ASCII)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._:@/-]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base forms, leftmost and non-overlapping for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), ASSIGN, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), ACCESS, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), HEX, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that overlap no base span."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), IDENTIFIER, m.end()) for m in _IDENTIFIER.finditer(text)]
    found += [(m.start(), SECRET, m.end()) for m in _SECRET.finditer(text)]
    if "://" in text:
        found += [(m.start(), ENDPOINT, m.end()) for m in _ENDPOINT.finditer(text)]
    if not found:
        return []
    out, i, upto = [], 0, 0
    for start, kind, end in sorted(found):
        while i < len(taken) and taken[i][0] < end:
            upto = max(upto, taken[i][2])
            i += 1
        if start >= upto:
            out.append((start, kind, end))
    return out


PARSED = f"row_id long, doc_id long, content string, base {SPANS}, weak {SPANS}"


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def parse(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        rows = lambda spans: [{"start": s, "kind": k, "end": e} for s, k, e in spans]
        for b in batches:
            bases, weaks = [], []
            for text in b.column(3).to_pylist():
                base = base_spans(text)
                bases.append(rows(base))
                weaks.append(rows(weak_spans(text, base)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bases, kind), pa.array(weaks, kind)], ["row_id", "doc_id", "content", "base", "weak"])

    rows = texts(docs).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", _digest().alias("content"), "text")
    return rows.mapInArrow(run, PARSED)


#: Which roles a part plays: an access key identifies; assigned and hexadecimal values are secrets.
_ROLE = "case when kind in (1, 3) then 'identifier' when kind = 5 then 'endpoint' else 'secret' end"


def link(parts: DataFrame, scope: int = 400) -> DataFrame:
    """Weak parts that complementary parts lie beside, within ``scope`` code points of one text.

    ``parts``: row_id, start, kind, end, weak.  A weak identifier or endpoint
    needs a secret beside it, a weak secret an identifier or an endpoint.  The
    interval join meets bins of ``scope`` code points: each text's parts are
    reduced to the outermost ones of each role and bin, so a candidate joins at
    most three rows of each role however many parts a scope holds.
    """
    roles = parts.withColumn("role", F.expr(_ROLE)).withColumn("bin", F.expr(f"start div {scope}"))
    bins = roles.groupBy("row_id", "role", "bin").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    reach = bins.select("row_id", F.col("role").alias("other"), "low", "high", F.explode(F.expr("array(bin - 1, bin, bin + 1)")).alias("bin"))
    needed = F.expr("case role when 'secret' then other <> 'secret' else other = 'secret' end")
    near = F.expr(f"(low between start - {scope} and start + {scope}) or (high between start - {scope} and start + {scope})")
    met = roles.where("weak").join(reach, ["row_id", "bin"]).where(needed & near)
    return met.select("row_id", "start", "kind", "end").distinct()


def find(docs: DataFrame, scope: int = 400) -> DataFrame:
    """A row per document: counts and digest of the base spans, and all spans as text.

    Null text counts as empty and has no spans; repeated rows and repeated or
    null doc_ids keep a row apiece.  Spans are in code points, ends exclusive.
    Very long texts are searched whole.  Other columns are not read; an empty
    table gives no rows.
    """
    parsed = stored(parse(docs), "secrets")
    added = link(_parts(parsed), scope)
    return summary(parsed, added, KINDS, 3)


def _parts(parsed: DataFrame) -> DataFrame:
    some = parsed.where("size(weak) > 0")
    strong = some.select("row_id", F.inline("base")).withColumn("weak", F.lit(False))
    return strong.union(some.select("row_id", F.inline("weak")).withColumn("weak", F.lit(True)))


def redacted(docs: DataFrame, scope: int = 400) -> DataFrame:
    """All rows of ``docs`` with each finding in ``text`` replaced by its kind in brackets, ``n_chars`` counted anew.

    Findings that overlap are replaced as one, by the kind of the first.  Spans
    are met again by a digest of the text, since they follow from it alone; the
    table of texts with findings is broadcast only if Spark finds it small.
    """
    parsed = stored(parse(docs), "secrets")
    linked = link(_parts(parsed), scope).join(parsed.select("row_id", "content"), "row_id")
    every = parsed.select("content", F.inline("base")).union(linked.select("content", "start", "kind", "end"))
    of, spans_of = fresh(docs, "secrets_of"), fresh(docs, "secrets")
    found = stored(every.groupBy(F.col("content").alias(of)).agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias(spans_of)), "found")

    @F.pandas_udf("string")
    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans):
            if found is not None and text is not None:
                parts, at = [], 0
                for x in found:
                    if x["start"] >= at:
                        parts += [text[at : x["start"]], f"[{KINDS[x['kind']]}]"]
                    at = max(at, x["end"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    joined = attached(docs, found, _digest(), of).withColumn("text", mask("text", spans_of))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(of).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return joined.select(*docs.columns)
