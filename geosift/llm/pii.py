"""Personal data by bootstrapped contextual extraction.

Entities of a fixed base form are the seeds.  The words around them are
patterns; Spark scores the graph of patterns and instances in rounds, and
patterns of high confidence lead to identifiers that the base form misses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, texts
from .spans import SPANS, summary

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: A match can only begin where a run of digits does: what follows the run is the same from any of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

#: Looser mentions that a pattern may turn into findings.
_NUMBER = re.compile(r"[0-9A-Fa-f]*[0-9][0-9A-Fa-f().:/-]*(?: [0-9(][0-9().:/-]*)*")
_AT = re.compile(r"@|[(\[]at[)\]]")
_WORD = re.compile(r"[^ \t-\r]+")
_GROUPS = re.compile(r"[.:]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base forms, leftmost and non-overlapping for each kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = domain.end()
                found.append((start, EMAIL, last))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGITS.sub("", m[0])
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), CARD, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                    found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def loose_mentions(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of looser mentions outside the base spans, with the kind each could be."""
    found = []
    free, upto = [], 0
    for start, _, end in taken:
        if start > upto:
            free.append((upto, start))
        upto = max(upto, end)
    free.append((upto, len(text)))
    has_digit = _DIGIT.search(text) is not None
    for lo, hi in free:
        for m in _AT.finditer(text, lo, hi):
            start, end = m.start(), m.end()
            while start > lo and not text[start - 1].isspace():
                start -= 1
            while end < hi and not text[end].isspace():
                end += 1
            if start < m.start() and end > m.end() and (not found or found[-1][2] <= start):
                found.append((start, EMAIL, end))
        if has_digit:
            for m in _NUMBER.finditer(text, lo, hi):
                shown = m[0].rstrip(" .:/(-")
                digits = len(_NOT_DIGITS.sub("", shown))
                if digits < 4:
                    continue
                groups = len(_GROUPS.findall(shown))
                kind = IP if groups >= 3 and " " not in shown else CARD if digits >= 12 else PHONE if digits >= 7 else None
                if kind is not None:
                    found.append((m.start(), kind, m.start() + len(shown)))
    return found


def _clean(word: str) -> str:
    return _DIGIT.sub("0", word.strip(".,;:!?\"'()[]").lower())


def contexts(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before a mention and the one after, within 64 characters; "" where there is none."""
    before = [_clean(w) for w in _WORD.findall(text[max(0, start - 64) : start])[-2:]]
    after = _WORD.search(text, end, end + 64)
    return (before[-2] if len(before) > 1 else "", before[-1] if before else "", _clean(after[0]) if after else "")


PARSED = f"row_id long, doc_id long, base {SPANS}, mentions array<struct<start: int, kind: int, end: int, known: boolean, surface: string, patterns: array<string>>>"


def parse(docs: DataFrame) -> DataFrame:
    """Base spans and mentions with their patterns, in one pass over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        mention = pa.struct([*span, ("known", pa.bool_()), ("surface", pa.string()), ("patterns", pa.list_(pa.string()))])
        for b in batches:
            bases, mentions = [], []
            for text in b.column(2).to_pylist():
                base = base_spans(text) if "@" in text or _DIGIT.search(text) else []
                loose = loose_mentions(text, base) if base or _AT.search(text) or _DIGIT.search(text) else []
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                own = []
                for known, spans in ((True, base), (False, loose)):
                    for s, k, e in spans:
                        far, near, after = contexts(text, s, e)
                        patterns = [f"{k}|{far} {near} _"] * bool(far) + [f"{k}|{near} _ {after}"] * bool(near and after)
                        own.append({"start": s, "kind": k, "end": e, "known": known, "surface": xxhash.xxh3_128_hexdigest(text[s:e].lower().encode(errors="surrogatepass")), "patterns": patterns})
                mentions.append(own)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(bases, pa.list_(span)), pa.array(mentions, pa.list_(mention))], ["row_id", "doc_id", "base", "mentions"]
            )

    rows = texts(docs).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    return rows.mapInArrow(run, PARSED)


def bootstrap(mentions: DataFrame, rounds: int = 3, least_support: int = 5, least_confidence: float = 0.8) -> DataFrame:
    """(kind, surface) of instances that confident patterns reach, other than the seeds.

    In each round a pattern's confidence is the mean score of its distinct
    instances, seeds 1 and unknown ones 0; it holds from ``least_support`` known
    instances and ``least_confidence``.  An instance's score is one less the
    product of its patterns' doubts, and it is known from ``least_confidence``.
    Both sides are sums that are pre-aggregated before each shuffle.
    """
    edges = stored(
        mentions.select("kind", "surface", "known", F.explode("patterns").alias("pattern"))
        .groupBy("kind", "surface", "pattern").agg(F.max("known").alias("seed")),
        "pii-edges",
    )
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        patterns = (
            scored.groupBy("pattern")
            .agg(F.avg("score").alias("confidence"), F.sum(F.expr(f"cast(score >= {least_confidence} as long)")).alias("support"))
            .where((F.col("support") >= least_support) & (F.col("confidence") >= least_confidence))
        )
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        instances = edges.join(patterns, "pattern").groupBy("kind", "surface").agg((1 - doubt).alias("reached"))
        new = stored(
            edges.join(instances, ["kind", "surface"], "left").select(
                "kind", "surface", "pattern", "seed",
                F.when(F.col("seed"), 1.0).when(F.col("reached") >= least_confidence, F.col("reached")).otherwise(0.0).alias("score"),
            ),
            "pii-scores",
        )
        drop_stored(scored)
        scored = new
    return scored.where("not seed and score > 0").select("kind", "surface").distinct()


def find(docs: DataFrame, **options) -> DataFrame:
    """A row per document: counts and digest of the base spans, and all spans as text.

    Null text counts as empty and has no spans; repeated rows and repeated or
    null doc_ids keep a row apiece.  Spans are in code points, ends exclusive.
    Very long texts are searched whole; a word of context counts by what lies
    within 64 characters of the mention, and mentions are one instance if they
    are equal but for case, however long.  Other columns are not read; an empty
    table gives no rows.
    """
    parsed = stored(parse(docs), "pii")
    mentions = parsed.select("row_id", F.inline("mentions"))
    reached = bootstrap(mentions, **options)
    added = mentions.where("not known").join(reached, ["kind", "surface"]).select("row_id", "start", "kind", "end")
    return summary(parsed, added, KINDS, len(KINDS))
