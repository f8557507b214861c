"""Second readings of texts that the parser could not read: which texts, in what chunks, and which answers hold.

The reader itself (a language model, a person) is a function from chunks to rows
that runs where the caller says; none is built in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import patterns as P
from ..functions.text import clean_text, merged_phones, safe_int
from ..operators.rows import chunks
from ..operators.segments import segmented
from .parse import lines

LEAST_CHARS = 1500

#: A reader: (doc, chunk, text) to (doc, chunk, payload), payload a JSON object {"records": [...]}, null or absent where it failed.
Reader = Callable[[DataFrame], DataFrame]
#: Fields of a record in a payload.
ANSWER = (
    "waste_code string, waste_name string, object_name string, owner_name string, user_address string, user_phone string, "
    "object_id string, owner_address string, owner_phone string, accepts_from_others boolean"
)
COUNTS = ("calls", "success", "fail", "accepted", "rejected")


def needed(docs: DataFrame, records: DataFrame) -> DataFrame:
    """Documents (doc, text) without a record, long enough, that name an object and hold a seven-digit run."""
    plain = clean_text(F.col("text"))
    likely = (F.length(plain) >= LEAST_CHARS) & plain.rlike(rf"{P.I}объект") & plain.rlike(r"(?<!\d)\d{7}(?!\d)")
    return docs.join(records.select("doc").distinct(), "doc", "left_anti").where(likely)


def pieces(lines: DataFrame, size: int = 2) -> DataFrame:
    """(doc, chunk, text): the lines' segments, ``size`` at a time between separator lines, without footers.

    ``lines``: doc, seg, pos, line.
    """
    rows = lines.where(~X.noise_line(F.col("line"))).groupBy("doc", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return chunks(rows.select("doc", "seg", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")), ["doc"], "seg", size, "text", "\n---\n")


def asked(docs: DataFrame, records: DataFrame, max_calls: int, size: int = 2) -> DataFrame:
    """(doc, source_part, chunk, text): the first ``max_calls`` pieces of the documents that need a second reading, in their order."""
    rows = lines(needed(docs, records))
    each = pieces(segmented(rows, ["doc"], "pos", X.code_line(F.col("line")).isNotNull(), "seg"), size)
    few = each.orderBy("doc", "chunk").limit(max(0, max_calls))
    return few.join(docs.select("doc", "source_part"), "doc")


def tagged(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """Each call's rows with their outcome: (doc, source_part, chunk, pos, read, holds, and the fields of an answer).

    ``calls``: doc, source_part, chunk; ``answers``: doc, chunk, payload.  A call
    whose payload is absent or no JSON object with a list of records has failed:
    one row, ``read`` false.  A call without records has one row as well, ``holds``
    null.  Otherwise there is a row for each record, and ``holds`` tells whether
    it is sound.
    """
    shape = f"struct<records: array<struct<{', '.join(f.replace(' ', ': ') for f in ANSWER.split(', '))}>>>"
    payload = answers.select("doc", "chunk", "payload").dropDuplicates(["doc", "chunk"])
    sound = F.try_parse_json("payload").isNotNull() & F.col("payload").rlike(r"^\s*\{")
    read = calls.join(payload, ["doc", "chunk"], "left").withColumn("_got", F.when(sound, F.from_json("payload", shape)["records"]))
    each = read.select("doc", "source_part", "chunk", F.col("_got").isNotNull().alias("read"), F.posexplode_outer("_got").alias("pos", "r"))
    flat = each.select("doc", "source_part", "chunk", "pos", "read", *(F.col(f"r.{f.split()[0]}").alias(f.split()[0]) for f in ANSWER.split(", ")))
    return flat.withColumn("holds", F.when(F.col("pos").isNotNull(), F.coalesce(_sound(), F.lit(False))))


def counters() -> list:
    """Aggregates over ``tagged`` rows: calls, success, fail, accepted, rejected."""
    first = F.coalesce("pos", F.lit(0)) == 0
    tests = {"calls": first, "success": first & F.col("read"), "fail": first & ~F.col("read"), "accepted": F.coalesce("holds", F.lit(False)), "rejected": ~F.coalesce("holds", F.lit(True))}
    return [F.count_if(tests[c]).alias(c) for c in COUNTS]


def second_readings(docs: DataFrame, records: DataFrame, reader: Reader, kept: Callable[[DataFrame], DataFrame], max_calls: int) -> tuple[DataFrame, dict[str, int]]:
    """Records of second readings, and the counts of calls and rows.

    ``kept`` writes a DataFrame and reads it back, so that the reader is asked
    once; the counts come out of that one pass.  The records have a null id where
    the answer does, and place (doc, pos) after all first readings of a document.
    """
    seen = Observation("second reading")
    calls = kept(asked(docs, records, max_calls))
    rows = kept(tagged(calls, reader(calls.select("doc", "chunk", "text"))).observe(seen, *counters()))
    found = validated(rows.where("holds")).withColumn("pos", F.col("_place")).drop("_place")
    return found, {c: int(n) for c, n in seen.get.items()}


def _code():
    return F.regexp_replace(clean_text(F.col("waste_code")), r"\s", "")


def _sound():
    return _code().rlike(r"^\d{7}$") & safe_int(F.col("object_id")).between(1, 999_999)


def validated(answers: DataFrame) -> DataFrame:
    """Records of the answers that hold: a seven-digit code, an id of 1 to 999999; blank fields filled, phones merged."""
    code, ident = _code(), safe_int(F.col("object_id"))
    text = lambda c: clean_text(F.col(c))
    some = lambda c: F.when(text(c) != "", text(c))
    good = answers.where(_sound())
    place = [] if "chunk" not in answers.columns else ["doc", (F.lit(1 << 30) + F.col("chunk") * 1000 + F.col("pos")).cast("int").alias("_place")]
    return good.select(
        *place, "source_part", ident.alias("id"), text("owner_name").alias("owner"), F.coalesce(some("object_name"), F.lit("—")).alias("object_name"), code.alias("waste_code"),
        F.coalesce(some("waste_name"), F.lit("—")).alias("waste_type_name"), F.coalesce("accepts_from_others", F.lit(True)).alias("accepts_external_waste"),
        F.coalesce(some("owner_address"), text("user_address")).alias("address"), merged_phones(F.col("owner_phone"), F.col("user_phone")).alias("phones"),
    )
