"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

#: Hash buckets for the n-grams of 1 to 4 characters: two to this power, fewer where many languages would make the matrix large.
BITS, LEAST_BITS = 15, 8
#: Bytes that the matrix of log probabilities may have, in the driver and as a broadcast.
MATRIX_BYTES = 64 << 20
#: Languages whose counts a task holds at once.
HELD = 64
UNKNOWN = "und"
_SEGMENT = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit: the checksum of its id as text leaves 2 by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of ASCII signs, digits and white space as one space, one in front."""
    at = np.frombuffer((" " + text.lower()).encode("utf-32-le", "replace"), np.uint32)
    letter = (at >= 128) | ((at >= 97) & (at <= 122))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, at, np.uint32(32))[keep]


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """How many of the whole text's n-grams of 1 to 4 characters fall in each bucket."""
    at = _characters(text)
    out = np.zeros(1 << bits, np.int64)
    low = np.uint32(32 - bits)
    for s in range(0, len(at), _SEGMENT):
        part = at[s : s + _SEGMENT + 3]
        gram = part * _MIX[0]
        for n in range(4):
            if n:
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * _MIX[n] + part[n:] * _MIX[0]
            out += np.bincount(((gram[:_SEGMENT] ^ (gram[:_SEGMENT] >> np.uint32(13))) * _MIX[2] >> low).astype(np.int32), minlength=1 << bits)
    return out


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


@dataclass
class Model:
    """Languages in order, the logarithms of their shares, and of each bucket's chance in each: buckets by languages."""

    langs: list[str]
    prior: np.ndarray
    matrix: np.ndarray
    bits: int

    @classmethod
    def of(cls, langs: list[str], documents: np.ndarray, seen: np.ndarray, bits: int) -> Model:
        """From the documents of each language and its n-grams in each bucket (languages by buckets), one added to each."""
        chance = (seen + 1.0) / (seen.sum(1, keepdims=True) + seen.shape[1])
        return cls(langs, np.log(documents / documents.sum()), np.log(chance).T.astype(np.float32), bits)

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest language, ties to the first by name, and its probability."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        seen = counts(text, self.bits)
        at = np.flatnonzero(seen)
        z = seen[at].astype(np.float64) @ self.matrix[at].astype(np.float64) + self.prior
        best = int(z.argmax())
        return self.langs[best], float(1 / np.exp(z - z[best]).sum())


def bits_for(langs: int) -> int:
    """As many bits, up to ``BITS``, as keep the matrix within ``MATRIX_BYTES``."""
    for bits in range(BITS, LEAST_BITS - 1, -1):
        if 4 * max(langs, 1) << bits <= MATRIX_BYTES:
            return bits
    raise ValueError(f"{langs} languages need a matrix of over {MATRIX_BYTES} bytes")


def fit(docs: DataFrame, label: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Naive Bayes from the text and label of every document that has both and is not held out.

    Each task sums its documents' n-grams by language and bucket, so that what is
    shuffled and collected is one number for each language and bucket, whatever
    the number of documents.  Texts without a letter teach nothing.  No documents
    give a model without languages.  ``ValueError`` if the labels are so many
    (over 65,536) that even the smallest matrix would pass ``MATRIX_BYTES``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col(label).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))).select("lang", "text")
    most = known.select("lang").distinct().count()
    bits = bits_for(most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (n, seen) in held.items():
                at = np.flatnonzero(seen)
                where, what = np.append(at, -1), np.append(seen[at], n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(what, pa.int64())], ["lang", "bucket", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not has_letter(text):
                    continue
                if lang not in held:
                    if len(held) == HELD:
                        yield from flush()
                        held = {}
                    held[lang] = [0, np.zeros(1 << bits, np.int64)]
                held[lang][0] += 1
                held[lang][1] += counts(text, bits)
        yield from flush()

    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # one row a language and bucket
    langs = sorted(set(sums["lang"]))
    row = sums["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(np.int64)
    bucket, n = sums["bucket"].to_numpy(np.int64), sums["n"].to_numpy(np.int64)
    documents, seen = np.ones(len(langs)), np.zeros((len(langs), 1 << bits))
    whole = bucket < 0
    documents[row[whole]] = n[whole]
    seen[row[~whole], bucket[~whole]] = n[~whole]
    return Model.of(langs, documents, seen, bits)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Every row of ``docs``, all its columns, with the language found and its probability.

    The matrix, of at most ``MATRIX_BYTES``, is broadcast.  Only the text is read
    for a prediction.  A null text and one without a letter get ``und`` and 0, as
    any text does if no language was learned; where ``docs`` has columns of the
    new names, the new ones get an underscore at the end.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(model)
    lang, score = fresh(docs, lang), fresh(docs, score)
    shape = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{lang}` string, `{score}` double"])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [known.value.predict(t or "") for t in b.column(at).to_pylist()]
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, langs, scores], [*b.schema.names, lang, score])

    return docs.mapInArrow(run, shape)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a model of the documents that are not held out.

    Repeated rows are rows of their own; texts are read whole; a null doc_id is
    not held out; an empty table gives no rows; other columns are not read.
    """
    model = fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
