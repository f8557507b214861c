"""Quality rules: text statistics and a hashed n-gram logistic regression with calibrated probabilities."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, small_batches, stored

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\v\f\r"
_CONTINUED = bytes(range(0x80, 0xC0))
#: Buckets of each of the four feature groups: words, word pairs, 3 and 4 characters of text.
BITS, GROUPS = 14, 4
#: Labelled documents, and bytes of their features, that the classifier is fitted on at most: documented bounds, not a share of the corpus.
FIT_ROWS, FIT_BYTES = 2000, 64 << 20
_SEGMENT = 1 << 20


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_ids(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Each word as a dense number, and the distinct words by number."""
    ids = _Ids()
    words = raw.split()
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), list(ids)


def repeated_words(ids: np.ndarray, n_distinct: int, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more, its first place included."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    key, high = ids[:n], n_distinct
    for k in range(1, size):
        if high > (1 << 62) // max(n_distinct, 1):  # numbers would overflow: rank the prefixes anew
            ranks, key = np.unique(key, return_inverse=True)
            high = len(ranks)
        key, high = key * n_distinct + ids[k : k + n], high * n_distinct
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.isin(key, twice)
    marks = np.zeros(len(ids), bool)
    for k in range(size):
        marks[k : k + n] |= at
    return int(marks.sum())


def text_stats(raw: bytes, ids: np.ndarray, n_distinct: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()] if b"\n" in raw else []
    return (
        len(ids),
        len(raw.translate(None, WHITE + _CONTINUED)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, n_distinct),
    )


def features(raw: bytes, ids: np.ndarray, distinct: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(group, buckets) arrays over the whole text: hashed words, word pairs, and n-grams of code points."""
    shift = np.uint64(64 - BITS)
    hashed = np.fromiter(map(crc32, distinct), np.uint64, len(distinct))[ids]
    mix = np.uint64(0x9E3779B97F4A7C15)
    yield 0, (hashed * mix >> shift).astype(np.int32)
    pairs = (hashed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[1:]) * mix >> shift
    yield 1, pairs.astype(np.int32)
    at = np.frombuffer(raw.decode(errors="replace").encode("utf-32-le"), np.uint32)
    low = np.uint32(32 - BITS)
    for s in range(0, len(at), _SEGMENT):
        part = at[s : s + _SEGMENT + 3]
        two = part[:-1] * np.uint32(0x9E3779B1) + part[1:]
        three = two[:-1] * np.uint32(0x85EBCA77) + part[2:]
        yield 2, (three[:_SEGMENT] * np.uint32(0xC2B2AE3D) >> low).astype(np.int32)
        four = three[:-1] * np.uint32(0x27D4EB2F) + part[3:]
        yield 3, (four * np.uint32(0x165667B1) >> low).astype(np.int32)


def sparse(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The text's features: in each group, the share of n-grams that fall in each bucket."""
    ids, distinct = word_ids(raw)
    counts = np.zeros(GROUPS << BITS)
    totals = Counter()
    for group, buckets in features(raw, ids, distinct):
        counts[group << BITS : group + 1 << BITS] += np.bincount(buckets, minlength=1 << BITS)
        totals[group] += len(buckets)
    index = np.flatnonzero(counts)
    return index.astype(np.int32), (counts[index] / np.array([max(totals[g], 1) for g in range(GROUPS)])[index >> BITS]).astype(np.float32)


@dataclass
class Model:
    """Weights of the regression, then slope and intercept that turn its score into a probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    intercept: float = 0.0

    def score(self, raw: bytes, ids: np.ndarray, distinct: list[bytes]) -> float:
        sums, totals = np.zeros(GROUPS), np.zeros(GROUPS)
        for group, buckets in features(raw, ids, distinct):
            sums[group] += self.weights[group << BITS : group + 1 << BITS][buckets].sum(dtype=np.float64)
            totals[group] += len(buckets)
        return float((sums / np.maximum(totals, 1)).sum() + self.bias)

    def probability(self, score: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * score + self.intercept, -50, 50))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Logistic regression by full-batch steps scaled by coordinate, classes weighted alike."""
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i, _ in rows])
    share = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    w, seen, bias, bias_seen = np.zeros(GROUPS << BITS), np.full(GROUPS << BITS, 1e-12), 0.0, 1e-12
    for _ in range(rounds):
        z = np.bincount(owner, w[index] * value, len(rows)) + bias
        off = (_sigmoid(z) - good) * share
        grad = np.bincount(index, off[owner] * value, len(w)) + decay * w
        seen += grad**2
        bias_seen += off.sum() ** 2
        w -= rate * grad / np.sqrt(seen)
        bias -= rate * off.sum() / np.sqrt(bias_seen)
    return Model(w.astype(np.float32), float(bias))


def calibrate(model: Model, scores: np.ndarray, good: np.ndarray, rounds: int = 50) -> Model:
    """Platt scaling on rows that the fit has not seen: Newton steps on slope and intercept."""
    n_good, n_bad = good.sum(), (~good).sum()
    if not n_good or not n_bad:
        return model
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x = np.stack([scores, np.ones(len(scores))])
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(at @ x)
        hess = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        at -= np.linalg.solve(hess, x @ (p - target))
    if at[0] > 0:
        model.slope, model.intercept = float(at[0]), float(at[1])
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model | None:
    """A calibrated model from at most ``fit_rows`` labelled documents, those with the least hashes of doc_id.

    Of rows that repeat a doc_id the one whose text has the least digest counts.
    Documents go by hash until their features reach ``fit_bytes``, so what the
    task that fits holds is bounded, long texts or not; the driver gets the
    model alone.  Every fourth one is held back
    for the calibration.  None when the labels don't hold both classes.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    raw = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    labelled = raw.join(F.broadcast(chosen), "doc_id")  # at most fit_rows rows of two numbers
    once = labelled.groupBy("doc_id", "quality").agg(F.min(F.struct(F.md5("raw"), "raw")).alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sparse(raw) for raw in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1).cast(pa.int32()), *(pa.array([x[k].tobytes() for x in made], pa.binary()) for k in (0, 1))], ["doc_id", "quality", "buckets", "shares"]
            )

    rows = once.select("doc_id", "quality", "least.raw").mapInArrow(run, "doc_id long, quality int, buckets binary, shares binary")
    rows = stored(rows.withColumn("turn", F.xxhash64("doc_id")), "quality-features")
    size = F.sum(F.octet_length("buckets") + F.octet_length("shares")).over(Window.orderBy("turn", "doc_id"))
    within = rows.select("doc_id", size.alias("size")).where(F.col("size") <= fit_bytes).select("doc_id")  # at most fit_rows rows of two numbers
    taken = rows.join(F.broadcast(within), "doc_id").select("doc_id", "quality", "buckets", "shares")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        got = pa.Table.from_batches(held).sort_by("doc_id")
        good = got["quality"].to_numpy() > 0
        made = [(np.frombuffer(i.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32)) for i, v in zip(got["buckets"], got["shares"])]
        held = np.arange(len(made)) % 4 == 3
        if len({*good[~held].tolist()}) < 2:
            return
        model = fit([m for m, h in zip(made, held) if not h], good[~held])
        scores = np.array([float(model.weights[i] @ v) + model.bias for (i, v), h in zip(made, held) if h])
        model = calibrate(model, scores, good[held])
        row = {"weights": model.weights.tobytes(), "bias": model.bias, "slope": model.slope, "intercept": model.intercept}
        yield pa.RecordBatch.from_pylist([row])

    learnt = taken.coalesce(1).mapInArrow(learn, "weights binary, bias double, slope double, intercept double").collect()
    drop_stored(rows)
    return next((Model(np.frombuffer(m.weights, np.float32), m.bias, m.slope, m.intercept) for m in learnt), None)


def judge(raw: bytes, model: Model | None, least_quality: float, least_words: int, most_repeated: int) -> tuple:
    """The statistics, base_failed, quality and kept of one whole text."""
    ids, distinct = word_ids(raw)
    stats = text_stats(raw, ids, len(distinct))
    failed = stats[0] < least_words or 100 * stats[4] > most_repeated * stats[0]
    p = model.probability(model.score(raw, ids, distinct)) if model else None
    return (*stats, failed, p, not failed and (p is None or p >= least_quality))


RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def rules(
    docs: DataFrame,
    labels: DataFrame,
    least_quality: float = 0.5,
    least_words: int = 50,
    most_repeated: int = 50,
    fit_rows: int = FIT_ROWS,
    model: Model | None = None,
) -> DataFrame:
    """Statistics and verdict of every whole document; one narrow pass after the fit.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeated``
    percent of them in repeated windows.  ``quality`` is the calibrated
    probability, null where no model could be fitted (labels of one class or
    none); then only the base rules decide; a tie at ``least_quality`` is kept.
    Null text counts as empty and fails for want of words.  Very long texts are
    read whole, in segments.  Repeated rows, and rows that share a doc_id or
    have none, get a verdict apiece.  Other columns are not read; an empty
    table gives no rows.
    """
    model = model or train(docs, labels, fit_rows)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RULES.split(", ")]
        for b in batches:
            out = [judge(raw, model, least_quality, least_words, most_repeated) for raw in b.column(1).to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return raw.mapInArrow(run, RULES)


def keep_good(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, least_words: int = 50, most_repeated: int = 50, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows whose text passes, whole and unchanged: a filter over the text, without a shuffle."""
    model = train(docs, labels, fit_rows)
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def passes(raws: pd.Series) -> pd.Series:
        return pd.Series([judge(raw, model, least_quality, least_words, most_repeated)[-1] for raw in raws], dtype=bool)

    return docs.where(passes(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
