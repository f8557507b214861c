"""Long repeated substrings over all documents, marked by run-length indexes.

Every window (so many bytes, or so many words) names an anchor: the least hash
of the short strings inside it.  Equal windows name equal anchors at equal
places, so Spark brings together only the surroundings of anchors that occur
more than once, and a run-length index over each such collection finds the
repeats exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, attached, drop_stored, fresh, maybe_in, small_batches, stored
from .runindex import RunIndex, long_repeats

LEAST = 400
#: Words of the shortest passage that counts as one: over fifty.
PASSAGE_WORDS = 51
#: Bytes of surroundings in one index; larger collections are dealt out as pairs of chunks.
CHUNK_BYTES = 2 << 20
#: Bytes from which small collections that share an index close it.
SHARED_BYTES = 3 << 14
_SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_WORD = re.compile(r"[^ \t-\r]+")


def _named(hashes: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(hash, first, last) of each anchor: the first and last of the windows of ``width`` hashes that it names.

    A tie goes to the leftmost place.
    """
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(_MIX[1])
    hashes ^= hashes >> np.uint64(32)
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & _PLACE).astype(np.int64)
    turns = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], turns])
    last = np.concatenate([turns, [len(place)]]) - 1
    return zip(hashes[place[first]].view(np.int64).tolist(), first.tolist(), last.tolist())


class ByteWindows:
    """Windows of ``least`` bytes; a repeat is a string of as many bytes that starts anywhere else."""

    def __init__(self, least: int = LEAST) -> None:
        if least < 8:
            raise ValueError("repeats shorter than 8 bytes aren't looked for")
        self.least = least

    def prepared(self, text: Column) -> Column:
        """The bytes that are searched, as a column; ``normal`` gives the same of one text."""
        return text.cast("binary")

    def normal(self, raw: bytes) -> bytes:
        return raw

    def anchors(self, raw: bytes) -> Iterator[tuple[int, int, int]]:
        """(hash, start, end) of each anchor and of the windows that name it, over the whole text."""
        least = self.least
        grams = max(1, min(4, least // 16))
        size = 8 * grams
        for base in range(0, len(raw) - least + 1, _SEGMENT):
            part = raw[base : base + _SEGMENT + least - 1]
            n = len(part) - size + 1
            words = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,)).astype(np.uint64)
            words *= np.uint64(_MIX[0])
            words ^= words >> np.uint64(32)
            hashes = words[:n].copy()
            for k in range(1, grams):
                hashes += words[8 * k : 8 * k + n] * np.uint64(_MIX[k])
            for h, first, last in _named(hashes, least - size + 1):
                yield h, base + first, base + last + least

    def need(self, index: RunIndex) -> np.ndarray:
        """The length of the window that starts at each position of an index."""
        return np.full(index.n, self.least)

    def cut(self, text: str, gone: list[tuple[int, int]]) -> str:
        """``text`` without the given intervals; a character of which only a part is left goes too."""
        raw, parts, at = text.encode(), [], 0
        for s, e in [*gone, (len(raw), len(raw))]:
            parts.append(raw[at:s].decode(errors="ignore"))
            at = e
        return "".join(parts)


class _Hashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


class WordWindows:
    """Windows of ``words`` whole words; a repeat is a run of as many words that starts anywhere else.

    Words are runs without ASCII white space, and which white space parts them
    makes no difference: what is searched has one space before, between and
    after them, and intervals refer to that.
    """

    GRAM = 8

    def __init__(self, words: int = PASSAGE_WORDS) -> None:
        if words < self.GRAM:
            raise ValueError(f"repeats of fewer than {self.GRAM} words aren't looked for")
        self.words = words
        self.hashes = _Hashes()

    def normal(self, raw: bytes) -> bytes:
        return b" %s " % b" ".join(raw.split())

    def prepared(self, text: Column) -> Column:
        return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, "[ \t-\r]+", " ")), F.lit(" ")).cast("binary")

    def anchors(self, raw: bytes) -> Iterator[tuple[int, int, int]]:
        words = raw.split()
        n = len(words) - self.words + 1
        if n < 1:
            return
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        each = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        for base in range(0, n, _SEGMENT):
            part = each[base : base + _SEGMENT + self.words - 1]
            m = len(part) - self.GRAM + 1
            hashes = part[:m].copy()
            for k in range(1, self.GRAM):
                hashes = hashes * np.uint64(_MIX[0]) + part[k : k + m]
            for h, first, last in _named(hashes, self.words - self.GRAM + 1):
                yield h, int(spaces[base + first]), int(spaces[base + last + self.words]) + 1

    def need(self, index: RunIndex) -> np.ndarray:
        spaces = np.flatnonzero((index.text[: index.n] == 32) & (index.left > 0))
        length = np.full(index.n, index.n + 1)  # longer than any match
        length[spaces[: -self.words]] = spaces[self.words :] - spaces[: -self.words] + 1
        return np.where(length <= index.left, length, index.n + 1)

    def spans_of_words(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """First word and word after the last of each interval."""
        raw = self.normal(text.encode())
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        return [(int(np.searchsorted(spaces, s)), int(np.searchsorted(spaces, e - 1))) for s, e in spans]

    def cut(self, text: str, gone: list[tuple[int, int]]) -> str:
        """``text`` without the words of the given intervals; the white space around them stays."""
        places, parts, at = [m.span() for m in _WORD.finditer(text)], [], 0
        for i, j in self.spans_of_words(text, gone):
            parts.append(text[at : places[i][0]])
            at = places[j - 1][1]
        return "".join([*parts, text[at:]])


Windows = ByteWindows | WordWindows


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _content(docs: DataFrame, windows: Windows) -> DataFrame:
    """Each row's searched bytes with a digest of its text; equal texts fare alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), windows.prepared(text).alias("raw"), _digest(text).alias("content"))


_SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])
_ANCHOR = pa.struct([("h", pa.int64()), ("d", pa.binary()), ("a", pa.int32()), ("z", pa.int32())])
SCANNED = (
    "doc_id long, content binary, n_bytes long, sha256 string, own array<struct<s: int, e: int>>, "
    "anchors array<struct<h: long, d: binary, a: int, z: int>>"
)


def scan(docs: DataFrame, windows: Windows) -> DataFrame:
    """A row per document: digests, its anchors with the extent and a digest of their surroundings.

    Surroundings that the document itself holds twice are marked on the spot and
    given once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, found, sizes, digests = [], [], [], []
            for raw in b.column(1).to_pylist():
                seen: dict[tuple[int, bytes], tuple[int, int]] = {}
                twice: list[tuple[int, int]] = []
                searched = windows.normal(raw)
                for h, a, z in windows.anchors(searched):
                    key = (h, xxhash.xxh3_128_digest(searched[a:z]))
                    if key in seen:
                        twice += [seen[key], (a, z)]
                    else:
                        seen[key] = (a, z)
                own.append([{"s": s, "e": e} for s, e in merged(twice)])
                found.append([{"h": h, "d": d, "a": a, "z": z} for (h, d), (a, z) in seen.items()])
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(own, pa.list_(_SPAN)), pa.array(found, pa.list_(_ANCHOR))],
                ["doc_id", "content", "n_bytes", "sha256", "own", "anchors"],
            )

    return _content(docs, ByteWindows()).mapInArrow(run, SCANNED)


def _cut(docs: DataFrame, by_text: DataFrame, windows: Windows) -> DataFrame:
    """(h, i, j, d, snippet) of the wanted surroundings, cut out of one text that holds each."""
    texts = _content(docs, windows)
    if by_text.count() > FEW:
        texts = texts.where(maybe_in(by_text.select("doc_id"))(texts.doc_id))
    texts = texts.join(
        by_text.select(F.col("content").alias("of"), F.col("doc_id").alias("of_id"), "cuts"),
        F.col("content").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")),
    )
    each = texts.select("raw", F.explode("cuts").alias("k")).select(
        "k.h", "k.d", "k.c", "k.x", F.expr("substring(raw, k.a + 1, k.z - k.a)").alias("snippet")
    )
    return (
        each.withColumn("y", F.explode(F.expr("sequence(0, c - 1)"))).where("c = 1 or x <> y")
        .select("h", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "d", "snippet")
    )


def _index(snippets: DataFrame, windows: Windows) -> DataFrame:
    """(h, d, s, e): the repeats inside each of the surroundings, from an index over each collection.

    Small collections share an index; that only saves work, since a match with
    another collection is a match as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], bytes] = {}
        size, group = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            rows = [(*keys[k], s, e) for k, s, e in long_repeats(list(held.values()), windows.need)]
            if rows:
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["h", "d", "s", "e"])

        for b in batches:
            for h, i, j, d, snippet in zip(*(c.to_pylist() for c in b.columns)):
                if (h, i, j) != group:
                    if size >= min(SHARED_BYTES, CHUNK_BYTES // 2):
                        yield from flush()
                        held, size = {}, 0
                    group = (h, i, j)
                if (h, d) not in held:
                    held[h, d] = snippet
                    size += len(snippet)
        yield from flush()

    keys = ["h", "i", "j"]
    return snippets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "h long, d binary, s int, e int")


def repeats(docs: DataFrame, windows: Windows) -> tuple[DataFrame, DataFrame]:
    """The scanned documents, and (content, doc_id, spans) of every text with repeats.

    doc_id names one row that holds the text.  Spans are byte intervals of what
    is searched, merged, end exclusive: exactly the bytes that a window covers
    which also starts anywhere else in the table, in the same text included.
    """
    small_batches(docs.sparkSession)
    scanned = stored(scan(docs, windows), "scanned")
    every = scanned.select("content", "doc_id", F.inline("anchors"))
    twice = stored(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    # most anchors occur once, and the filter keeps those where they are
    placed = every.where(maybe_in(twice)(every.h))
    kinds = placed.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(F.struct("content", "doc_id", "a", "z")).alias("at"))
    shared = kinds.groupBy("h").agg(
        F.count("*").alias("variants"), F.sum("n").alias("places"), F.min("n").alias("rarest"), F.sum(F.expr("at.z - at.a")).alias("size")
    ).where("places > 1")
    known = stored(kinds.join(shared, "h").select("h", "d", "n", "at.*", "variants", "rarest", "size"), "anchors")
    # surroundings that occur twice are repeats from end to end, so only collections that hold others need an index
    wanted = known.where("variants > 1 and rarest = 1").withColumn("c", F.expr(f"cast(ceil(size / {CHUNK_BYTES}) as int)"))
    wanted = wanted.withColumn("x", F.expr("cast(pmod(xxhash64(d), c) as int)"))
    by_text = stored(wanted.groupBy("content", "doc_id").agg(F.collect_list(F.struct("h", "d", "a", "z", "c", "x")).alias("cuts")), "cuts")
    inside = _index(_cut(docs, by_text, windows), windows)
    whole = known.where("n > 1").select("h", "d", F.lit(0).alias("s"), F.expr("z - a").alias("e"))
    marks = stored(inside.union(whole), "marks")
    for done in (known, twice, by_text):
        drop_stored(done)
    at = placed.join(marks, ["h", "d"]).select("content", "doc_id", F.expr("a + s").alias("s"), F.expr("a + e").alias("e"))
    spans = at.union(scanned.select("content", "doc_id", F.inline("own"))).groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.collect_set(F.struct("s", "e")).alias("spans"))
    return scanned, spans


def _runs(spans: Iterable[dict] | None) -> list[tuple[int, int]]:
    return merged([(x["s"], x["e"]) for x in spans]) if spans is not None else []


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes are gone, and in how many runs."""
    parts, at = [], 0
    for s, e in gone:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]]), sum(e - s for s, e in gone), len(gone)


def digests(docs: DataFrame, least: int = LEAST, words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words) of every document.

    The first columns tell what removing every repeated string of ``least``
    bytes does.  n_passages and passage_words count the runs of ``words`` words
    or more that also start elsewhere, and their words, whatever their bytes;
    nothing is removed for those alone.

    Null text counts as empty; texts shorter than ``least`` lose nothing; exact
    copies of longer ones lose everything.  Very long texts are searched whole,
    in segments.  Repeated rows, which are copies too, keep a row apiece, and
    so do rows without a doc_id.  Each distinct text is cut once.  Other columns
    are not read; an empty table gives no rows.
    """
    by_words = WordWindows(words)
    scanned, bytes_found = repeats(docs, ByteWindows(least))
    passages_scanned, words_found = repeats(docs, by_words)
    found = stored(
        bytes_found.join(words_found.select("content", F.col("doc_id").alias("id2"), F.col("spans").alias("passages")), "content", "full").select(
            F.col("content").alias("of"), F.coalesce("doc_id", "id2").alias("of_id"), "spans", "passages"
        ),
        "repeats",
    )
    drop_stored(passages_scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content, raw, spans, passages in zip(*(c.to_pylist() for c in b.columns)):
                kept, n_removed, n_spans = _kept(raw, _runs(spans))
                runs = by_words.spans_of_words(raw.decode(), _runs(passages)) if passages else []
                rows.append((content, n_removed, n_spans, hashlib.sha256(kept).hexdigest(), len(runs), sum(j - i for i, j in runs)))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["of", *_CUT])

    texts = _content(docs, ByteWindows(least)).join(found, F.col("content").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    cut = texts.select("content", "raw", "spans", "passages").mapInArrow(run, "of binary, n_removed long, n_spans long, kept string, n_passages long, passage_words long")
    cut = cut.groupBy("of").agg(*(F.first(c).alias(c) for c in _CUT))  # several rows if a doc_id repeats with its text
    none = F.lit(0).cast("long")
    return scanned.select("doc_id", "content", "n_bytes", "sha256").join(cut, F.col("content") == F.col("of"), "left").select(
        "doc_id", "n_bytes", *(F.coalesce(c, none).alias(c) for c in _CUT[:2]), F.coalesce("kept", "sha256").alias("kept_sha256"), *(F.coalesce(c, none).alias(c) for c in _CUT[3:])
    )


_CUT = ("n_removed", "n_spans", "kept", "n_passages", "passage_words")


def deduplicated(docs: DataFrame, windows: Windows | None = None) -> DataFrame:
    """All rows of ``docs`` with the repeats gone from ``text``, ``n_chars`` counted anew.

    By default passages of over fifty words go.  Rows stay even where nothing
    is left of the text; null texts stay null; every copy of a repeat goes.
    Other columns stay as they are, whatever their names; an empty table gives
    no rows.
    """
    windows = windows or WordWindows()
    _, spans = repeats(docs, windows)
    of, gone_of = fresh(docs, "repeats_of"), fresh(docs, "repeats")
    found = stored(spans.select(F.col("content").alias(of), F.col("spans").alias(gone_of)), "repeats")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = [t if t is None or g is None else windows.cut(t, _runs(g)) for t, g in zip(texts, gone)]
        return pd.Series(out, dtype=object)

    joined = attached(docs, found, _digest(F.coalesce(F.col("text"), F.lit(""))), of).withColumn("text", cut("text", gone_of))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(of).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return joined.select(*docs.columns)
