"""Source divergence audit: how far the words of each source of a language stray from the others' and from the language's."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count as numbers
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Terms by group that a task indexes in memory before it spills a run.
BLOCK_TERMS = 1 << 18
#: Postings of one piece of a run; a merge holds about one piece of each run in memory, and at least ``MERGED`` postings.
PIECE, MERGED = 2048, 1 << 17
#: Documents of a language that a kept term occurs in at least.
LEAST_DOCUMENTS = 3
#: Ranks of the terms of a group.
TERM_RANKS = 200
BILLION = 1_000_000_000
#: Pairs of sources that are worked on at once, and sums of pairs that a task holds.
PAIRS, SUMS = 1 << 19, 1 << 20
#: Sources of one part of the partners of a source.
PARTNERS = 256
_SEGMENT = 1 << 20
#: A to Z to lower case, other ASCII but a to z to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RUNS = "shard int, lang string, first binary, sources array<string>, terms binary, at array<int>, counts array<long>, docs array<long>"
POSTINGS = "lang string, term string, source string, count long, total long"


def terms(text: str) -> Iterator[list[bytes]]:
    """The text's terms in order, a list for each part of about a million bytes."""
    raw = text.encode().translate(_FOLD)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + _SEGMENT)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


class Block:
    """Postings of the documents read since the last spill: for each (lang, source), occurrences and documents of each term."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, lang: str, source: str, text: str) -> None:
        counts, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
        own: set[bytes] = set()
        for part in terms(text):
            counts.update(part)
            own.update(part)
        docs.update(own)

    def __len__(self) -> int:
        return sum(len(counts) for counts, _ in self.groups.values())

    def runs(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The postings in order of term, a run for each shard and language, in pieces."""
        langs: dict[str, list[str]] = {}
        for lang, source in self.groups:
            langs.setdefault(lang, []).append(source)
        for lang, sources in langs.items():
            groups = [self.groups[lang, source] for source in sources]
            words = sorted(set().union(*(counts for counts, _ in groups)))
            if not words:
                continue
            rank = {word: i for i, word in enumerate(words)}
            dealt = np.fromiter((crc32(word) % shards for word in words), np.int64, len(words))
            of = lambda each: np.concatenate([np.fromiter(each(*group), np.int64, len(group[0])) for group in groups])
            code = of(lambda counts, _: map(rank.__getitem__, counts))
            at = np.repeat(np.arange(len(groups)), [len(counts) for counts, _ in groups])
            order = np.argsort((dealt[code] * len(words) + code) * len(groups) + at)
            n, n_docs = of(lambda counts, _: counts.values())[order], of(lambda counts, docs: map(docs.__getitem__, counts))[order]
            code, at = code[order], at[order]
            turns = [0, *(np.flatnonzero(np.diff(dealt[code])) + 1).tolist(), len(code)]
            rows = []
            for begin, end in zip(turns, turns[1:]):
                for s in range(begin, end, PIECE):
                    own = slice(s, min(s + PIECE, end))
                    used, place = np.unique(at[own], return_inverse=True)
                    terms_of = [words[i] for i in code[own].tolist()]
                    rows.append((
                        int(dealt[code[s]]), lang, terms_of[0], [sources[i] for i in used.tolist()], b" ".join(terms_of),
                        place.astype(np.int32), n[own], n_docs[own],
                    ))
            kinds = [pa.int32(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in RUNS.split(", ")])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def spilled_runs(docs: DataFrame, shards: int, block: int = BLOCK_TERMS) -> DataFrame:
    """Term-sorted runs of the documents' postings: each task reads once and spills a block when it is full."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, since = Block(), 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                now.add(lang, source, text)
                since += len(text)
                if since >= block:  # so many characters at least lie between two looks at the size
                    since = 0
                    if len(now) >= block:
                        yield from now.runs(shards)
                        now = Block()
        yield from now.runs(shards)

    return _documents(docs).mapInArrow(index, RUNS)


def merged_blocks(pieces: Iterator[tuple], least: int = LEAST_DOCUMENTS, most: int = MERGED) -> Iterator[tuple[str, list[bytes], list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, terms, sources, term, source, occurrences) of the terms in at least ``least`` documents of their language, as runs are merged.

    The last three are arrays with an element for each posting, by term and source: places in ``terms``, which go on in order, and in ``sources``.
    ``pieces``: (shard, lang, first term, sources, terms, each posting's source by
    place, counts, docs), in order of shard, lang and first term.  Pieces gather
    up to ``most`` postings, then what lies before the next piece's first term is
    whole and goes on, so what is held at a time is twice one piece of each run about, or ``most``.
    """
    for key, group in _by(pieces, itemgetter(0, 1)):
        sources: defaultdict[str, int] = defaultdict(numbers().__next__)
        ids: defaultdict[bytes, int] = defaultdict(numbers().__next__)
        held: list[tuple[np.ndarray, ...]] = []
        size, full = 0, most

        def upto(limit: bytes | None):
            """The terms before ``limit``; the others stay."""
            nonlocal ids, held, size, full
            terms = sorted(ids)
            ranks = np.empty(len(terms), np.int64)
            ranks[np.fromiter(map(ids.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
            term, source, n, n_docs = (np.concatenate(c) for c in zip(*held))
            term = ranks[term]
            whole = len(terms) if limit is None else bisect_left(terms, limit)
            rest = term >= whole
            ids = defaultdict(numbers(len(terms) - whole).__next__, zip(terms[whole:], range(len(terms) - whole)))
            held = [(term[rest] - whole, source[rest], n[rest], n_docs[rest])]
            size = len(held[0][0])
            full = max(most, 2 * size)
            term, source, n, n_docs = (c[~rest] for c in (term, source, n, n_docs))
            of_docs = np.zeros(whole, np.int64)
            np.add.at(of_docs, term, n_docs)
            kept = of_docs >= least
            wanted = kept[term]
            code, n = term[wanted] * len(sources) + source[wanted], n[wanted]
            if not len(code):
                return
            order = np.argsort(code)
            code, n = code[order], n[order]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            term, source = np.divmod(code[starts], len(sources))
            place = np.cumsum(kept) - 1
            yield key[1], [terms[i] for i in np.flatnonzero(kept).tolist()], list(sources), place[term], source, np.add.reduceat(n, starts)

        for _, _, first, names, words, at, counts, n_docs in group:
            if size >= full:
                yield from upto(first)
            own = np.fromiter(map(ids.__getitem__, words.split(b" ")), np.int64, len(at))
            held.append((own, np.array([sources[name] for name in names], np.int64)[np.asarray(at)], np.asarray(counts), np.asarray(n_docs)))
            size += len(at)
        yield from upto(None)


def merged_runs(pieces: Iterator[tuple], least: int = LEAST_DOCUMENTS, most: int = MERGED) -> Iterator[tuple[str, bytes, dict[str, int]]]:
    """(lang, term, {source: occurrences}) of ``merged_blocks``, term by term."""
    for lang, terms, sources, term, source, n in merged_blocks(pieces, least, most):
        found: list[dict[str, int]] = [{} for _ in terms]
        for t, i, c in zip(term.tolist(), source.tolist(), n.tolist()):
            found[t][sources[i]] = c
        yield from ((lang, t, f) for t, f in zip(terms, found))


def _by(rows: Iterator[tuple], key) -> Iterator[tuple]:
    """Adjacent rows of one key, as they come; unlike itertools.groupby, a group is always read to its end."""
    row = next(rows, None)
    while row is not None:
        now = key(row)

        def group():
            nonlocal row
            while row is not None and key(row) == now:
                yield row
                row = next(rows, None)

        members = group()
        yield now, members
        for _ in members:
            pass


def frequencies(docs: DataFrame, shards: int | None = None, block: int = BLOCK_TERMS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, source, count, total) of each kept term in each source that has it, and once with a null source.

    ``total`` counts the term in all of its language.  Runs are dealt by a hash
    of the term, so a task merges whole terms; a term has at most one posting for
    each run and source, however common it is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in b.columns[5:]]
            for i, head in enumerate(zip(*(c.to_pylist() for c in b.columns[:5]))):
                yield *head, *(values[at[i] : at[i + 1]] for at, values in lists)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, terms, sources, term, source, n in merged_blocks(pieces(batches), least):
            total = np.zeros(len(terms), np.int64)
            np.add.at(total, term, n)
            of = np.concatenate([np.arange(len(terms)), term])
            names = pa.array([*sources, None], pa.string()).take(pa.array(np.append(np.full(len(terms), len(sources)), source)))
            columns = [
                pa.repeat(pa.scalar(lang, pa.string()), len(of)), pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(of)),
                names, pa.array(np.append(total, n)), pa.array(total[of]),
            ]
            whole = pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in POSTINGS.split(", ")])
            yield from (whole.slice(s, 8192) for s in range(0, len(of), 8192))

    dealt = spilled_runs(docs, shards, block).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "lang", "first")
    return dealt.mapInArrow(merge, POSTINGS)


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)), exact; null where n + v is 0."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", (wide(count) + F.lit(1)) * F.lit(BILLION), F.nullif(wide(n) + wide(v), F.lit(0).cast("decimal(19,0)")))


def _apart(p, q):
    """floor((p - q)^2 / q) of longs from 1 to 1,000,000,001: no square passes 10^18."""
    return (p - q) * (p - q) // q


def _group_stats(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, k, v, p0, sid) of every occurring group: its occurrences and kept terms, the language's kept terms, the share of an absent term, a number in its language."""
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("k"))
    langs = sums.where("source is null").select("lang", F.col("k").alias("v"))
    groups = _documents(docs.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
    none = F.lit(0).cast("long")
    full = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("n", "k", "v")))
    order = Window.partitionBy("lang").orderBy("source")
    return full.withColumn("p0", _share(none, F.col("n"), F.col("v"))).withColumn("sid", F.row_number().over(order).cast("long") - 1)


def _term_part(postings: DataFrame, totals: DataFrame, ranks: int) -> DataFrame:
    """The terms that a group uses more than its language does, the strongest ``ranks``."""
    q = _share(F.col("total"), F.col("ln"), F.col("v"))
    rows = postings.join(totals, "lang").withColumn("q", q).where("p > q")
    rows = rows.withColumn("value", F.expr("(p - q) * (p - q) div q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")  # each task sends on a group's best only
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _absent_sums(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sums over all kept terms of each pair as if no term were in both.

    A group's terms come as counts of equal shares, so a pair costs one step for
    each distinct count, not for each term.
    """
    shares = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).groupBy("lang", "source").agg(F.collect_list("p").alias("ps"), F.collect_list("m").alias("ms"))
    partners = stats.groupBy("lang", F.expr(f"sid div {PARTNERS}").alias("part")).agg(F.collect_list("source").alias("items"), F.collect_list("p0").alias("qs"))
    rows = stats.where("v > 0").join(shares, ["lang", "source"], "left").join(partners, "lang").select("lang", "source", "p0", "k", "v", "ps", "ms", "items", "qs")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, source, p0, k, v, ps, ms, items, qs in zip(*(c.to_pylist() for c in b.columns)):
                p, m, q = (np.array(x or [], np.int64) for x in (ps, ms, qs))
                there, back = (v - k) * _apart(p0, q), -k * _apart(q, p0)
                for s in range(0, len(p), PAIRS // PARTNERS):
                    one, times = p[s : s + PAIRS // PARTNERS, None], m[s : s + PAIRS // PARTNERS, None]
                    there = there + (times * _apart(one, q)).sum(0)
                    back = back + (times * _apart(q, one)).sum(0)
                n = len(q)
                names = pa.array([source] * n + items, pa.string()), pa.array(items + [source] * n, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * 2 * n, pa.string()), *names, pa.array(np.concatenate([there, back]), pa.int64())], ["lang", "source", "item", "value"])

    return rows.mapInArrow(add, "lang string, source string, item string, value long").where("source <> item")


def _corrections(postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): what the terms that two sources share add to ``_absent_sums``, summed in each task.

    Postings stream in order of term; a term's sources meet pair by pair in
    pieces of ``PAIRS``, and sums go on when a task holds ``SUMS`` of them.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, int], str] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, (code, value) in held.items():
                a, b = ((code >> 32).tolist(), (code & 0xFFFFFFFF).tolist())
                source, item = (pa.array([names[lang, i] for i in ids], pa.string()) for ids in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), source, item, pa.array(value, pa.int64())], ["lang", "source", "item", "value"])
            held.clear()

        def join(lang: str, sid: np.ndarray, p: np.ndarray, p0: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
            """Rows with the begin and size of their term; each meets all rows of its term."""
            ends = np.cumsum(size)
            s = 0
            while s < len(sid):
                e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, "right")))
                n = size[s:e]
                left = np.repeat(np.arange(s, e), n)
                right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[s:e], n)
                other = left != right
                left, right = left[other], right[other]
                value = _apart(p[left], p[right]) - _apart(p[left], p0[right]) - _apart(p0[left], p[right]) + _apart(p0[left], p0[right])
                old = held.get(lang, (np.empty(0, np.int64), np.empty(0, np.int64)))
                code, at = np.unique(np.concatenate([old[0], sid[left] << 32 | sid[right]]), return_inverse=True)
                total = np.zeros(len(code), np.int64)
                np.add.at(total, at, np.concatenate([old[1], value]))
                held[lang] = code, total
                s = e

        def whole(table: pa.Table) -> None:
            """Postings of whole terms of one language."""
            lang = table.column("lang")[0].as_py()
            sid, p, p0 = (table.column(c).to_numpy() for c in ("sid", "p", "p0"))
            for i, name in zip(sid.tolist(), table.column("source").to_pylist()):
                names[lang, i] = name
            begin = np.flatnonzero(_starts(table.column("term")))
            size = np.diff(np.append(begin, len(sid)))
            join(lang, sid, p, p0, np.repeat(begin, size), np.repeat(size, size))

        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            cuts = np.flatnonzero(_starts(table.column("lang")) | _starts(table.column("term")))
            done = table.slice(0, cuts[-1])  # the last term may go on
            rest = table.slice(cuts[-1])
            turns = [*np.flatnonzero(_starts(done.column("lang"))).tolist(), len(done)]
            for s, e in zip(turns, turns[1:]):
                whole(done.slice(s, e - s))
            if sum(len(code) for code, _ in held.values()) > SUMS:
                yield from emit()
                names.clear()
        if rest is not None:
            whole(rest)
        yield from emit()

    rows = postings.select("lang", "term", "source", "sid", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return rows.mapInArrow(stream, "lang string, source string, item string, value long")


def _starts(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before it; the first does."""
    code = column.combine_chunks().dictionary_encode().indices.to_numpy()
    return np.append(np.ones(min(1, len(code)), bool), code[1:] != code[:-1])


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, block: int = BLOCK_TERMS, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): how each group of documents differs, in exact integers.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z
    lower-cased; a language keeps those in at least ``least`` of its documents.
    A group is a (lang, source) that occurs.  p is a kept term's share of a group
    in thousand-millionths, with one added to each count, and the divergence of
    two shares p and q is floor((p - q)^2 / q).  Part ``pair`` has a row for each
    other source of the language: the sum over all kept terms, the item's share
    as q.  Part ``term`` has the ``ranks`` kept terms of highest divergence from
    the whole language among those that the group has and uses more.

    Null lang, source and text count as ''; repeated rows are documents of their
    own; a group without terms has pairs, of value 0 if its language keeps no
    term; texts are read whole; an empty table gives no rows; other columns are
    not read.  Sums are exact while a language keeps fewer than 10^9 terms, since
    no sum of squared shares then passes 2^63.
    """
    kept = stored(frequencies(docs, shards, block, least), "frequencies")
    stats = stored(_group_stats(docs, kept).coalesce(4), "groups")  # in few files, so that its size shows whether it can be broadcast
    totals = kept.where("source is null").groupBy("lang").agg(F.sum("count").alias("ln"))
    each = kept.where("source is not null").join(stats, ["lang", "source"])
    postings = each.withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))
    sums = _absent_sums(postings, stats).union(_corrections(postings)).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    bare = stats.where("v = 0").select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.unionByName(bare).withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.union(_term_part(postings, totals, ranks))
