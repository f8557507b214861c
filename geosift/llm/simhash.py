"""SimHash near-duplicates: pigeonhole blocks, joined and verified by Hamming distance."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, attached, drop_stored, fresh, maybe_in, stored, texts
from .graph import components

SEED = 42
#: Members of a block bucket that one task compares at once; larger buckets are split into chunk pairs.
CHUNK = 2048


#: Words of a wide fingerprint that a bucket compares; the rest of its bits only make keys.
CHECK_WORDS = 4
#: Bits of a block up to 2^20 texts; each doubling beyond adds one.
LEAST_WIDTH = 16
#: Members of a class that meet one copy of its representative's shingles.
STAR = 500

#: What sets the hashes for each 64 bits of a wide fingerprint apart.
_STREAMS = np.random.default_rng(SEED).integers(0, 1 << 63, 512, np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hash of each shingle, in order; that of the whole sequence if it is no longer than one."""
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    shingles = [joined[s:e] for s, e in zip(starts, ends[size - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def fingerprint(text: str, size: int = 3) -> int:
    """64-bit SimHash of a whole text, as a signed long.

    Words are runs without ASCII white space, A-Z lower-cased; each shingle of
    ``size`` words counts as often as it occurs; with fewer words the whole
    sequence is the only shingle.  A bit is set if over half the hashes set it.
    A text without words has fingerprint zero.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = _shingle_hashes(words, size)
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(raw), 1 << 14):
        counts += np.unpackbits(raw[i : i + (1 << 14)], axis=1).sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles of ``size`` words; none if it has no words.

    Words are as in ``fingerprint``; with fewer words the whole sequence is the only shingle.
    """
    parts = text.encode().lower().split()
    return np.unique(_shingle_hashes(parts, size)) if parts else np.array([], np.uint64)


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``words`` times 64 bits over a set of hashes; a bit is set if over half the hashes set it."""
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), 255):  # so few that a byte holds each count
        each = hashes[i : i + 255, None] ^ _STREAMS[:words]
        for mix in _MIX:
            each *= mix
            each ^= each >> np.uint64(31)
        counts += np.unpackbits(each.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def bit_share(similarity: float) -> float:
    """Share of differing bits at which sets of the given Jaccard similarity lie on average, were they of one size."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def bits_apart(similarity: float, bits: int, spread: float = 0.0) -> int:
    """Differing bits of sets of the given similarity, on average and ``spread`` standard deviations beyond."""
    p = bit_share(similarity)
    return int(bits * p + spread * math.sqrt(bits * p * (1 - p)))


def block_width(rows: int) -> int:
    """Bits of a block, so that a bucket holds about sixteen texts by chance at most, however many there are."""
    return max(LEAST_WIDTH, rows.bit_length() - 4)


def block_count(similarity: float, width: int, recall: float = 0.99) -> int:
    """Blocks of ``width`` bits of which sets of ``similarity`` share one with a chance of ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log1p(-((1 - bit_share(similarity)) ** width)))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def sketches(docs: DataFrame, size: int, blocks: int, width: int) -> DataFrame:
    """(doc_id, of, fp, keys) of every row: a digest of its set of shingles, what buckets compare, and its blocks.

    Null text counts as empty; a text without words has no blocks.
    """
    words = max(CHECK_WORDS, math.ceil(blocks * width / 64))
    places = np.int64(1) << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, fps, keys = [], [], []
            for text in b.column(1).to_pylist():
                hashes = shingle_set(text, size)
                fp = wide_fingerprint(hashes, words)
                bits = np.unpackbits(fp.view(np.uint8), bitorder="little")[: blocks * width].reshape(blocks, width)
                of.append(hashlib.md5(hashes.tobytes()).digest())
                fps.append(fp[:CHECK_WORDS].view(np.int64))
                keys.append(bits @ places if len(hashes) else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of, pa.binary()), pa.array(fps, longs), pa.array(keys, longs)], ["doc_id", "of", "fp", "keys"])

    return texts(docs).mapInArrow(run, "doc_id long, of binary, fp array<long>, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, hashes binary) of the ``wanted`` nodes (node, of, least), read again from their least document.

    Written out, ``wanted`` has a known size: Spark ships its ids to the texts if they are few, else both by id, of the texts those that a filter lets through.
    """
    wanted = stored(wanted, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [shingle_set(t, size).tobytes() for t in b.column(1).to_pylist()]
            of = [hashlib.md5(r).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.binary()), pa.array(raw, pa.binary())], ["of", "hashes"])

    rows = texts(docs)
    if wanted.count() > FEW:
        rows = rows.where(maybe_in(wanted.select("least"))(rows.doc_id))
    rows = rows.join(wanted.select("least").distinct(), rows.doc_id.eqNullSafe(F.col("least")), "left_semi")
    # several rows where a doc_id repeats with its text; the join needs them by the same key
    return rows.mapInArrow(run, "of binary, hashes binary").dropDuplicates(["of"]).join(wanted.select("node", "of"), "of").select("node", "hashes")


def block_masks(distance: int) -> list[int]:
    """Masks of which at least one covers only equal bits of any pair within ``distance``.

    The 64 bits fall into ``distance + 2`` blocks; ``distance`` differing bits
    leave two whole blocks equal, so a mask for each pair of blocks is enough.
    """
    n = distance + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (e - s)) - 1) << s for s, e in zip(edges, edges[1:])]
    unsigned = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def spanning_links(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest over the pairs of rows within ``distance``: at most one fewer than members."""
    rest, a, b = np.arange(len(fps)), [], []
    todo: list[int] = []
    while len(rest) or todo:
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
        one = todo.pop()
        near = _apart(fps[rest], fps[one]) <= distance
        if near.any():
            found = rest[near].tolist()
            rest = rest[~near]
            a += [one] * len(found)
            b += found
            todo += found
    return a, b


def _any_close(fps: np.ndarray, group: np.ndarray, sizes: np.ndarray, distance: int) -> np.ndarray:
    """Whether each group of adjacent rows may hold a close pair; groups of over 32 rows are taken to."""
    hit = sizes > 32
    small = ~hit[group]
    for step in range(1, int(sizes[~hit].max(initial=1))):
        same = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        hit[group[same[_apart(fps[same], fps[same + step]) <= distance]]] = True
    return hit


def _chunk_links(fps: np.ndarray, x: np.ndarray, i: int, j: int, distance: int) -> tuple[list[int], list[int]]:
    """Links over the rows of chunks ``i`` and ``j`` (``x`` tells which) within ``distance``, those of a chunk with itself in one of its pairs only.

    Over all pairs of chunks their components are those of all close pairs, yet a
    bucket of one group gives about a link a member and one a pair of chunks.
    """
    a, b = spanning_links(fps, distance)
    if i == j or not a:
        return a, b
    kin, u, v = np.arange(len(fps)), [], []
    for part in (i, j):
        rows = np.flatnonzero(x == part)
        inner = [rows[ends] for ends in spanning_links(fps[rows], distance)] if len(rows) else [rows, rows]
        for one, two in zip(*inner):  # from the root outwards
            kin[two] = kin[one]
        if i == 0 and (part == j or j == 1):
            u += inner[0].tolist()
            v += inner[1].tolist()
    up = kin.tolist()
    for one, two in zip(a, b):
        tops = []
        for k in (one, two):
            while up[k] != k:
                up[k] = k = up[up[k]]
            tops.append(k)
        if tops[0] != tops[1]:
            up[tops[1]] = tops[0]
            u.append(one)
            v.append(two)
    return u, v


Found = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _meet(entries: DataFrame, chunk: int, found: Found, schema: str) -> DataFrame:
    """What ``found`` makes of whole buckets: keys (t, k, the pair of chunks, the row's own chunk), nodes and fingerprints of their rows, and where each begins.

    ``entries``: t, k, node, fp array<long>; nodes with equal ``k`` in table
    ``t`` meet.  A bucket of over ``chunk`` members is dealt out as pairs of
    chunks: each pair of its members meets in some task and no task holds more
    than about two chunks.  Such buckets are few, at most one for ``chunk``
    entries, so only their sizes are joined back.
    """
    large = stored(entries.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "buckets")
    placed = (
        entries.join(large, ["t", "k"], "left")
        .withColumn("c", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int"))
        .withColumn("x", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .where("c = 1 or x <> y")
        .select("t", "k", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "node", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """What all whole buckets held give; the last one may go on."""
            nonlocal held, n
            key, node, fp = (np.concatenate(c) for c in zip(*held))
            starts = np.flatnonzero(np.append(True, (key[1:, :4] != key[:-1, :4]).any(1)))
            upto = len(key) if last else starts[-1]
            held, n = ([], 0) if last else ([(key[upto:], node[upto:], fp[upto:])], 0)
            starts = starts[starts < upto]
            if not len(starts):
                return
            yield from found(key[:upto], node[:upto], fp[:upto], starts)

        for batch in batches:
            if batch.num_rows:
                key = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:5]], 1)
                node, fp = batch.column(5).to_numpy(zero_copy_only=False), batch.column(6).flatten().to_numpy(zero_copy_only=False)
                held.append((key, node, fp.view(np.uint64).reshape(len(node), -1)))
                n += len(node)
                if n >= 1 << 15:
                    yield from flush(last=False)
        if held:
            yield from flush(last=True)

    keys = ["t", "k", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def links(entries: DataFrame, distance: int, chunk: int = CHUNK) -> DataFrame:
    """(u, v) links between nodes; their components are those of all close pairs that share a block.

    ``entries`` meet as in ``_meet``; a bucket gives a spanning forest rather
    than all pairs, as do all chunk pairs of a large one together where it is one group.
    """

    def found(key: np.ndarray, node: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for s, e in _close_buckets(fp, starts, distance):
            rows = s + np.argsort(node[s:e])  # the least node is the root, so many buckets give the same links
            a, b = _chunk_links(fp[rows], key[rows, 4], *key[s, 2:4].tolist(), distance)
            u += node[rows[a]].tolist() if a else []
            v += node[rows[b]].tolist() if b else []
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return _meet(entries, chunk, found, "u long, v long")


def _close_buckets(fp: np.ndarray, starts: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the buckets that may hold a close pair."""
    ends = np.append(starts[1:], len(fp))
    sizes = ends - starts
    close = np.flatnonzero(_any_close(fp, np.repeat(np.arange(len(starts)), sizes), sizes, distance))
    return zip(starts[close].tolist(), ends[close].tolist())


def candidates(entries: DataFrame, near: int, net: int, chunk: int = CHUNK) -> DataFrame:
    """(g, u, v) of what shares a block: links (null g) of nodes within ``near``, and members u of groups (null v).

    A group is a set of nodes of one bucket held together by pairs within
    ``net``, so every such pair that shares a block is in a group.  Both are
    guesses by fingerprint; a group has a row for each member, not each pair.
    """

    def found(key: np.ndarray, node: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        g, u, v = [], [], []
        for s, e in _close_buckets(fp, starts, net):
            order = s + np.argsort(node[s:e])  # the least node is the root, so many buckets give the same links
            kin = np.arange(e - s)
            for a, b in zip(*spanning_links(fp[order], net)):  # from the root outwards
                kin[b] = kin[a]
            for root in np.unique(kin).tolist():
                rows = order[kin == root]
                if len(rows) == 1:
                    continue
                a, b = _chunk_links(fp[rows], key[rows, 4], *key[s, 2:4].tolist(), near)
                g += [None] * len(a)
                u += node[rows[a]].tolist() if a else []
                v += node[rows[b]].tolist() if b else []
                of = xxhash.xxh64_intdigest(np.append(key[s, :4], node[order[root]]).tobytes())
                g += [of - (1 << 63)] * len(rows)
                u += node[rows].tolist()
                v += [None] * len(rows)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (g, u, v)], ["g", "u", "v"])

    return _meet(entries, chunk, found, "g long, u long, v long")


def _entries(nodes: DataFrame, keys: list[Column]) -> DataFrame:
    """A row for each block of each (node, fp array<long>)."""
    spread = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), k.alias("k")) for t, k in enumerate(keys)]))
    return nodes.select("node", "fp", spread.alias("x")).select("x.t", "x.k", "node", "fp")


def near_duplicates(docs: DataFrame, distance: int = 3, size: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    component_id is the smallest doc_id reachable over links of ``distance`` or
    fewer differing bits, itself included.  Texts without words share the
    fingerprint zero and so a component.  A null doc_id keeps its row and never
    names a component that has another id.  Repeated rows stay; very long texts
    are read whole; other columns are not read; an empty table gives no rows.
    """
    fps = stored(fingerprints(docs, size), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = least.select(F.col("fp").alias("node"), F.array("fp").alias("fp"))
    keys = [F.col("fp")[0].bitwiseAND(F.lit(m)) for m in block_masks(distance)]
    linked = components(links(_entries(nodes, keys), distance, chunk))
    return fps.join(_named(least, "fp", linked), "fp").select("doc_id", "fp", "component_id")


def _named(least: DataFrame, node: str, linked: DataFrame) -> DataFrame:
    """(node, component_id): each node with the least document of its component."""
    classes = stored(
        least.join(linked.withColumnRenamed("node", "linked"), F.col(node) == F.col("linked"), "left").select(node, "least", F.coalesce("component", node).alias("component")),
        "classes",
    )
    named = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return classes.join(named, "component").select(node, "component_id")


def _star(classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the members of ``classes`` that are as similar to their representative as asked.

    The representative of a large class meets its members in several copies, one for ``STAR`` of them.
    """

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        of = lambda raw: np.frombuffer(raw, np.uint64)
        return pd.Series([jaccard(of(x), of(y)) >= similarity for x, y in zip(a, b)], dtype=bool)

    copies = classes.groupBy("component").agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies"))
    centre = copies.join(sets.select(F.col("node").alias("component"), F.col("hashes").alias("centre")), "component")
    centre = centre.select("component", "centre", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    members = classes.join(copies, "component").select("node", "component", F.expr("cast(pmod(xxhash64(node), copies) as int)").alias("copy"))
    met = members.join(sets, "node").join(centre, ["component", "copy"])
    return met.where(alike("hashes", "centre")).select("node", "component")


def _settle(contested: DataFrame, similarity: float) -> DataFrame:
    """(u, v) links of nodes as similar as asked within groups: g, node, label, hashes.

    Nodes of one label are linked already.  A group gives no link between nodes that its links join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled() -> Iterator[pa.RecordBatch]:
            up = {label: label for _, label, _ in held}

            def top(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            held.sort(key=lambda m: len(m[2]))
            u, v = [], []
            for i, (a, la, x) in enumerate(held):
                for b, lb, y in held[i + 1 :]:
                    if len(x) < similarity * len(y):
                        break
                    if top(la) != top(lb) and jaccard(x, y) >= similarity:
                        up[top(la)] = top(lb)
                        u.append(a)
                        v.append(b)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        held: list[tuple[int, int, np.ndarray]] = []
        at = None
        for batch in batches:
            for g, node, label, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if g != at:
                    yield from settled()
                    held, at = [], g
                held.append((node, label, np.frombuffer(raw, np.uint64)))
        yield from settled()

    return contested.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def similar(docs: DataFrame, similarity: float = 0.8, size: int = 5, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, component_id) of every document, linked where sets of five-word shingles reach ``similarity``.

    Wide fingerprints cast the net: texts meet where they share a block of bits,
    in so many blocks that a pair of exactly ``similarity`` shares one with a
    chance of 0.99, and of such a width that a bucket's chance members stay few
    at any number of rows.  Every link is then verified by the exact Jaccard
    similarity of the two sets (of 64-bit hashes): classes by fingerprint
    against their representative first, then all pairs which those links leave
    apart in the groups that a bucket's fingerprints form.  So no pair below ``similarity`` is
    linked, and a pair from it on is joined whenever it meets.

    Texts without words are equal.  Null text counts as empty; a null doc_id
    keeps its row and never names a component that has another id.  Repeated
    rows stay; very long texts are read whole; other columns are not read; an
    empty table gives no rows.
    """
    width = block_width(docs.count())
    rows = stored(sketches(docs, size, block_count(similarity, width), width), "sketches")
    nodes = rows.groupBy("of").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("node", "fp", F.posexplode("keys").alias("t", "k")).select("t", "k", "node", "fp")
    bits = 64 * CHECK_WORDS
    met = stored(candidates(entries, bits_apart(similarity, bits), bits_apart(similarity, bits, 3.5), chunk), "candidates")
    classes = stored(components(met.where("g is null").select("u", "v")), "classes")
    wanted = met.select(F.col("u").alias("node")).union(met.where("v is not null").select("v")).distinct()
    sets = stored(shingle_sets(docs, nodes.select("node", "of", "least").join(wanted, "node"), size), "sets")
    star = stored(_star(classes, sets, similarity), "star")
    groups = met.where("v is null").select("g", F.col("u").alias("node")).join(star, "node", "left")
    groups = groups.select("g", "node", F.coalesce("component", "node").alias("label"))
    open_ = groups.groupBy("g").agg((F.min("label") < F.max("label")).alias("open")).where("open").select("g")
    contested = groups.join(open_, "g").join(sets, "node").select("g", "node", "label", "hashes")
    verified = star.select(F.col("node").alias("u"), F.col("component").alias("v")).union(_settle(contested, similarity))
    verified = stored(verified, "verified")
    for done in (met, classes, sets, star):
        drop_stored(done)
    linked = components(verified)
    named = nodes.select("node", "of").join(_named(nodes.select("node", "least"), "node", linked), "node")
    return rows.select("doc_id", "of").join(named, "of").select("doc_id", "component_id")


def survivors(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The documents that stand for their components under ``similar``: one row of each, whole and unchanged.

    The smallest doc_id stays.  Rows that share a doc_id stand or fall together;
    rows without one stay if no row of their component has an id.  Null texts
    count as empty ones, which are alike; very long texts are compared whole.
    Other columns pass unchanged, whatever their names; an empty table gives no
    rows.
    """
    found = similar(docs, similarity, size)
    gone = fresh(docs, "gone_id")
    stays = found.groupBy(F.col("doc_id").alias(gone)).agg(F.max(F.expr("doc_id <=> component_id")).alias("stays"))
    return attached(docs, stored(stays.where("not stays").select(gone), "gone"), docs.doc_id, gone, "left_anti")
