"""Approximate nearest neighbours: NN-descent builds the graph, queries search it greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, small_batches, stored

#: Members of one local join; larger neighbourhoods are split into parts of about this size, anew in each round.
PART = 256
#: Members of one part of a first bucket, whatever the number of vectors.
FIRST_PART = 64
#: Neighbours that one local join sends on for a member; a pair lost to this comes up in other joins.
SEND = 6
SEED = 17


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec array<double>) of the vectors that take part.

    Left out: null ids, null or zero vectors, null or non-finite components, and
    vectors of another length than most have.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        "vec_id is not null and vec is not null and size(vec) > 0"
        " and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    )
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (most["n"] if most else 0))


def nodes_and_members(rows: DataFrame, members: int) -> tuple[DataFrame, DataFrame]:
    """Equal vectors are one node, named by the least row number; each node keeps its ``members`` least ids.

    ``rows``: row, vec_id, vec.  A node's name is no vec_id, since one id may
    stand on several vectors.  No answer of fewer than ``members`` neighbours,
    ties to the smaller id, can hold more rows of a node than it keeps, so nothing
    is lost, and a very common vector is cut to its few least ids before the
    shuffle.
    """
    w = Window.partitionBy("vec").orderBy("vec_id", "row")
    ranked = stored(
        rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= members).withColumn("node", F.min("row").over(Window.partitionBy("vec"))),
        "ann-members",
    )
    return ranked.where("rn = 1").select("node", "vec"), ranked.select("node", "row", "vec_id")


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The lists of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _points(nodes: DataFrame, tables: int) -> DataFrame:
    """(node, unit binary, signs array<long>): unit vectors in half precision, and one word of hyperplane signs for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(b.column(1).to_pylist())
            if planes is None:
                planes = np.random.default_rng(SEED).standard_normal((unit.shape[1], tables * 32)).astype(np.float32)
            bits = (unit @ planes > 0).reshape(len(unit), tables, 32)
            signs = (bits << np.arange(32)).sum(2, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([u.tobytes() for u in unit.astype(np.float16)], pa.binary()), pa.array(signs.tolist(), pa.list_(pa.int64()))], ["node", "unit", "signs"]
            )

    return nodes.select("node", "vec").mapInArrow(run, "node long, unit binary, signs array<long>")


FOUND = "node long, nbr long, score float"


def _local_join(groups: DataFrame, keep: int, send: int) -> DataFrame:
    """Better neighbours among the members of each group.

    ``groups``: g, part, node, new, worst, unit.  Two members are multiplied only
    if either is new to the group; a pair counts for a member whose worst neighbour
    so far it beats, and the best ``send`` of a group go on.  Each task keeps the best ``keep`` for a node before it
    sends them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            node, nbr, score = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((nbr, -score, node))
            node, nbr, score = node[order], nbr[order], score[order]
            fresh = np.ones(len(node), bool)
            fresh[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
            node, nbr, score = node[fresh], nbr[fresh], score[fresh]
            begin = np.maximum.accumulate(np.where(np.append(True, node[1:] != node[:-1]), np.arange(len(node)), 0))
            best = np.arange(len(node)) - begin < keep
            yield pa.RecordBatch.from_arrays([pa.array(node[best]), pa.array(nbr[best]), pa.array(score[best], pa.float32())], ["node", "nbr", "score"])

        def keep_better(node: np.ndarray, worst: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
            """For each node (a row) the best others that beat its worst neighbour."""
            nonlocal size
            at = np.argpartition(score, -send, axis=1)[:, -send:] if len(other) > send else np.broadcast_to(np.arange(len(other)), score.shape)
            best = np.take_along_axis(score, at, 1)
            a, k = np.nonzero(best > worst[:, None])
            if len(a):
                held.append((node[a], other[at[a, k]], best[a, k]))
                size += len(a)

        def join(parts: list[tuple]) -> None:
            """The new members against all; two old ones have met before."""
            node, new, worst, unit = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(~new, kind="stable")
            node, worst, unit, m = node[order], worst[order], unit[order], int(new.sum())
            for s in range(0, m, 256):
                i = slice(s, min(s + 256, m))
                score = unit[i] @ unit.T
                score[node[i, None] == node[None]] = -3
                keep_better(node[i], worst[i], node, score)
                if m < len(node):
                    keep_better(node[m:], worst[m:], node[i], score[:, m:].T)

        key, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            g, part, node, new, worst = (c.to_numpy(zero_copy_only=False) for c in b.columns[:5])
            unit = np.frombuffer(b"".join(b.column(5).to_pylist()), np.float16).astype(np.float32).reshape(b.num_rows, -1)
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(part) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(g)]
            for s, e in zip(bounds, bounds[1:]):
                if (g[s], part[s]) != key:
                    if parts:
                        join(parts)
                    key, parts = (g[s], part[s]), []
                parts.append((node[s:e], new[s:e], worst[s:e], unit[s:e]))
            if size > 400_000:
                yield from flush()
                held, size = [], 0
        if parts:
            join(parts)
        if held:
            yield from flush()

    dealt = groups.select("g", "part", "node", "new", "worst", "unit")
    return dealt.repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(run, FOUND)


def _parted(groups: DataFrame, size: int = PART, salt: int = 0) -> DataFrame:
    """Deal each group out in parts of about ``size`` members; every member stays in exactly one."""
    sizes = groups.groupBy("g").agg(F.count("*").alias("n"))
    return groups.join(sizes, "g").withColumn("part", F.expr(f"cast(pmod(xxhash64(node, g, {salt}), ceil(n / {size})) as int)"))


def _best(rows: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` neighbours of each node; new marks edges not joined yet, fresh those of this round."""
    each = rows.groupBy("node", "nbr").agg(F.max("score").alias("score"), F.min("new").alias("new"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("node").orderBy(F.desc("score"), "nbr")
    return each.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")


def descend(nodes: DataFrame, neighbours: int = 64, tables: int = 2, rounds: int = 40, settled: float = 0.01, first_part: int = FIRST_PART) -> DataFrame:
    """NN-descent: (node, nbr, score, new, fresh) with the nearest ``neighbours`` found for each node.

    The first lists come from members that share hyperplane signs, and from
    random parts so that every node has some: at most about ``(tables + 1) *
    first_part`` products a vector, however many vectors there are.  In each
    round half of the edges not joined yet, by chance, and all older ones bring
    the neighbours of a node, in both directions, together, until fewer than
    ``settled`` of the edges change.  ``rounds`` only guards against a run
    without end.
    """
    points = stored(_points(nodes, tables), "ann-points")
    n = max(1, points.count())
    bits = int(np.ceil(np.log2(max(1.0, n / first_part))))  # so many that a usual bucket is one part
    words = [F.expr(f"named_struct('g', xxhash64({t}, signs[{t}] & {(1 << bits) - 1}))") for t in range(tables)]
    words.append(F.expr(f"named_struct('g', xxhash64({tables}, pmod(xxhash64(node, {SEED}), {max(1, n // first_part)})))"))
    none = F.lit(-2.0).cast("float")
    first = points.select(F.inline(F.array(*words)), "node", "unit").withColumn("new", F.lit(True)).withColumn("worst", none)
    marked = {"new": F.lit(True), "fresh": F.lit(True)}
    graph = stored(_best(_local_join(_parted(first, first_part), neighbours, max(16, neighbours // 4)).withColumns(marked), neighbours), "ann-graph")
    for turn in range(rounds):
        worst = graph.groupBy("node").agg(F.expr(f"cast(if(count(*) < {neighbours}, -2, min(score)) as float)").alias("worst"))
        known = points.join(worst, "node", "left").select("node", F.coalesce("worst", none).alias("worst"), "unit")
        taken = F.col("new") & (F.pmod(F.xxhash64("node", "nbr", F.lit(turn)), F.lit(2)) == 0)
        edges = graph.withColumn("taken", taken).where("taken or not new")
        both = edges.select(F.col("node").alias("g"), F.col("nbr").alias("node"), "taken").union(edges.select(F.col("nbr").alias("g"), "node", "taken"))
        met = both.groupBy("g", "node").agg(F.max("taken").alias("new"))
        live = met.groupBy("g").agg(F.max("new").alias("any")).where("any").select("g")  # the others bring nothing new
        groups = _parted(met.join(live, "g", "left_semi"), PART, turn).join(known, "node")
        better = _local_join(groups, neighbours, SEND).withColumns(marked)
        old = graph.withColumns({"new": F.col("new") & ~taken, "fresh": F.lit(False)})
        grown = stored(_best(old.unionByName(better), neighbours), "ann-graph")
        drop_stored(graph)
        graph = grown
        changed, edges_n = graph.agg(F.count_if("fresh"), F.count("*")).first()
        if changed <= settled * edges_n:
            break
    return graph


def _scored(pairs: DataFrame) -> DataFrame:
    """(query_id, node, score double): the cosine of qvec and vec in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (_matrix(b.column(i)) for i in (2, 3))
                score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["query_id", "node", "score"])

    return pairs.select("query_id", "node", "qvec", "vec").mapInArrow(run, "query_id long, node long, score double")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, starts: DataFrame, beam: int = 32, rounds: int = 12) -> DataFrame:
    """Greedy graph search: (query_id, node, score) of the best ``beam`` nodes met by each query.

    ``queries``: query_id, qvec; ``starts``: query_id, node.  In each round every
    query looks at the neighbours of the beam's nodes that it has not looked at;
    it ends when no beam has such a node.
    """

    def score(pairs: DataFrame) -> DataFrame:
        return _scored(pairs.join(queries, "query_id").join(nodes, "node"))

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    trim = lambda df: df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= beam).drop("rn")
    met = stored(trim(score(starts.distinct()).withColumn("done", F.lit(False))), "ann-beam")
    for _ in range(rounds):
        todo = met.where("not done").select("query_id", "node")
        if todo.isEmpty():
            break
        near = todo.join(graph.select("node", "nbr"), "node").select("query_id", F.col("nbr").alias("node")).distinct()
        fresh = score(near.join(met.select("query_id", "node"), ["query_id", "node"], "left_anti")).withColumn("done", F.lit(False))
        grown = stored(trim(met.withColumn("done", F.lit(True)).union(fresh)), "ann-beam")
        drop_stored(met)
        met = grown
    return met.select("query_id", "node", "score")


def neighbours(
    vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, graph_size: int = 64, beam: int = 24, tables: int = 2, rounds: int = 40, first_part: int = FIRST_PART
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that ``queries`` selects.

    Nearest first by cosine, ties to the smaller vec_id; never the query's own
    row.  Every usable vector is indexed.  A query starts at its own node.  Of
    rows that repeat a vec_id with different vectors each is a row of its own: as
    a query it has ``k`` answers of its own, which may hold the others; rows that
    repeat both count once.  Vectors that ``usable`` leaves out take no part;
    other columns are not read; an empty table gives no rows.
    """
    small_batches(vectors.sparkSession, 2048)
    rows = stored(usable(vectors).distinct().withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    nodes, members = nodes_and_members(rows, k + 2)
    graph = descend(nodes, graph_size, tables, rounds, first_part=first_part)
    asked = rows.where(queries).select("row", F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    homes = asked.join(nodes, F.col("qvec") == F.col("vec")).select(F.col("row").alias("query"), "query_id", F.col("node").alias("home"))  # queries of one vector share a search
    begin = homes.select(F.col("home").alias("node")).distinct()
    probes = begin.join(nodes, "node").select(F.col("node").alias("query_id"), F.col("vec").alias("qvec"))
    met = search(probes, nodes, graph, begin.select(F.col("node").alias("query_id"), "node"), beam)
    w = Window.partitionBy("home").orderBy(F.desc("score"), "vec_id", "row")
    best = (
        met.withColumnRenamed("query_id", "home").join(members, "node")
        .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1).select("home", "row", "vec_id", "score")
    )
    answers = homes.join(best, "home").where("row <> query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return (
        answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
