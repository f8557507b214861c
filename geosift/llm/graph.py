"""Connected components by alternating large-star and small-star steps over forests that each task makes of its edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, ship, stored


def _each(edges: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """An edge (u, v) for each of the given pairs of columns; no union, which would part again what one task holds."""
    return edges.select(F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends))).alias("x")).select("x.*")


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least neighbour of u; pre-aggregated before the shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _each(edges, ("u", "v"), ("v", "u"))
    near = _with_least(both).select("u", "v", F.least("u", "m").alias("m")).where("v > u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down)
    return _each(near, ("v", "m"), ("u", "m")).where("u <> v")


def _open(edges: DataFrame) -> bool:
    """Whether distinct edges, each from the greater node to the lesser, are more than stars: a node with two lesser ones, or one between others."""
    ends = edges.select(F.explode(F.expr("array(struct(u as node, 1 as up, 0 as down), struct(v as node, 0 as up, 1 as down))")).alias("x")).select("x.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or up = 1 and down = 1").limit(1).count() > 0


#: Edges up to which a round runs in one task, without a shuffle: 1 MB of longs, as Spark's own merging of small partitions would have it.
FEW_EDGES = 1 << 16


def _together(edges: DataFrame) -> DataFrame:
    return edges.coalesce(1) if edges.count() <= FEW_EDGES else edges


def _forests(edges: DataFrame, most: int) -> DataFrame:
    """Stars with the components of ``edges``: each task joins the edges of ``most`` nodes at a time and sends on a link a node.

    Groups whose members are linked many times over shrink to about a link a
    member before any shuffle; edges of few nodes become their components at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def stars() -> pa.RecordBatch:
            links = [(node, least) for node in up if (least := top(node)) != node]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links) if links else ([], []))], ["u", "v"])

        for b in batches:
            for u, v in zip(*(c.to_pylist() for c in b.columns)):
                if (one := top(u)) != (two := top(v)):
                    up[max(one, two)] = min(one, two)
            if len(up) >= most:
                yield stars()
        yield stars()

    ship(edges.sparkSession)
    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _shrunk(edges: DataFrame, few: int) -> DataFrame:
    """``edges``, written out, as the forests of tasks of about ``few`` edges."""
    forests = stored(_forests(edges.coalesce(edges.count() // few + 1), 2 * few).distinct(), "edges")
    drop_stored(edges)
    return forests


def components(edges: DataFrame, a: str = "u", b: str = "v", few: int = FEW_EDGES) -> DataFrame:
    """(node, component): every node of an edge with the least node it can reach.

    Edges are pairs of non-null longs; repeated edges and self loops do no harm.
    Each round first shrinks the edges to forests, each of about ``few`` of them,
    works on the edges only and is written to the shared folder; the
    rounds end when stars are left.  No list of neighbours is ever gathered.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    now = _shrunk(now, few)
    while _open(near := _together(now)):
        new = stored(_small_star(_large_star(near).distinct()).distinct(), "edges")
        drop_stored(now)
        now = _shrunk(new, few)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
