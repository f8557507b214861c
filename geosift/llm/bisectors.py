"""Centroid clustering in integers: a tournament of bisector tests finds the nearest centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

SCALE = 64
#: Components below this in size make every product and sum of a test fit 64 bits, up to 1,024 dimensions.
SMALL = 1 << 24
#: Rows whose differences from their centroids a task holds at once.
_ROWS = 4096


def usable(vec: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none null or non-finite."""
    return vec.isNotNull() & (F.size(vec) == dims) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(64 x) of each component, exact: as longs, or as Python integers where some are large."""
    if not x.size or np.abs(x).max() * SCALE < SMALL:
        return np.floor(x * SCALE).astype(np.int64)
    whole = [[int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()]
    return np.array(whole, object)


@dataclass
class Tournament:
    """Centroids (number by component), and for each pair i < j the bisector's normal and threshold.

    x is nearer to j if and only if normal[i, j] . x > threshold[i, j]; on the
    bisector, the smaller number wins.
    """

    centroids: np.ndarray
    normal: np.ndarray
    threshold: np.ndarray

    @classmethod
    def of(cls, centroids: list[list[int]]) -> Tournament:
        small = all(abs(v) < SMALL for c in centroids for v in c)
        c = np.array(centroids, np.int64 if small else object)
        square = (c * c).sum(1)
        return cls(c, 2 * (c[None] - c[:, None]), square[None] - square[:, None])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row and its squared distance: one test for each centroid after the first."""
        win, far = np.zeros(len(x), np.int64), np.zeros(len(x), object if object in (x.dtype, self.centroids.dtype) else np.int64)
        for s in range(0, len(x), _ROWS):
            part, w = x[s : s + _ROWS], win[s : s + _ROWS]
            for j in range(1, len(self.centroids)):
                side = (part * self.normal[w, j]).sum(1) - self.threshold[w, j]
                w[side > 0] = j
            off = part - self.centroids[w]
            far[s : s + _ROWS] = (off * off).sum(1)
        return win, far


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return quantised(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims))


def _first(vectors: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors of least hash, equal hashes by their components."""
    least = vectors.orderBy(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "vec").limit(k)
    return [quantised(np.array([r.vec], np.float64))[0].tolist() for r in least.select("vec").collect()]  # k rows


def _moved(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Each centroid at the floor of its vectors' mean; those without vectors stay."""
    known = vectors.sparkSession.sparkContext.broadcast(Tournament.of(centroids))
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = [[0] * dims for _ in range(k)], [0] * k
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0), dims)
            win, _ = known.value.assign(x)
            for c in np.unique(win).tolist():
                mine = win == c
                sizes[c] += int(mine.sum())
                sums[c] = [a + int(v) for a, v in zip(sums[c], x[mine].sum(0))]
        some = [c for c in range(k) if sizes[c]]
        rows = [(c, d, str(v)) for c in some for d, v in enumerate([*sums[c], sizes[c]])]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["cluster", "dim", "total"])

    parts = vectors.select("vec").mapInArrow(run, "cluster int, dim int, total string")
    sums = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k rows for each component
    total = {(r.cluster, r.dim): int(r.total) for r in sums}
    return [[total[c, d] // total[c, dims] for d in range(dims)] if (c, dims) in total else old for c, old in enumerate(centroids)]


def assigned(vectors: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of each row of ``vectors`` (vec_id, vec)."""
    known = vectors.sparkSession.sparkContext.broadcast(Tournament.of(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                win, far = known.value.assign(_matrix(b.column(1), dims))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(win, pa.int32()), pa.array(far.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "vec").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Vectors of another length than ``dims``, null ones and those with a null or
    non-finite component take no part; the others become integers floor(64 x).
    Centroids start as the ``k`` vectors of least hash (fewer, if there are
    fewer), move ``rounds`` times to the floor of their vectors' mean, and all
    sums are exact at any size of component; only a squared distance or inertia
    that no long can hold is an error.  A null vec_id is hashed as empty text;
    equal hashes, as of repeated ids, go by their components; repeated rows are
    rows of their own; an empty table gives no rows; other columns are not read.

    A round is one narrow pass: each task gives one sum for each centroid and
    component, whatever it has read, and a table of k rows carries the inertia.
    """
    spark = vectors.sparkSession
    small_batches(spark, 8192)
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(usable(F.col("vec"), dims))
    centroids = _first(rows, k)
    if not centroids:
        return rows.limit(0).select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = _moved(rows, centroids, dims)
    found = stored(assigned(rows, centroids, dims), "clusters")
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    shape = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    shown = spark.createDataFrame([(c, n, sum(sums.values()), digest[c]) for c, n in sums.items()], shape)
    return found.join(F.broadcast(shown), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
