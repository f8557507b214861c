"""Centroid clustering against plain integers."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from geosift.llm import bisectors

from .fixtures import with_clashes

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, j) in zip(kept, assign()):
            groups.setdefault(j, []).append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    found = assign()
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, found))


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)
    assert Counter(map(tuple, bisectors.cluster(with_clashes(df), **options).collect())) == plain(rows, **options)


def test_the_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = bisectors.cluster(df)
    assert Counter(map(tuple, got.collect())) == plain(rows)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


def test_ties_repeats_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64]) for i in range(80)]  # few places, so many ties
    rows += rows[:5] + [(7, [1.0, 0.0, -1.0, 0.5]), (None, [0.25] * 4), (None, [-0.26] * 4)]
    rows += [(90, None), (91, []), (92, [1.0] * 3), (93, [1.0, None, 1.0, 1.0]), (94, [math.nan] * 4), (95, [1.0, math.inf, 0.0, 0.0]), (96, [0.0] * 4), (97, [-1e-300] * 4)]
    check(spark, rows, dims=4)
    check(spark, rows, dims=4, k=100, rounds=2)
    check(spark, rows, dims=3)


def test_large_components_stay_exact(spark):
    rows = [(i, [x, -x / 3, 5.0]) for i, x in enumerate([3e6, 1.5e7, 2.0**24 + 1 / 64, 1e7, -1e7, 2e6 + 0.3, 0.1])]
    check(spark, rows, dims=3, k=3)
    assert bisectors.quantised(np.array([[2.0**60, -(2.0**60), 0.99]])).tolist() == [[2**66, -(2**66), 63]]
    far = spark.createDataFrame([(0, [1e30, 0.0], 0), (1, [-1e30, 0.0], 0)], VECTORS)
    with pytest.raises(Exception, match="[Oo]verflow|too large|out of range|bounds"):
        bisectors.cluster(far, k=1, dims=2).collect()


def test_empty_table(spark):
    df = spark.createDataFrame([], VECTORS)
    assert bisectors.cluster(df).count() == 0 and bisectors.cluster(df).columns[-1] == "centroid_sha256"


def test_tournament_equals_least_distance():
    rng = np.random.default_rng(1)
    c, x = rng.integers(-3, 4, (9, 5)), rng.integers(-3, 4, (9000, 5))
    win, far = bisectors.Tournament.of(c.tolist()).assign(x)
    d = ((x[:, None] - c) ** 2).sum(2)
    assert np.array_equal(win, d.argmin(1)) and np.array_equal(far, d.min(1))
