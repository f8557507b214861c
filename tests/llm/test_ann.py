"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from geosift.llm import ann

from .fixtures import with_clashes

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k, every):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in [i for i, v in enumerate(ids) if v % every == 0]:
        s = x @ x[q]
        s[q] = -9
        order = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[: min(k, len(ids) - 1)]
        out[ids[q]] = [(ids[j], s[j]) for j in order]
    return out


def rows_by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf,options", [("0.001", {}), ("0.1", {})])
def test_recall_on_the_given_vectors(spark, sf, options):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    pdf = df.toPandas()
    want = brute(pdf.vec_id.tolist(), np.stack(pdf.embedding.to_numpy()).astype(float), 5, 50)
    got = rows_by_query(ann.neighbours(with_clashes(df), **options))
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q in want:
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) and len(got[q]) == len(want[q])
        for (v, s), (_, best) in zip(got[q], want[q]):
            assert s <= best + 1e-9


def test_descent_carries_recall_from_a_start_of_few_pairs(spark):
    """Vectors without clusters; the start compares at most 3 * 40 of 3,000 others for each."""
    n, options = 3000, {"tables": 2, "first_part": 40}
    x = np.random.default_rng(5).standard_normal((n, 64))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    want = brute(list(range(n)), x, 5, 50)
    got = rows_by_query(ann.neighbours(df, **options))
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_few_odd_and_equal_vectors(spark):
    rows = [(i * 50, [1.0, float(i % 3), 0.5], 0) for i in range(1, 12)]
    rows += [(1, None, 0), (50 * 99, [0.0, 0.0, 0.0], 0), (2, [1.0, None, 2.0], 0), (3, [float("nan"), 1.0, 1.0], 0), (4, [1.0, float("inf"), 1.0], 0), (5, [1.0], 0), (None, [1.0, 1.0, 1.0], 0), (6, [], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    good = [(i, v) for i, v, _ in rows[:11]]
    want = brute([i for i, _ in good], np.array([v for _, v in good]), 5, 50)
    got = rows_by_query(ann.neighbours(df))
    assert {q: [v for v, _ in a] for q, a in got.items()} == {q: [v for v, _ in a] for q, a in want.items()}
    two = rows_by_query(ann.neighbours(spark.createDataFrame(rows[:2], VECTORS)))
    assert {q: [v for v, _ in a] for q, a in two.items()} == {50: [100], 100: [50]}


def test_exact_repeats_count_once(spark):
    rows = [(i, [1.0, float(i % 3), i / 7], 0) for i in range(1, 9)] + [(50, [1.0, 2.0, 0.5], 0)]
    once, often = (rows_by_query(ann.neighbours(spark.createDataFrame(r, VECTORS))) for r in (rows, rows + 7 * rows[-1:] + rows[:2]))
    assert once == often and len(once[50]) == 5


def exact(rows, k=5, every=50):
    """(query id, answers in order) of each query row, by brute force over rows."""
    unit = np.array([v for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    out = []
    for q, (i, _) in enumerate(rows):
        if i % every == 0:
            s = unit @ unit[q]
            out.append((i, tuple(rows[j][0] for j in sorted((j for j in range(len(rows)) if j != q), key=lambda j: (-round(s[j], 12), rows[j][0]))[:k])))
    return sorted(out)


def answers(df):
    """The same from an answer table; the rows of queries that share an id are told apart by their ranks' places."""
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault((r.query_id, r.rank), []).append(r.vec_id)
    return {q: sorted(v) for q, v in by.items()}


@pytest.mark.parametrize("times", [2, 50])
def test_an_id_on_several_vectors(spark, times):
    """Each such row is a row of its own, as a query and as an answer."""
    rng = np.random.default_rng(times)
    rows = [(i, [1.0, float(i % 3), i / 7]) for i in range(1, 9)]
    rows += [(50, [1.0, 2.0, 0.5]), (50, [-1.0, 0.3, 2.0])]
    rows += [(i, rng.standard_normal(3).tolist()) for i in (50, 100, 7) for _ in range(times)]
    rows += [(150, [1.0, 2.0, 0.5]), (3, [1.0, 2.0, 0.5])]  # and vectors on several ids
    want = {}
    for q, found in exact(rows):
        for rank, v in enumerate(found, 1):
            want.setdefault((q, rank), []).append(v)
    got = answers(ann.neighbours(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)))
    assert got == {q: sorted(v) for q, v in want.items()}


def test_empty_and_single(spark):
    assert ann.neighbours(spark.createDataFrame([], VECTORS)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(0, [1.0, 2.0], 0)], VECTORS)).count() == 0
