import math

import numpy as np
import pytest

from cellweave.llm import whitening as W


def fixed(vector):
    if vector is None or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def check(spark, rows, components=16, schema="vec_id bigint, embedding array<float>", df=None):
    """Against the covariance of the distinct vectors and its eigenvectors."""
    df = spark.createDataFrame(rows, schema) if df is None else df
    have = W.whiten(df, components).collect()
    kept = [(i, x) for i, v in rows if (x := fixed(v)) is not None]
    x = np.array(sorted({tuple(v) for _, v in kept}), dtype=object)
    n, sums = len(x), x.sum(0)
    centred = (x - np.array([float(s) / n for s in sums])).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(have) == k * len(kept)
    mean = np.array([float(s) / n for s in sums])
    by = {}
    for r in have:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    for i, v in kept:
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))
        mine = by[(i, deviation)]
        assert sorted(mine) == list(range(1, k + 1))
        for c in range(1, k + 1):
            alone = all(abs(values[c - 1] - w) > 1e-6 * values[0] for m, w in enumerate(values) if m != c - 1)
            want = abs((np.array(v, float) - mean) @ vectors[:, c - 1]) / math.sqrt(values[c - 1])
            assert not alone or min(abs(abs(w) - want) for w in mine[c]) < 1e-6
    return have


def test_random_vectors_with_repeats(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(24, 24)) * np.logspace(0, -2, 24)
    v = (rng.normal(size=(900, 24)) @ mix * 3).astype(np.float32)
    rows = [(int(i), [float(c) for c in v[i % 600]]) for i in range(900)]
    check(spark, rows)


def test_embeddings(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    have = check(spark, rows, df=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assert len(have) == 16 * len(rows) == W.query(spark, sf_dir).count()


def test_equal_eigenvalues_and_few_directions(spark):
    axes = [(2 * i + s, [float((1 - 2 * s) * (i == j)) * 4 for j in range(12)]) for i in range(12) for s in (0, 1)]
    check(spark, axes)
    flat = [(i, [float(i), float(2 * i), 3.0, 0.0]) for i in range(50)]
    assert {r.component for r in check(spark, flat)} == {1}
    assert {r.component for r in check(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])])} == {1}


def test_nulls_short_vectors_empty_table_and_other_columns(spark):
    schema = "vec_id bigint, embedding array<float>"
    bad = [(7, None), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [1.0, float("inf")])]
    good = [(1, [1.0, 2.0]), (None, [2.0, 1.0]), (1, [1.0, 2.0]), (3, [5.0, 5.0]), (3, [0.0, 7.0])]
    check(spark, bad + good)
    assert W.whiten(spark.createDataFrame(bad, schema)).collect() == []
    assert W.whiten(spark.createDataFrame([], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([*good, (4, []), (5, [1.0])], schema)).count() == 2 * len(good)
    more = spark.createDataFrame([(*r, 1, 2.0, "y") for r in good], schema + ", n int, whitened double, x string")
    assert W.whiten(more).count() == 2 * len(good)
    far = W.whiten(spark.createDataFrame([(1, [3e13, 1.0]), (2, [-3e13, 2.0]), (3, [1e30, 1.0])], "vec_id bigint, embedding array<double>")).collect()
    assert {r.vec_id for r in far} == {1, 2} and all(r.deviation is None for r in far)


def test_singular_values_of_bidiagonal_matrices():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 64):
        for grade in (0, 4, 9):
            d, e = rng.normal(size=n) * np.logspace(0, -grade, n), rng.normal(size=max(n - 1, 0)) * np.logspace(0, -grade, max(n - 1, 1))[: n - 1]
            b = np.diag(d) + np.diag(e, 1)
            values = W.dqds(d, e)
            assert np.allclose(np.sqrt(values), np.linalg.svd(b)[1], rtol=1e-9, atol=1e-14)
            squares, vectors = W.principal(b)
            assert np.allclose(vectors.T @ vectors, np.eye(len(squares)), atol=1e-10)
            assert np.allclose(np.linalg.norm(b @ vectors, axis=0), np.sqrt(squares), rtol=1e-8, atol=1e-14)
    # tiny values keep their digits where the square of the matrix has none left
    d, e = np.array([1.0, 1e-6, 1e-12]), np.array([1e-3, 1e-9])
    assert np.sqrt(np.prod(W.dqds(d, e))) == pytest.approx(np.prod(d), rel=1e-12)


def test_reflections_keep_the_matrix():
    a = np.random.default_rng(5).normal(size=(9, 9))
    d, e, right = W.bidiagonal(a)
    b = np.diag(d) + np.diag(e, 1)
    assert np.allclose(right.T @ right, np.eye(9)) and np.allclose(a.T @ a, right @ b.T @ b @ right.T)
