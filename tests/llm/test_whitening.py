"""Embedding whitening against a dense eigendecomposition of the covariance."""

import math

import numpy as np
import pytest

from postcred.llm import whitening as Wh
from postcred.llm.dense import orthonormal, product, symmetric_eigen
from postcred.llm.queries import QUERIES


def plain(vectors):
    """(x, n, S, eigenvalues, eigenvectors) of the covariance formed whole."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = (fit - s // n) - (s % n) / n
    cov = np.einsum("ni,nj->ij", z, z) / n
    values, basis = symmetric_eigen(cov)
    assert np.abs(cov @ basis - basis * values).max() <= 1e-12 * max(values[0], 1)
    return x, n, s, values, basis


def check(rows, ids, vectors, components=16):
    x, n, s, values, basis = plain(vectors)
    k = min(components, int((values > 1e-10 * values[0]).sum()))
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append(r)
    assert sorted(got) == sorted(set(ids)) and len(rows) == k * len(ids)
    white = {}
    for i, row in zip(ids, x):
        mine = sorted(got[i], key=lambda r: r.component)
        t = n * row.astype(object) - s.astype(object)
        assert {r.component for r in mine} == set(range(1, k + 1))
        assert all(r.n == n and int(r.deviation) == int((t * t).sum()) for r in mine)
        assert all(r.identity_error <= 1e-9 for r in mine)
        for r in mine:
            assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        white[i] = [r.whitened for r in mine[:k]] if len(mine) == k else None
    for c in range(k):
        gap = min([abs(values[c] - v) for j, v in enumerate(values) if j != c], default=values[c]) / values[0]
        want = ((x - s // n) - (s % n) / n) @ basis[:, c] / math.sqrt(values[c])
        mine = np.array([white[i][c] for i in ids])
        sign = 1.0 if (want * mine).sum() >= 0 else -1.0
        assert np.abs(want - sign * mine).max() <= 1e-10 / max(gap, 1e-9)


def frame(spark, ids, vectors, parts=3):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>").repartition(parts)


@pytest.mark.parametrize("n, d, seed", [(300, 40, 1), (60, 5, 2), (12, 30, 3), (400, 16, 4)])
def test_against_dense(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((n, d)) * np.linspace(1, 4, d)
    vectors = np.vstack([vectors, vectors[: n // 3], vectors[:1].repeat(20, axis=0)])  # copies enter the fit once
    ids = list(range(len(vectors)))
    rows = Wh.whiten(frame(spark, ids, vectors)).collect()
    check(rows, ids, vectors)


def test_large_offsets_and_deviations_past_64_bits(spark):
    """Entries of 1e13 around 1e15: centring by plain doubles would lose the signal; deviations are exact beyond 64 bits."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((90, 6)) * 1e13 + 1e15
    rows = Wh.whiten(frame(spark, list(range(90)), vectors)).collect()
    assert max(int(r.deviation) for r in rows) > 1 << 64
    check(rows, list(range(90)), vectors)


def test_tree_of_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(Wh, "FAN_IN", 2)
    monkeypatch.setattr(Wh, "BLOCK_BYTES", 1)
    vectors = np.random.default_rng(6).standard_normal((200, 20)) * np.linspace(1, 3, 20)
    rows = Wh.whiten(frame(spark, list(range(200)), vectors, 7), components=4, guard=2).collect()
    check(rows, list(range(200)), vectors, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = np.random.default_rng(7).standard_normal((30, 3))
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 2.0]), (104, [inf, 1.0, 2.0]), (105, [1.0, 2.0]), (106, [-inf, 0.0, 0.0])]
    df = spark.createDataFrame(odd + [(i, [float(c) for c in v]) for i, v in enumerate(good)] + [(None, [0.5, 0.5, 0.5])] * 2,
                               "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as id", "2 as x", "3 as n")
    rows = Wh.whiten(df).collect()
    vectors = [*good, [0.5] * 3, [0.5] * 3]
    assert {r.vec_id for r in rows} == {*range(30), None} and len(rows) == 3 * len(vectors)
    x, n, s, _, _ = plain(vectors)
    t = (n * x - s) ** 2
    assert n == 31 and {r.vec_id: int(r.deviation) for r in rows if r.vec_id is not None} == {i: int(t[i].sum()) for i in range(30)}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_scale(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert Wh.whiten(df).collect() == []


def test_huge_entries_saturate(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    rows = Wh.whiten(df).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in rows)


def test_registered_query(spark, sf_small):
    given = spark.read.parquet(f"{sf_small}/embeddings.parquet").select("vec_id", "embedding").collect()
    df = QUERIES["op12_embedding_whitening"](spark, sf_small)
    assert dict(df.dtypes)["deviation"] == "bigint" and dict(df.dtypes)["n"] == "bigint"
    check(df.collect(), [r.vec_id for r in given], [r.embedding for r in given])


def test_dense_helpers():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((30, 12))
    a[:, 5] = a[:, 3]  # dependent columns still give an orthonormal block
    q = orthonormal(a)
    assert np.abs(product(q.T, q) - np.eye(12)).max() < 1e-13
    m = product(a.T, a)
    values, vectors = symmetric_eigen(m)
    assert (np.diff(values) <= 1e-12).all() and np.abs(m @ vectors - vectors * values).max() < 1e-11
