"""Whitening against a dense eigendecomposition; updates, deflation and combination of spectra; odd rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import queries, whitening

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def dense(x):
    """n, S, centred vectors, eigenvalues falling and eigenvectors of the different rows of x."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (fit * n - s) / n
    vals, vecs = np.linalg.eigh(y.T @ y / n)
    return n, s, (x * n - s) / n, vals[::-1], vecs[:, ::-1]


def held_against(rows, ids, x, k):
    n, s, y, vals, vecs = dense(x)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(by) == len(rows) == len(set(ids)) * k
    got = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    expected = y @ vecs[:, :k] / np.sqrt(vals[:k])
    assert np.abs(got * np.sign((got * expected).sum(axis=0)) - expected).max() < 1e-9
    squares = ((x.astype(object) * n - s) ** 2).sum(axis=1)
    for i, square in zip(ids, squares, strict=True):
        assert by[i, 1]["deviation"] == square and by[i, 1]["n"] == n
    for c in range(k):
        assert abs(by[ids[0], c + 1]["explained"] - vals[c] / vals.sum()) < 1e-12
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-10


def test_query(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in table], dtype=float)).astype(np.int64) + 1_000_000
    held_against(queries.op11_whitening(spark, SF_DIR).collect(), [r["vec_id"] for r in table], x, 16)


def test_many_tasks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TASK_ROWS", 9)
    draw = np.random.default_rng(3)
    m = np.round(draw.standard_normal((300, 12)) * np.linspace(1, 30, 12), 2)
    m[100:200] = m[0]  # a third of all rows
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(vectors.repartition(7), k=5).collect()
    held_against(rows, list(range(300)), np.floor(64 * m).astype(np.int64) + 1_000_000, 5)
    assert {r["n"] for r in rows} == {200}


@pytest.mark.parametrize("d, n, step", [(6, 3, 0.0), (9, 60, 0.0), (9, 60, 1.0), (30, 200, 0.5), (1, 20, 0.0)])
def test_rank_one_updates(d, n, step):
    draw = np.random.default_rng(d + n)
    y = draw.standard_normal((n, d)) * np.linspace(1, 5, d)
    if step:  # equal vectors and equal entries: eigenvalues that meet
        y = np.round(y / step) * step
        y[::2] = y[0]
    parts = [whitening.Spectrum(d) for _ in range(3)]
    for i, v in enumerate(y):
        parts[i % 3].add(v)
    parts[0].merge(parts[1])
    parts[0].merge(whitening.Spectrum(d))
    parts[0].merge(parts[2])
    found, scatter = parts[0], (y - y.mean(axis=0)).T @ (y - y.mean(axis=0))
    scale = np.abs(scatter).max()
    assert found.n == n and np.allclose(found.mean, y.mean(axis=0))
    assert np.abs((found.vecs * found.vals) @ found.vecs.T - scatter).max() < 1e-12 * scale
    assert np.abs(found.vecs.T @ found.vecs - np.eye(found.vecs.shape[1])).max() < 1e-12


@pytest.mark.parametrize("near", [1e-3, 1e-9, 1e-15, 0.0])
def test_secular_roots_of_near_poles(near):
    vals = np.array([1.0, 1.0 + near, 1.0 + 2 * near, 2.0, 2.0 + near])
    v = np.array([1.0, 1e-7, 0.3, 0.0, 2.0])
    got, vecs = whitening.rank_one(vals, np.eye(5), v, 0.7)
    full = np.diag(vals) + 0.7 * np.outer(v, v)
    assert np.abs(got - np.linalg.eigvalsh(full)).max() < 1e-14 * 5
    assert np.abs((vecs * got) @ vecs.T - full).max() < 1e-14 * 10
    assert np.abs(vecs.T @ vecs - np.eye(5)).max() < 1e-14 * 5


def test_refinement_mends_a_poor_space(spark, monkeypatch):
    draw = np.random.default_rng(8)
    m = np.round(draw.standard_normal((400, 40)) * np.linspace(40, 1, 40), 2)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    exact = whitening.incremental

    def blurred(*args):
        found = exact(*args)
        found.vecs = np.linalg.qr(found.vecs + 1e-8 * draw.standard_normal(found.vecs.shape))[0]
        return found

    monkeypatch.setattr(whitening, "incremental", blurred)
    x = np.floor(64 * m).astype(np.int64) + 1_000_000
    held_against(whitening.whiten(vectors, k=3).collect(), list(range(400)), x, 3)


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (2, [0.0, 1.0, 0.0]), (None, [3.0, 5.0, 0.0]), (3, None), (4, []),
        (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = vectors.withColumn("x", F.lit("y")).withColumn("n", F.lit(1)).withColumn("component", F.lit(0.5))
    got = whitening.whiten(vectors).collect()
    assert len(got) == 4 * 3 + 2 * 2
    three = [r for r in got if r["vec_id"] != 8]
    assert sum(r["vec_id"] is None for r in three) == 3 and {r["n"] for r in three} == {3}
    # Three different vectors span two components; the third entry never varies.
    assert {r["whitened"] is None for r in three if r["component"] == 3} == {True}
    assert {r["whitened"] is None for r in three if r["component"] < 3} == {False}
    assert three[0]["identity_error"] < 1e-10
    # One vector of its length: no variance at all.
    alone = [tuple(r) for r in got if r["vec_id"] == 8]
    assert set(alone) == {(8, c, 1, 0, None, None, None) for c in (1, 2)}
    assert whitening.whiten(vectors.limit(0)).collect() == []


def test_whole_numbers_beyond_64_bits(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5e9, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(vectors).collect()}
    assert len(got) == 6 and got[1, 1]["deviation"] is None and got[1, 1]["whitened"] is not None
