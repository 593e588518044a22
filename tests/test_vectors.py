"""Vector expressions and aggregates against numpy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelspark.functions import medians, vectors
from parcelspark.session import rank_in_group


def reference_distance(a, b):
    return 1 - np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-10)


def test_cosine_and_unit(spark):
    rng = np.random.RandomState(3)
    pairs = [(rng.randn(16).tolist(), rng.randn(16).tolist()) for _ in range(20)] + [([0.0] * 16, [1.0] * 16)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    rows = vectors.unit_vectors(df, "a").select(vectors.cosine_distance(F.col("a"), F.col("b")).alias("d"), "unit").collect()
    for (a, b), row in zip(pairs, rows):
        assert row.d == pytest.approx(reference_distance(np.array(a), np.array(b)), abs=1e-12)
        assert row.unit == pytest.approx(np.array(a) / (np.linalg.norm(a) + 1e-12), abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.floats(-5, 5), min_size=4, max_size=4).filter(lambda v: np.linalg.norm(v) > 0.1),
    st.lists(st.floats(-5, 5), min_size=4, max_size=4).filter(lambda v: np.linalg.norm(v) > 0.1),
    st.floats(0.5, 20),
)
def test_distance_is_bounded_and_ignores_length(spark, a, b, scale):
    df = spark.createDataFrame([(a, b, [x * scale for x in a])], "a array<double>, b array<double>, c array<double>")
    d, e = df.select(
        vectors.cosine_distance(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("c"), F.col("b"))
    ).first()
    assert -1e-9 <= d <= 2 + 1e-9 and d == pytest.approx(e, abs=1e-8)


def grouped(spark):
    """Groups of odd and even size; in the largest one a third of all values are equal."""
    rng = np.random.RandomState(5)
    data = {}
    for key, n in (("odd", 31), ("even", 30), ("one", 1), ("two", 2)):
        data[key] = rng.randn(n, 6).astype(np.float32)
    data["odd"][:11] = 0.0
    data["even"][:, 1] = -0.25
    rows = [(k, v.tolist()) for k, m in data.items() for v in m]
    return data, spark.createDataFrame(rows, "k string, v array<float>")


@pytest.mark.parametrize("block_rows", [None, 100_000, 5, 1])
def test_median_vectors_are_exact(spark, block_rows):
    data, df = grouped(spark)
    got = {r.k: r for r in medians.median_vectors(df, ["k"], "v", 2, block_rows).collect()}
    assert set(got) == {"odd", "even", "two"}
    for key, row in got.items():
        assert row.n_obs == len(data[key])
        assert row.ref == np.median(data[key].astype(float), axis=0).tolist()


@pytest.mark.parametrize("block_rows", [None, 3])
def test_median_vectors_of_odd_rows(spark, block_rows):
    """Null keys, null and NaN entries, vectors of several lengths, infinities, both zeros."""
    rows = [
        (None, 1, [1.0, None]), (None, 2, [3.0, 5.0]), (None, 3, [2.0, float("nan")]), (None, 4, [9.0]), ("a", 5, None), ("a", 6, []),
        ("b", 7, [float("inf"), 0.0]), ("b", 8, [float("-inf"), -0.0]), ("c", 9, [None, 4.0]), ("b", 10, [1e-310, -1.0]), ("c", 11, [None, 5.0]),
    ]
    df = spark.createDataFrame(rows, "k string, i int, v array<double>").withColumn("n_obs", F.lit("x"))
    got = {r.k: (r.v_mid, r.n_obs) for r in medians.median_vectors(df, ["k"], "v", 1, block_rows, "v_mid", ["i"]).collect()}
    assert got == {None: ([2.5, 5.0], 4), "b": ([1e-310, 0.0], 3), "c": ([None, 4.5], 2)}
    assert medians.median_vectors(df.limit(0), ["k"], "v").collect() == []


def test_median_of_a_large_group_narrows_in_rounds(spark, monkeypatch):
    """Equal copies, values far apart and a middle pair in two clusters; few buckets, so many rounds are needed."""
    rng = np.random.RandomState(9)
    m = rng.standard_t(1, (4000, 5)).astype(np.float32)
    m[:1500, 1] = m[0, 1]
    m[:, 2] = np.where(np.arange(4000) < 2000, rng.rand(4000), 1e30 * (1 + rng.rand(4000)))
    m[:, 3] = 7.0
    monkeypatch.setattr(medians, "COUNT_BYTES", 16 * 5 * 64)
    monkeypatch.setattr(medians, "SELECT_BYTES", 8 * 40)
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(m)], "k string, i int, v array<float>")
    (row,) = medians.median_vectors(df, ["k"], "v", 2, 300, spread=["i"]).collect()
    assert row.ref == np.median(m.astype(float), axis=0).tolist() and row.n_obs == 4000


def test_medians_shuffle_vectors_only(spark, capsys):
    _, df = grouped(spark)
    medians.median_vectors(df, ["k"], "v", 2, 5).explain()
    assert "Generate" not in capsys.readouterr().out


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.floats(allow_nan=False), min_size=2, max_size=2), min_size=1, max_size=40), st.integers(1, 7))
def test_search_finds_the_middle_of_any_blocks(rows, size):
    m = np.array(rows)
    blocks = [np.sort(medians.ordered(m[i : i + size]), axis=0) for i in range(0, len(m), size)]
    search = medians.Search(2)
    search.buckets = 8
    while search.inside.any():
        search.narrow(sum(search.count(b) for b in blocks))
    whole = np.sort(medians.ordered(m), axis=0)
    assert search.finish([], []).tolist() == medians.middle(whole).tolist()


def test_mean_vectors(spark):
    data, df = grouped(spark)
    for row in vectors.mean_vectors(df, ["k"], "v").collect():
        assert row.n_obs == len(data[row.k])
        assert row.mean == pytest.approx(data[row.k].astype(float).mean(axis=0), abs=1e-12)


def test_rank_in_group(spark):
    rng = np.random.RandomState(7)
    rows = [("hot" if i % 3 else "cold", int(v)) for i, v in enumerate(rng.permutation(500))] + [(None, 5), (None, 2)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = rank_in_group(df, ["g"], ["v"], F.floor(F.col("v") / 16), "r").collect()
    assert len(got) == len(rows)
    for group in ("hot", "cold", None):
        ordered = sorted((r for r in got if r.g == group), key=lambda r: r.v)
        assert [r.r for r in ordered] == list(range(len(ordered)))


def test_small_blocks_are_read_in_bundles():
    rng = np.random.RandomState(3)
    blocks = [np.sort(rng.randint(0, 99, (3, 2)).astype(np.int64), axis=0) for _ in range(7)]
    pdf = pd.DataFrame({"_group": [1] * 5 + [2] * 2, "_bundle": [0, 0, 0, 1, 1, 1, 1], "_d": 2, "_raw": [b.tobytes() for b in blocks]})
    found = [keys for _, keys in medians._bundles(iter([pdf.iloc[:2], pdf.iloc[2:]]))]
    assert [len(keys) for keys in found] == [9, 6, 6]
    assert (found[0] == np.sort(np.concatenate(blocks[:3]), axis=0)).all()
    runs = [(len(whole), starts.tolist()) for whole, starts in medians._whole_runs(iter([pdf.iloc[:1], pdf.iloc[1:4], pdf.iloc[4:]]), ["_group", "_bundle"])]
    assert runs == [(3, [0]), (2, [0]), (2, [0])]
