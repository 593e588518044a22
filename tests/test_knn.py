"""The nearest-neighbour join against brute force, with hot copies, small cells and a distance cap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.operators.knn import CosineMetric, HaversineMetric, KnnPlan, grown_block, knn_join
from parcelspark.operators.similarity import nearest_of_all, nearest_to, scan_mislabels

SMALL = KnnPlan(one_cell_rows=10, block_rows=5, max_cells=14)


def brute(ids, rows, k, metric, cap=None, asked=None):
    embedded, out = metric.embed(rows), {}
    for i, name in enumerate(ids):
        if asked is not None and name not in asked:
            continue
        exact = metric.distance(np.repeat(rows[i : i + 1], len(rows), 0), rows, embedded @ embedded[i])
        order = np.lexsort((ids, np.round(exact, metric.digits)))
        near = [j for j in order if j != i and (cap is None or exact[j] <= cap)][:k]
        out[name] = [(ids[j], exact[j]) for j in near]
    return out


def check(spark, ids, rows, k, metric, plan, cap=None, asked=None):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, rows)], "id string, vec array<double>")
    queries = df if asked is None else df.where(F.col("id").isin(list(asked)))
    got = {}
    for r in sorted(knn_join(queries, df, k, metric, cap, plan).collect(), key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append((r.neighbor_id, r.distance))
        assert r["rank"] == len(got[r.id]) and r.id != r.neighbor_id
    expected = {q: near for q, near in brute(ids, rows, k, metric, cap, asked).items() if near}
    assert {q: [n for n, _ in near] for q, near in got.items()} == {q: [n for n, _ in near] for q, near in expected.items()}
    for q, near in expected.items():
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in near], abs=1e-6)


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("plan", [KnnPlan(), SMALL])
def test_cosine(spark, plan):
    rng = np.random.RandomState(1)
    centres = rng.randn(6, 8) * 3
    rows = unit(centres[rng.randint(6, size=200)] + rng.randn(200, 8))
    check(spark, [f"p{i}" for i in range(200)], rows, 5, CosineMetric, plan)


@pytest.mark.parametrize("plan", [KnnPlan(), SMALL])
def test_hot_copies(spark, plan):
    """Every third vector is the same one: copies find each other, smallest ids first."""
    rng = np.random.RandomState(2)
    rows = unit(rng.randn(150, 4))
    rows[::3] = rows[0]
    check(spark, [f"p{i}" for i in range(150)], rows, 4, CosineMetric, plan)


@pytest.mark.parametrize("cap", [None, 12.0])
@pytest.mark.parametrize("plan", [KnnPlan(), SMALL])
def test_haversine(spark, plan, cap):
    rng = np.random.RandomState(3)
    rows = np.column_stack([41 + rng.rand(250), -94 + rng.rand(250)])
    rows[50:90] = rows[50]
    rows[90:130] = rows[90] + rng.rand(40, 2) * 1e-4
    check(spark, [f"p{i}" for i in range(250)], rows, 5, HaversineMetric, plan, cap)


def test_world_and_date_line(spark):
    rng = np.random.RandomState(4)
    rows = np.column_stack([rng.uniform(-89, 89, 120), rng.choice([-179.9, 179.9, 0.0], 120) + rng.rand(120) * 0.05])
    check(spark, [f"p{i}" for i in range(120)], rows, 6, HaversineMetric, SMALL)


def test_some_queries_and_short_corpus(spark):
    rng = np.random.RandomState(5)
    rows = unit(rng.randn(90, 6))
    ids = [f"p{i}" for i in range(90)]
    check(spark, ids, rows, 5, CosineMetric, SMALL, asked={"p3", "p44", "p71"})
    check(spark, ids[:4], rows[:4], 10, CosineMetric, KnnPlan())


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "id string, vec array<double>")
    assert knn_join(none, none, 3).count() == 0


def vectors(spark):
    rows = [
        ("a", "corn", [1.0, 0.0]), ("b", "rye", [0.99, 0.14]), ("c", "rye", [0.98, 0.2]), ("d", None, [0.9, 0.43]),
        ("e", "corn", [0.0, 1.0]), ("f", " corn ", [0.1, 0.99]),
    ]
    return spark.createDataFrame(rows, "parcel_id string, crop_name string, unit array<double>")


def test_one_parcel_agrees_with_all(spark):
    v = vectors(spark)
    every = nearest_of_all(v, 3).where("parcel_id = 'a'").orderBy("rank").collect()
    one = nearest_to(v, "a", 3).collect()
    assert [r.parcel_id for r in one] == [r.neighbor_id for r in every] == ["b", "c", "d"]
    assert [r.similarity for r in one] == pytest.approx([r.similarity for r in every])
    with pytest.raises(KeyError):
        nearest_to(v, "nobody")


def test_mislabel_scan(spark):
    found = {r.parcel_id: r for r in scan_mislabels(vectors(spark), 3, 0.5, crop="corn").collect()}
    # a: b, c differ and d is unlabelled; e and f see each other and two rye or unlabelled parcels.
    assert (found["a"].diff_neighbors, found["a"].labeled_neighbors, found["a"].neighbor_diff_fraction) == (2, 2, 1.0)
    assert set(found) <= {"a", "e", "f"}
    assert not scan_mislabels(vectors(spark), 3, 0.5, crop="oats").collect()


def test_a_parcel_of_two_crops_counts_once(spark):
    v = vectors(spark)
    twice = v.unionByName(v.where("parcel_id IN ('a', 'b')").withColumn("crop_name", F.lit("oats")))
    one = [(r.parcel_id, r.crop_name) for r in nearest_to(twice, "a", 2).collect()]
    assert sorted(one) == [("b", "oats"), ("b", "rye"), ("c", "rye")]
    every = nearest_of_all(twice, 2).where("parcel_id = 'a'").collect()
    assert sorted((r.neighbor_id, r.neighbor_crop, r["rank"]) for r in every) == [("b", "oats", 1), ("b", "rye", 1), ("c", "rye", 2)]


def test_small_blocks_grow_with_the_table():
    assert [grown_block(16, n) for n in (100, 90_000, 10_000_000)] == [16, 300, 512] and grown_block(600, 10**7) == 600
