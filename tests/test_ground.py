"""Footprints over points: slanted shapes, the antimeridian, and cells that split where it is crowded."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.functions.geo import RINGS_TYPE
from parcelspark.operators import chips, ground, scenes

SCENE = f"scene_id int, scene_date date, cloud_cover double, bbox array<double>, footprint {RINGS_TYPE}"
PARCEL = "parcel_id int, centroid_lon double, centroid_lat double"


def inside(polygon, x, y):
    odd = False
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1]):
        if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
            odd = not odd
    return odd


def world(spark, n=600, crowd=0.9):
    """Nine of ten points in a small part of one cell, and slanted footprints all over."""
    rng = np.random.RandomState(6)
    near = rng.rand(n) < crowd
    lon = np.where(near, 10.3 + rng.rand(n) * 0.02, 10 + rng.rand(n) * 3)
    lat = np.where(near, 45.2 + rng.rand(n) * 0.02, 45 + rng.rand(n) * 3)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat))] + [(n, None, 45.0)]
    shapes, rows = {}, []
    for s in range(40):
        x, y, tilt = 9.8 + rng.rand() * 2.5, 44.8 + rng.rand() * 2.5, 0.1 + rng.rand() * 0.3
        shape = [(x, y + tilt), (x + 0.6, y), (x + 0.9, y + 0.7), (x + 0.3, y + 0.7 + tilt)]
        shapes[s] = shape
        ring = [[(float(a), float(b)) for a, b in shape]]
        box = [min(a for a, _ in shape), min(b for _, b in shape), max(a for a, _ in shape), max(b for _, b in shape)]
        rows.append((s, date(2024, 5, 1 + s % 5), float(s % 7), [float(v) for v in box], ring if s % 4 else None))
    return points, shapes, rows, spark.createDataFrame(points, PARCEL), spark.createDataFrame(rows, SCENE)


def shown(points, shapes, rows):
    return {
        (i, s) for i, x, y in points if x is not None
        for s, _, _, box, ring in rows
        if (inside(shapes[s], x, y) if ring else box[0] <= x <= box[2] and box[1] <= y <= box[3])
    }


@pytest.mark.parametrize("crowd, finest", [(None, 10), (5, 3), (1, 10), (10_000, 10)])
def test_points_meet_footprints(spark, crowd, finest):
    points, shapes, rows, parcels, found = world(spark, 300)
    met = ground.shown_points(parcels, "parcel_id", "centroid_lon", "centroid_lat", found, crowd=crowd, finest=finest)
    got = [(r.parcel_id, r.scene_id) for r in met.select("parcel_id", "scene_id").collect()]
    assert len(got) == len(set(got)) and set(got) == shown(points, shapes, rows)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_plan_takes_the_least_cloudy_scene(spark):
    points, shapes, rows, parcels, found = world(spark, 200)
    best = {}
    for i, s in shown(points, shapes, rows):
        _, day, cloud, _, _ = rows[s]
        best[i, day] = min(best.get((i, day), (99.0, 99)), (cloud, s))
    got = {(r.parcel_id, r.scene_date): r.scene_id for r in chips.covered_plan(parcels, found).collect()}
    assert got == {k: s for k, (_, s) in best.items()}


def test_a_crowded_cell_is_spread(spark):
    _, _, _, parcels, _ = world(spark, 6000)
    size = ground.CELL_DEG / 2**ground.FINEST
    fine = lambda c: F.floor(F.col(c) / size).cast("long")
    points = parcels.where("centroid_lon is not null").select(fine("centroid_lon").alias("_fx"), fine("centroid_lat").alias("_fy"))
    _, leaves = ground.crowded_cells(points, ground.CELL_DEG, 50, ground.FINEST)
    held = points.join(leaves, ["_fx", "_fy"]).groupBy("level", "cx", "cy", "salts").count().collect()
    assert sum(r["count"] for r in held) == 6000 and max(r["count"] / r["salts"] for r in held) <= 50
    # Dealt to eight tasks by these keys, none gets twice the mean.
    keyed = points.join(leaves, ["_fx", "_fy"]).repartition(8, "level", "cx", "cy")
    tasks = [r["count"] for r in keyed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) <= 2 * 6000 / 8
    same = spark.range(500).select(F.lit(7).cast("long").alias("_fx"), F.lit(9).cast("long").alias("_fy"))
    _, one = ground.crowded_cells(same, ground.CELL_DEG, 100, 4)
    assert [(r.level, r.salts) for r in one.collect()] == [(4, 5)]


def test_antimeridian(spark):
    rows = [(1, date(2024, 5, 1), 1.0, [179.5, -1.0, -179.5, 1.0], None), (2, date(2024, 5, 1), 2.0, [-10.0, -1.0, 10.0, 1.0], None)]
    found = spark.createDataFrame(rows, SCENE)
    cells = {(r.cell_x, r.scene_id) for r in scenes.over_cells(found).collect()}
    assert {x for x, s in cells if s == 1} == {359, 360, -360, -359} and len(cells) == 4 + 41
    kept = scenes.filter_scenes(found, "2024-01-01", "2024-12-31", bbox=(-179.9, 0, -179.8, 1)).collect()
    assert [r.scene_id for r in kept] == [1]
    parcels = spark.createDataFrame([(1, 179.8, 0.0), (2, -179.8, 0.0), (3, 100.0, 0.0), (4, 0.0, 0.0)], PARCEL)
    got = {(r.parcel_id, r.scene_id) for r in chips.covered_plan(parcels, found).collect()}
    assert got == {(1, 1), (2, 1), (4, 2)}
    assert chips.covered_plan(parcels.limit(0), found).collect() == []


def test_a_cell_keeps_few_scenes_of_a_date(spark):
    """However many scenes show the points of a date, only those that can be the least cloudy one meet them."""
    points = spark.range(60).select(
        F.col("id").alias("parcel_id"), (F.col("id") * 37 % 61 / 100 - 94).alias("centroid_lon"), (F.col("id") * 53 % 59 / 100 + 41).alias("centroid_lat")
    )
    moved = (F.col("id") * 31 % 97) / 1000
    west, south = F.lit(-94.5) + moved, F.lit(40.5) + moved
    found = spark.range(400).select(
        F.col("id").alias("scene_id"), F.when(F.col("id") % 4 > 0, F.lit("2024-05-01").cast("date")).alias("scene_date"),
        (F.col("id") * 7919 % 101).cast("double").alias("cloud_cover"),
        F.array(west, south, west + F.when(F.col("id") % 3 == 0, 0.7).otherwise(2.0), south + 2.0).alias("bbox"),
    )
    near = ("parcel_id", "centroid_lon", "centroid_lat")
    every = ground.shown_points(points, *near, found, crowd=20, finest=3)
    few = ground.shown_points(points, *near, found, crowd=20, finest=3, least_per="scene_date")
    assert few.count() * 10 < every.count()
    best = lambda met: sorted(map(tuple, scenes.least_cloudy(met.select("parcel_id", "scene_id", "scene_date", "cloud_cover"), "parcel_id", "scene_date").collect()), key=repr)
    assert best(few) == best(every)
    assert len(best(few)) == chips.covered_plan(points, found, crowd=20, finest=3).count()
