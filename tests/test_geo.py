"""Geometry and the zonal join against published values and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.functions import geo
from parcelspark.functions.geo import Ellipsoid
from parcelspark.operators import similarity, zonal
from parcelspark.sources import raster

CLARKE = Ellipsoid(6378206.4, 1 / 294.978698)  # ellipsoid of the published map-projection examples
RINGS = f"parcel_id string, rings {geo.RINGS_TYPE}"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_albers_example(spark):
    x, y = geo.albers(F.lit(-75.0), F.lit(35.0), CLARKE)
    row = one(spark, x, y)
    assert row[0] == pytest.approx(1_885_472.7, abs=0.1) and row[1] == pytest.approx(1_535_925.0, abs=0.1)


def test_transverse_mercator_example(spark):
    assert one(spark, geo.utm_zone(F.lit(-73.5)))[0] == 18
    x, y = geo.utm(F.lit(-73.5), F.lit(40.5), F.lit(18), CLARKE)
    row = one(spark, x, y)
    assert row[0] - 500_000 == pytest.approx(127_106.5, abs=0.1) and row[1] == pytest.approx(4_484_124.4, abs=0.2)


def test_haversine(spark):
    d = lambda *p: geo.haversine_km(*[F.lit(float(v)) for v in p])
    row = one(spark, d(0, 0, 0, 180), d(10, 20, 10, 20), d(1, 2, 3, 4), d(3, 4, 1, 2))
    assert row[0] == pytest.approx(np.pi * 6371.0)
    assert row[1] == 0.0
    assert row[2] == pytest.approx(row[3]) and row[2] == pytest.approx(314.4, abs=0.1)


def test_chip_bounds(spark):
    b = one(spark, geo.chip_bounds(F.lit(-93.5), F.lit(42.0)).alias("b")).b
    assert b.north - b.south == pytest.approx(2240 / 111_320)
    assert b.east - b.west == pytest.approx(2240 / 111_320 / np.cos(np.radians(42)))


def rings(*rings_):
    return [[(float(x), float(y)) for x, y in ring] for ring in rings_]


SQUARE_WITH_HOLE = rings([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)])


def test_polygon_measures(spark):
    df = spark.createDataFrame([("a", SQUARE_WITH_HOLE), ("b", rings([(0, 0), (3, 0), (0, 3)]))], RINGS)
    rows = {r.parcel_id: r for r in df.select("parcel_id", geo.polygon_centroid(F.col("rings")).alias("m"), geo.polygon_bounds(F.col("rings")).alias("b")).collect()}
    assert rows["a"].m.area == pytest.approx(15.0)
    assert rows["a"].m.lon == pytest.approx((32 - 1.5) / 15)
    assert rows["b"].m.area == pytest.approx(4.5) and rows["b"].m.lat == pytest.approx(1.0)
    assert tuple(rows["a"].b) == (0.0, 0.0, 4.0, 4.0)


def test_area_in_square_metres(spark):
    side = 0.001
    ring = [(-93.5, 42.0), (-93.5 + side, 42.0), (-93.5 + side, 42.0 + side), (-93.5, 42.0 + side)]
    df = spark.createDataFrame([("a", rings(ring))], RINGS)
    area = df.select(geo.polygon_area_m2(F.col("rings"))).first()[0]
    # Metres per degree on the ellipsoid at 42 N are about 111 072 north and 82 850 east.
    assert area == pytest.approx(111.072 * 82.85, rel=2e-3)


def clip_area(polygon, x, y):
    """Area of one ring inside the cell, by clipping against its four sides."""
    points = [np.array(p, float) for p in polygon]
    for axis, level, keep_above in ((0, x, True), (0, x + 1, False), (1, y, True), (1, y + 1, False)):
        out = []
        for a, b in zip(points, points[1:] + points[:1]):
            inside = lambda p: p[axis] >= level if keep_above else p[axis] <= level
            if inside(a) != inside(b):
                t = (level - a[axis]) / (b[axis] - a[axis])
                cross = a + t * (b - a)
            if inside(a):
                out.append(a)
            if inside(a) != inside(b):
                out.append(cross)
        points = out
        if not points:
            return 0.0
    p = np.array(points)
    q = np.roll(p, -1, axis=0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2


def star(rng, n, centre, size):
    angles = np.sort(rng.rand(n)) * 2 * np.pi
    radii = size * (0.3 + rng.rand(n))
    return [(centre[0] + r * np.cos(a), centre[1] + r * np.sin(a)) for a, r in zip(angles, radii)]


def test_touched_cells_of_concave_polygons(spark):
    rng = np.random.RandomState(11)
    shapes = {f"s{i}": star(rng, rng.randint(3, 9), rng.rand(2) * 10 - 2, 0.2 + rng.rand() * 4) for i in range(40)}
    shapes["grid"] = [(1, 1), (3, 1), (3, 4), (1, 4)]
    shapes["sliver"] = [(0.2, 5.1), (6.7, 5.3), (0.2, 5.2)]
    df = spark.createDataFrame([(k, rings(v)) for k, v in shapes.items()], RINGS)
    got = {}
    for r in zonal.touched_cells(df).collect():
        got.setdefault(r.parcel_id, set()).add((r.x, r.y))
    for key, polygon in shapes.items():
        p = np.array(polygon)
        (x0, y0), (x1, y1) = np.floor(p.min(0)).astype(int), np.ceil(p.max(0)).astype(int)
        expected = {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) if clip_area(polygon, x, y) > 1e-12}
        assert got[key] == expected, key


def test_holes_leave_cells_out(spark):
    big_hole = rings([(0, 0), (6, 0), (6, 6), (0, 6), (0, 0)], [(1, 1), (5, 1), (5, 5), (1, 5), (1, 1)])
    cells = {(r.x, r.y) for r in zonal.touched_cells(spark.createDataFrame([("a", big_hole)], RINGS)).collect()}
    assert cells == {(x, y) for x in range(6) for y in range(6) if x in (0, 5) or y in (0, 5)}


def shapes_of_all_kinds():
    """Triangles, stars, polygons with holes and islands, large ones over many blocks, and squares on block borders."""
    rng = np.random.RandomState(21)
    shapes = {f"t{i}": [[tuple(p) for p in rng.rand(3, 2) * 90 - 10]] for i in range(12)}
    shapes |= {f"s{i}": [star(rng, rng.randint(3, 9), rng.rand(2) * 60, 1 + rng.rand() * 25)] for i in range(12)}
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    shapes["grid"] = [square(8, 40)]
    shapes["hole"] = [square(1, 62), square(9.5, 50.25)]
    shapes["island"] = [square(0, 64), square(4, 60), square(10, 30)]
    shapes["below"] = [square(-30, -3.5)]
    return shapes


@pytest.mark.parametrize("block", [4, 16])
def test_zonal_counts_by_squares(spark, block, monkeypatch):
    """Whole squares from class counts and opened blocks together equal counting cell by cell."""
    shapes = shapes_of_all_kinds()
    parcels = spark.createDataFrame([(k, rings(*v)) for k, v in shapes.items()], RINGS)
    cells = [(x, y, (x * 7 + y * y) % 5) for x in range(-8, 80) for y in range(-8, 80) if (x + y) % 11]
    pixels = spark.createDataFrame(cells, "x long, y long, code int")
    stored = raster.stage_raster(pixels, block)
    assert stored.levels >= 2 and stored.blocks.count() < len(cells) / (block * block) * 2
    got = {(r.parcel_id, r.code): r.n for r in zonal.zonal_counts(parcels, stored).collect()}
    code = {(x, y): c for x, y, c in cells}
    expected = {}
    for r in zonal.touched_cells(parcels, block=1, levels=0).collect():
        c = code.get((r.x, r.y))
        if c is not None:
            expected[r.parcel_id, c] = expected.get((r.parcel_id, c), 0) + 1
    assert got == expected
    covered = zonal.cover(parcels, "parcel_id", block, stored.levels)
    assert block == 16 or covered.where("whole and level > 0").count() > 5
    monkeypatch.setattr(zonal, "CROWDED", 3)
    assert {(r.parcel_id, r.code): r.n for r in zonal.zonal_counts(parcels, stored).collect()} == expected


def test_squares_and_cells_agree(spark):
    shapes = shapes_of_all_kinds()
    parcels = spark.createDataFrame([(k, rings(*v)) for k, v in shapes.items()], RINGS)
    cells = lambda block, levels: {tuple(r) for r in zonal.touched_cells(parcels, block=block, levels=levels).collect()}
    assert cells(4, 3) == cells(16, 0) == cells(8, 5)


def test_stored_blocks_are_not_shuffled(spark, tmp_path):
    parcels = spark.createDataFrame([("a", rings([(1, 1), (90, 3), (40, 80)]))], RINGS)
    pixels = spark.range(10_000).selectExpr("id % 100 AS x", "id div 100 AS y", "cast(id % 7 AS int) AS code")
    stored = raster.write_raster(pixels, str(tmp_path / "r"), buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = zonal.zonal_counts(parcels, stored)
        counts.collect()
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = plan[: plan.index("codes#")].splitlines()[-1] if "codes#" in plan else ""
    blocks = [line for line in plan.splitlines() if "FileScan" in line and "codes" in line]
    assert blocks and all("Bucketed: true" in line for line in blocks), scan
    again = raster.open_raster(spark, str(tmp_path / "r"))
    count = lambda r: {(c.code, c.n) for c in zonal.zonal_counts(parcels, r).collect()}
    assert count(again) == count(stored)


def test_z_order(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (3, 3), (1000, 77)], "x long, y long")
    interleaved = lambda a, b: sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(24))
    for r in df.select("x", "y", raster.z_order(F.col("x"), F.col("y")).alias("z")).collect():
        assert r.z == interleaved(r.x, r.y)


def test_zonal_majority_ties_and_gaps(spark):
    parcels = spark.createDataFrame(
        [("tie", rings([(0, 0), (2, 0), (2, 1), (0, 1)])), ("off", rings([(90, 90), (91, 90), (91, 91), (90, 91)])), ("odd", rings([(2, 0), (3, 0), (3, 1), (2, 1)]))],
        RINGS,
    )
    pixels = spark.createDataFrame([(0, 0, 5), (1, 0, 1), (2, 0, 999)], "x long, y long, code int")
    got = {r.parcel_id: (r.crop_code, r.crop_name) for r in zonal.label_from_raster(parcels, pixels).collect()}
    assert got == {"tie": (1, "corn"), "off": (None, None), "odd": (999, "unknown")}


def test_raster_tables(spark, tmp_path):
    pixels = spark.range(400).selectExpr("id % 20 AS x", "id div 20 AS y", "cast(id % 7 AS int) AS code")
    raster.write_pixels(pixels, str(tmp_path / "px"), 5)
    window = raster.read_pixels(spark, str(tmp_path / "px"), (3, 4, 6, 9))
    assert window.count() == 24 and raster.read_pixels(spark, str(tmp_path / "px")).count() == 400
    assert "PushedFilters: [IsNotNull(x)" in window._jdf.queryExecution().executedPlan().toString()
    tiles = spark.createDataFrame([("s", b, 0, 0, [1]) for b in ("B02", "B04")], "scene_id string, band string, tx int, ty int, pixels array<int>")
    raster.write_tiles(tiles, str(tmp_path / "tiles"))
    assert raster.read_tiles(spark, str(tmp_path / "tiles"), ["B04"]).count() == 1


def test_projected_labels(spark):
    parcels = spark.createDataFrame([("a", rings([(10, 20), (12, 20), (12, 22), (10, 22)]))], RINGS)
    pixels = spark.createDataFrame([(0, 0, 5)], "x long, y long, code int")
    grid = lambda lon, lat: ((lon - 10) / 2, (lat - 20) / 2)
    assert zonal.label_from_raster(parcels, pixels, grid).first().crop_name == "soybeans"


def test_places_without_coordinates_are_skipped(spark):
    places = spark.createDataFrame([("a", 41.0, -94.0), ("b", 41.1, -94.0), ("c", None, None)], "id string, lat double, lon double")
    got = {(r.id, r.neighbor_id) for r in similarity.nearest_places(places, 5).collect()}
    assert got == {("a", "b"), ("b", "a")}


def test_southern_zones_count_from_ten_thousand_kilometres(spark):
    # 60 W 30 S is 789,409 m east and 6,677,424 m north in zone 20 south.
    x, y = geo.utm(F.lit(-60.0), F.lit(-30.0), geo.utm_zone(F.lit(-60.1)))
    got = spark.range(1).select(x, y).first()
    assert got[0] == pytest.approx(789_409, abs=1) and got[1] == pytest.approx(6_677_424, abs=1)
