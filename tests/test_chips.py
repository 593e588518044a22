"""Chips: plan, assembly from tiles, nodata rule, encoder inputs and mock vectors."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.functions import encoding
from parcelspark.operators import chips, encode, incremental

DAY = date(2024, 5, 1)
CHIP = (
    "parcel_id string, obs_date date, lat double, lon double, gsd double, bands array<string>, "
    "pixels array<array<int>>, height int, width int"
)


def test_plan_is_parcels_by_dates_without_a_join(spark):
    parcels = spark.createDataFrame([(f"p{i}",) for i in range(4)], "parcel_id string")
    scenes = spark.createDataFrame(
        [("a", DAY, 5.0), ("b", DAY, 1.0), ("c", date(2024, 5, 2), 9.0)], "scene_id string, scene_date date, cloud_cover double"
    )
    plan = chips.chip_plan(parcels, scenes)
    assert {(r.parcel_id, r.scene_id) for r in plan.collect()} == {(f"p{i}", s) for i in range(4) for s in "bc"}
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Cartesian" not in text
    assert [r.parcel_id for r in chips.cap_parcels(parcels, 2).collect()] == ["p0", "p1"]


def raster(size):
    rng = np.random.RandomState(8)
    return rng.randint(1, 4000, (size, size))


def make_tiles(spark, image, band, tile):
    """Tiles of an image whose pixel (row, col) covers x in [col, col+1), y in [-row-1, -row)."""
    rows = []
    for r in range(0, image.shape[0], tile):
        for c in range(0, image.shape[1], tile):
            piece = image[r : r + tile, c : c + tile]
            rows.append(("s", band, c // tile, -(r // tile) - 1, piece.ravel().tolist()))
    return spark.createDataFrame(rows, "scene_id string, band string, tx int, ty int, pixels array<int>")


def windows(spark, rows):
    full = [(p, "s", DAY, 0.0, 0.0, *w) for p, *w in rows]
    return spark.createDataFrame(
        full, "parcel_id string, scene_id string, scene_date date, lat double, lon double, west double, south double, east double, north double"
    )


def test_chips_across_tiles(spark):
    image = raster(32)
    tiles = make_tiles(spark, image, "B02", 8).unionByName(make_tiles(spark, image[::-1], "B03", 8))
    asked = windows(spark, [("exact", 5.0, -21.0, 15.0, -11.0), ("half", 3.5, -12.5, 13.5, -2.5), ("coarse", 2.0, -30.0, 30.0, -2.0), ("out", 100.0, -120.0, 110.0, -110.0)])
    res = {"B02": 1.0, "B03": 1.0}
    got = {r.parcel_id: r for r in chips.extract_chips(asked, tiles, ["B02", "B03"], res, tile_px=8, size_px=10).collect()}
    plain = lambda r: np.array(r.pixels[0]).reshape(10, 10)
    assert (plain(got["exact"]) == image[11:21, 5:15]).all()
    assert (np.array(got["exact"].pixels[1]).reshape(10, 10) == image[::-1][11:21, 5:15]).all()
    mean4 = (image[2:13, 3:14].astype(float)[:-1, :-1] + image[2:13, 3:14][:-1, 1:] + image[2:13, 3:14][1:, :-1] + image[2:13, 3:14][1:, 1:]) / 4
    assert np.abs(plain(got["half"]) - mean4).max() <= 0.5
    # 28 pixels onto 10: centres at 2 + 2.8 (i + 0.5), sampled between the four nearest pixel centres.
    at = 2 + 2.8 * (np.arange(10) + 0.5) - 0.5
    i0, f = np.floor(at).astype(int), at - np.floor(at)
    rows = image[i0] * (1 - f)[:, None] + image[i0 + 1] * f[:, None]
    expected = rows[:, i0] * (1 - f)[None, :] + rows[:, i0 + 1] * f[None, :]
    assert np.abs(plain(got["coarse"]) - expected).max() <= 0.5
    assert got["out"].pixels is None and got["exact"].bands == ["B02", "B03"] and got["exact"].obs_date == DAY

    only = chips.extract_chips(asked, tiles.where("band = 'B02'"), ["B02", "B03"], res, tile_px=8, size_px=10)
    assert {r.outcome: r.n for r in chips.count_outcomes(chips.chip_outcome(only)).collect()} == {"skipped_error": 4}


def crowd(spark, n):
    """Nine of ten windows lie on the tile (0, -1), the others anywhere."""
    rng = np.random.RandomState(4)
    low = np.where(rng.rand(n) < 0.9, rng.uniform(1, 4, n), rng.uniform(8, 24, n))
    rows = [(f"p{i}", float(x), -float(x) - 3.0, float(x) + 3.0, -float(x)) for i, x in enumerate(low)]
    return low, windows(spark, rows)


def test_windows_of_a_wanted_tile_are_spread(spark):
    low, asked = crowd(spark, 400)
    lists = chips.wanted_tiles(asked, ["B02"], {"B02": 1.0}, 8, per_cut=20).collect()
    hot = [len(r.windows) for r in lists if (r.tx, r.ty) == (0, -1)]
    assert sum(hot) >= 350 and len(hot) == -(-sum(hot) // 20) and max(hot) <= 2 * 20
    assert max(len(r.windows) for r in lists) <= 2 * 20
    assert {r.salt for r in chips.wanted_tiles(asked, ["B02"], {"B02": 1.0}, 8, per_cut=1000).collect()} == {0}


def test_each_tile_is_read_once_a_list(spark):
    _, asked = crowd(spark, 400)
    tiles = make_tiles(spark, raster(32), "B02", 8)
    lists = chips.wanted_tiles(asked, ["B02"], {"B02": 1.0}, 8, 50).collect()
    jobs = chips.tile_jobs(asked, tiles, ["B02"], {"B02": 1.0}, 8, 50)
    read = jobs.select("tx", "ty", F.size("windows").alias("n")).collect()
    inside = [r for r in lists if 0 <= r.tx < 4 and -4 <= r.ty < 0]
    assert sorted((r.tx, r.ty, r.n) for r in read) == sorted((r.tx, r.ty, len(r.windows)) for r in inside)
    assert len(read) < 100 and chips.cut_tiles(jobs, 8).count() >= 400


@pytest.mark.parametrize("per_cut", [3, 128])
def test_lists_of_windows_change_nothing(spark, per_cut):
    image = raster(32)
    low, asked = crowd(spark, 60)
    tiles = make_tiles(spark, image, "B02", 8)
    got = chips.extract_chips(asked, tiles, ["B02"], {"B02": 1.0}, tile_px=8, size_px=3, per_cut=per_cut)
    for r in got.collect():
        at = low[int(r.parcel_id[1:])] + np.arange(3)
        i, f = np.floor(at).astype(int), at - np.floor(at)
        rows = image[i] * (1 - f)[:, None] + image[np.minimum(i + 1, 31)] * f[:, None]
        expected = rows[:, i] * (1 - f)[None, :] + rows[:, np.minimum(i + 1, 31)] * f[None, :]
        assert np.abs(np.array(r.pixels[0]).reshape(3, 3) - expected).max() <= 0.5


def test_chip_windows(spark):
    plan = spark.createDataFrame([("p", "s", DAY), ("q", "s", DAY)], "parcel_id string, scene_id string, scene_date date")
    parcels = spark.createDataFrame([("p", 42.0, -93.0), ("q", None, None)], "parcel_id string, centroid_lat double, centroid_lon double")
    row = chips.windows(plan, parcels, 224, 10.0).collect()
    assert len(row) == 1 and row[0].north - row[0].south == pytest.approx(2240 / 111_320)
    metres = chips.windows(plan, parcels, 224, 10.0, lambda lon, lat: (lon * 1000, -lat * 500)).first()
    assert metres.east > metres.west and metres.north > metres.south


def one_chip(spark, pixels, bands=("B02", "B03", "B04")):
    return spark.createDataFrame([("p", DAY, 42.0, -93.0, 10.0, list(bands), pixels, 2, 2)], CHIP)


def test_nodata_rule(spark):
    share = lambda pixels: one_chip(spark, pixels).select(chips.nodata_fraction(F.col("pixels"))).first()[0]
    assert share([[0, 0, 0, 1], [0, 0, 0, 0], [0, 1, 0, 0]]) == 0.5
    half = one_chip(spark, [[0, 0, 1, 1]] * 3)
    assert chips.keep_covered(half, 0.5).count() == 1 and chips.keep_covered(half, 0.49).count() == 0
    assert chips.chip_outcome(half, 0.3).first().outcome == "skipped_nodata"
    assert chips.chip_outcome(half, 0.5).first().outcome == "extracted"


def test_preview(spark):
    r = chips.rgb_preview(one_chip(spark, [[0, 3000, 1500, 6000], [1] * 4, [300] * 4])).first()
    assert r.blue == [0.0, 1.0, 0.5, 1.0] and r.red == [0.1] * 4
    many = spark.createDataFrame([("p", date(2024, 5, d)) for d in range(1, 20)], "parcel_id string, obs_date date")
    assert [r.obs_date.day for r in chips.first_chips(many, "p").collect()] == list(range(1, 13))


def test_encoder_inputs(spark):
    df = one_chip(spark, [[10_000, 0, 0, 0]] * 2, ("B02", "B99"))
    r = df.select(
        encoding.reflectance(F.col("pixels")).alias("px"), encoding.time_encoding(F.col("obs_date")).alias("t"),
        encoding.place_encoding(F.col("lat"), F.col("lon")).alias("l"), encoding.wavelengths(F.col("bands")).alias("w"),
    ).first()
    angle = 2 * np.pi * 122 / 365.25
    assert r.px[0] == [1.0, 0.0, 0.0, 0.0] and r.w == [492.4, 0.0]
    assert r.t == pytest.approx([np.sin(angle), np.cos(angle), 0, 1])
    assert r.l == pytest.approx([np.sin(np.radians(42)), np.cos(np.radians(42)), np.sin(np.radians(-93)), np.cos(np.radians(-93))])


def test_mock_vectors(spark):
    """Seeded by the MD5 of the id alone."""
    import hashlib

    df = spark.createDataFrame([("p1", DAY), ("p1", date(2024, 6, 1)), ("p2", DAY)], "parcel_id string, obs_date date")
    got = encode.mock_embeddings(df, 32).collect()
    for r in got:
        seed = int(hashlib.md5(r.parcel_id.encode()).hexdigest()[:8], 16)
        v = np.random.RandomState(seed).randn(32).astype(np.float32)
        assert r.embedding == pytest.approx(v / (np.linalg.norm(v) + 1e-8), abs=1e-6)


def token_encoder():
    def encode_batch(pixels, time, place, gsd, waves):
        assert pixels.shape[1:] == (2, 2, 2) and waves.shape[1:] == (2,)
        tokens = np.zeros((len(pixels), 3, 2), dtype=np.float32)
        tokens[:, 0, :] = pixels.mean(axis=(2, 3))
        return tokens

    return encode_batch


def test_encoder_and_incremental_runs(spark):
    px = [[10_000, 20_000, 30_000, 40_000], [0] * 4]
    rows = [(p, DAY, 42.0, -93.0, 10.0, ["B02", "B03"], x, 2, 2) for p, x in (("a", px), ("b", px), ("c", None))]
    todo = spark.createDataFrame(rows, CHIP)
    done = spark.createDataFrame([("a", DAY, "v2"), ("b", DAY, "v1")], "parcel_id string, obs_date date, encoder_version string")
    made = encode.embed_pending(todo, done, token_encoder, "v2", (2, 2, 2)).collect()
    assert [(r.parcel_id, r.embedding, r.encoder_version) for r in made] == [("b", [2.5, 0.0], "v2")]
    assert incremental.fresh_results(done, "v2").count() == 1
    assert incremental.pending(todo, todo).count() == 0
    assert incremental.unique_observations(todo.unionByName(todo)).count() == 3


def test_pending_holds_neither_side(spark):
    plan = spark.range(9).select(F.col("id").alias("parcel_id"), F.lit("2024-05-01").cast("date").alias("obs_date"))
    left = incremental.pending(plan, plan.where("parcel_id % 3 = 0"))
    text = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text and left.count() == 6
