"""Training data: classes, manifests, splits, augmentation, linear head."""

from collections import Counter
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from parcelspark.operators import training
from parcelspark.sources import tables


def parcels(spark):
    names = ["corn"] * 5 + ["rye"] * 2 + ["oats"] * 3 + [None]
    return spark.createDataFrame([(f"p{i}", n) for i, n in enumerate(names)], "parcel_id string, crop_name string")


TARGETS = ["oats", "rye", "corn", "barley"]


def test_classes_and_manifest(spark):
    classes = training.eligible_classes(parcels(spark), TARGETS, 3)
    assert {r.crop_name: r.crop_class_id for r in classes.collect()} == {"oats": 0, "corn": 1}
    assert {r.crop_name: r.n for r in training.dropped_classes(parcels(spark), TARGETS, 3).collect()} == {"rye": 2, "barley": 0}
    chips = spark.createDataFrame([("p0", date(2024, 5, 1)), ("p0", date(2024, 5, 2)), ("p5", date(2024, 5, 1))], "parcel_id string, obs_date date")
    rows = training.manifest(parcels(spark), chips, classes).collect()
    assert sorted((r.chip_path, r.crop_class_id) for r in rows) == [("p0/2024-05-01", 1), ("p0/2024-05-02", 1)]


def samples(spark):
    rows = [(f"p{i // 4}/{i % 4}", 0 if i < 300 else 1, f"p{i // 4}") for i in range(400)]
    return spark.createDataFrame(rows, "chip_path string, crop_class_id int, parcel_id string")


def test_split_is_a_stratified_partition(spark):
    rows = training.stratified_split(samples(spark)).collect()
    assert len(rows) == 400 and len({r.chip_path for r in rows}) == 400
    counts = Counter((r.crop_class_id, r.split) for r in rows)
    assert counts == {(0, "test"): 30, (0, "val"): 30, (0, "train"): 240, (1, "test"): 10, (1, "val"): 10, (1, "train"): 80}
    again = {r.chip_path: r.split for r in training.stratified_split(samples(spark).repartition(5)).collect()}
    assert again == {r.chip_path: r.split for r in rows}
    other = {r.chip_path: r.split for r in training.stratified_split(samples(spark), seed=7).collect()}
    assert other != again


def test_split_by_parcel_keeps_parcels_together(spark):
    rows = training.stratified_split(samples(spark), unit=["parcel_id"]).collect()
    places = {}
    for r in rows:
        places.setdefault(r.parcel_id, set()).add(r.split)
    assert len(rows) == 400 and all(len(s) == 1 for s in places.values())


def test_manifest_files(spark, tmp_path):
    split = training.stratified_split(samples(spark))
    tables.write_manifests(split, str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert back.count() == 400 and back.where("split = 'val'").count() == 40
    classes = training.eligible_classes(parcels(spark), TARGETS, 3)
    tables.write_class_mapping(classes, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).first()[0] == '{"0":"oats","1":"corn"}'


def test_augment(spark):
    rows = [(i, [[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]], 2, 3) for i in range(200)]
    chips = spark.createDataFrame(rows, "id int, pixels array<array<int>>, height int, width int")
    got = training.augment(chips, ["id"], band_dropout=0.0).collect()
    grid = np.array(rows[0][1]).reshape(2, 2, 3)
    forms = {"": grid, "h": grid[:, :, ::-1], "v": grid[:, ::-1], "hv": grid[:, ::-1, ::-1]}
    seen = Counter(next(k for k, g in forms.items() if g.reshape(2, -1).tolist() == r.pixels) for r in got)
    assert set(seen) == set(forms) and min(seen.values()) > 25
    dropped = training.augment(chips, ["id"], flip_horizontal=False, flip_vertical=False, band_dropout=0.3).collect()
    blank = sum(set(b) == {0} for r in dropped for b in r.pixels)
    assert 80 < blank < 160 and dropped == training.augment(chips.repartition(3), ["id"], flip_horizontal=False, flip_vertical=False, band_dropout=0.3).orderBy("id").collect()


def test_linear_head(spark):
    rng = np.random.RandomState(1)
    rows = []
    for i in range(240):
        c = i % 3
        v = rng.randn(4) * 0.3
        v[c] += 2
        rows.append((f"c{i}", c, "test" if i % 5 == 0 else "train", v.tolist()))
    df = spark.createDataFrame(rows, "chip_path string, crop_class_id int, split string, embedding array<float>")
    model = training.linear_head(df)
    metrics = training.head_metrics(training.head_predictions(model, df.where("split = 'test'")))
    assert metrics["accuracy"] > 0.95 and metrics["f1"] > 0.95


def test_relabel(spark):
    shapes = spark.createDataFrame(
        [("a", "rye", 27, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]])],
        "parcel_id string, crop_name string, crop_code int, rings array<array<struct<lon:double,lat:double>>>",
    )
    pixels = spark.createDataFrame([(0, 0, 1)], "x long, y long, code int")
    row = training.relabel(shapes, pixels).first()
    assert (row.crop_code, row.crop_name) == (1, "corn")
