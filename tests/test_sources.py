"""Files in and out: fragments, labels, catalogues, archives, exports, upserts."""

import json
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelspark.operators import scenes
from parcelspark.plans import table_queries
from parcelspark.session import parallelism
from parcelspark.sources import archives, catalog, parcels, tables


def feature(properties, ring=((0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01), (0, 0)), **extra):
    ring = [[-93.0 + x, 42.0 + y] for x, y in ring]
    return {"type": "Feature", **extra, "properties": properties, "geometry": {"type": "Polygon", "coordinates": [ring]}}


def write_fragment(folder, tile, fragment, features):
    path = folder / tile
    path.mkdir(exist_ok=True)
    (path / f"{tile}_fragment_{fragment}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))


@pytest.fixture()
def fields(tmp_path):
    write_fragment(
        tmp_path, "16tgk", "00_00",
        [
            feature({"id": 7, "kind": "top", "props": {"kind": "nested", "area": 25000, "center_lat": 42.5, "center_lng": -93.5, "crops_2022": "Winter Wheat/Soybeans", "crops_ids_2022": "26", "crops_2021": "Corn"}}),
            feature({"id": 8, "props": {"crops_2022": None, "crops_ids_2022": "n/a"}}),
        ],
    )
    write_fragment(tmp_path, "16tgk", "00_01", [feature({"props": {"crops_2022": "Corn", "crops_ids_2022": "1.0", "confidence_2022": 0.9}}), feature({})])
    write_fragment(tmp_path, "17abc", "00_00", [feature({"parcel_id": "own", "props": {"crops_2022": "Rye"}})])
    return tmp_path


def test_discovery(spark, fields):
    found = parcels.discover_fragments(spark, str(fields), ["16tgk", "none", "17abc"])
    assert [p.rsplit("/", 1)[1] for p in found] == [
        "16tgk_fragment_00_00.geojson", "16tgk_fragment_00_01.geojson", "17abc_fragment_00_00.geojson",
    ]
    assert len(parcels.discover_fragments(spark, str(fields), ["16tgk"], ["00_01", "09_09"])) == 1
    assert parcels.discover_fragments(spark, str(fields), []) == []


def test_ingest_embedded(spark, fields):
    got = {r.parcel_id: r for r in parcels.ingest(spark, str(fields), ["16tgk", "17abc"]).collect()}
    assert set(got) == {"7", "8", "16tgk_00_01_0", "16tgk_00_01_1", "own"}
    seven, eight = got["7"], got["8"]
    assert (seven.tile_id, seven.fragment_id, seven.crop_name, seven.crop_code) == ("16tgk", "00_00", "winter_wheat_soybeans", 26)
    assert (seven.area_ha, seven.centroid_lat, seven.centroid_lon) == (2.5, 42.5, -93.5)
    assert seven.attrs == {"kind": "top"}
    assert (eight.crop_name, eight.crop_code) == (None, None)
    assert eight.centroid_lat == pytest.approx(42.005) and eight.area_ha == pytest.approx(91.9, abs=0.5)
    assert got["16tgk_00_01_0"].crop_code == 1 and got["16tgk_00_01_1"].crop_name is None
    assert got["own"].crop_name == "rye" and len(seven.rings[0]) == 5


def test_ingest_errors(spark, fields):
    with pytest.raises(ValueError, match="crops_2021"):
        parcels.ingest(spark, str(fields), ["16tgk"], year=1999)
    with pytest.raises(FileNotFoundError):
        parcels.ingest(spark, str(fields), ["none"])
    with pytest.raises(ValueError, match="label source"):
        parcels.ingest(spark, str(fields), ["16tgk"], source="other")


def test_codes_from_names(spark, fields):
    got = {r.parcel_id: r for r in parcels.ingest(spark, str(fields), ["17abc"]).collect()}
    assert got["own"].crop_code == 27


def test_ingest_label_table(spark, fields, tmp_path):
    labels = tmp_path / "labels.csv"
    labels.write_text("parcel_id,crop_code,crop_name\n7,5,soybeans\n")
    got = {r.parcel_id: r for r in parcels.ingest(spark, str(fields), ["16tgk"], source="local", labels_path=str(labels)).collect()}
    assert len(got) == 4 and (got["7"].crop_code, got["7"].crop_name) == (5, "soybeans") and got["8"].crop_name is None
    labels.write_text("parcel_id,crop\n7,5\n")
    with pytest.raises(ValueError, match="crop_code"):
        parcels.read_labels(spark, str(labels))


def test_ingest_raster_and_sample(spark, fields):
    pixels = spark.createDataFrame([(0, 0, 1)], "x long, y long, code int")
    grid = lambda lon, lat: ((lon + 93) * 100, (lat - 42) * 100)
    rows = parcels.ingest(spark, str(fields), ["16tgk"], source="raster", pixels=pixels, project=grid, sample=2).collect()
    assert [r.crop_name for r in rows] == ["corn", "corn"]


def item(name, day, cloud, assets, box=(-94, 41, -92, 43)):
    return {
        "id": name, "collection": "s2", "bbox": list(box), "properties": {"datetime": f"{day}T17:00:00Z", "eo:cloud_cover": cloud},
        "assets": {k: {"href": f"u/{name}/{k}", "title": k} for k in assets},
    }


def test_scene_index(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(item("a", "2024-05-01", 3.0, ["blue", "B04"])))
    many = [
        item("b", "2024-05-01", 2.0, ["B02", "red"]), item("c", "2024-05-09", 50.0, ["B02"]), item("d", "2024-05-03", 1.0, ["thumb"]),
        item("e", "2024-05-07", 1.0, ["B02"]), item("f", "2024-05-08", 1.0, ["B02"], (0, 0, 1, 1)), item("g", "2025-01-01", 1.0, ["B02"]),
    ]
    (tmp_path / "many.json").write_text(json.dumps({"type": "FeatureCollection", "features": many}))
    rows = catalog.read_scene_items(spark, [str(tmp_path / "one.json"), str(tmp_path / "many.json")])
    assert rows.count() == 7
    usable = scenes.resolve_bands(rows, ["B02", "B04"])
    urls = {r.scene_id: r.asset_urls for r in usable.collect()}
    assert urls["a"] == {"B02": "u/a/blue", "B04": "u/a/B04"} and urls["b"]["B04"] == "u/b/red" and "d" not in urls
    index = scenes.scene_index(usable, "2024-04-15", "2024-10-31", bbox=(-93.5, 41.5, -92.5, 42.5), collection="s2", max_scenes=5)
    assert [r.scene_id for r in index.orderBy("scene_date", "scene_id").collect()] == ["a", "b", "e"]
    asked = scenes.question(bbox=(-93.5, 41.5, -92.5, 42.5), collection="s2")
    assert scenes.covers(index, "2024-04-15", "2024-10-31", asked)
    assert not scenes.covers(index, "2024-04-15", "2024-10-31", scenes.question(bbox=(0, 0, 1, 1), collection="s2"))
    assert scenes.covers(index, "2024-04-15", "2024-10-31") and not scenes.covers(index, "2024-04-01", "2024-10-31")
    assert not scenes.covers(usable.drop("x"), "2024-04-15", "2025-01-01") and scenes.covers(usable, "2024-05-01", "2025-01-01")


def test_items_one_a_line_and_in_pages(spark, tmp_path):
    lines = [json.dumps(item(f"i{i}", "2024-05-01", 1.0, ["B02"])) for i in range(25)]
    (tmp_path / "items.jsonl").write_text("\n".join(lines) + "\n")
    assert catalog.read_scene_items(spark, str(tmp_path / "items.jsonl"), by_line=True).count() == 25
    pages = [page for frame in table_queries._collections(10)([pd.DataFrame({"value": lines})]) for page in frame["value"]]
    assert [len(json.loads(page)["features"]) for page in pages] == [10, 10, 5]
    for i, page in enumerate(pages):
        (tmp_path / f"page{i}.json").write_text(page)
    found = catalog.read_scene_items(spark, [str(tmp_path / f"page{i}.json") for i in range(3)])
    assert sorted(r.scene_id for r in found.collect()) == sorted(f"i{i}" for i in range(25))


def test_tasks_do_not_follow_small_splits(spark, tmp_path):
    lines = [json.dumps(feature({"n": str(i)})) for i in range(600)]
    (tmp_path / "a.geojsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        read = parcels.read_features(spark, [str(tmp_path / "a.geojsonl")])
        assert read.rdd.getNumPartitions() <= parallelism(spark)
        found = {r.pos: r.n for r in read.select("pos", F.col("feature.properties")["n"].alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {i: str(i) for i in range(600)}


def test_scene_predicates_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("a", date(2024, 5, 1), 3.0, "s2")], "scene_id string, scene_date date, cloud_cover double, collection string")
    rows.write.parquet(str(tmp_path / "scenes"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = scenes.filter_scenes(spark.read.parquet(str(tmp_path / "scenes")), "2024-04-15", "2024-10-31", 20, "s2")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(cloud_cover,20.0)" in text and "GreaterThanOrEqual(scene_date" in text


def test_a_failed_task_leaves_no_file(tmp_path):
    from pyspark.sql import Row

    writer = archives.ArchiveWriter(f"file:{tmp_path}/out", "npy")
    rows = [Row(parcel_id="p/1", day="2024-05-01", content=b"x"), Row(parcel_id="p2", day="2024-05-02", content=b"y")]

    def broken():
        yield rows[0]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    writer.abort([])
    assert list((tmp_path / "out").rglob("*")) == []
    message = writer.write(iter(rows))
    writer.write(iter(rows[1:]))  # a repeated task
    writer.commit([message])
    files = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert message.files == 2 and files == {"p%2F1/2024-05-01.npy": b"x", "p2/2024-05-02.npy": b"y"}


def test_archives(spark, tmp_path):
    chips = spark.createDataFrame(
        [("p1", date(2024, 5, 1), 42.0, -93.0, 10.0, ["B02", "B03"], [[1, 2, 3, 4], [5, 6, 7, 8]], 2, 2)], archives.CHIP_SCHEMA
    )
    archives.write_chip_archive(chips, str(tmp_path / "chips"))
    (tmp_path / "chips" / "p1" / "2024-05-02.npz").write_bytes(b"broken")
    back = {str(r.obs_date): r for r in archives.read_chip_archive(spark, str(tmp_path / "chips")).collect()}
    assert back["2024-05-01"].pixels == [[1, 2, 3, 4], [5, 6, 7, 8]] and back["2024-05-01"].bands == ["B02", "B03"]
    assert back["2024-05-02"].pixels is None and back["2024-05-02"].parcel_id == "p1"
    counts = archives.decode_outcomes(archives.read_chip_archive(spark, str(tmp_path / "chips")))
    assert {r.outcome: r.n for r in counts.collect()} == {"decoded": 1, "skipped": 1}

    seen = spark.createDataFrame([("p1", date(2024, 5, 1), [0.5, 1.5]), ("p2", date(2024, 5, 1), [2.0, 3.0])], archives.OBSERVATION_SCHEMA)
    archives.write_embedding_archive(seen, str(tmp_path / "vectors"))
    np.save(tmp_path / "vectors" / "p2" / "latest.npy", np.zeros(2))
    rows = {(r.parcel_id, str(r.obs_date)): r.embedding for r in archives.read_embedding_archive(spark, str(tmp_path / "vectors")).collect()}
    assert rows == {("p1", "2024-05-01"): [0.5, 1.5], ("p2", "2024-05-01"): [2.0, 3.0], ("p2", "None"): [0.0, 0.0]}


def test_exports(spark, tmp_path):
    scores = spark.createDataFrame(
        [("a", 0.5, [0.1, 0.2], [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]]), ("b", None, [], None)],
        "parcel_id string, health_score double, distance_trajectory array<double>, rings array<array<struct<lon:double,lat:double>>>",
    )
    tables.write_geojson(scores, str(tmp_path / "geo"))
    lines = {f["properties"]["parcel_id"]: f for f in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "geo")).collect())}
    assert lines["a"]["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]]
    assert lines["a"]["properties"]["distance_trajectory"] == "[0.1,0.2]"
    assert lines["b"]["geometry"] is None and lines["b"]["properties"]["health_score"] is None

    limits = spark.createDataFrame([("adaptive", 0.2, 0.4)], "method string, green double, red double")
    tables.write_json_row(limits, str(tmp_path / "limits"))
    assert tuple(tables.read_thresholds(spark, str(tmp_path / "limits")).first()) == ("adaptive", 0.2, 0.4)
    assert tuple(tables.read_thresholds(spark, str(tmp_path / "nothing")).first()) == ("fixed", 0.15, 0.30)
    (tmp_path / "part").mkdir()
    (tmp_path / "part" / "x.json").write_text('{"green": 0.5}')
    assert tuple(tables.read_thresholds(spark, str(tmp_path / "part")).first()) == ("fixed", 0.5, 0.30)

    shapes = spark.createDataFrame([("a", [[(0.0, 0.0)]])], "parcel_id string, rings array<array<struct<lon:double,lat:double>>>")
    assert {r.parcel_id for r in tables.attach_geometry(scores.drop("rings"), shapes).collect()} == {"a", "b"}

    tables.write_csv(limits, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["method", "green", "red"]


def test_upsert_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    tables.upsert_table(make([("a", 1), ("b", 1)]), path, ["k"])
    for _ in range(2):
        after = tables.upsert_table(make([("b", 2), ("c", 2)]), path, ["k"])
        assert sorted(map(tuple, after.collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_partial_upsert_rewrites_only_touched_parts(spark, tmp_path):
    path = str(tmp_path / "table")
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    tables.upsert_table(make([(f"k{i}", 1) for i in range(50)]), path, ["k"], 8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").glob("part=*/*.parquet")}
    for _ in range(2):
        after = tables.upsert_table(make([("k7", 2), ("new", 2)]), path, ["k"], 8)
        assert sorted(map(tuple, after.collect())) == sorted([(f"k{i}", 2 if i == 7 else 1) for i in range(50)] + [("new", 2)])
    kept = [p for p in before if p.exists()]
    assert len({p.parent for p in before} - {p.parent for p in kept}) <= 2 and len(kept) >= 6


def test_observation_table_prunes_months(spark, tmp_path):
    rows = spark.createDataFrame([("p", date(2024, m, 3), [1.0]) for m in (5, 6)], archives.OBSERVATION_SCHEMA)
    table = tables.write_observations(rows, str(tmp_path / "obs"))
    june = table.where(F.col("month") == F.lit("2024-06-01").cast("date"))
    assert june.count() == 1 and "PartitionFilters: [isnotnull(month" in june._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_needs_no_shuffle_of_the_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucket_test LOCATION '{tmp_path}/db'")
    rows = spark.range(100).select(F.col("id").cast("string").alias("parcel_id"), F.col("id").alias("v"))
    a = tables.write_bucketed(rows, "bucket_test.a", "parcel_id", 4)
    b = tables.write_bucketed(rows, "bucket_test.b", "parcel_id", 4)
    joined = a.hint("merge").join(b, "parcel_id")
    assert joined.count() == 100
    assert "Exchange hashpartitioning(parcel_id" not in joined._jdf.queryExecution().executedPlan().toString()


def test_several_polygons_and_lines(spark, tmp_path):
    square = lambda x, y: [[[x, y], [x + 0.01, y], [x + 0.01, y + 0.01], [x, y + 0.01], [x, y]]]
    shapes = [
        {"type": "Polygon", "coordinates": square(10, 50)},
        {"type": "MultiPolygon", "coordinates": [square(10, 50), square(10.02, 50)]},
        {"type": "Point", "coordinates": [1, 2]},
        None,
    ]
    features = [{"type": "Feature", "id": str(i), "properties": {"n": i}, "geometry": g} for i, g in enumerate(shapes)]
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "t_fragment_a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (folder / "t_fragment_b.geojsonl").write_text("\n".join(json.dumps(f) for f in features))
    paths = parcels.discover_fragments(spark, str(tmp_path), ["t"])
    got = parcels.read_fragments(spark, paths, ["t"])
    by = {(r.fragment_id, r.parcel_id): r for r in got.collect()}
    for fragment in "ab":
        one, two = by[fragment, "0"], by[fragment, "1"]
        assert two.area_ha == pytest.approx(2 * one.area_ha, rel=1e-3) and len(two.rings) == 2
        assert (two.centroid_lon, two.centroid_lat) == pytest.approx((10.015, 50.005))
        assert by[fragment, "2"].rings is None and by[fragment, "3"].rings is None
    assert {(r.fragment_id, r.n) for r in parcels.unreadable_features(got).collect()} == {("a", 2), ("b", 2)}
