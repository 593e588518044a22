"""A whole campaign on small made-up files: scenes, chips, vectors, scores, report, explanations, training."""

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.functions.season import Season
from parcelspark.operators.scoring import ScoringRules
from parcelspark.plans.campaign import Campaign, embed, explain_campaign, index_scenes, make_chips, monitor, prepare_training


def encoder():
    return lambda pixels, time, place, gsd, waves: np.concatenate([pixels.mean(axis=(2, 3)), time[:, :2]], axis=1)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    return Campaign(
        folder=str(tmp_path_factory.mktemp("campaign")), season=Season("2024-05-01", "2024-07-01"), bands=["B02", "B04"], min_parcels=3,
        max_cloud=50, size_px=4, resolution_m=400.0, tile_px=16, band_res={"B02": 0.01, "B04": 0.01}, rules=ScoringRules(sigma_yellow=0.5, sigma_red=1.5),
    )


@pytest.fixture(scope="module")
def parcels(spark):
    rows = []
    for i in range(8):
        lon, lat = 0.1 + 0.02 * i, 0.1 + 0.01 * i
        ring = [(lon - 0.01, lat - 0.01), (lon + 0.01, lat - 0.01), (lon + 0.01, lat + 0.01), (lon - 0.01, lat + 0.01)]
        rows.append((f"p{i}", "corn" if i < 6 else "rye", lat, lon, 1.0, "t", "00_00", [ring]))
    return spark.createDataFrame(
        rows, "parcel_id string, crop_name string, centroid_lat double, centroid_lon double, area_ha double, tile_id string, "
        "fragment_id string, rings array<array<struct<lon:double,lat:double>>>",
    )


def test_campaign(spark, run, parcels):
    days = [date(2024, 5, 3), date(2024, 5, 20), date(2024, 6, 10)]
    catalogue = spark.createDataFrame(
        [(f"s{i}", "c", d, 10.0, [-1.0, -1.0, 1.0, 1.0], {"blue": "u", "B04": "u"}) for i, d in enumerate(days)]
        + [("cloudy", "c", days[0], 40.0, [-1.0, -1.0, 1.0, 1.0], {"blue": "u"}), ("away", "c", days[0], 1.0, [5.0, 5.0, 6.0, 6.0], {"blue": "u"})],
        "scene_id string, collection string, scene_date date, cloud_cover double, bbox array<double>, assets map<string,string>",
    )
    index = index_scenes(run, parcels, catalogue)
    assert sorted(r.scene_id for r in index.collect()) == ["cloudy", "s0", "s1", "s2"]
    assert index_scenes(run, parcels, catalogue.limit(0)).count() == 4  # the stored index covers the season

    rng = np.random.RandomState(0)
    tiles = spark.createDataFrame(
        [
            (f"s{s}", band, tx, ty, ([0] * 256 if s == 2 else rng.randint(1, 9000, 256).tolist()))
            for s in range(3) for band in ("B02", "B04") for tx in range(-1, 4) for ty in range(-1, 4)
        ],
        "scene_id string, band string, tx int, ty int, pixels array<int>",
    )
    counts = {r.outcome: r.n for r in make_chips(run, parcels, index, tiles).collect()}
    assert counts == {"extracted": 16, "skipped_nodata": 8}
    again = {r.outcome: r.n for r in make_chips(run, parcels, index, tiles).collect()}
    assert again == {"skipped_nodata": 8} and spark.read.parquet(run.path("chips")).count() == 16

    seen = embed(run, encoder, "v1")
    assert seen.count() == 16 and embed(run, encoder, "v1").count() == 16
    made = monitor(run, parcels, seen)
    scores = {r.parcel_id: r for r in made["scores"].collect()}
    assert len(scores) == 8 and scores["p7"].status == "GRAY" and scores["p0"].n_observations == 2
    report = json.loads(spark.read.text(run.path("report")).first()[0])
    assert report["total_parcels"] == 8 and report["status_counts"]["GRAY"] == 2 and len(report["crop_breakdown"]) == 2
    assert spark.read.text(run.path("scores_geojson")).count() == 8 and made["vectors"].count() == 8

    explained = explain_campaign(run, made)
    assert explained.count() == 8
    assert explain_campaign(run, made, parcel_ids=["p1"], model="again").where("llm_model = 'again'").count() == 1
    kept = explain_campaign(run, made, skip_unchanged=True, model="third")
    assert kept.where("llm_model = 'third'").count() == 0 and kept.count() == 8

    rows = prepare_training(run, parcels, ["corn", "rye"], 3, (0.5, 0.25, 0.25), ["parcel_id"])
    assert rows.count() == 12 and rows.select("split").distinct().count() == 3
    assert spark.read.text(run.path("class_mapping")).first()[0] == '{"0":"corn"}'


def test_mock_vectors_for_a_trial_run(spark, run):
    assert embed(run, None, "mock").agg(F.max(F.size("embedding"))).first()[0] == 768
