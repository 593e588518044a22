"""Report aggregates on hand-made scores."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from parcelspark.operators import report

SCORES = (
    "parcel_id string, fragment_id string, tile_id string, crop_name string, health_score double, status string, "
    "n_observations long, max_deviation_date date, trajectory array<struct<obs_date:date,distance:double>>"
)


@pytest.fixture(scope="module")
def scores(spark):
    d = date(2024, 5, 1)
    rows = [
        ("a", "00", "t", "corn", 0.1, "GREEN", 4, d, [(d, 0.1), (d, 0.2), (d, 0.4)]),
        ("b", "00", "t", "corn", 0.2, "YELLOW", 3, d, []),
        ("c", "01", "t", "corn", 0.4, "RED", 2, d, []),
        ("d", "01", "u", "corn", 0.0, "GRAY", 1, None, []),
        ("e", "01", "u", "rye", None, "GRAY", None, None, []),
        ("f", "02", "u", None, None, "GRAY", 0, None, []),
    ]
    return spark.createDataFrame(rows, SCORES).cache()


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_summary(scores):
    got = rows(report.crop_summary(scores), "crop_name")
    corn = got["corn"]
    assert (corn.total, corn.green, corn.yellow, corn.red, corn.gray) == (4, 1, 1, 1, 1)
    assert corn.avg_health_score == 0.175 and got["rye"].avg_health_score is None
    assert rows(report.crop_rollup(scores), "crop_name")["all"].total == 5


def test_means_on_a_tie_ignore_order(spark):
    values = [0.8309, 0.8310] * 3
    for order in (values, values[::-1]):
        df = spark.createDataFrame([("c", v, "GREEN") for v in order], "crop_name string, health_score double, status string")
        assert report.crop_summary(df.repartition(3)).first().avg_health_score == 0.831


def test_status_shares(scores):
    got = rows(report.status_counts(scores), "status")
    assert (got["GRAY"].n, got["GRAY"].pct, got["GRAY"].monitored_pct) == (3, 50.0, None)
    assert (got["RED"].pct, got["RED"].monitored_pct) == (16.7, 33.0)


def test_coverage_worst_and_alerts(scores):
    c = report.temporal_coverage(scores).first()
    assert (c.mean_observations, c.min_observations, c.max_observations, c.median_observations) == (1.7, 0, 4, 1.5)
    assert [r.parcel_id for r in report.worst_parcels(scores, 3).collect()] == ["c", "b", "a"]
    assert "TakeOrderedAndProject" in report.worst_parcels(scores, 3)._jdf.queryExecution().executedPlan().toString()
    listed = report.by_severity(report.alerts(scores))
    assert [r.parcel_id for r in listed.collect()] == ["c", "b"] and "area_ha" not in listed.columns
    assert [r.parcel_id for r in report.alerts(scores, ("RED",)).collect()] == ["c"]


def test_selection(scores):
    pick = lambda **kw: sorted(r.parcel_id for r in report.select_region(scores, **kw).collect())
    assert pick(fragments=["01"]) == ["c", "d", "e"] and pick(tiles=["u"], fragments=["01"]) == ["d", "e"] and len(pick()) == 6
    assert report.of_crop(scores, "rye").count() == 1 and report.of_parcels(scores, ["a", "f"]).count() == 2
    assert [r[0] for r in report.picker_values(scores, "crop_name").collect()] == ["corn"]


def test_kpis_histogram_and_colours(scores):
    k = report.crop_kpis(scores).first()
    assert (k.crop_name, k.parcels, k.red_alerts, k.avg_health_score) == ("corn", 3, 1, 0.2333)
    assert {(r.crop_name, r.bin): r.n for r in report.score_histogram(scores).collect()} == {("corn", 1): 1, ("corn", 11): 1, ("corn", 30): 1}
    one = scores.where("parcel_id = 'a'")
    assert [(r.bin, r.n) for r in report.score_histogram(one).collect()] == [(1, 1)]
    assert [r.colour for r in report.point_colours(one, 0.15, 0.3).collect()] == ["green", "orange", "red"]


def test_labels(scores):
    o = report.label_overview(scores).first()
    assert tuple(o) == (6, 5, 1, 2, "corn", 66.7)
    assert {r.crop_name: (r.n, r.pct) for r in report.class_balance(scores).collect()} == {"corn": (4, 66.7), "rye": (1, 16.7)}


def test_inventory(spark, scores):
    chips = scores.where("parcel_id in ('a', 'b')").select("parcel_id").union(scores.where("parcel_id = 'a'").select("parcel_id"))
    scenes = spark.createDataFrame([(date(2024, 5, 1),), (date(2024, 5, 1),), (date(2024, 5, 2),)], "scene_date date")
    i = report.inventory(scores, scenes, chips, chips).first()
    assert (i.parcels, i.scene_dates, i.chips, i.parcels_with_chips, i.embeddings, i.dates_per_parcel, i.possible_chips) == (6, 2, 3, 2, 3, 1.5, 4)


def test_campaign_report(spark, scores):
    limits = spark.createDataFrame([("fixed", 0.15, 0.3)], "method string, green double, red double")
    one = report.campaign_report(scores, limits, {"start_date": "2024-04-15"}, "here")
    doc = json.loads(one.select(F.to_json(F.struct(*one.columns))).first()[0])
    assert doc["total_parcels"] == 6 and doc["status_counts"] == {"GREEN": 1, "YELLOW": 1, "RED": 1, "GRAY": 3}
    assert [c["crop_name"] for c in doc["crop_breakdown"]] == ["corn", "rye"]
    assert [w["parcel_id"] for w in doc["top10_worst"]] == ["c", "b", "a", "d"]
    assert doc["temporal_coverage"]["median_observations"] == 1.5 and doc["thresholds"]["red"] == 0.3 and doc["region"] == "here"
