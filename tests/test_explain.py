"""Flags, payloads, replies, prompts and the explanation job."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from parcelspark.functions import replies
from parcelspark.functions.season import Season
from parcelspark.operators import explain, retrieval
from parcelspark.sources.tables import upsert_table

SCORES = (
    "parcel_id string, crop_name string, health_score double, status string, n_observations long, "
    "max_deviation_date date, distance_trajectory array<double>"
)


def flags(spark, distances, green=0.15):
    df = spark.createDataFrame([(distances,)], "d array<double>")
    return df.select(explain.trajectory_flags(F.col("d"), F.lit(green))).first()[0]


@pytest.mark.parametrize(
    "distances, expected",
    [
        ([], []),
        ([0.9], []),
        ([0.2, 0.1], ["early_deviation"]),
        ([0.1, 0.9], []),
        ([0.1, 0.1, 0.9, 0.1, 0.1, 0.1], []),
        ([0.1, 0.2, 0.1, 0.1, 0.1, 0.1], ["early_deviation"]),
        ([0.1, 0.2, 0.3], ["worsening_trend"]),
        ([0.2, 0.3, 0.4], ["early_deviation", "persistent_deviation", "worsening_trend"]),
        ([0.1, 0.1, 0.3, 0.2, 0.16], ["persistent_deviation"]),
        ([0.1, 0.11, 0.12, 0.13, 0.12, 0.11], []),  # exactly 0.6 of the steps rise
    ],
)
def test_trajectory_flags(spark, distances, expected):
    assert flags(spark, distances) == expected


def scores(spark, rows=None):
    rows = rows or [
        ("a", "corn", 0.35, "RED", 7, date(2024, 6, 15), [0.12, 0.2, 0.3, 0.31, 0.4, 0.48, 0.36]),
        ("b", "corn", 0.2, "YELLOW", 2, None, [0.2, 0.2]),
        ("c", None, None, "GRAY", 0, None, []),
    ]
    return spark.createDataFrame(rows, SCORES)


def limits(spark):
    return spark.createDataFrame([("fixed", 0.15, 0.30)], "method string, green double, red double")


def payloads(spark, **kw):
    return explain.build_payloads(scores(spark, **kw), limits(spark), Season())


def test_payload(spark):
    rows = {r.parcel_id: r for r in payloads(spark).collect()}
    a, b, c = (rows[k].payload for k in "abc")
    assert a.trajectory_flags == ["early_deviation", "persistent_deviation", "worsening_trend"]
    assert a.data_quality_flags == [] and a.distance_summary.n_points == 7 and a.distance_summary.max == 0.48
    assert b.data_quality_flags == ["few_observations"] and b.distance_summary["std"] == 0.0
    assert c.data_quality_flags == ["few_observations", "insufficient_data"] and c.distance_summary is None
    assert a.context.scoring_method == "fixed" and a.context.season_end == "2024-10-31"
    again = {r.parcel_id: r.payload_hash for r in payloads(spark).collect()}
    assert again == {k: r.payload_hash for k, r in rows.items()} and len(set(again.values())) == 3


def test_trajectory_text(spark):
    df = spark.createDataFrame([("[0.1, 0.2]",), ("broken",), (None,)], "t string")
    assert [r[0] for r in df.select(explain.parse_trajectory(F.col("t"))).collect()] == [[0.1, 0.2], [], []]


GOOD = {
    "status": "critical", "summary": "s", "possible_causes": ["x"], "confidence": "low", "recommended_action": "go",
    "evidence_used": ["e"], "consistency_check": "consistent",
}


def judge(spark, reply, colour="RED"):
    text = reply if isinstance(reply, str) else json.dumps(reply)
    df = spark.createDataFrame([(text, colour)], "reply string, colour string")
    return replies.with_validated(df, "reply", "colour", "e").first().e


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, ("critical", "low", "consistent")),
        ({"status": " RED "}, ("critical", "low", "consistent")),
        ({"status": "Red"}, None),
        ({"status": "CRITICAL"}, ("critical", "low", "consistent")),
        ({"status": "warning"}, ("warning", "low", "unsupported")),
        ({"status": 3}, None),
        ({"confidence": "Very High"}, ("critical", "high", "consistent")),
        ({"confidence": "sure"}, None),
        ({"consistency_check": "weakly supported"}, ("critical", "low", "weakly_supported")),
        ({"consistency_check": "Inconsistent"}, ("critical", "low", "unsupported")),
        ({"consistency_check": None}, None),
        ({"summary": "s" * 500}, ("critical", "low", "consistent")),
        ({"summary": "s" * 501}, None),
        ({"summary": 5}, None),
        ({"recommended_action": "a" * 301}, None),
        ({"possible_causes": ["c"] * 6}, None),
        ({"possible_causes": [1]}, None),
        ({"possible_causes": "c"}, None),
        ({"possible_causes": None}, None),
        ({"possible_causes": []}, ("critical", "low", "consistent")),
        ({"evidence_used": ["e"] * 9}, None),
        ({"extra": 1}, ("critical", "low", "consistent")),
    ],
)
def test_reply_rules(spark, change, expected):
    e = judge(spark, {**GOOD, **change})
    assert (None if e is None else (e.status, e.confidence, e.consistency_check)) == expected


def test_missing_parts_and_wrapping(spark):
    short = {k: GOOD[k] for k in ("status", "summary", "confidence", "recommended_action")}
    e = judge(spark, "Sure!\n```JSON\n" + json.dumps(short, indent=1) + "\n```\ndone")
    assert e.possible_causes == [] and e.evidence_used == [] and e.consistency_check == "consistent"
    for key in short:
        assert judge(spark, {k: v for k, v in short.items() if k != key}) is None
    for text in ("", "no braces", "} {", '{"status": "cri', "[1]"):
        assert judge(spark, text) is None
    assert judge(spark, GOOD, colour="BLUE").consistency_check == "consistent"


def test_mock_job(spark):
    made = {r.parcel_id: r for r in explain.explain_parcels(payloads(spark)).collect()}
    assert {k: r.llm_status for k, r in made.items()} == {"a": "critical", "b": "insufficient_data", "c": "insufficient_data"}
    assert json.loads(made["b"].explanation_json)["consistency_check"] == "unsupported"
    assert made["a"].llm_model == "mock" and made["a"].geo_rag_used is False and made["a"].retrieval_json is None


def moody_generator():
    def generate(messages, temperature):
        for system, user in messages:
            assert "JSON" in system
            record = json.loads(user[user.index("{") :])
            if record["parcel_id"] == "b" and temperature < 0.2 or record["parcel_id"] == "c":
                yield "I would rather not"
            else:
                yield "```json\n" + json.dumps({**GOOD, "status": record["status"]}) + "\n```"

    return generate


def test_retry_then_fallback_and_reuse(spark, tmp_path):
    table = str(tmp_path / "explanations")
    first = upsert_table(explain.explain_parcels(payloads(spark), moody_generator, model="m", profile="p"), table, ["parcel_id"])
    made = {r.parcel_id: r for r in first.collect()}
    assert {k: r.llm_status for k, r in made.items()} == {"a": "critical", "b": "warning", "c": "insufficient_data"}
    assert "no valid reply" in made["c"].explanation_json and made["c"].llm_confidence == "low"

    changed = [("a", "corn", 0.9, "RED", 7, date(2024, 6, 15), [0.9] * 7), ("b", "corn", 0.2, "YELLOW", 2, None, [0.2, 0.2])]
    second = upsert_table(
        explain.explain_parcels(payloads(spark, rows=changed), stored=first, model="new"), table, ["parcel_id"]
    )
    models = {r.parcel_id: r.llm_model for r in second.collect()}
    assert models == {"a": "new", "b": "m", "c": "m"}
    counts = explain.explanation_outcomes(second).agg(F.sum("n")).first()[0]
    assert counts == 3
    joined = explain.with_explanations(scores(spark), second.where("parcel_id <> 'b'"))
    assert {r.parcel_id: r.llm_status is None for r in joined.collect()} == {"a": False, "b": True, "c": False}


def context(spark):
    rows = [
        ("a", "corn", "RED", 41.0, -94.0), ("b", "corn", None, 41.1, -94.0), ("c", "oats", "GREEN", None, None), ("d", None, "GRAY", 41.2, -94.0),
    ]
    s = spark.createDataFrame(rows, "parcel_id string, crop_name string, status string, centroid_lat double, centroid_lon double")
    vecs = spark.createDataFrame(
        [("a", "corn", [1.0, 0.0]), ("b", "corn", [0.8, 0.6]), ("d", None, [0.0, 1.0])], "parcel_id string, crop_name string, unit array<double>"
    )
    profs = spark.createDataFrame([("corn", 0, date(2024, 4, 22), [1.0])], "crop_name string, bin int, bin_center date, ref array<double>")
    return s, vecs, profs


def test_bundles(spark):
    s, vecs, profs = context(spark)
    got = {r.parcel_id: r for r in retrieval.retrieval_bundles(s, vecs, profs, 2, 1).collect()}
    assert [(n.parcel_id, n.status) for n in got["a"].similar_parcels] == [("b", "GRAY"), ("d", "GRAY")]
    assert [(n.parcel_id, n.status) for n in got["a"].spatial_neighbors] == [("b", "GRAY")]
    assert got["a"].reference_context.n_temporal_bins == 1 and got["a"].retrieval_notes == []
    assert got["c"].retrieval_notes == ["parcel_not_in_similarity_index", "no_centroid_for_spatial", "no_reference_profile_for_crop"]
    assert got["d"].reference_context is None and got["d"].retrieval_notes == []
    bare = {r.parcel_id: r for r in retrieval.retrieval_bundles(s, None, None, 2, 0).collect()}
    assert bare["a"].retrieval_notes == ["similarity_index_missing"] and bare["a"].spatial_neighbors == []
    some = retrieval.retrieval_bundles(s, vecs, profs, 2, 2, queries=s.where("parcel_id = 'd'")).collect()
    assert [r.parcel_id for r in some] == ["d"] and [n.parcel_id for n in some[0].spatial_neighbors] == ["b", "a"]


def test_places_fall_back_to_the_polygon(spark):
    square = [[(-94.0, 41.0), (-93.8, 41.0), (-93.8, 41.2), (-94.0, 41.2)]]
    rows = [("a", "corn", "RED", None, -94.0, square), ("b", "corn", "GREEN", 41.1, -93.9, None), ("c", "corn", "GREEN", None, None, None)]
    s = spark.createDataFrame(
        rows, "parcel_id string, crop_name string, status string, centroid_lat double, centroid_lon double, "
        "rings array<array<struct<lon:double,lat:double>>>",
    )
    got = {r.parcel_id: r for r in retrieval.retrieval_bundles(s, None, None, 0, 3).collect()}
    assert [(n.parcel_id, n.distance_km) for n in got["a"].spatial_neighbors] == [("b", 0.0)]
    assert got["c"].retrieval_notes == ["no_centroid_for_spatial"]


def echo_generator():
    def generate(messages, temperature):
        for _, user in messages:
            enriched = "parcel_analytics" in user
            yield json.dumps({**GOOD, "summary": "with context" if enriched else "plain"})

    return generate


def test_context_reaches_the_prompt(spark):
    s, vecs, profs = context(spark)
    bundles = retrieval.retrieval_bundles(s, vecs, profs, 2, 0)
    made = {r.parcel_id: r for r in explain.explain_parcels(payloads(spark), echo_generator, bundles=bundles).collect()}
    says = {k: json.loads(r.explanation_json)["summary"] for k, r in made.items()}
    assert says == {"a": "with context", "b": "with context", "c": "plain"}
    assert all(r.geo_rag_used for r in made.values()) and "similar_parcels" in made["a"].retrieval_json


def test_prompts():
    text = explain.system_prompt(with_context=True)
    assert "insufficient_data" in text and "parcel_analytics" in text and "Example" in text
    assert "Example" not in explain.system_prompt(with_example=False)
