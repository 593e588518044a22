"""Season calendar, profiles and scores on hand-made rows."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.functions.season import Season, bin_index, early_weight, season_bins
from parcelspark.operators import profiles, scoring
from parcelspark.operators.scoring import ScoringRules
from parcelspark.session import lookup_join

PARCELS = "parcel_id string, crop_name string"
OBS = "parcel_id string, obs_date date, embedding array<float>"
PROFILES = "crop_name string, bin int, bin_center date, ref array<double>, n_obs long"


def at_distance(d):
    """A unit vector whose cosine distance to (1, 0) is d."""
    c = 1.0 - d
    return [c, float(np.sqrt(1 - c * c))]


def day(text):
    return date.fromisoformat(text)


def run(spark, parcels, obs, profs, season=Season(), **rules):
    result = scoring.score_parcels(
        spark.createDataFrame(parcels, PARCELS),
        spark.createDataFrame(obs, OBS),
        spark.createDataFrame(profs, PROFILES),
        season,
        ScoringRules(**rules),
    )
    return {r.parcel_id: r for r in result.scores.collect()}, result.thresholds.first()


def test_bins_of_the_default_season(spark):
    bins = season_bins(spark, Season()).orderBy("bin").collect()
    assert len(bins) == 15
    last = bins[-1]
    assert (last.bin_start, last.bin_end, last.bin_center) == (day("2024-10-28"), day("2024-10-31"), day("2024-10-29"))


def test_bin_edges_and_early_weight(spark):
    days = ["2024-04-14", "2024-04-15", "2024-04-29", "2024-10-30", "2024-10-31", "2024-06-12", "2024-06-14"]
    df = spark.createDataFrame([(day(d),) for d in days], "d date")
    got = df.select(bin_index(F.col("d"), Season()), early_weight(F.col("d"), Season(), 2.0)).collect()
    assert [r[0] for r in got] == [None, 0, 1, 14, None, 4, 4]
    assert [r[1] for r in got] == [2.0, 2.0, 2.0, 1.0, 1.0, 2.0, 1.0]


def test_worked_example(spark):
    """Weights 2, 2, 1, 1, 1 over five distances give 0.133."""
    season = Season("2024-04-01", "2024-07-01")
    dates = ["2024-04-12", "2024-04-26", "2024-05-08", "2024-05-22", "2024-06-05"]
    centres = ["2024-04-07", "2024-04-21", "2024-05-05", "2024-05-19", "2024-06-02"]
    distances = [0.008, 0.012, 0.071, 0.380, 0.440]
    obs = [("P", day(d), at_distance(x)) for d, x in zip(dates, distances)]
    profs = [("corn", i, day(c), [1.0, 0.0], 5) for i, c in enumerate(centres)]
    rows, _ = run(spark, [("P", "corn")], obs, profs, season, method="fixed", green=0.10, red=0.25, urgency=2.0)
    row = rows["P"]
    assert row.health_score == pytest.approx(0.931 / 7, abs=1e-4)
    assert row.status == "YELLOW"
    assert row.max_deviation_date == day("2024-06-05")
    assert row.distance_trajectory == pytest.approx(distances, abs=1e-4)


def test_gates_and_edges(spark):
    profs = [
        ("corn", 0, day("2024-05-01"), [1.0, 0.0], 3),
        ("corn", 1, day("2024-05-15"), [0.0, 1.0], 3),
    ]
    obs = [
        ("tie", day("2024-05-08"), [1.0, 0.0]),  # seven days from both: the earlier one wins
        ("far", day("2024-08-01"), [1.0, 0.0]),
        ("partly", day("2024-05-01"), [0.0, 1.0]),
        ("partly", day("2024-08-01"), [1.0, 0.0]),
        ("lost", day("2024-05-01"), [1.0, 0.0]),
        ("blank", day("2024-05-01"), [1.0, 0.0]),
        ("none", day("2024-05-01"), [1.0, 0.0]),
        ("zero", day("2024-05-01"), [0.0, 0.0]),
    ]
    parcels = [
        ("tie", "corn"), ("far", "corn"), ("partly", "corn"), ("lost", "rye"), ("blank", ""), ("none", None),
        ("unseen", "corn"), ("zero", "corn"),
    ]
    rows, limits = run(spark, parcels, obs, profs, method="fixed")
    assert len(rows) == len(parcels)
    assert (rows["tie"].health_score, rows["tie"].status) == (0.0, "GREEN")
    assert (rows["far"].health_score, rows["far"].status, rows["far"].n_observations) == (0.0, "GRAY", 1)
    assert rows["far"].distance_trajectory == [] and rows["far"].max_deviation_date is None
    assert (rows["partly"].health_score, rows["partly"].status, rows["partly"].n_observations) == (1.0, "RED", 2)
    assert (rows["lost"].health_score, rows["lost"].status, rows["lost"].n_observations) == (None, "GRAY", 1)
    for name in ("blank", "none"):
        assert (rows[name].health_score, rows[name].status, rows[name].n_observations) == (None, "GRAY", 0)
    assert (rows["unseen"].health_score, rows["unseen"].status, rows["unseen"].n_observations) == (None, "GRAY", 0)
    assert rows["zero"].health_score == 1.0
    assert (limits.method, limits.green, limits.red) == ("fixed", 0.15, 0.30)

    rows, _ = run(spark, parcels, obs, profs, method="fixed", unmatched_score="null")
    assert (rows["far"].health_score, rows["far"].status) == (None, "GRAY")
    rows, _ = run(spark, parcels, obs, profs, method="fixed", min_observations=2)
    assert (rows["tie"].health_score, rows["tie"].status, rows["tie"].n_observations) == (None, "GRAY", 1)
    assert rows["partly"].status == "RED"


def test_adaptive_limits(spark):
    profs = [("corn", 0, day("2024-05-01"), [1.0, 0.0], 3)]
    distances = [0.1, 0.1, 0.1, 0.1, 0.2, 0.9]
    parcels = [(f"p{i}", "corn") for i in range(6)]
    obs = [(f"p{i}", day("2024-05-01"), at_distance(d)) for i, d in enumerate(distances)]
    rows, limits = run(spark, parcels, obs, profs, sigma_yellow=0.0, sigma_red=1.0)
    scores = np.array([rows[f"p{i}"].health_score for i in range(6)])
    assert limits.green == pytest.approx(scores.mean(), abs=1e-6)
    assert limits.red == pytest.approx(scores.mean() + scores.std(), abs=1e-6)
    assert [rows[f"p{i}"].status for i in range(6)] == ["GREEN"] * 5 + ["RED"]

    few, limits = run(spark, parcels[:4], obs[:4], profs)
    assert {r.status for r in few.values()} == {"GRAY"} and (limits.green, limits.red) == (0.0, 0.0)


def test_unknown_method_is_an_error(spark):
    with pytest.raises(ValueError, match="threshold method"):
        run(spark, [("p", "corn")], [], [], method="other")


def test_profile_rules(spark):
    parcels = spark.createDataFrame([(f"a{i}", "corn") for i in range(3)] + [("b0", "rye"), ("c0", "")], PARCELS)
    obs = spark.createDataFrame(
        [
            ("a0", day("2024-04-15"), [1.0, 0.0]),
            ("a1", day("2024-04-20"), [3.0, 0.0]),
            ("a0", day("2024-05-01"), [9.0, 9.0]),  # the only vector of its bin
            ("a1", day("2024-10-31"), [9.0, 9.0]),  # the last day lies in no bin
            ("a2", day("2024-10-31"), [9.0, 9.0]),
            ("b0", day("2024-04-15"), [5.0, 5.0]),
            ("c0", day("2024-04-15"), [5.0, 5.0]),
        ],
        OBS,
    )
    found = profiles.build_profiles(parcels, obs, Season(), min_parcels=3).collect()
    assert [(r.crop_name, r.bin, r.bin_center, r.ref, r.n_obs) for r in found] == [
        ("corn", 0, day("2024-04-22"), [2.0, 0.0], 2)
    ]


def test_lookup_join_gives_the_same_rows_salted(spark):
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 7).cast("int").alias("k"))
    small = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k int, v string")
    plain = lookup_join(big, small, ["k"], 0, ["id"])
    salted = lookup_join(big, small, ["k"], 1, ["id"], limit_bytes=0, salts=8)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, salted.collect()))
    assert "BroadcastHashJoin" in plain._jdf.queryExecution().executedPlan().toString()
