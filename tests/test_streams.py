"""Streams fed with files in several batches."""

import os
from datetime import date, datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from parcelspark.functions.season import Season
from parcelspark.operators import scoring
from parcelspark.operators.scoring import ScoringRules
from parcelspark.session import staging_folder
from parcelspark.streaming import intake

ROWS = [
    ("a", "corn", date(2024, 4, 20), datetime(2024, 4, 20), [1.0, 0.0]),
    ("b", "corn", date(2024, 4, 21), datetime(2024, 4, 21), [0.0, 1.0]),
    ("a", "corn", date(2024, 5, 2), datetime(2024, 5, 2), [0.6, 0.8]),
]
OLD = [("a", "corn", date(2023, 1, 5), datetime(2023, 1, 5), [1.0, 0.0])]


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, intake.INTAKE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_bin_counts_take_late_rows(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (ROWS[2:], ROWS[:2]):
        arrive(spark, folder, rows)
        stream = intake.read_intake(spark, folder, 1)
        intake.upsert_stream(intake.bin_counts(stream), out, ["crop_name", "bin_start"], str(tmp_path / "progress")).awaitTermination()
    got = {(r.crop_name, r.bin_start): r.n_obs for r in spark.read.parquet(out).collect()}
    assert got == {("corn", date(2024, 4, 15)): 2, ("corn", date(2024, 4, 29)): 1}
    arrive(spark, folder, OLD)  # long before everything else
    stream = intake.read_intake(spark, folder, 1)
    intake.upsert_stream(intake.bin_counts(stream), out, ["crop_name", "bin_start"], str(tmp_path / "progress")).awaitTermination()
    got = {(r.crop_name, r.bin_start): r.n_obs for r in spark.read.parquet(out).collect()}
    assert got[("corn", date(2022, 12, 26))] == 1 and sum(got.values()) == 4


def test_first_arrivals(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (ROWS[1:], ROWS[2:], OLD + ROWS[1:2], ROWS[:1] + OLD):  # the oldest dates come last
        arrive(spark, folder, rows)
    intake.store_arrivals(intake.read_intake(spark, folder, 1), out, str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    # A restart from the checkpoint adds nothing, nor do known rows in new files.
    intake.store_arrivals(intake.read_intake(spark, folder, 1), out, str(tmp_path / "progress")).awaitTermination()
    arrive(spark, folder, ROWS)
    intake.store_arrivals(intake.read_intake(spark, folder, 1), out, str(tmp_path / "progress")).awaitTermination()
    assert sorted((r.parcel_id, r.obs_date) for r in spark.read.parquet(out).collect()) == sorted((r[0], r[2]) for r in ROWS + OLD)


def test_streams_stage_nothing(spark, tmp_path):
    folder, before = str(tmp_path / "in"), set(os.listdir(staging_folder(spark)) if os.path.isdir(staging_folder(spark)) else ())
    arrive(spark, folder, ROWS)
    intake.store_arrivals(intake.read_intake(spark, folder, 1), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert set(os.listdir(staging_folder(spark)) if os.path.isdir(staging_folder(spark)) else ()) == before


def test_incremental_scores_equal_a_full_run(spark, tmp_path):
    parcels = spark.createDataFrame([("a", "corn"), ("b", "corn"), ("c", "corn")], "parcel_id string, crop_name string")
    profiles = spark.createDataFrame(
        [("corn", 0, date(2024, 4, 22), [1.0, 0.0], 2)], "crop_name string, bin int, bin_center date, ref array<double>, n_obs long"
    )
    folder = str(tmp_path / "in")
    for rows in (ROWS[:1], ROWS[1:], ROWS[:2]):  # the last batch brings known rows again
        arrive(spark, folder, rows)
        intake.score_stream(
            intake.read_intake(spark, folder, 1), parcels, profiles, (0.15, 0.3), str(tmp_path / "scores"),
            str(tmp_path / "progress"),
        ).awaitTermination()
    got = {r.parcel_id: (r.health_score, r.status, r.n_observations) for r in spark.read.parquet(str(tmp_path / "scores")).collect()}
    seen = spark.createDataFrame(ROWS, intake.INTAKE_SCHEMA).select("parcel_id", "obs_date", "embedding")
    full = scoring.score_parcels(parcels, seen, profiles, Season(), ScoringRules(method="fixed")).scores
    expected = {r.parcel_id: (r.health_score, r.status, r.n_observations) for r in full.collect() if r.parcel_id != "c"}
    assert got == expected


def test_a_touch_is_one_read_and_one_write():
    class State:
        held, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    scores, state = intake.RunningScores(), State()
    scores.known = state
    seen = lambda day, distance: Row(obs_date=date(2024, 5, day), weight=1.0, distance=distance, has_profile=True)
    list(scores.handleInputRows(("a",), iter([seen(3, 0.25), seen(1, None), seen(2, 0.75)]), None))
    (out,) = scores.handleInputRows(("a",), iter([seen(3, 9.0), seen(4, 0.5)]), None)
    assert state.calls == ["get", "update"] * 2
    assert (out._n, out.n_matched, out._score, out._worst_date) == (4, 3, 0.5, date(2024, 5, 2))
    assert [(p.obs_date.day, p.distance) for p in out._path] == [(2, 0.75), (3, 0.25), (4, 0.5)]
