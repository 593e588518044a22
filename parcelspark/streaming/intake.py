"""Streams: observation intake, counts per season bin, incremental scoring."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parcelspark.functions.season import Season
from parcelspark.operators.scoring import ScoringRules, classify, match_observations, summarised
from parcelspark.sources.tables import upsert_table

EPOCH = date(1970, 1, 1)
NO_DAY = -(2**31)
INTAKE_SCHEMA = "parcel_id string, crop_name string, obs_date date, seen_at timestamp, embedding array<float>"


def read_intake(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New observation files as they arrive."""
    return (
        spark.readStream.schema(INTAKE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep the state of their keys in RocksDB, which stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class FirstArrivals(StatefulProcessor):
    """Lets every date of a parcel through once; the dates seen are the parcel's state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "day int", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            fresh = []
            for day in days(batch["obs_date"]):
                fresh.append(not self.seen.containsKey((day,)))
                if fresh[-1]:
                    self.seen.updateValue((day,), (True,))
            yield batch[fresh]

    def close(self) -> None:
        pass


def day_number(day: date | None) -> int:
    """A date as days since 1970; a missing date is a day of its own."""
    return NO_DAY if pd.isna(day) else (day - EPOCH).days


def days(dates: pd.Series) -> list[int]:
    return [day_number(d) for d in dates]


def missing(value: float | None) -> bool:
    return value is None or value != value


def store_arrivals(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each (parcel, date) once to a table, whenever it arrives and whatever came before.

    The dates of every parcel are keyed state, so nothing stored is read again; progress and output are committed
    together, so a restart from the checkpoint adds nothing.
    """
    fresh = stream.groupBy("parcel_id").transformWithStateInPandas(
        statefulProcessor=FirstArrivals(), outputStructType=INTAKE_SCHEMA, outputMode="Append", timeMode="None"
    )
    with keyed_state(stream.sparkSession):
        return (
            fresh.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )


def bin_counts(stream: DataFrame, season: Season = Season()) -> DataFrame:
    """Observations per crop and season bin, for update mode.

    The state has one row per crop and bin, so it needs no watermark and no row comes too late.
    """
    first = F.lit(season.start).cast("date")
    place = F.floor(F.datediff("obs_date", first) / season.bin_days).cast("int")
    return (
        stream.groupBy("crop_name", F.date_add(first, place * season.bin_days).alias("bin_start"))
        .agg(F.count(F.lit(1)).alias("n_obs"))
    )


class RunningScores(StatefulProcessor):
    """Running weighted sums of a parcel's distances; a touched parcel comes out with what is known of it.

    State: one row of sums with the parcel's dates and their distances, so a touch costs one read and one write. A date
    that comes again changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState(
            "known",
            "n long, hits long, profiled boolean, total double, weight double, worst double, worst_day int, "
            "days array<int>, distances array<double>",
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, hits, profiled, total, weight, worst, worst_day, seen, distances = self.known.get() or (0, 0, False, 0.0, 0.0, -1.0, 0, (), ())
        path = dict(zip(seen, distances, strict=True))
        for row in rows:
            day, w, d = day_number(row.obs_date), row.weight, row.distance
            if missing(w) or day in path:  # without a label, or known
                continue
            hit = not missing(d)
            path[day] = float(d) if hit else None
            n, profiled = n + 1, profiled or bool(row.has_profile)
            if hit:
                hits, total, weight = hits + 1, total + d * w, weight + w
                if d > worst or (d == worst and day < worst_day):
                    worst, worst_day = float(d), day
        self.known.update((n, hits, profiled, float(total), float(weight), float(worst), worst_day, list(path), list(path.values())))
        date = lambda day: None if day == NO_DAY else EPOCH + timedelta(days=day)
        yield Row(
            parcel_id=key[0], _n=n, n_matched=hits, _profiled=profiled,
            _score=total / weight if hits else None, _worst_date=date(worst_day) if hits else None,
            _path=[Row(obs_date=date(day), distance=d) for day, d in sorted(path.items()) if d is not None],
        )

    def close(self) -> None:
        pass


RUNNING = (
    "parcel_id string, _n long, n_matched long, _profiled boolean, _score double, _worst_date date, "
    "_path array<struct<obs_date:date,distance:double>>"
)


def score_stream(
    stream: DataFrame,
    parcels: DataFrame,
    profiles: DataFrame,
    limits: tuple[float, float],
    scores_path: str,
    checkpoint: str,
    season: Season = Season(),
    rules: ScoringRules = ScoringRules(method="fixed"),
    parts: int = 64,
) -> StreamingQuery:
    """Score touched parcels on every micro-batch against frozen profiles and limits.

    Distances to frozen profiles never change, so a batch matches its own observations only; per parcel, running sums
    and dates are keyed state. What comes out of a batch are the touched parcels, whose scores are upserted by parts.
    Replaying a batch changes nothing.
    """
    green, red = limits
    frozen = replace(rules, method="fixed", green=green, red=red)
    arrived = stream.select("parcel_id", "obs_date", "embedding")
    matched = match_observations(parcels, arrived, profiles, season, frozen, unlabelled=True)
    running = matched.groupBy("parcel_id").transformWithState(
        statefulProcessor=RunningScores(), outputStructType=RUNNING, outputMode="Update", timeMode="None"
    )

    def apply(batch: DataFrame, epoch: int) -> None:
        rounded = F.transform("_path", lambda e: F.struct(e["obs_date"], F.round(e["distance"], 4).alias("distance")))
        known = batch.withColumn("_path", rounded)
        touched = parcels.join(known.select("parcel_id"), "parcel_id", "left_semi")
        upsert_table(classify(summarised(touched, known, frozen), frozen), scores_path, ["parcel_id"], parts)

    with keyed_state(stream.sparkSession):
        return (
            running.writeStream.foreachBatch(apply)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the latest value per key of an updating aggregate in a table."""

    def apply(batch: DataFrame, epoch: int) -> None:
        upsert_table(batch, path, keys)

    return (
        stream.writeStream.foreachBatch(apply)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
