"""Incremental work: what is still to do, what is stale, what can be reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["parcel_id", "obs_date"]


def pending(wanted: DataFrame, done: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Wanted rows without a result yet.

    Both sides are sorted and merged, which spills: what is done grows with the campaign, and its size is easily
    estimated too small where rows are unfolded, so it is never held in memory as a whole.
    """
    return wanted.join(done.select(*keys).hint("merge"), keys, "left_anti")


def fresh_results(results: DataFrame, version: str) -> DataFrame:
    """Results of the current encoder; all others are stale."""
    return results.where(F.col("encoder_version") == version)


def pending_for_version(wanted: DataFrame, done: DataFrame, version: str, keys: list[str] = KEYS) -> DataFrame:
    """Wanted rows without a result of the current encoder."""
    return pending(wanted, fresh_results(done, version), keys)


def split_unchanged(current: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored results whose payload is unchanged, and the current rows still to process."""
    keys = ["parcel_id", "payload_hash"]
    reuse = stored.join(current.select(*keys), keys, "left_semi")
    return reuse, current.join(stored.select(*keys), keys, "left_anti")


def unique_observations(observations: DataFrame) -> DataFrame:
    """One row per parcel and date."""
    return observations.dropDuplicates(KEYS)
