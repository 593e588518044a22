"""Reference profiles: the median embedding per crop and season bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.medians import median_vectors
from parcelspark.functions.season import Season, bin_center, bin_index
from parcelspark.session import stage


def is_labelled(crop: Column) -> Column:
    return crop.isNotNull() & (crop != "")


def crop_sizes(parcels: DataFrame) -> DataFrame:
    """Labelled parcels per crop, with or without observations."""
    return (
        parcels.where(is_labelled(F.col("crop_name")))
        .groupBy("crop_name")
        .agg(F.count(F.lit(1)).alias("n_parcels"))
    )


def profile_crops(parcels: DataFrame, min_parcels: int = 10) -> DataFrame:
    return crop_sizes(parcels).where(F.col("n_parcels") >= min_parcels)


def build_profiles(
    parcels: DataFrame,
    observations: DataFrame,
    season: Season = Season(),
    min_parcels: int = 10,
    min_vectors: int = 2,
    block_rows: int | None = None,
) -> DataFrame:
    """One row per (crop, bin) with at least `min_vectors` vectors: crop_name, bin, bin_center, ref, n_obs.

    The result is a staged table: scoring, coverage and retrieval all read it.
    """
    crops = profile_crops(parcels, min_parcels).select("crop_name")
    members = parcels.select("parcel_id", "crop_name").join(crops, "crop_name", "left_semi")
    binned = (
        observations.select("parcel_id", "obs_date", bin_index(F.col("obs_date"), season).alias("bin"), "embedding")
        .where(F.col("bin").isNotNull())
        .join(members, "parcel_id")
    )
    # Parcel and date tell the vectors of a group apart.
    medians = median_vectors(
        binned, ["crop_name", "bin"], "embedding", min_vectors, block_rows, spread=["parcel_id", "obs_date"]
    )
    profiles = medians.select(
        "crop_name", "bin", bin_center(F.col("bin"), season).alias("bin_center"), "ref", "n_obs"
    )
    return stage(profiles, "profiles")


def profile_values(profiles: DataFrame) -> DataFrame:
    """Long form: one row per vector component."""
    return profiles.select("crop_name", "bin_center", "n_obs", F.posexplode("ref").alias("pos", "value"))


def profile_coverage(profiles: DataFrame) -> DataFrame:
    """Bins per crop and a sample of their dates: the first five, and the last three beyond eight."""
    dates = F.array_sort(F.collect_list("bin_center"))
    sample = F.when(
        F.col("n_temporal_bins") > 8,
        F.array_distinct(F.concat(F.slice("_dates", 1, 5), F.slice("_dates", -3, 3))),
    ).otherwise(F.slice("_dates", 1, 5))
    return (
        profiles.groupBy("crop_name")
        .agg(F.count(F.lit(1)).alias("n_temporal_bins"), dates.alias("_dates"))
        .select("crop_name", "n_temporal_bins", sample.alias("bin_sample_dates"))
    )
