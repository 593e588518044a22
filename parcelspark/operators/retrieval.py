"""Context for explanations: similar parcels, places nearby, reference summary, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.geo import parts_centroid, shape_of
from parcelspark.operators.profiles import profile_coverage
from parcelspark.operators.similarity import nearest_of_all, nearest_places

SIMILAR_TYPE = (
    "array<struct<parcel_id:string,crop_name:string,similarity:double,cosine_distance:double,status:string>>"
)
SPATIAL_TYPE = "array<struct<parcel_id:string,distance_km:double,status:string,crop_name:string>>"


def _by_rank(entry: F.Column) -> F.Column:
    ranked = F.array_sort(F.collect_list(F.struct(F.col("rank"), entry.alias("hit"))))
    return F.transform(ranked, lambda e: e["hit"])


def place(df: DataFrame) -> list[F.Column]:
    """Latitude and longitude of a row: its centre columns, or the centroid of its polygons if one is missing."""
    lat, lon = F.col("centroid_lat"), F.col("centroid_lon")
    if "rings" in df.columns:
        given = lat.isNotNull() & lon.isNotNull()
        centre = parts_centroid(shape_of(df))
        lat, lon = F.when(given, lat).otherwise(centre["lat"]), F.when(given, lon).otherwise(centre["lon"])
    return [lat.alias("lat"), lon.alias("lon")]


def similar_parcels(scores: DataFrame, vectors: DataFrame, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """Semantic neighbours per parcel; a neighbour without score row has a null status."""
    asked = None if queries is None else vectors.join(queries.select("parcel_id"), "parcel_id", "left_semi")
    near = nearest_of_all(vectors, k, queries=asked)
    status = scores.select(F.col("parcel_id").alias("neighbor_id"), F.coalesce("status", F.lit("GRAY")).alias("status"))
    hit = F.struct(
        F.col("neighbor_id").alias("parcel_id"), F.col("neighbor_crop").alias("crop_name"),
        F.round("similarity", 6).alias("similarity"), F.round("cosine_distance", 6).alias("cosine_distance"),
        "status",
    )
    return near.join(status, "neighbor_id", "left").groupBy("parcel_id").agg(_by_rank(hit).alias("similar_parcels"))


def spatial_neighbors(
    scores: DataFrame, k: int = 5, max_km: float | None = None, queries: DataFrame | None = None
) -> DataFrame:
    """Geographic neighbours per parcel; a blank status counts as GRAY."""
    places = lambda df: df.select(F.col("parcel_id").alias("id"), *place(df))
    near = nearest_places(places(scores), k, max_km, None if queries is None else places(queries))
    info = scores.select(
        F.col("parcel_id").alias("neighbor_id"), "crop_name",
        F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("GRAY")).alias("status"),
    )
    hit = F.struct(
        F.col("neighbor_id").alias("parcel_id"), F.round("distance_km", 4).alias("distance_km"), "status", "crop_name"
    )
    return (
        near.join(info, "neighbor_id")
        .groupBy(F.col("id").alias("parcel_id"))
        .agg(_by_rank(hit).alias("spatial_neighbors"))
    )


def retrieval_bundles(
    scores: DataFrame,
    vectors: DataFrame | None,
    profiles: DataFrame | None,
    k_semantic: int = 5,
    k_spatial: int = 5,
    max_km: float | None = None,
    queries: DataFrame | None = None,
) -> DataFrame:
    """One bundle per parcel: similar_parcels, spatial_neighbors, reference_context, retrieval_notes."""
    base = scores if queries is None else queries
    out = base.select("parcel_id", F.trim("crop_name").alias("_crop"), *place(base))
    notes = []
    if k_semantic > 0 and vectors is None:
        notes.append(F.lit("similarity_index_missing"))
    if k_semantic > 0 and vectors is not None:
        out = out.join(similar_parcels(scores, vectors, k_semantic, queries), "parcel_id", "left")
        known = vectors.select("parcel_id", F.lit(True).alias("_indexed"))
        out = out.join(known, "parcel_id", "left")
        notes.append(F.when(F.col("_indexed").isNull(), "parcel_not_in_similarity_index"))
    else:
        out = out.withColumn("similar_parcels", F.array().cast(SIMILAR_TYPE))
    if k_spatial > 0:
        out = out.join(spatial_neighbors(scores, k_spatial, max_km, queries), "parcel_id", "left")
        placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        notes.append(F.when(~placed, "no_centroid_for_spatial"))
    else:
        out = out.withColumn("spatial_neighbors", F.array().cast(SPATIAL_TYPE))
    if profiles is not None:
        covered = profile_coverage(profiles).select(
            F.col("crop_name").alias("_crop"), F.struct("crop_name", "n_temporal_bins", "bin_sample_dates").alias("reference_context")
        )
        out = out.join(covered, "_crop", "left")
        missing = F.col("reference_context").isNull() & (F.col("_crop") != "")
        notes.append(F.when(missing, "no_reference_profile_for_crop"))
    else:
        context = "struct<crop_name:string,n_temporal_bins:bigint,bin_sample_dates:array<date>>"
        out = out.withColumn("reference_context", F.lit(None).cast(context))
    notes_column = F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>")
    return out.select(
        "parcel_id",
        F.coalesce("similar_parcels", F.array().cast(SIMILAR_TYPE)).alias("similar_parcels"),
        F.coalesce("spatial_neighbors", F.array().cast(SPATIAL_TYPE)).alias("spatial_neighbors"),
        "reference_context",
        notes_column.alias("retrieval_notes"),
    )
