"""Similarity between parcels: seasonal mean vectors, neighbours, label-error scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.vectors import dot, mean_vectors, unit_vectors
from parcelspark.operators.knn import CosineMetric, HaversineMetric, KnnPlan, knn_join
from parcelspark.session import stage


def parcel_vectors(scores: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per parcel with at least one embedding: its scores columns kept for search, and `unit`.

    Staged: it is the index every search reads.
    """
    means = unit_vectors(mean_vectors(observations, ["parcel_id"], "embedding"), "mean")
    kept = [c for c in ("crop_name", "status", "centroid_lat", "centroid_lon") if c in scores.columns]
    return stage(
        scores.select("parcel_id", *kept).join(means.select("parcel_id", "unit"), "parcel_id"), "parcel-vectors"
    )


def similarity_columns(distance: Column) -> list[Column]:
    return [(1.0 - distance).alias("similarity"), distance.alias("cosine_distance")]


def nearest_to(vectors: DataFrame, parcel_id: str, k: int = 10) -> DataFrame:
    """The k most similar parcels of one parcel. The query vector is a scalar subquery.

    A parcel with several rows, one a crop, has one vector: it counts once, and all its rows come.
    """
    query = vectors.where(F.col("parcel_id") == parcel_id)
    if query.isEmpty():
        raise KeyError(f"no vector for parcel {parcel_id}")
    # Ordered at 9 dp like the join below, so that both give the same order.
    return (
        vectors.where(F.col("parcel_id") != parcel_id)
        .withColumn("_query", query.agg(F.min("unit")).scalar())
        .select("parcel_id", "crop_name", (1.0 - dot(F.col("unit"), F.col("_query"))).alias("_d"))
        .groupBy("parcel_id")
        .agg(F.min("_d").alias("_d"), F.collect_list(F.struct("crop_name")).alias("_rows"))
        .orderBy(F.round("_d", 9), "parcel_id")
        .limit(k)
        .select("parcel_id", "_d", F.inline("_rows"))
        .select("parcel_id", "crop_name", *similarity_columns(F.col("_d")))
    )


def nearest_of_all(
    vectors: DataFrame, k: int = 10, queries: DataFrame | None = None, plan: KnnPlan = KnnPlan()
) -> DataFrame:
    """The k most similar parcels of every parcel, or of those in `queries`; as above, a parcel counts once."""
    as_points = lambda df: df.groupBy(F.col("parcel_id").alias("id")).agg(F.min("unit").alias("vec"))
    corpus = as_points(vectors)
    found = knn_join(corpus if queries is None else as_points(queries), corpus, k, CosineMetric, plan=plan)
    labels = vectors.select(F.col("parcel_id").alias("neighbor_id"), F.col("crop_name").alias("neighbor_crop"))
    return found.join(labels, "neighbor_id").select(
        F.col("id").alias("parcel_id"), "neighbor_id", "neighbor_crop",
        *similarity_columns(F.col("distance")), "rank",
    )


def clean_crop(crop: Column) -> Column:
    return F.nullif(F.trim(crop), F.lit(""))


def scan_mislabels(
    vectors: DataFrame, k: int = 10, min_fraction: float = 0.5, crop: str | None = None, plan: KnnPlan = KnnPlan()
) -> DataFrame:
    """Labelled parcels whose labelled neighbours mostly carry another crop.

    The limit tests the unrounded fraction. With `crop` only its parcels are checked.
    """
    asked = vectors.where(F.col("crop_name").isNotNull())
    if crop is not None:
        asked = asked.where(F.trim("crop_name") == crop.strip())
    near = nearest_of_all(vectors, k, queries=asked, plan=plan)
    own = asked.select("parcel_id", "crop_name")
    differs = F.trim("neighbor_crop") != F.trim("crop_name")
    counted = (
        near.join(own, "parcel_id")
        .groupBy("parcel_id", "crop_name")
        .agg(F.count_if(differs).alias("diff_neighbors"), F.count("neighbor_crop").alias("labeled_neighbors"))
        .where(F.col("labeled_neighbors") > 0)
    )
    fraction = F.col("diff_neighbors") / F.col("labeled_neighbors")
    return counted.where(fraction >= min_fraction).select(
        "parcel_id", "crop_name", F.round(fraction, 4).alias("neighbor_diff_fraction"),
        "diff_neighbors", "labeled_neighbors",
    )


def ordered_mislabels(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("neighbor_diff_fraction"), "parcel_id")


def neighbor_roles(vectors: DataFrame, near: DataFrame) -> DataFrame:
    """Role and note of every neighbour for a map, plus one row for the query parcel itself."""
    own = vectors.select("parcel_id", clean_crop(F.col("crop_name")).alias("_own"))
    other = clean_crop(F.col("neighbor_crop"))
    differs = F.col("_own").isNotNull() & other.isNotNull() & (other != F.col("_own"))
    text = F.format_string("cos_sim=%.3f", "similarity")
    labelled = near.join(own, "parcel_id").select(
        "parcel_id", "neighbor_id", F.col("neighbor_crop").alias("crop_name"),
        F.when(differs, "neighbor_diff").otherwise("neighbor_same").alias("map_role"),
        F.when(differs, F.concat(text, F.lit(", labels differ")))
        .otherwise(text).alias("similarity_note"),
    )
    itself = near.select("parcel_id").distinct().join(own, "parcel_id").select(
        "parcel_id", F.col("parcel_id").alias("neighbor_id"), F.col("_own").alias("crop_name"),
        F.lit("query").alias("map_role"), F.lit("the query itself").alias("similarity_note"),
    )
    return labelled.unionByName(itself)


def nearest_places(
    places: DataFrame, k: int = 5, max_km: float | None = None, queries: DataFrame | None = None,
    plan: KnnPlan = KnnPlan(),
) -> DataFrame:
    """Geographic neighbours: (id, neighbor_id, distance_km, rank). Rows without coordinates are skipped.

    `places` carries id, lat and lon. Order and ties follow the distance at 6 dp, then the smaller id.
    """

    def as_points(df: DataFrame) -> DataFrame:
        located = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        return located.select("id", F.array(F.col("lat").cast("double"), F.col("lon").cast("double")).alias("vec"))

    corpus = as_points(places)
    found = knn_join(corpus if queries is None else as_points(queries), corpus, k, HaversineMetric, max_km, plan)
    return found.withColumnRenamed("distance", "distance_km")
