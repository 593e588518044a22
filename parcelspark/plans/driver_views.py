"""Views that give the driver's tables the shapes of the monitoring data.

Each view exists as a DataFrame here and as plain SQL in `oracles.py`; both yield the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.session import rank_in_group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their crop: up to five dates per parcel, label 9 without crop."""
    raw = table(spark, sf_dir, "embeddings")
    keys = rank_in_group(
        raw.select("vec_id", "label"), ["label"], ["vec_id"], F.shiftright("vec_id", 16), "rn"
    )
    fifth = F.floor(F.col("rn") / 5).cast("int")
    pk = F.col("label") * 1000 + fifth
    shift = (
        (F.col("rn") % 5) * 40
        + (F.col("label") * 3 + fifth * 5) % 14
        + F.when(F.col("rn") % 11 == 7, 25).otherwise(0)
    )
    placed = keys.select(
        "vec_id",
        F.when(F.col("label") != 9, F.concat(F.lit("crop_"), F.col("label").cast("string"))).alias("crop_name"),
        F.concat(F.lit("p"), pk.cast("string")).alias("parcel_id"),
        pk.alias("pk"),
        F.date_add(F.lit("2024-04-15").cast("date"), shift.cast("int")).alias("obs_date"),
    )
    return placed.join(raw.select("vec_id", "embedding"), "vec_id")


def observations(labelled: DataFrame) -> DataFrame:
    return labelled.select("parcel_id", "obs_date", "embedding")


def parcels(labelled: DataFrame) -> DataFrame:
    """One row per parcel of the observation view, with places derived from its number."""
    number = F.col("pk")
    return (
        labelled.select("parcel_id", "crop_name", "pk")
        .distinct()
        .select(
            "parcel_id",
            "crop_name",
            (F.lit(41.0) + (number * 37 % 997) / F.lit(1000.0)).alias("centroid_lat"),
            (F.lit(-94.0) + (number * 91 % 991) / F.lit(1000.0)).alias("centroid_lon"),
            (1 + number % 40).cast("double").alias("area_ha"),
            F.concat(F.lit("t"), (number % 3).cast("string")).alias("tile_id"),
            F.concat(F.lit("0"), (number % 4).cast("string"), F.lit("_00")).alias("fragment_id"),
        )
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and grid rectangles; every fiftieth site has no coordinates."""
    key = F.col("c_custkey")
    placed = key % 50 != 0
    return table(spark, sf_dir, "customer").select(
        key.alias("site_id"),
        F.col("c_mktsegment").alias("crop_name"),
        F.when(placed, F.lit(41.0) + (key * 37 % 997) / F.lit(1000.0)).alias("lat"),
        F.when(placed, F.lit(-94.0) + (key * 91 % 991) / F.lit(1000.0)).alias("lon"),
        (key * 7 % 90).alias("x0"),
        (key * 13 % 45).alias("y0"),
        (3 + key % 5).alias("w"),
        (2 + key % 4).alias("h"),
    )


def site_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site rectangles as polygons in pixel units."""
    corner = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    x0, y0 = F.col("x0"), F.col("y0")
    x1, y1 = x0 + F.col("w"), y0 + F.col("h")
    shell = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    return sites(spark, sf_dir).withColumn("rings", F.array(shell))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A categorical raster on a 100 x 50 grid with classes 1 to 6."""
    cell = [(F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 50).alias("y")]
    first = F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy(*cell).agg((1 + first % 6).cast("int").alias("code"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("scene_id"),
        F.col("ts").cast("date").alias("scene_date"),
        F.col("value").alias("cloud_cover"),
        F.col("event_type").alias("collection"),
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes with boxes of 0.3 by 0.2 degrees that leave parts of the sites' extent uncovered."""
    west = F.lit(-94.0) + (F.col("scene_id") * 7 % 10) / F.lit(10.0)
    south = F.lit(41.0) + (F.col("scene_id") * 3 % 8) / F.lit(10.0)
    box = F.array(west, south, west + F.lit(0.3), south + F.lit(0.2))
    return scenes(spark, sf_dir).withColumn("bbox", box)


def slanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes with slanted footprints inside their boxes."""
    found = footprints(spark, sf_dir)
    west, south = F.col("bbox")[0], F.col("bbox")[1]
    corner = lambda x, y: F.struct((west + F.lit(x)).alias("lon"), (south + F.lit(y)).alias("lat"))
    ring = F.array(corner(0.0, 0.0005), corner(0.3, 0.0405), corner(0.34, 0.2405), corner(0.04, 0.2005))
    return found.withColumn("footprint", F.array(ring)).withColumn("bbox", F.array(west, south, west + F.lit(0.34), south + F.lit(0.2405)))


def label_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labels and codes, some codes not numeric."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("parcel_id"),
        F.concat("p_type", F.lit(" / "), "p_brand").alias("crops_raw"),
        F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("code_raw"),
    )
