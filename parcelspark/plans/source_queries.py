"""Registered queries that go through files: driver rows are written in a source format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions.geo import parts_centroid
from parcelspark.plans import driver_views as views
from parcelspark.session import stage, staging_folder
from parcelspark.sources import archives, files, parcels, raster, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """One polygon as GeoJSON coordinates: a list with its shell."""
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return F.array(F.array(*[F.array(*corner) for corner in corners]))


def _features(sites: DataFrame) -> DataFrame:
    """tile and one GeoJSON feature a site: polygons, shapes of two equal polygons, and none for every fiftieth."""
    w, h = F.col("w") / F.lit(1000.0), F.col("h") / F.lit(1000.0)
    first = _rectangle(F.col("lon"), F.col("lat"), w, h)
    second = _rectangle(F.col("lon") + F.lit(0.5), F.col("lat"), w, h)
    shape = lambda kind, coordinates: F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
    geometry = F.when(F.col("lat").isNull(), F.lit("null")).when(
        F.col("site_id") % 3 == 1, shape("MultiPolygon", F.array(first, second))
    ).otherwise(shape("Polygon", first))
    nested = F.struct(
        (F.col("w") * F.col("h") * 10_000).alias("area"),
        F.when(F.col("site_id") % 4 == 0, F.lit(45.5)).alias("center_lat"),
        F.col("crop_name").alias("crops_2022"),
        F.when(F.col("site_id") % 7 == 0, F.lit("n/a")).otherwise((F.col("site_id") % 30).cast("string")).alias("crops_ids_2022"),
        F.col("crop_name").alias("crops_2021"),
    )
    named = F.when(F.col("site_id") % 5 != 0, F.concat(F.lit('"id": "f'), F.col("site_id"), F.lit('", ')))
    properties = F.to_json(F.struct(F.concat(F.lit("p"), F.col("site_id")).alias("id"), nested.alias("props")))
    text = F.concat(
        F.lit('{"type": "Feature", '), F.coalesce(named, F.lit("")), F.lit('"properties": '), properties,
        F.lit(', "geometry": '), geometry, F.lit("}"),
    )
    return sites.select((F.col("site_id") % 3).alias("tile"), text.alias("value"))


def fragment_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Fields written as fragments of three tiles, discovered, read and labelled."""
    folder = _folder(spark, "fields")
    features = _features(views.sites(spark, sf))
    for tile in range(3):
        name = f"tile{tile}"
        aside = f"{folder}/_{name}"
        features.where(F.col("tile") == tile).select("value").repartition(2).write.text(aside)
        for i, part in enumerate(files.matching(spark, f"{aside}/part-*")):
            files.move(spark, part, f"{folder}/{name}/{name}_fragment_{i}.geojsonl")
    tiles = [f"tile{tile}" for tile in range(3)]
    found = parcels.ingest(spark, folder, tiles, year=2022)
    return found.select(
        "parcel_id", "tile_id", "crop_name", "crop_code",
        F.round("centroid_lat", 6).alias("centroid_lat"), F.round("centroid_lon", 6).alias("centroid_lon"),
        F.round("area_ha", 6).alias("area_ha"), F.size("rings").alias("n_rings"), F.size("attrs").alias("n_attrs"),
    )


def generated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Features without any id, one a line, read with three sizes of splits: the ids they get, and how often."""
    folder = _folder(spark, "unnamed")
    place = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct("site_id", "crop_name").alias("properties"), place.alias("geometry")
    )
    rows = views.sites(spark, sf).select((F.col("site_id") % 3).alias("tile"), "site_id", F.to_json(feature).alias("value"))
    for tile in range(3):
        name, aside = f"tile{tile}", f"{folder}/_tile{tile}"
        # One file of ordered lines a tile, as a field agency would deliver it.
        rows.where(F.col("tile") == tile).orderBy("site_id").select("value").coalesce(1).write.text(aside)
        files.move(spark, files.matching(spark, f"{aside}/part-*")[0], f"{folder}/{name}/{name}_fragment_0.geojsonl")
    tiles = [f"tile{tile}" for tile in range(3)]
    split_bytes, reads = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("4k", "50k", split_bytes):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = parcels.read_fragments(spark, parcels.discover_fragments(spark, folder, tiles), tiles)
            reads.append(stage(found.select("parcel_id", F.col("attrs.site_id").cast("long").alias("site_id")), "unnamed"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    every = reads[0].unionByName(reads[1]).unionByName(reads[2])
    return every.groupBy("parcel_id", "site_id").agg(F.count(F.lit(1)).alias("n_reads"))


def label_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A label table as CSV, codes that are no numbers included."""
    folder = _folder(spark, "labels")
    raw = views.label_source(spark, sf).select("parcel_id", F.col("code_raw").alias("crop_code"), F.col("crops_raw").alias("crop_name"))
    raw.write.option("header", True).csv(folder)
    return parcels.read_labels(spark, folder)


def pixel_window(spark: SparkSession, sf: str) -> DataFrame:
    """Part of a stored raster."""
    folder = _folder(spark, "raster")
    raster.write_pixels(views.pixels(spark, sf), folder, block=16)
    return raster.read_pixels(spark, folder, (10, 5, 59, 30)).select("x", "y", "code")


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    return views.observations(views.labelled_observations(spark, sf)).where(F.col("parcel_id").isNotNull())


def embedding_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Dated vectors written as a tree of numpy files and read back."""
    folder = _folder(spark, "vectors")
    archives.write_embedding_archive(_observations(spark, sf), folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return archives.read_embedding_archive(spark, folder).select(
        "parcel_id", F.col("obs_date").cast("string").alias("obs_date"), F.size("embedding").alias("width"),
        F.get("embedding", F.lit(7)).cast("double").alias("eighth"), F.round(total, 4).alias("total"),
    )


def chip_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Chips of four bands written as a tree of compressed numpy files and read back; one file is broken."""
    folder = _folder(spark, "chips")
    level = F.transform("embedding", lambda v: F.abs(F.floor(v.cast("double") * 1000)).cast("int"))
    band = lambda i: F.slice(level, 1 + 16 * i, 16)
    chips = _observations(spark, sf).select(
        "parcel_id", "obs_date", F.lit(42.0).alias("lat"), F.lit(-93.5).alias("lon"), F.lit(10.0).alias("gsd"),
        F.array(*[F.lit(b) for b in ("B02", "B03", "B04", "B08")]).alias("bands"),
        F.array(*[band(i) for i in range(4)]).alias("pixels"), F.lit(4).alias("height"), F.lit(4).alias("width"),
    )
    archives.write_chip_archive(chips, folder)
    found = archives.read_chip_archive(spark, folder)
    return found.select(
        "parcel_id", F.col("obs_date").cast("string").alias("obs_date"), "lat", "lon", "gsd", "height", "width",
        F.array_join("bands", ",").alias("bands"), F.posexplode("pixels").alias("band", "values"),
    ).withColumn("values", F.concat_ws(",", F.col("values").cast("array<string>")))


def scores_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels of one or two polygons exported as features, and areas and centres of what is read back."""
    folder = _folder(spark, "export")
    sites = views.sites(spark, sf).where(F.col("lat").isNotNull())
    corner = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    ring = lambda x, y, w, h: F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h), corner(x, y))
    first = ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("h"))
    second = ring(F.col("x0") + 100, F.col("y0"), F.lit(1), F.lit(1))
    two = F.col("site_id") % 2 == 0
    shaped = sites.select(
        F.concat(F.lit("p"), "site_id").alias("parcel_id"), "crop_name",
        F.when(two, F.array(first, second)).otherwise(F.array(first)).alias("rings"),
        F.when(two, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1))).alias("part_rings"),
    )
    scores = shaped.select("parcel_id", "crop_name")
    tables.write_geojson(tables.attach_geometry(scores, shaped), folder)
    read = spark.read.schema(parcels.FEATURE_SCHEMA).json(folder)
    parts = parcels.shape_parts(F.col("geometry"))
    centre = parts_centroid(parts)
    return read.select(
        F.col("properties.parcel_id").alias("parcel_id"), F.col("properties.crop_name").alias("crop_name"),
        F.col("geometry.type").alias("kind"), F.size(parts).alias("n_parts"), F.round(centre["area"], 6).alias("area"),
        F.round(centre["lon"], 6).alias("lon"), F.round(centre["lat"], 6).alias("lat"),
    )


def upsert_files(spark: SparkSession, sf: str) -> DataFrame:
    """A table in parts after three upserts; null keys count as equal."""
    folder = _folder(spark, "upserts")
    rows = views.sites(spark, sf).select(F.when(F.col("site_id") % 10 != 0, F.col("site_id")).alias("key"), "site_id")
    rows = rows.groupBy("key").agg(F.max("site_id").alias("site_id"))
    for step, divisor in enumerate((1, 2, 5)):
        chosen = rows.where((F.col("site_id") % divisor == 0) | F.col("key").isNull())
        out = tables.upsert_table(chosen.withColumn("step", F.lit(step)), folder, ["key"], parts=4)
    return out.select("key", "site_id", "step")


def saved_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Limits saved without one of them, which falls back to the configured value."""
    folder = _folder(spark, "thresholds")
    green = views.sites(spark, sf).agg(F.round(F.count("lat") / F.count(F.lit(1)), 4).alias("green"))
    tables.write_json_row(green.withColumn("method", F.lit("adaptive")), folder)
    return tables.read_thresholds(spark, folder, red=0.25)


QUERIES = {
    "fragment_scan": fragment_scan,
    "generated_ids": generated_ids,
    "label_csv": label_csv,
    "pixel_window": pixel_window,
    "embedding_archive": embedding_archive,
    "chip_archive": chip_archive,
    "scores_geojson": scores_geojson,
    "upsert_files": upsert_files,
    "saved_thresholds": saved_thresholds,
}

SELECTS = {
    "fragment_scan": """SELECT concat('p', CAST(site_id AS VARCHAR)) AS parcel_id, concat('tile', CAST(site_id % 3 AS VARCHAR)) AS tile_id,
        lower(crop_name) AS crop_name, CASE WHEN site_id % 7 = 0 THEN NULL ELSE CAST(site_id % 30 AS INT) END AS crop_code,
        CASE WHEN site_id % 4 = 0 THEN 45.5::DOUBLE ELSE round(lat + h / 2000.0::DOUBLE, 6) END AS centroid_lat,
        round(lon + w / 2000.0::DOUBLE + CASE WHEN site_id % 3 = 1 THEN 0.25::DOUBLE ELSE 0 END, 6) AS centroid_lon,
        CAST(w * h AS DOUBLE) AS area_ha,
        CASE WHEN lat IS NULL THEN NULL WHEN site_id % 3 = 1 THEN 2 ELSE 1 END AS n_rings, 0 AS n_attrs FROM sites""",
    "generated_ids": """SELECT concat('tile', CAST(site_id % 3 AS VARCHAR), '_0_',
        CAST(row_number() OVER (PARTITION BY site_id % 3 ORDER BY site_id) - 1 AS VARCHAR)) AS parcel_id, site_id, CAST(3 AS BIGINT) AS n_reads FROM sites""",
    "label_csv": """SELECT CAST(parcel_id AS VARCHAR) AS parcel_id, TRY_CAST(code_raw AS INT) AS crop_code, crops_raw AS crop_name FROM label_source""",
    "pixel_window": "SELECT x, y, CAST(code AS INT) AS code FROM pixels WHERE x BETWEEN 10 AND 59 AND y BETWEEN 5 AND 30",
    "embedding_archive": """SELECT parcel_id, CAST(obs_date AS VARCHAR) AS obs_date, CAST(len(embedding) AS INT) AS width,
        CAST(embedding[8] AS DOUBLE) AS eighth, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) AS total FROM obs""",
    "chip_archive": """SELECT parcel_id, CAST(obs_date AS VARCHAR) AS obs_date, 42.0::DOUBLE AS lat, -93.5::DOUBLE AS lon, 10.0::DOUBLE AS gsd,
        4 AS height, 4 AS width, 'B02,B03,B04,B08' AS bands, CAST(band AS INT) AS band,
        array_to_string(list_transform(embedding[band * 16 + 1 : band * 16 + 16], lambda v: CAST(abs(floor(CAST(v AS DOUBLE) * 1000)) AS BIGINT)), ',') AS values
        FROM obs, (VALUES (0), (1), (2), (3)) b(band)""",
    "scores_geojson": """SELECT concat('p', CAST(site_id AS VARCHAR)) AS parcel_id, crop_name, CASE WHEN site_id % 2 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
        CASE WHEN site_id % 2 = 0 THEN 2 ELSE 1 END AS n_parts, CAST(w * h + (1 - site_id % 2) AS DOUBLE) AS area,
        round((w * h * (x0 + w / 2.0::DOUBLE) + (1 - site_id % 2) * (x0 + 100.5::DOUBLE)) / (w * h + (1 - site_id % 2)), 6) AS lon,
        round((w * h * (y0 + h / 2.0::DOUBLE) + (1 - site_id % 2) * (y0 + 0.5::DOUBLE)) / (w * h + (1 - site_id % 2)), 6) AS lat FROM sites WHERE lat IS NOT NULL""",
    "upsert_files": """SELECT key, site_id, CASE WHEN key IS NULL OR site_id % 5 = 0 THEN 2 WHEN site_id % 2 = 0 THEN 1 ELSE 0 END AS step FROM (
         SELECT key, max(site_id) AS site_id FROM (SELECT CASE WHEN site_id % 10 <> 0 THEN site_id END AS key, site_id FROM sites) t GROUP BY key) u""",
    "saved_thresholds": "SELECT 'adaptive' AS method, round(count(lat) / CAST(count(*) AS DOUBLE), 4) AS green, 0.25::DOUBLE AS red FROM sites",
}
