"""Tables and export files of the monitoring run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions.geo import shape_of
from parcelspark.session import stage
from parcelspark.sources.files import exists, swap_in

DEFAULT_GREEN, DEFAULT_RED = 0.15, 0.30


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """Write a Parquet table and read it back."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save a table bucketed by its join key, under `path` if given: later joins on the key need no shuffle of it."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def write_observations(observations: DataFrame, path: str) -> DataFrame:
    """Partition dated vectors by month, never by parcel, so that files stay large and dates prune."""
    return write_table(observations.withColumn("month", F.trunc("obs_date", "month")), path, ["month"])


def geometry_text(parts: F.Column) -> F.Column:
    """The GeoJSON geometry of a list of polygons: one a Polygon, several a MultiPolygon, none null."""
    point = lambda v: F.array(v["lon"], v["lat"])
    points = F.transform(parts, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))
    shaped = lambda kind, coordinates: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(coordinates), F.lit("}"))
    several = shaped("MultiPolygon", points)
    return F.when(F.size(parts) > 1, several).when(F.size(parts) == 1, shaped("Polygon", F.get(points, 0))).otherwise(F.lit("null"))


def features(scores: DataFrame) -> DataFrame:
    """One GeoJSON feature text per row; the geometry comes from `rings` and `part_rings`."""
    columns = [c for c in scores.columns if c not in ("rings", "part_rings", "trajectory")]
    properties = F.struct(
        *[
            F.to_json("distance_trajectory").alias(c) if c == "distance_trajectory" else F.col(c)
            for c in columns
        ]
    )
    shape = geometry_text(shape_of(scores)) if "rings" in scores.columns else F.lit("null")
    text = F.to_json(properties, {"ignoreNullFields": "false"})
    return scores.select(
        F.concat(F.lit('{"type":"Feature","properties":'), text, F.lit(',"geometry":'), shape, F.lit("}")).alias("value")
    )


def write_geojson(scores: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features, one file per partition."""
    features(scores).write.mode("overwrite").text(path)


def attach_geometry(scores: DataFrame, parcels: DataFrame) -> DataFrame:
    """Give every score row its geometry; score rows without a parcel stay."""
    shape = [c for c in ("rings", "part_rings") if c in parcels.columns]
    return parcels.select("parcel_id", *shape).join(scores, "parcel_id", "right")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file; only for tables with a row per crop or per class."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_row(df: DataFrame, path: str) -> None:
    """Write a one-row table as one JSON object."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_thresholds(
    spark: SparkSession, path: str, green: float = DEFAULT_GREEN, red: float = DEFAULT_RED, method: str = "fixed"
) -> DataFrame:
    """Saved limits, each falling back to its configured value when missing or unreadable."""
    schema = "method string, green double, red double"
    configured = spark.range(1).select(F.lit(method).alias("_m"), F.lit(green).alias("_g"), F.lit(red).alias("_r"))
    if not exists(spark, path):
        return configured.select(F.col("_m").alias("method"), F.col("_g").alias("green"), F.col("_r").alias("red"))
    saved = spark.read.schema(schema).json(path).select(F.first(F.struct("*"))).scalar()
    return configured.select(
        F.coalesce(saved["method"], "_m").alias("method"),
        F.coalesce(saved["green"], "_g").alias("green"),
        F.coalesce(saved["red"], "_r").alias("red"),
    )


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not in the new ones, and all new rows; nulls in a key are equal."""
    fresh = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    kept = old.join(fresh, same, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_table(new: DataFrame, path: str, keys: list[str], parts: int | None = None) -> DataFrame:
    """Replace rows by key in a Parquet table: write the merged table aside, then swap it in.

    With `parts` the table is partitioned by a hash of its keys and only the parts that `new` touches
    are read and rewritten. Use the same number on every call.
    """
    spark = new.sparkSession
    if parts:
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        fresh = stage(new.withColumn("part", part), "upsert")
        if exists(spark, path):
            touched = [r["part"] for r in fresh.select("part").distinct().collect()]  # at most `parts` values
            old = spark.read.parquet(path).where(F.col("part").isin(touched))
            fresh = stage(replace_by_key(old, fresh, keys), "upsert-merged")
        writer = fresh.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part").parquet(path)
        return spark.read.parquet(path).drop("part")
    aside = f"{path}._new-{uuid.uuid4().hex}"
    merged = replace_by_key(spark.read.parquet(path), new, keys) if exists(spark, path) else new
    merged.write.parquet(aside)
    swap_in(spark, aside, path)
    return spark.read.parquet(path)


def write_manifests(splits: DataFrame, path: str) -> None:
    """Training manifests as CSV, one folder per split."""
    splits.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def write_class_mapping(classes: DataFrame, path: str) -> None:
    """The class id to name mapping as one JSON object."""
    pairs = F.array_sort(F.collect_list(F.struct("crop_class_id", "crop_name")))
    as_map = F.map_from_entries(
        F.transform(pairs, lambda e: F.struct(e["crop_class_id"].cast("string"), e["crop_name"]))
    )
    classes.agg(F.to_json(as_map).alias("value")).coalesce(1).write.mode("overwrite").text(path)
