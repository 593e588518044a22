"""Scene catalogue files: item and item-collection JSON to scene rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.sources.parcels import shape_parts

# One catalogue item, as a nested type and as top-level columns.
ITEM = (
    "id:string, collection:string, bbox:array<double>, geometry:struct<type:string,coordinates:string>, "
    "properties:struct<datetime:string, `eo:cloud_cover`:double>, assets:map<string,struct<href:string>>"
)
COLUMNS = (
    "id string, collection string, bbox array<double>, geometry struct<type:string,coordinates:string>, "
    "properties struct<datetime:string, `eo:cloud_cover`:double>, assets map<string,struct<href:string>>"
)


def read_scene_items(spark: SparkSession, paths: str | list[str], by_line: bool = False) -> DataFrame:
    """Rows (scene_id, collection, scene_date, cloud_cover, bbox, footprint, assets) of items and collections.

    A file holds one document, which one task reads as a whole, or `by_line` one on each line, which Spark can split.
    footprint: the rings of the item's geometry, all polygons in turn; null without a readable one.
    """
    raw = (
        spark.read.schema(f"{COLUMNS}, features array<struct<{ITEM}>>")
        .option("multiLine", not by_line)
        .json(paths)
    )
    own = F.struct("id", "collection", "bbox", "geometry", "properties", "assets")
    items = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.array(own))
    return (
        raw.select(F.explode(items).alias("item"))
        .where(F.col("item.id").isNotNull())
        .select(
            F.col("item.id").alias("scene_id"),
            F.col("item.collection").alias("collection"),
            F.try_to_date(F.substring("item.properties.datetime", 1, 10)).alias("scene_date"),
            F.col("item.properties").getField("eo:cloud_cover").alias("cloud_cover"),
            F.col("item.bbox").alias("bbox"),
            F.flatten(shape_parts(F.col("item.geometry"))).alias("footprint"),
            F.transform_values("item.assets", lambda _, a: a["href"]).alias("assets"),
        )
    )

