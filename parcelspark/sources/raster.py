"""Raster tables: categorical rasters in packed blocks with a pyramid of class counts, single pixels, image tiles."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.session import parallelism, stage, staging_folder

BLOCK = 16  # cells along the side of a block
ROW_BYTES = 64  # of a block besides its codes


@dataclass(frozen=True)
class Raster:
    """A stored categorical raster.

    blocks: block_x, block_y, codes - the classes of a block row by row, null where there is no pixel.
    pyramid: level, node_x, node_y, classes - how often each class occurs in a square of 2^level blocks a side.
    """

    blocks: DataFrame
    pyramid: DataFrame
    block: int
    levels: int


def to_blocks(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Single pixels (x, y, code) as one row a block; of pixels with one place any counts."""
    place = lambda c: F.floor(F.col(c) / block).cast("long")
    local = F.pmod(F.col("y"), F.lit(block)) * block + F.pmod(F.col("x"), F.lit(block))
    entries = F.array_sort(F.collect_list(F.struct(local.cast("int").alias("i"), F.col("code").alias("code"))))
    grouped = pixels.groupBy(place("x").alias("block_x"), place("y").alias("block_y")).agg(entries.alias("e"))
    known = F.map_from_entries("e")
    gaps = F.transform(F.sequence(F.lit(0), F.lit(block * block - 1)), lambda i: F.try_element_at(known, i))
    full = F.transform("e", lambda x: x["code"])
    return grouped.select("block_x", "block_y", F.when(F.size("e") == block * block, full).otherwise(gaps).alias("codes"))


def z_order(x: Column, y: Column, bits: int = 24) -> Column:
    """Interleaved bits of two block numbers (negative ones wrap), so that neighbours lie close in a file."""

    def spread(v: Column) -> Column:
        v = v.bitwiseAND(F.lit((1 << bits) - 1))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x.cast("long")).bitwiseOR(F.shiftleft(spread(y.cast("long")), 1))


def class_counts(codes: Column) -> Column:
    """How often each class occurs in an array of codes: array of (code, n)."""
    known = F.filter(codes, lambda c: c.isNotNull())
    return F.transform(
        F.array_distinct(known),
        lambda c: F.struct(c.alias("code"), F.size(F.filter(known, lambda d: d == c)).cast("long").alias("n")),
    )


def write_raster(pixels: DataFrame, folder: str, block: int = BLOCK, buckets: int | None = None) -> Raster:
    """Store (x, y, code) as packed blocks and a pyramid of class counts under `folder`.

    Blocks are bucketed by their number and lie in Z-order inside a bucket: a join on the block moves no pixels, and the
    statistics of a file's row groups leave out blocks beyond a window. The bucketed table is known to this session
    by a name of its own; `open_raster` gives it to another one.
    """
    spark = pixels.sparkSession
    buckets = buckets or parallelism(spark)
    blocks = to_blocks(pixels.select("x", "y", "code"), block).withColumn("z", z_order(F.col("block_x"), F.col("block_y")))
    blocks = blocks.repartition(buckets, "block_x", "block_y")
    table = f"raster_{uuid.uuid4().hex}"
    writer = blocks.write.bucketBy(buckets, "block_x", "block_y").sortBy("z")
    writer.option("path", f"{folder}/blocks").saveAsTable(table)
    stored = spark.table(table)

    box = stored.agg(F.min("block_x"), F.max("block_x"), F.min("block_y"), F.max("block_y")).first()
    side = max(box[1] - box[0], box[3] - box[2], 0) if box[0] is not None else 0
    levels = max(0, int(side).bit_length() - 1)
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    counts = stored.select("block_x", "block_y", class_counts(F.col("codes")).alias("c"))
    counts = counts.select("block_x", "block_y", F.inline("c")).select("*", level)
    node = lambda c: F.expr(f"shiftright({c}, level)")  # rounds down, also below zero
    summed = counts.groupBy("level", node("block_x").alias("node_x"), node("block_y").alias("node_y"), "code")
    summed = summed.agg(F.sum("n").alias("n"))
    classes = summed.groupBy("level", "node_x", "node_y").agg(F.collect_list(F.struct("code", "n")).alias("classes"))
    classes.write.mode("overwrite").parquet(f"{folder}/pyramid")
    return Raster(stored, spark.read.schema(classes.schema).parquet(f"{folder}/pyramid"), block, levels)


def open_raster(spark: SparkSession, folder: str, block: int = BLOCK) -> Raster:
    """A raster stored under `folder`, by another session too; without its catalogue entry joins shuffle the blocks."""
    pyramid = spark.read.parquet(f"{folder}/pyramid")
    levels = pyramid.agg(F.max("level")).first()[0] or 0
    return Raster(spark.read.parquet(f"{folder}/blocks"), pyramid, block, levels)


def packed(pixels: DataFrame, block: int = BLOCK) -> Raster:
    """A raster for one use: staged blocks, and the class counts of single blocks."""
    blocks = stage(to_blocks(pixels.select("x", "y", "code"), block), "raster-blocks")
    classes = blocks.select(
        F.lit(0).alias("level"), F.col("block_x").alias("node_x"), F.col("block_y").alias("node_y"),
        class_counts(F.col("codes")).alias("classes"),
    )
    return Raster(blocks, classes, block, 0)


def stage_raster(pixels: DataFrame, block: int = BLOCK) -> Raster:
    """Store a raster for the length of this application."""
    return write_raster(pixels, f"{staging_folder(pixels.sparkSession)}/raster-{uuid.uuid4().hex}", block)


def write_pixels(pixels: DataFrame, path: str, block: int = 1024) -> DataFrame:
    """Store (x, y, code) block by block, so that file statistics let a window skip most files."""
    cell = lambda c: F.floor(F.col(c) / block).alias(f"block_{c}")
    laid_out = (
        pixels.select("x", "y", "code", cell("x"), cell("y"))
        .repartitionByRange(parallelism(pixels.sparkSession), "block_y", "block_x")
        .sortWithinPartitions("block_y", "block_x", "y", "x")
    )
    laid_out.drop("block_x", "block_y").write.mode("overwrite").parquet(path)
    return pixels.sparkSession.read.parquet(path)


def read_pixels(spark: SparkSession, path: str, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels, optionally only those with min_x <= x <= max_x and min_y <= y <= max_y."""
    pixels = spark.read.parquet(path)
    if bounds is None:
        return pixels
    min_x, min_y, max_x, max_y = bounds
    return pixels.where(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y))


def write_tiles(tiles: DataFrame, path: str) -> DataFrame:
    """Store image tiles (scene_id, band, tx, ty, pixels) with one folder per band and scenes kept together."""
    n = parallelism(tiles.sparkSession)
    spread = tiles.repartition(n, "scene_id", "tx").sortWithinPartitions("scene_id", "tx", "ty")
    spread.write.mode("overwrite").partitionBy("band").parquet(path)
    return tiles.sparkSession.read.parquet(path)


def read_tiles(spark: SparkSession, path: str, bands: list[str]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("band").isin(bands))
