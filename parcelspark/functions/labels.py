"""Crop labels: normal form, code coercion, code names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Land-cover codes and their crop names.
CROP_CODES = {
    1: "corn",
    2: "cotton",
    3: "rice",
    4: "sorghum",
    5: "soybeans",
    6: "sunflower",
    10: "peanuts",
    11: "tobacco",
    12: "sweet_corn",
    13: "popcorn",
    21: "barley",
    22: "durum_wheat",
    23: "spring_wheat",
    24: "winter_wheat",
    25: "other_small_grains",
    26: "winter_wheat_soybeans",
    27: "rye",
    28: "oats",
    29: "millet",
    30: "speltz",
    31: "canola",
    32: "flaxseed",
    33: "safflower",
    34: "rape_seed",
    35: "mustard",
    36: "alfalfa",
    37: "other_hay",
    41: "sugarbeets",
    42: "dry_beans",
    43: "potatoes",
    44: "other_crops",
    45: "sugarcane",
    46: "sweet_potatoes",
    47: "misc_vegs_fruits",
    48: "watermelons",
    49: "onions",
    50: "cucumbers",
    51: "chick_peas",
    52: "lentils",
    53: "peas",
    54: "tomatoes",
    55: "caneberries",
    56: "hops",
    57: "herbs",
    58: "clover",
    59: "sod_grass_seed",
    60: "switchgrass",
    61: "fallow",
    62: "pasture_grass",
    63: "forest",
    64: "shrubland",
    65: "barren",
    66: "cherries",
    67: "peaches",
    68: "apples",
    69: "grapes",
    70: "christmas_trees",
    71: "other_tree_crops",
    72: "citrus",
    74: "pecans",
    75: "almonds",
    76: "walnuts",
    77: "pears",
    176: "grassland",
    190: "woody_wetlands",
    195: "herbaceous_wetlands",
}


def crop_lookup(spark: SparkSession) -> DataFrame:
    """The code table; fixed size, so always small enough to broadcast."""
    return spark.createDataFrame(list(CROP_CODES.items()), "crop_code int, crop_name string")


def normal_label(raw: Column) -> Column:
    """Lower case, with slashes and blanks as underscores. Null stays null."""
    return F.translate(F.lower(raw), "/ ", "__")


def crop_code(raw: Column) -> Column:
    """Numeric code or null; decimals such as '5.0' count as their integer."""
    return raw.try_cast("double").try_cast("int")


def name_codes(df: DataFrame, code: str = "crop_code", out: str = "crop_name") -> DataFrame:
    """Add the crop name of a code: unknown codes become "unknown", null stays null."""
    names = crop_lookup(df.sparkSession).select(F.col("crop_code").alias("_code"), F.col("crop_name").alias("_name"))
    named = df.join(F.broadcast(names), F.col(code) == F.col("_code"), "left")
    value = F.when(F.col(code).isNotNull(), F.coalesce("_name", F.lit("unknown")))
    return named.withColumn(out, value).drop("_code", "_name")


def code_names(df: DataFrame, name: str = "crop_name", out: str = "crop_code") -> DataFrame:
    """Add the code of a crop name, null where the name is not in the table."""
    codes = crop_lookup(df.sparkSession).select(F.col("crop_name").alias("_name"), F.col("crop_code").alias(out))
    return df.join(F.broadcast(codes), F.col(name) == F.col("_name"), "left").drop("_name")
