"""Vector expressions: inner product, norm, cosine distance, unit vectors, mean vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Guards against a zero norm in the distance and in the unit vector.
COSINE_EPS = 1e-10
UNIT_EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / (norm(a) * norm(b) + COSINE_EPS)


def unit_vectors(df: DataFrame, vec: str, out: str = "unit") -> DataFrame:
    """Add the L2-normalised vector; the norm is its own projection so it is computed once per row."""
    with_norm = df.withColumn("_norm", norm(F.col(vec)) + UNIT_EPS)
    scaled = F.transform(F.col(vec), lambda x: x.cast("double") / F.col("_norm"))
    return with_norm.withColumn(out, scaled).drop("_norm")


def mean_vectors(df: DataFrame, keys: list[str], vec: str, out: str = "mean") -> DataFrame:
    """Component-wise mean per key, with partial sums on the map side and no row explosion."""
    as_vector = array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double")))
    return (
        df.groupBy(*keys)
        .agg(Summarizer.mean(as_vector).alias("_mean"), F.count(F.lit(1)).alias("n_obs"))
        .select(*keys, vector_to_array("_mean").alias(out), "n_obs")
    )
