"""Embeddings from chips by a pluggable encoder, loaded once per Python worker."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelspark.functions.encoding import parcel_seed, place_encoding, reflectance, time_encoding, wavelengths
from parcelspark.operators.incremental import pending_for_version

Encoder = Callable[..., np.ndarray]


def first_token(output: np.ndarray) -> np.ndarray:
    """The leading token of a (batch, tokens, width) output; a (batch, width) output as it is."""
    return output[:, 0, :] if output.ndim == 3 else output


def embed_chips(
    chips: DataFrame,
    make_encoder: Callable[[], Encoder],
    version: str,
    shape: tuple[int, int, int] = (10, 224, 224),
    batch_size: int = 16,
) -> DataFrame:
    """Observations (parcel_id, obs_date, embedding, encoder_version) of decodable chips.

    `make_encoder` returns `encode(pixels, time, place, gsd, waves)`, called on batches; pixels arrive
    as (batch, bands, height, width) reflectances of the given shape.
    """

    def make_predict():
        encode = make_encoder()

        def predict(pixels, time, place, gsd, waves):
            return first_token(np.asarray(encode(pixels, time, place, gsd, waves))).astype(np.float32)

        return predict

    run = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(shape), [4], [4], None, [shape[0]]],
    )
    inputs = chips.where(F.col("pixels").isNotNull()).select(
        "parcel_id", "obs_date",
        F.flatten(reflectance(F.col("pixels"))).alias("pixels"),
        time_encoding(F.col("obs_date")).alias("time"),
        place_encoding(F.col("lat"), F.col("lon")).alias("place"),
        F.col("gsd").cast("double").alias("gsd"),
        wavelengths(F.col("bands")).alias("waves"),
    )
    return inputs.select(
        "parcel_id", "obs_date", run("pixels", "time", "place", "gsd", "waves").alias("embedding"),
        F.lit(version).alias("encoder_version"),
    )


def mock_embeddings(chips: DataFrame, dim: int = 768, version: str = "mock") -> DataFrame:
    """Unit Gaussian vectors seeded by the parcel id alone: reproducible, equal on every date."""

    @F.pandas_udf("array<float>")
    def draw(seeds: pd.Series) -> pd.Series:
        def one(seed: int) -> np.ndarray:
            v = np.random.RandomState(seed).randn(dim).astype(np.float32)
            return v / (np.linalg.norm(v) + 1e-8)

        # The dates of a parcel share its vector, which is drawn once for all of them.
        drawn = {seed: one(seed) for seed in seeds.unique()}
        return seeds.map(drawn)

    return chips.select(
        "parcel_id", "obs_date", draw(parcel_seed(F.col("parcel_id"))).alias("embedding"),
        F.lit(version).alias("encoder_version"),
    )


def embed_pending(
    chips: DataFrame,
    done: DataFrame,
    make_encoder: Callable[[], Encoder],
    version: str,
    shape: tuple[int, int, int] = (10, 224, 224),
    batch_size: int = 16,
) -> DataFrame:
    """Embed only chips without a result of this encoder version."""
    return embed_chips(pending_for_version(chips, done, version), make_encoder, version, shape, batch_size)
