"""Training data: eligible classes, manifest, stratified split, augmentation, linear head."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.session import rank_in_group


def class_sizes(parcels: DataFrame, target_classes: list[str]) -> DataFrame:
    """Configured classes in their order with their parcel counts, zero included."""
    configured = parcels.sparkSession.createDataFrame(list(enumerate(target_classes)), "pos int, crop_name string")
    counts = parcels.where(F.col("crop_name").isin(target_classes)).groupBy("crop_name").agg(F.count(F.lit(1)).alias("n"))
    return configured.join(counts, "crop_name", "left").select("pos", "crop_name", F.coalesce("n", F.lit(0)).alias("n"))


def eligible_classes(parcels: DataFrame, target_classes: list[str], min_parcels: int) -> DataFrame:
    """Classes with enough parcels and their dense ids in configured order: (crop_name, crop_class_id)."""
    kept = class_sizes(parcels, target_classes).where(F.col("n") >= min_parcels)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "crop_name")))
    return (
        kept.agg(ordered.alias("_c"))
        .select(F.posexplode("_c").alias("crop_class_id", "_e"))
        .select("_e.crop_name", "crop_class_id")
    )


def dropped_classes(parcels: DataFrame, target_classes: list[str], min_parcels: int) -> DataFrame:
    return class_sizes(parcels, target_classes).where(F.col("n") < min_parcels).select("crop_name", "n")


def manifest(parcels: DataFrame, chips: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per chip of an eligible parcel. Pixels stay behind; only keys travel."""
    members = parcels.select("parcel_id", "crop_name").join(classes, "crop_name")
    path = F.concat_ws("/", F.col("parcel_id").cast("string"), F.col("obs_date").cast("string"))
    return (
        chips.select("parcel_id", "obs_date")
        .join(members, "parcel_id")
        .select(path.alias("chip_path"), "crop_class_id", "crop_name", "parcel_id", F.col("obs_date").alias("date"))
    )


def stratified_split(
    samples: DataFrame,
    test: float = 0.1,
    val: float = 0.1,
    train: float = 0.8,
    seed: int = 42,
    stratum: str = "crop_class_id",
    unit: list[str] | None = None,
) -> DataFrame:
    """Add `split` with per-class quotas: test first, then validation from the rest, at random by seeded hash.

    `unit` names the columns that are split as a whole; by default every sample, with ["parcel_id"]
    all chips of a parcel stay together and quotas count parcels.
    """
    unit = unit or ["chip_path"]
    units = samples.select(stratum, *unit).distinct()
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in unit]))
    keyed = units.withColumn("_key", order)
    # The leading digits of the hash cut every class into even ranges, so no class is sorted as a whole.
    bucket = F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")
    ranked = rank_in_group(keyed, [stratum], ["_key", *unit], bucket, "_rank")
    sizes = units.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    n_test = F.round(F.col("_n") * test)
    n_val = F.round((F.col("_n") - n_test) * (val / (train + val)))
    name = (
        F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train")
    )
    assigned = ranked.join(sizes, stratum).select(stratum, *unit, name.alias("split"))
    return samples.join(assigned, [stratum, *unit])


def _draw(key: list[str], seed: int, salt: Column) -> Column:
    """A uniform number in [0, 1) that depends only on the row's key, so retried tasks repeat it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), salt, *[F.col(k).cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") / float(1 << 28)


def augment(
    chips: DataFrame,
    key: list[str],
    seed: int = 42,
    flip_horizontal: bool = True,
    flip_vertical: bool = True,
    band_dropout: float = 0.1,
) -> DataFrame:
    """Random flips (half of the chips each) and dropped bands; apply to the training split only."""
    keyed = lambda salt: _draw(key, seed, salt)
    out = chips
    if flip_horizontal:
        rows = lambda band: F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.col("height") - 1),
                lambda r: F.reverse(F.slice(band, r * F.col("width") + 1, F.col("width"))),
            )
        )
        flipped = F.transform("pixels", rows)
        out = out.withColumn("pixels", F.when(keyed(F.lit("h")) > 0.5, flipped).otherwise(F.col("pixels")))
    if flip_vertical:
        rows = lambda band: F.flatten(
            F.transform(
                F.sequence(F.col("height") - 1, F.lit(0), F.lit(-1)),
                lambda r: F.slice(band, r * F.col("width") + 1, F.col("width")),
            )
        )
        flipped = F.transform("pixels", rows)
        out = out.withColumn("pixels", F.when(keyed(F.lit("v")) > 0.5, flipped).otherwise(F.col("pixels")))
    if band_dropout > 0:
        blank = lambda band, i: F.when(
            keyed(F.concat(F.lit("b"), i.cast("string"))) > band_dropout, band
        ).otherwise(F.transform(band, lambda v: v * 0))
        out = out.withColumn("pixels", F.transform("pixels", blank))
    return out


def training_chips(chips: DataFrame, splits: DataFrame, copies: int = 1, seed: int = 42) -> DataFrame:
    """`copies` augmented chips of every chip in the training split, and of no other: its columns, class and `copy`."""
    train = splits.where(F.col("split") == "train").select("parcel_id", F.col("date").alias("obs_date"), "crop_class_id")
    copied = chips.join(train, ["parcel_id", "obs_date"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return augment(copied, ["parcel_id", "obs_date", "copy"], seed)


def linear_head(samples: DataFrame, max_iter: int = 50, reg: float = 1e-3):
    """Fit a multinomial logistic head on frozen embeddings of the training split.

    `samples` carries embedding, crop_class_id and split. Returns the fitted model.
    """
    head = LogisticRegression(
        featuresCol="features", labelCol="crop_class_id", family="multinomial", maxIter=max_iter, regParam=reg
    )
    return Pipeline(stages=[head]).fit(_with_features(samples.where(F.col("split") == "train")))


def _with_features(samples: DataFrame) -> DataFrame:
    return samples.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))


def head_predictions(model, samples: DataFrame) -> DataFrame:
    scored = model.transform(_with_features(samples))
    kept = [c for c in samples.columns if c != "embedding"]
    return scored.select(*kept, F.col("prediction").cast("int").alias("predicted_class_id"))


def class_totals(model, samples: DataFrame) -> DataFrame:
    """(crop_class_id, total): predicted probabilities summed per class.

    On the training split they equal the class counts once the fit has converged, as the intercepts carry no penalty.
    """
    scored = model.transform(_with_features(samples))
    each = scored.select(F.posexplode(vector_to_array("probability")).alias("crop_class_id", "p"))
    return each.groupBy("crop_class_id").agg(F.sum("p").alias("total"))


def head_metrics(predictions: DataFrame) -> dict[str, float]:
    """Accuracy and F1 on any split."""
    rows = predictions.withColumn("prediction", F.col("predicted_class_id").cast("double"))
    measure = lambda name: MulticlassClassificationEvaluator(
        labelCol="crop_class_id", predictionCol="prediction", metricName=name
    ).evaluate(rows)
    return {name: measure(name) for name in ("accuracy", "f1")}


def relabel(parcels: DataFrame, pixels: DataFrame, project=None) -> DataFrame:
    """Labels of another year, taken from its raster, before splitting."""
    from parcelspark.operators.zonal import label_from_raster

    return label_from_raster(parcels, pixels, project)
