"""Campaign reports and the aggregates behind every dashboard panel."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.rounding import mean_4dp, ticks

COLOURS = ["GREEN", "YELLOW", "RED", "GRAY"]
ALERT_COLUMNS = [
    "parcel_id", "fragment_id", "crop_name", "health_score", "status",
    "n_observations", "max_deviation_date", "area_ha",
]


def select_region(scores: DataFrame, tiles: list[str] | None = None, fragments: list[str] | None = None) -> DataFrame:
    """Parcels of the chosen tiles and fragments; an empty choice keeps all."""
    if tiles:
        scores = scores.where(F.col("tile_id").isin(tiles))
    if fragments:
        scores = scores.where(F.col("fragment_id").isin(fragments))
    return scores


def present_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select([c for c in wanted if c in df.columns])


def of_crop(scores: DataFrame, crop: str) -> DataFrame:
    return scores.where(F.col("crop_name") == crop)


def of_parcels(scores: DataFrame, parcel_ids: list[str]) -> DataFrame:
    return scores.where(F.col("parcel_id").isin(parcel_ids))


def monitored(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("status") != "GRAY")


def _colour_counts() -> list[Column]:
    return [F.count_if(F.col("status") == c).alias(c.lower()) for c in COLOURS]


def crop_summary(scores: DataFrame) -> DataFrame:
    return (
        scores.where(F.col("crop_name").isNotNull())
        .groupBy("crop_name")
        .agg(
            F.count(F.lit(1)).alias("total"), *_colour_counts(),
            mean_4dp("health_score").alias("avg_health_score"),
        )
    )


def status_counts(scores: DataFrame) -> DataFrame:
    """Parcels per status, their share of all parcels and of the monitored ones."""
    counts = scores.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("status") != "GRAY", F.col("n"))).alias("monitored")
    ).select(F.struct("total", "monitored")).scalar()
    share = F.when(F.col("status") != "GRAY", F.round(F.col("n") / totals["monitored"] * 100, 0))
    return counts.select(
        "status", "n", F.round(F.col("n") / totals["total"] * 100, 1).alias("pct"), share.alias("monitored_pct")
    )


def temporal_coverage(scores: DataFrame) -> DataFrame:
    n = F.coalesce(F.col("n_observations"), F.lit(0))
    return scores.agg(
        F.round(F.avg(n), 1).alias("mean_observations"),
        F.min(n).cast("long").alias("min_observations"),
        F.max(n).cast("long").alias("max_observations"),
        F.round(F.percentile(n, 0.5), 1).alias("median_observations"),
    )


def worst_parcels(scores: DataFrame, n: int = 10) -> DataFrame:
    return (
        scores.where(F.col("health_score").isNotNull())
        .orderBy(F.desc("health_score"), "parcel_id")
        .limit(n)
        .select("parcel_id", "crop_name", "health_score", "status", "n_observations", "max_deviation_date")
    )


def alerts(scores: DataFrame, levels: tuple[str, ...] = ("RED", "YELLOW")) -> DataFrame:
    """Parcels needing attention; order them with `by_severity` for display."""
    return present_columns(scores.where(F.col("status").isin(*levels)), ALERT_COLUMNS)


def by_severity(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("health_score"), "parcel_id")


def crop_kpis(scores: DataFrame) -> DataFrame:
    return (
        monitored(scores)
        .where(F.col("crop_name").isNotNull())
        .groupBy("crop_name")
        .agg(
            F.count(F.lit(1)).alias("parcels"),
            mean_4dp("health_score").alias("avg_health_score"),
            F.count_if(F.col("status") == "RED").alias("red_alerts"),
        )
    )


def class_balance(parcels: DataFrame) -> DataFrame:
    """Labelled parcels per crop and their share of all parcels."""
    counts = parcels.groupBy("crop_name").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.where(F.col("crop_name").isNotNull()).select(
        "crop_name", "n", F.round(F.col("n") / total * 100, 1).alias("pct")
    )


def label_overview(parcels: DataFrame) -> DataFrame:
    """One row: parcels, labelled, unlabelled, distinct crops, the most common crop and its share."""
    counts = parcels.groupBy("crop_name").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("crop_name").isNotNull()
    most = F.max(F.when(named, F.col("n")))
    return counts.agg(
        F.sum("n").alias("parcels"),
        F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("labelled"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unlabelled"),
        F.count("crop_name").alias("crops"),
        F.min_by("crop_name", F.when(named, F.struct(-F.col("n"), "crop_name"))).alias("most_common"),
        F.round(most / F.sum("n") * 100, 1).alias("most_common_pct"),
    )


def score_histogram(scores: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of health scores per crop; the maximum belongs to the last bin.

    Bins are found on whole ten-thousandths, so a score on a bin's edge always falls to the upper bin.
    """
    valid = monitored(scores).where(F.col("crop_name").isNotNull() & F.col("health_score").isNotNull())
    # Count equal scores first: at most one row per crop and distinct score goes on.
    counts = valid.groupBy("crop_name", ticks(F.col("health_score")).alias("t")).agg(F.count(F.lit(1)).alias("c"))
    limits = counts.groupBy("crop_name").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    raw = F.floor((F.col("t") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))) + 1
    index = F.least(F.coalesce(raw, F.lit(1)), F.lit(bins)).cast("int")
    return (
        counts.join(limits, "crop_name")
        .groupBy("crop_name", index.alias("bin"))
        .agg(F.sum("c").alias("n"))
    )


def inventory(parcels: DataFrame, scenes: DataFrame, chips: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: table sizes, dates per parcel with chips, and the number of chips possible."""
    size = lambda df, name: df.agg(F.count(F.lit(1))).scalar().alias(name)
    base = chips.agg(
        F.count(F.lit(1)).alias("chips"), F.countDistinct("parcel_id").alias("parcels_with_chips")
    ).select(
        size(parcels, "parcels"), scenes.agg(F.countDistinct("scene_date")).scalar().alias("scene_dates"),
        "chips", "parcels_with_chips", size(observations, "embeddings"),
    )
    return base.select(
        "*",
        F.round(F.col("chips") / F.nullif(F.col("parcels_with_chips"), F.lit(0)), 1).alias("dates_per_parcel"),
        (F.col("parcels_with_chips") * F.col("scene_dates")).alias("possible_chips"),
    )


def point_colours(scores: DataFrame, green: float, red: float) -> DataFrame:
    """Trajectory points with the colour band of each distance, dates kept next to distances."""
    return scores.select("parcel_id", F.inline("trajectory")).select(
        "parcel_id", "obs_date", "distance",
        F.when(F.col("distance") < green, "green").when(F.col("distance") < red, "orange").otherwise("red").alias("colour"),
    )


def picker_values(scores: DataFrame, column: str) -> DataFrame:
    """Distinct values of the monitored parcels for a selection list."""
    return monitored(scores).where(F.col(column).isNotNull()).select(column).distinct()


def campaign_report(
    scores: DataFrame, thresholds: DataFrame, season: dict, region: str = "unknown", rules: dict | None = None
) -> DataFrame:
    """The whole report as one struct row; every part is a small aggregate."""
    rows = lambda df, order: F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row"))))
    crops = crop_summary(scores)
    breakdown = crops.agg(F.transform(rows(crops, ["crop_name"]), lambda e: e["row"])).scalar()
    worst = worst_parcels(scores).withColumn("_rank", -F.col("health_score"))
    columns = [c for c in worst.columns if c != "_rank"]
    ten = worst.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", "parcel_id", F.struct(*columns).alias("row")))),
            lambda e: e["row"],
        )
    ).scalar()
    by_status = status_counts(scores)
    as_map = lambda value: by_status.agg(F.map_from_entries(F.collect_list(F.struct("status", value)))).scalar()
    coverage = temporal_coverage(scores)
    return scores.agg(F.count(F.lit(1)).alias("total_parcels")).select(
        "total_parcels",
        as_map("n").alias("status_counts"),
        as_map("pct").alias("status_pct"),
        breakdown.alias("crop_breakdown"),
        ten.alias("top10_worst"),
        coverage.select(F.struct(*coverage.columns)).scalar().alias("temporal_coverage"),
        thresholds.select(F.struct(*thresholds.columns)).scalar().alias("thresholds"),
        F.lit(region).alias("region"),
        F.lit(json.dumps(season, sort_keys=True)).alias("season"),
        F.lit(json.dumps(rules or {}, sort_keys=True)).alias("scoring"),
    )


def crop_rollup(scores: DataFrame) -> DataFrame:
    """Per-crop summary and its grand total in one pass; the total row is named "all"."""
    return (
        scores.where(F.col("crop_name").isNotNull())
        .rollup("crop_name")
        .agg(
            F.count(F.lit(1)).alias("total"), *_colour_counts(),
            mean_4dp("health_score").alias("avg_health_score"),
        )
        .withColumn("crop_name", F.coalesce("crop_name", F.lit("all")))
    )
