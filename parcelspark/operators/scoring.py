"""Health scores: nearest reference date, weighted distance, traffic-light status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from parcelspark.functions.season import Season, early_weight
from parcelspark.functions.vectors import cosine_distance
from parcelspark.operators.profiles import is_labelled
from parcelspark.session import BROADCAST_LIMIT_BYTES, lookup_join, stage


@dataclass(frozen=True)
class ScoringRules:
    method: str = "adaptive"  # "adaptive" or "fixed"
    green: float = 0.15
    red: float = 0.30
    sigma_yellow: float = 1.5
    sigma_red: float = 2.5
    min_observations: int = 1
    urgency: float = 1.5
    early_fraction: float = 0.3
    tolerance_days: int = 21
    min_scores: int = 5
    unmatched_score: str = "zero"  # "zero" or "null": score of parcels without any matched date
    broadcast_bytes: int = BROADCAST_LIMIT_BYTES  # profiles up to this size are broadcast; larger ones meet salted rows


def match_observations(
    parcels: DataFrame,
    observations: DataFrame,
    profiles: DataFrame,
    season: Season = Season(),
    rules: ScoringRules = ScoringRules(),
    unlabelled: bool = False,
) -> DataFrame:
    """Every observation of a labelled parcel with its nearest reference date, weight and distance.

    With `unlabelled` those of all other parcels come too, without weight. Unmatched observations stay, with a null
    distance. The nearest date comes from the crop's short
    list of bin centres, so no observation is multiplied by candidate dates. Ties take the earlier date.
    """
    labelled = parcels.where(is_labelled(F.col("crop_name"))).select("parcel_id", "crop_name")
    size = profiles.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("crop_name").alias("crops"), F.max(F.size("ref")).alias("dim")
    ).first()
    centres = profiles.groupBy("crop_name").agg(F.collect_list(F.struct("bin_center", "bin")).alias("_bins"))
    dated = observations.select("parcel_id", "obs_date", "embedding").join(
        labelled, "parcel_id", "left" if unlabelled else "inner"
    )
    gap = lambda c: F.abs(F.datediff(F.col("obs_date"), c["bin_center"]))
    near = F.filter("_bins", lambda c: gap(c) <= rules.tolerance_days)
    nearest = F.array_min(F.transform(near, lambda c: F.struct(gap(c).alias("gap"), c["bin_center"], c["bin"])))
    located = (
        lookup_join(
            dated, centres, ["crop_name"], 64 * size["rows"] + 128 * size["crops"], ["parcel_id", "obs_date"],
            limit_bytes=rules.broadcast_bytes,
        )
        .withColumn("_near", nearest)
        .select(
            "parcel_id", "crop_name", "obs_date", "embedding",
            F.col("_bins").isNotNull().alias("has_profile"),
            F.col("_near.bin").alias("bin"),
            F.col("_near.bin_center").alias("ref_date"),
        )
    )
    refs = profiles.select("crop_name", "bin", "ref")
    ref_bytes = size["rows"] * (8 * (size["dim"] or 0) + 128)
    matched = lookup_join(located, refs, ["crop_name", "bin"], ref_bytes, ["parcel_id", "obs_date"], limit_bytes=rules.broadcast_bytes)
    return matched.select(
        "parcel_id", "crop_name", "obs_date", "has_profile", "ref_date",
        F.when(
            F.col("crop_name").isNotNull(), early_weight(F.col("obs_date"), season, rules.urgency, rules.early_fraction)
        ).alias("weight"),
        F.when(F.col("ref").isNotNull(), cosine_distance(F.col("embedding"), F.col("ref"))).alias("distance"),
    )


def parcel_distances(parcels: DataFrame, matched: DataFrame, rules: ScoringRules = ScoringRules()) -> DataFrame:
    """One row per parcel with its unrounded score, before any classification.

    All parcel columns pass through. Parcels without label, observations, or profile keep a null score.
    """
    hit = F.col("distance").isNotNull()
    weighted = F.sum(F.col("distance") * F.col("weight")) / F.sum(F.when(hit, F.col("weight")))
    day = F.datediff(F.col("obs_date"), F.lit("1970-01-01").cast("date"))
    per_parcel = matched.groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("distance").alias("n_matched"),
        F.bool_or("has_profile").alias("_profiled"),
        weighted.alias("_score"),
        F.max_by("obs_date", F.when(hit, F.struct("distance", -day))).alias("_worst_date"),
        F.array_sort(
            F.collect_list(F.when(hit, F.struct("obs_date", F.round("distance", 4).alias("distance"))))
        ).alias("_path"),
    )
    return summarised(parcels, per_parcel, rules)


def summarised(parcels: DataFrame, per_parcel: DataFrame, rules: ScoringRules) -> DataFrame:
    """Parcels with the sums of their observations: the score if there are enough, the worst date, the trajectory."""
    joined = parcels.join(per_parcel, "parcel_id", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    scoreable = (n >= rules.min_observations) & F.coalesce(F.col("_profiled"), F.lit(False))
    matched_any = scoreable & (F.col("n_matched") > 0)
    unmatched = F.lit(0.0) if rules.unmatched_score == "zero" else F.lit(None).cast("double")
    empty = F.array().cast("array<struct<obs_date:date,distance:double>>")
    return (
        joined.withColumn("raw_score", F.when(matched_any, F.col("_score")).when(scoreable, unmatched))
        .withColumn("has_match", F.coalesce(matched_any, F.lit(False)))
        .withColumn("n_observations", n)
        .withColumn("max_deviation_date", F.when(F.col("has_match"), F.col("_worst_date")))
        .withColumn("trajectory", F.when(F.col("has_match"), F.col("_path")).otherwise(empty))
        .withColumn("distance_trajectory", F.transform("trajectory", lambda e: e["distance"]))
        .drop("_n", "n_matched", "_profiled", "_score", "_worst_date", "_path")
    )


def status_of(score: Column, green: Column, red: Column) -> Column:
    return F.when(score < green, "GREEN").when(score < red, "YELLOW").otherwise("RED")


def score_statistics() -> list[Column]:
    """Count, mean and population deviation of the rounded scores, as aggregates."""
    score = F.round(F.col("raw_score"), 4)
    return [F.count(score).alias("n"), F.avg(score).alias("mu"), F.stddev_pop(score).alias("sigma")]


def with_limits(stats: DataFrame, rules: ScoringRules) -> DataFrame:
    """One row of statistics with the two limits derived from them."""
    enough = F.col("n") >= rules.min_scores
    limit = lambda factor: F.when(enough, F.col("mu") + factor * F.col("sigma")).otherwise(F.lit(0.0))
    return stats.select(
        "n", "mu", "sigma", enough.alias("enough"),
        limit(rules.sigma_yellow).alias("green"), limit(rules.sigma_red).alias("red"),
    )


def adaptive_thresholds(scored: DataFrame, rules: ScoringRules = ScoringRules()) -> DataFrame:
    """One row: score count, mean, population deviation and the two limits derived from them."""
    return with_limits(scored.agg(*score_statistics()), rules)


def classify(scored: DataFrame, rules: ScoringRules = ScoringRules(), limits: DataFrame | None = None) -> DataFrame:
    """Add `health_score` (4 dp) and `status`.

    Fixed limits test the unrounded score, adaptive limits the rounded one. Adaptive `limits`, if not given, come from
    the scores themselves; either way they reach every row as a scalar subquery.
    """
    health = F.round("raw_score", 4)
    if rules.method == "fixed":
        colour = status_of(F.col("raw_score"), F.lit(rules.green), F.lit(rules.red))
        status = F.when(~F.col("has_match"), "GRAY").otherwise(colour)
    elif rules.method == "adaptive":
        known = adaptive_thresholds(scored, rules) if limits is None else limits
        limits = known.select(F.struct("enough", "green", "red")).scalar()
        colour = status_of(health, limits["green"], limits["red"])
        status = F.when(~F.col("has_match") | ~limits["enough"], "GRAY").otherwise(colour)
    else:
        raise ValueError(f"unknown threshold method {rules.method!r}: use 'fixed' or 'adaptive'")
    return scored.withColumn("health_score", health).withColumn("status", status).drop("raw_score", "has_match")


def effective_thresholds(
    scored: DataFrame, rules: ScoringRules = ScoringRules(), limits: DataFrame | None = None
) -> DataFrame:
    """The limits actually applied, as one row (method, green, red); adaptive ones to 6 dp."""
    if rules.method == "fixed":
        return scored.sparkSession.range(1).select(
            F.lit("fixed").alias("method"), F.lit(rules.green).alias("green"), F.lit(rules.red).alias("red")
        )
    known = adaptive_thresholds(scored, rules) if limits is None else limits
    return known.select(
        F.lit("adaptive").alias("method"), F.round("green", 6).alias("green"), F.round("red", 6).alias("red")
    )


@dataclass(frozen=True)
class ScoreResult:
    scores: DataFrame
    thresholds: DataFrame


def score_parcels(
    parcels: DataFrame,
    observations: DataFrame,
    profiles: DataFrame,
    season: Season = Season(),
    rules: ScoringRules = ScoringRules(),
) -> ScoreResult:
    """Score and classify every parcel; exactly one output row per parcel row.

    The unclassified scores are staged once for adaptive limits, and their statistics are taken in the pass that
    writes them.
    """
    matched = match_observations(parcels, observations, profiles, season, rules)
    scored = parcel_distances(parcels, matched, rules)
    if rules.method != "adaptive":
        return ScoreResult(classify(scored, rules), effective_thresholds(scored, rules))
    seen = Observation()
    scored = stage(scored.observe(seen, *score_statistics()), "raw-scores")
    stats = scored.sparkSession.createDataFrame([tuple(seen.get[k] for k in ("n", "mu", "sigma"))], "n long, mu double, sigma double")
    limits = with_limits(stats, rules)
    return ScoreResult(classify(scored, rules, limits), effective_thresholds(scored, rules, limits))
