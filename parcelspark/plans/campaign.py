"""Whole runs: data preparation, training data, and a monitoring campaign, as one application each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions.geo import total_bounds
from parcelspark.functions.season import Season
from parcelspark.operators import (
    chips, encode, explain, incremental, profiles, report, retrieval, scenes, scoring, similarity, training,
)
from parcelspark.sources import tables
from parcelspark.sources.files import exists


EXPLANATION_PARTS = 64  # an upsert reads and rewrites only the parts of its parcels


@dataclass(frozen=True)
class Campaign:
    """Settings of a campaign and the folder its tables live in."""

    folder: str
    region: str = "unknown"
    season: Season = Season()
    rules: scoring.ScoringRules = scoring.ScoringRules()
    min_parcels: int = 10
    bands: list[str] = field(default_factory=lambda: list(scenes.DEFAULT_BANDS))
    band_res: dict[str, float] = field(default_factory=dict)
    max_cloud: float = 20
    max_scenes: int | None = None
    max_parcels: int | None = None
    size_px: int = 224
    resolution_m: float = 10.0
    tile_px: int = 256
    nodata_threshold: float = 0.3
    k_semantic: int = 5
    k_spatial: int = 5
    max_km: float | None = None
    geojson: bool = True
    csv_summary: bool = True

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"


def index_scenes(run: Campaign, parcels: DataFrame, catalogue: DataFrame, collection: str | None = None) -> DataFrame:
    """The scene index of the parcels' extent, reused when a stored one covers the season."""
    spark = parcels.sparkSession
    path = run.path("scenes")
    box = total_bounds(parcels).first()
    asked = dict(
        bands=run.bands, max_cloud=run.max_cloud, collection=collection,
        bbox=(box["west"], box["south"], box["east"], box["north"]),
    )
    if exists(spark, path):
        stored = spark.read.parquet(path)
        if scenes.covers(stored, run.season.start, run.season.end, scenes.question(**asked)):
            return stored
    usable = scenes.resolve_bands(catalogue, run.bands)
    index = scenes.scene_index(usable, run.season.start, run.season.end, run.max_scenes, **asked)
    return tables.write_table(index, path)


def make_chips(run: Campaign, parcels: DataFrame, index: DataFrame, tiles: DataFrame, project=None) -> DataFrame:
    """Extract the chips that are not stored yet and append the covered ones. Returns outcome counts.

    The counts are taken while the chips are written.
    """
    spark = parcels.sparkSession
    path = run.path("chips")
    chosen = chips.cap_parcels(parcels, run.max_parcels)
    planned = chips.covered_plan(chosen, index) if "bbox" in index.columns else chips.chip_plan(chosen, index)
    plan = planned.withColumn("obs_date", F.col("scene_date"))
    if exists(spark, path):
        plan = incremental.pending(plan, spark.read.parquet(path))
    windowed = chips.windows(plan.drop("obs_date"), chosen, run.size_px, run.resolution_m, project)
    res = {b: run.band_res.get(b, run.resolution_m) for b in run.bands}
    cut = chips.extract_chips(windowed, tiles, run.bands, res, run.tile_px, run.size_px, run.resolution_m)
    seen = Observation()
    judged = chips.chip_outcome(cut, run.nodata_threshold).observe(seen, *chips.outcome_metrics())
    judged = tables.write_table(judged, run.path("chip_outcomes"))
    judged.where(F.col("outcome") == "extracted").drop("outcome").write.mode("append").parquet(path)
    return chips.observed_outcomes(spark, seen)


def embed(run: Campaign, make_encoder, version: str, batch_size: int = 16) -> DataFrame:
    """Embed chips without a vector of this encoder version; older versions stay until replaced."""
    spark = SparkSession.getActiveSession()
    todo, path = spark.read.parquet(run.path("chips")), run.path("observations")
    done = exists(spark, path)
    shape = (len(run.bands), run.size_px, run.size_px)
    if done:
        todo = incremental.pending_for_version(todo, spark.read.parquet(path), version)
    made = encode.mock_embeddings(todo, version=version) if make_encoder is None else encode.embed_chips(
        todo, make_encoder, version, shape, batch_size
    )
    made.write.mode("append").parquet(path)
    return incremental.fresh_results(spark.read.parquet(path), version)


def monitor(run: Campaign, parcels: DataFrame, observations: DataFrame) -> dict[str, DataFrame]:
    """Profiles, scores, limits, report and search index of a campaign, written to its folder."""
    observations = incremental.unique_observations(observations)
    found = tables.write_table(
        profiles.build_profiles(parcels, observations, run.season, run.min_parcels), run.path("profiles")
    )
    result = scoring.score_parcels(parcels, observations, found, run.season, run.rules)
    scores = tables.write_table(result.scores.drop("attrs", "rings", "part_rings"), run.path("scores"))
    tables.write_json_row(result.thresholds, run.path("thresholds"))
    limits = tables.read_thresholds(parcels.sparkSession, run.path("thresholds"), run.rules.green, run.rules.red)
    if run.geojson:
        shaped = tables.attach_geometry(scores, parcels) if "rings" in parcels.columns else scores
        tables.write_geojson(shaped, run.path("scores_geojson"))
    if run.csv_summary:
        tables.write_csv(report.crop_summary(scores), run.path("summary_csv"))
    season = {"start_date": run.season.start, "end_date": run.season.end}
    tables.write_json_row(report.campaign_report(scores, limits, season, run.region), run.path("report"))
    vectors = tables.write_table(similarity.parcel_vectors(scores, observations), run.path("vectors"))
    return {"profiles": found, "scores": scores, "thresholds": limits, "vectors": vectors}


def explain_campaign(
    run: Campaign, made: dict[str, DataFrame], parcel_ids: list[str] | None = None, make_generator=None,
    with_context: bool = False, skip_unchanged: bool = False, max_parcels: int | None = None, **options,
) -> DataFrame:
    """Explain all parcels or the named ones and upsert the stored explanations."""
    spark = made["scores"].sparkSession
    path, chosen = run.path("explanations"), made["scores"]
    if parcel_ids:
        chosen = report.of_parcels(chosen, parcel_ids)
    chosen = chips.cap_parcels(chosen, max_parcels)
    payloads = explain.build_payloads(chosen, made["thresholds"], run.season, run.rules.min_observations)
    bundles = None
    if with_context and make_generator is not None:
        bundles = retrieval.retrieval_bundles(
            made["scores"], made["vectors"], made["profiles"], run.k_semantic, run.k_spatial, run.max_km, chosen
        )
    stored = spark.read.parquet(path).drop("part") if skip_unchanged and exists(spark, path) else None
    rows = explain.explain_parcels(payloads, make_generator, bundles, stored, **options)
    return tables.upsert_table(rows, path, ["parcel_id"], EXPLANATION_PARTS)


def prepare_training(
    run: Campaign, parcels: DataFrame, target_classes: list[str], min_per_class: int = 500,
    split: tuple[float, float, float] = (0.8, 0.1, 0.1), unit: list[str] | None = None, augmented: int = 0,
) -> DataFrame:
    """Split manifest of the campaign's chips, with its CSV files and the class mapping.

    `augmented` copies of the chips in the training split, and of these only, are written beside the manifests.
    """
    stored = parcels.sparkSession.read.parquet(run.path("chips"))
    classes = training.eligible_classes(parcels, target_classes, min_per_class)
    samples = training.manifest(parcels, stored, classes)
    train, val, test = split
    rows = training.stratified_split(samples, test, val, train, unit=unit)
    tables.write_manifests(rows, run.path("manifests"))
    if augmented:
        tables.write_table(training.training_chips(stored, rows, augmented), run.path("training_chips"))
    tables.write_class_mapping(classes, run.path("class_mapping"))
    return rows
