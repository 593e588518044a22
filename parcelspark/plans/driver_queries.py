"""The registered queries: every operator on whole driver tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import encoding, geo, labels, replies
from parcelspark.functions.season import (
    Season, bin_index, early_weight, register_season_bins, season_bins, season_fraction,
)
from parcelspark.functions.vectors import mean_vectors, norm
from parcelspark.operators import (
    chips, encode, explain, incremental, profiles, report, retrieval, scenes, scoring, similarity, training, zonal,
)
from parcelspark.operators.knn import KnnPlan
from parcelspark.plans import driver_views as views, source_queries
from parcelspark.session import stage, staging_folder
from parcelspark.sources import tables
from parcelspark.sources.parcels import flatten_attributes
from parcelspark.sources.raster import stage_raster
from parcelspark.sources.tables import replace_by_key
from parcelspark.streaming import intake

SEASON = Season()
# Limits at which all four colours occur in the driver's data.
FIXED = scoring.ScoringRules(method="fixed", green=0.60, red=0.75)
ADAPTIVE = scoring.ScoringRules(method="adaptive", sigma_yellow=0.5, sigma_red=1.5)
TARGET_CLASSES = ["crop_8", "crop_3", "crop_0", "crop_5", "crop_1", "crop_99"]


def text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def rounded(digits: int, *columns: str) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


# --- profiles and scores -------------------------------------------------------------------------


class Base:
    """The observation view, written once per query, with its parcels."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        labelled = stage(views.labelled_observations(spark, sf), "observations")
        self.observations = views.observations(labelled)
        self.parcels = views.parcels(labelled)

    def profiles(self) -> DataFrame:
        return profiles.build_profiles(self.parcels, self.observations, SEASON)

    def score(self, found: DataFrame, rules: scoring.ScoringRules) -> scoring.ScoreResult:
        return scoring.score_parcels(self.parcels, self.observations, found, SEASON, rules)


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return Base(spark, sf).profiles()


def _result(spark: SparkSession, sf: str, rules: scoring.ScoringRules = FIXED) -> scoring.ScoreResult:
    base = Base(spark, sf)
    return base.score(base.profiles(), rules)


def _scores(spark: SparkSession, sf: str, rules: scoring.ScoringRules = FIXED) -> DataFrame:
    return _result(spark, sf, rules).scores


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    return views.observations(views.labelled_observations(spark, sf))


def _parcels(spark: SparkSession, sf: str) -> DataFrame:
    return views.parcels(views.labelled_observations(spark, sf))


def _two_scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Fixed and adaptive scores of the same profiles."""
    base = Base(spark, sf)
    found = base.profiles()
    return base.score(found, FIXED).scores, base.score(found, ADAPTIVE).scores


def _score_columns(scores: DataFrame) -> DataFrame:
    return scores.select(
        "parcel_id", "crop_name", "health_score", "status", "n_observations", text("max_deviation_date")
    )


def crop_status_summary(spark, sf):
    return report.crop_summary(_scores(spark, sf, ADAPTIVE))


def season_bin_counts(spark, sf):
    seen = (
        _observations(spark, sf)
        .groupBy(bin_index(F.col("obs_date"), SEASON).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return season_bins(spark, SEASON).join(seen, "bin", "left").select(
        "bin", text("bin_start"), text("bin_end"), text("bin_center"), F.coalesce("n", F.lit(0)).alias("n_obs")
    )


def crop_profiles(spark, sf):
    return profiles.profile_values(_profiles(spark, sf)).select(
        "crop_name", text("bin_center"), "n_obs", "pos", F.round("value", 6).alias("value")
    )


def profile_coverage(spark, sf):
    return profiles.profile_coverage(_profiles(spark, sf)).select(
        "crop_name", "n_temporal_bins", F.concat_ws(",", F.col("bin_sample_dates").cast("array<string>")).alias("bin_sample_dates")
    )


def parcel_scores_fixed(spark, sf):
    return _score_columns(_scores(spark, sf))


def parcel_scores_adaptive(spark, sf):
    return _score_columns(_scores(spark, sf, ADAPTIVE))


def side_by_side(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parcels and observations stored in buckets by parcel, and the profiles."""
    base = Base(spark, sf)
    folder, mark = _folder(spark, "buckets"), uuid.uuid4().hex
    stored = lambda df, name: tables.write_bucketed(df, f"{name}_{mark}", "parcel_id", 8, f"{folder}/{name}")
    return stored(base.parcels, "parcels"), stored(base.observations, "observations"), base.profiles()


def parcel_scores_bucketed(spark, sf):
    """Scores from tables stored side by side: the vectors are not shuffled again."""
    parcels, observations, found = side_by_side(spark, sf)
    return _score_columns(scoring.score_parcels(parcels, observations, found, SEASON, FIXED).scores)


def season_bins_sql(spark, sf):
    """Calendars of different bin lengths by crop, from a table function in SQL, and the observations in each bin."""
    register_season_bins(spark)
    labelled = views.labelled_observations(spark, sf).where(F.col("crop_name").isNotNull())
    view = f"observed_{uuid.uuid4().hex}"
    labelled.select("crop_name", "obs_date").createOrReplaceTempView(view)
    return spark.sql(f"""
        WITH crops AS (SELECT DISTINCT crop_name, 7 * (1 + int(substring(crop_name, 6)) % 3) AS bin_days FROM {view})
        SELECT c.crop_name, b.bin, string(b.bin_start) AS bin_start, string(b.bin_end) AS bin_end,
          string(b.bin_center) AS bin_center, count(o.obs_date) AS n_obs
        FROM crops c, LATERAL season_bins(DATE '{SEASON.start}', DATE '{SEASON.end}', c.bin_days) b
        LEFT JOIN {view} o ON o.crop_name = c.crop_name AND o.obs_date >= b.bin_start AND o.obs_date < b.bin_end
        GROUP BY ALL""")


def effective_thresholds(spark, sf):
    return _result(spark, sf, ADAPTIVE).thresholds


def distance_trajectory(spark, sf):
    return _scores(spark, sf).select("parcel_id", F.inline("trajectory")).select("parcel_id", text("obs_date"), "distance")


def max_deviation_date(spark, sf):
    return _scores(spark, sf).where(F.col("max_deviation_date").isNotNull()).select("parcel_id", text("max_deviation_date"))


def observation_weights(spark, sf):
    day = F.col("obs_date")
    return _observations(spark, sf).select(
        "parcel_id", text("obs_date"), F.round(season_fraction(day, SEASON), 6).alias("season_fraction"),
        early_weight(day, SEASON).alias("weight"),
    )


# --- reports -------------------------------------------------------------------------------------


def status_counts_pct(spark, sf):
    return report.status_counts(_scores(spark, sf))


def temporal_coverage(spark, sf):
    return report.temporal_coverage(_scores(spark, sf))


def top10_worst(spark, sf):
    return _score_columns(report.worst_parcels(_scores(spark, sf)))


def alert_list(spark, sf):
    return report.alerts(_scores(spark, sf)).withColumn("max_deviation_date", F.col("max_deviation_date").cast("string"))


def score_histogram(spark, sf):
    return report.score_histogram(_scores(spark, sf))


def crop_kpis(spark, sf):
    return report.crop_kpis(_scores(spark, sf))


def class_balance(spark, sf):
    return report.class_balance(_parcels(spark, sf))


def label_overview(spark, sf):
    return report.label_overview(_parcels(spark, sf))


def inventory(spark, sf):
    base = Base(spark, sf)
    return report.inventory(base.parcels, views.scenes(spark, sf), base.observations, base.observations)


def trajectory_colours(spark, sf):
    return report.point_colours(_scores(spark, sf), FIXED.green, FIXED.red).withColumn("obs_date", F.col("obs_date").cast("string"))


def region_selection(spark, sf):
    chosen = report.select_region(_scores(spark, sf), ["t0", "t2"], ["00_00", "01_00", "03_00"])
    return chosen.select(
        "parcel_id", "crop_name", "health_score", "status", "n_observations", text("max_deviation_date"),
        "tile_id", "fragment_id",
    )


def monitored_crops(spark, sf):
    return report.picker_values(_scores(spark, sf), "crop_name")


def campaign_rollup(spark, sf):
    return report.crop_rollup(_scores(spark, sf))


def campaign_report(spark, sf):
    result = _result(spark, sf)
    scores = stage(result.scores, "scores")
    season = {"start_date": SEASON.start, "end_date": SEASON.end}
    one = report.campaign_report(scores, result.thresholds, season, "driver")
    row = lambda section, key, value: F.struct(
        F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value")
    )
    of_map = lambda name: F.transform(F.map_entries(name), lambda e: row(name, e["key"], e["value"]))
    of_list = lambda name, key, value: F.transform(name, lambda e: row(f"{name}.{value}", e[key], e[value]))
    fields = lambda name, keys: F.array(*[row(name, F.lit(k), F.col(f"{name}.{k}")) for k in keys])
    entries = F.concat(
        F.array(row("total_parcels", F.col("region"), F.col("total_parcels"))),
        of_map("status_counts"), of_map("status_pct"),
        of_list("crop_breakdown", "crop_name", "total"), of_list("crop_breakdown", "crop_name", "avg_health_score"),
        of_list("top10_worst", "parcel_id", "health_score"),
        fields("temporal_coverage", ["mean_observations", "min_observations", "max_observations", "median_observations"]),
        fields("thresholds", ["green", "red"]),
    )
    return one.select(F.inline(entries))


# --- vectors and neighbours ----------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    base = Base(spark, sf)
    return similarity.parcel_vectors(base.parcels, base.observations)


def mean_vector_values(spark, sf):
    return mean_vectors(_observations(spark, sf), ["parcel_id"], "embedding").select(
        "parcel_id", F.posexplode("mean").alias("pos", "v")
    ).select("parcel_id", "pos", F.round("v", 6).alias("value"))


def unit_norms(spark, sf):
    return _vectors(spark, sf).select("parcel_id", F.round(norm(F.col("unit")), 6).alias("norm"))


def knn_one(spark, sf):
    near = similarity.nearest_to(_vectors(spark, sf), "p3000", 10)
    return near.select("parcel_id", "crop_name", *rounded(6, "similarity", "cosine_distance"))


def knn_all(spark, sf):
    near = similarity.nearest_of_all(_vectors(spark, sf), 10)
    return near.select(
        "parcel_id", "neighbor_id", "neighbor_crop", *rounded(6, "similarity", "cosine_distance"), "rank"
    )


# The large side of each size switch, forced at small size: same rows, another plan.


def knn_all_cells(spark, sf):
    near = similarity.nearest_of_all(_vectors(spark, sf), 10, plan=KnnPlan(one_cell_rows=20, block_rows=16))
    return near.select(
        "parcel_id", "neighbor_id", "neighbor_crop", *rounded(6, "similarity", "cosine_distance"), "rank"
    )


def spatial_knn_cells(spark, sf):
    plan = KnnPlan(one_cell_rows=100, block_rows=64)
    return _near_sites(similarity.nearest_places(_places(spark, sf), 5, plan=plan))


def crop_profiles_large(spark, sf):
    base = Base(spark, sf)
    found = profiles.build_profiles(base.parcels, base.observations, SEASON, block_rows=3)
    return profiles.profile_values(found).select(
        "crop_name", text("bin_center"), "n_obs", "pos", F.round("value", 6).alias("value")
    )


def parcel_scores_salted(spark, sf):
    return _score_columns(_scores(spark, sf, replace(FIXED, broadcast_bytes=0)))


def mislabel_scan(spark, sf):
    return similarity.scan_mislabels(_vectors(spark, sf), 10, 0.9)


def neighbor_roles(spark, sf):
    vectors = _vectors(spark, sf)
    return similarity.neighbor_roles(vectors, similarity.nearest_of_all(vectors, 10))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return views.sites(spark, sf).select(F.col("site_id").alias("id"), "lat", "lon")


def _near_sites(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("site_id"), "neighbor_id", F.round("distance_km", 6).alias("distance_km"), "rank")


def spatial_knn(spark, sf):
    return _near_sites(similarity.nearest_places(_places(spark, sf), 5))


def spatial_knn_capped(spark, sf):
    return _near_sites(similarity.nearest_places(_places(spark, sf), 8, 3.0))


def retrieval_bundle_long(spark, sf):
    base = Base(spark, sf)
    found = base.profiles()
    scores = stage(base.score(found, FIXED).scores, "scores")
    vectors = similarity.parcel_vectors(scores, base.observations)
    bundles = stage(retrieval.retrieval_bundles(scores, vectors, found), "bundles")
    row = lambda kind, rank, item, measure, status: F.struct(
        F.lit(kind).alias("kind"), rank.cast("int").alias("rank"), item.alias("item"),
        measure.cast("double").alias("measure"), status.cast("string").alias("status"),
    )
    nothing, zero = F.lit(None), F.lit(0)
    context = F.col("reference_context")
    entries = F.concat(
        F.transform("similar_parcels", lambda e, i: row("similar", i + 1, e["parcel_id"], e["cosine_distance"], e["status"])),
        F.transform("spatial_neighbors", lambda e, i: row("spatial", i + 1, e["parcel_id"], e["distance_km"], e["status"])),
        F.when(context.isNotNull(), F.array(row(
            "reference", zero, F.concat_ws(",", context["bin_sample_dates"].cast("array<string>")), context["n_temporal_bins"], nothing
        ))).otherwise(F.array()),
        F.transform("retrieval_notes", lambda n: row("note", zero, n, nothing, nothing)),
    )
    return bundles.select("parcel_id", F.inline(entries))


# --- scenes and chips ----------------------------------------------------------------------------


def _scene_rows(found: DataFrame) -> DataFrame:
    return found.select("scene_id", text("scene_date"), "cloud_cover")


def scene_filter(spark, sf):
    return _scene_rows(scenes.filter_scenes(views.scenes(spark, sf), "2024-01-05", "2024-01-25", 20, "view"))


def best_scene_per_date(spark, sf):
    return _scene_rows(scenes.best_per_date(views.scenes(spark, sf)))


def scene_cap(spark, sf):
    return _scene_rows(scenes.cap_scenes(scenes.best_per_date(views.scenes(spark, sf)), 20))


def cloud_stats(spark, sf):
    clear = views.scenes(spark, sf).where(F.col("cloud_cover") < 20)
    return scenes.cloud_stats(clear).select("n_scenes", "n_dates", F.round("avg_cloud", 6).alias("avg_cloud"))


def band_resolve(spark, sf):
    key = F.col("scene_id").cast("string")
    address = lambda name: F.concat(F.lit("s/"), key, F.lit("/"), name)
    first = F.when(F.col("scene_id") % 3 == 0, "blue").otherwise("B02")
    kind = F.col("collection")
    assets = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(kind == "error", F.struct(F.lit("thumbnail").alias("k"), address(F.lit("thumbnail")).alias("v"))),
                F.when(kind != "error", F.struct(first.alias("k"), address(first).alias("v"))),
                F.when(kind == "click", F.struct(F.lit("red").alias("k"), address(F.lit("red")).alias("v"))),
            )
        )
    )
    found = scenes.resolve_bands(views.scenes(spark, sf).withColumn("assets", assets), ["B02", "B04"])
    url = lambda band: F.try_element_at("asset_urls", F.lit(band)).alias(band.lower())
    return found.select("scene_id", url("B02"), url("B04"), F.size("asset_urls").alias("n_bands"))


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    parcels = views.sites(spark, sf).select(F.col("site_id").alias("parcel_id"))
    return chips.chip_plan(parcels, views.scenes(spark, sf))


def chip_plan(spark, sf):
    return _plan(spark, sf).select("parcel_id", "scene_id", text("scene_date"))


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    parcels = views.sites(spark, sf).select(
        F.col("site_id").alias("parcel_id"), F.col("lat").alias("centroid_lat"), F.col("lon").alias("centroid_lon")
    )
    return chips.covered_plan(parcels, views.slanted(spark, sf))


def best_scene_per_cell(spark, sf):
    found = scenes.best_per_cell(views.footprints(spark, sf))
    return found.select("cell_x", "cell_y", "scene_id", text("scene_date"), "cloud_cover")


def chip_plan_covered(spark, sf):
    return _covered(spark, sf).select("parcel_id", "scene_id", text("scene_date"))


def scene_index(spark, sf):
    found = scenes.scene_index(
        views.footprints(spark, sf), "2024-01-05", "2024-01-25", max_cloud=20, bbox=(-93.55, 41.25, -93.25, 41.45)
    )
    return found.select("scene_id", text("scene_date"), "cloud_cover", text("queried_from"), text("queried_to"))


def chip_todo(spark, sf):
    """The plan minus the chips already there, here every third one by parcel and day."""
    plan = _plan(spark, sf).withColumnRenamed("scene_date", "obs_date")
    done = plan.where((F.col("parcel_id") + F.dayofmonth("obs_date")) % 3 == 0)
    return incremental.pending(plan, done).select("parcel_id", F.col("obs_date").cast("string").alias("scene_date"))


def chip_bounds(spark, sf):
    located = views.sites(spark, sf).where(F.col("lat").isNotNull())
    window = geo.chip_bounds(F.col("lon"), F.col("lat"), 224, 10.0)
    return located.select("site_id", window.alias("b")).select(
        "site_id", *[F.round(f"b.{s}", 8).alias(s) for s in ("west", "south", "east", "north")]
    )


def nodata_fraction(spark, sf):
    bands = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.slice("embedding", b * 16 + 1, 16))
    share = chips.nodata_fraction(bands, empty=lambda v: F.abs(v.cast("double")) < 0.1)
    return views.table(spark, sf, "embeddings").select("vec_id", share.alias("nodata")).select(
        "vec_id", "nodata", (F.col("nodata") <= 0.3).alias("kept")
    )


def _vector_chips(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a small chip of 4 bands of 4 x 4 pixels."""
    value = lambda v: F.round(v.cast("double") * 10_000).cast("int")
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda b: F.transform(F.slice("embedding", b * 16 + 1, 16), value)
    )
    return views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("parcel_id"), F.date_add(F.lit("2024-04-15").cast("date"), F.col("label")).alias("obs_date"),
        F.lit(41.0).alias("lat"), F.lit(-94.0).alias("lon"), F.lit(10.0).alias("gsd"),
        F.array(*[F.lit(b) for b in ("B02", "B03", "B04", "B08")]).alias("bands"), bands.alias("pixels"),
        F.lit(4).alias("height"), F.lit(4).alias("width"),
    )


def chip_rgb(spark, sf):
    views_ = chips.rgb_preview(_vector_chips(spark, sf))
    rows = views_.select("parcel_id", F.posexplode(F.arrays_zip("red", "green", "blue")).alias("px", "c"))
    return rows.select(F.col("parcel_id").alias("vec_id"), "px", *[F.round(f"c.{b}", 6).alias(b) for b in ("red", "green", "blue")])


def chip_outcomes(spark, sf):
    return chips.count_outcomes(chips.chip_outcome(_vector_chips(spark, sf)))


def resample(spark, sf):
    """Chips of 8 x 8 pixels cut from the categorical raster, stored as tiles of 16 x 16 pixels."""
    tile = 16
    cells = views.pixels(spark, sf).select(
        "code", F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("y") / tile).cast("int").alias("ty"),
        ((tile - 1 - F.col("y") % tile) * tile + F.col("x") % tile).cast("int").alias("at"),
    )
    filled = cells.groupBy("tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("at", "code"))).alias("m"))
    # The raster covers its whole extent of 100 x 50 cells; cells without a pixel are nodata.
    extent = spark.range(7 * 4).select((F.col("id") % 7).cast("int").alias("tx"), F.floor(F.col("id") / 7).cast("int").alias("ty"))
    tiles = extent.join(filled, ["tx", "ty"], "left").select(
        F.lit(1).alias("scene_id"), F.lit("B02").alias("band"), "tx", "ty",
        F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("pixels"),
    )
    side = lambda low, size: (F.col(low) + F.col(size)).cast("double")
    windowed = views.sites(spark, sf).select(
        F.col("site_id").alias("parcel_id"), F.lit(1).alias("scene_id"), F.lit("2024-06-01").cast("date").alias("scene_date"),
        "lat", "lon", F.col("x0").cast("double").alias("west"), F.col("y0").cast("double").alias("south"),
        side("x0", "w").alias("east"), side("y0", "h").alias("north"),
    )
    cut = chips.extract_chips(windowed, tiles, ["B02"], {"B02": 1.0}, tile_px=tile, size_px=8, gsd=1.0)
    return cut.select("parcel_id", F.posexplode(F.col("pixels")[0]).alias("px", "value"))


# --- geometry, raster, labels --------------------------------------------------------------------


def total_bounds(spark, sf):
    box = geo.total_bounds(views.site_rings(spark, sf))
    return box.select(*rounded(6, *box.columns))


def polygon_area_centroid(spark, sf):
    middle = geo.polygon_centroid(F.col("rings"))
    return views.site_rings(spark, sf).select("site_id", middle.alias("m")).select(
        "site_id", F.round("m.area", 6).alias("area"), F.round("m.lon", 6).alias("lon"), F.round("m.lat", 6).alias("lat")
    )


def albers_project(spark, sf):
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    located = views.sites(spark, sf).where(F.col("lat").isNotNull())
    return located.select("site_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def utm_project(spark, sf):
    x, y = geo.utm(F.col("lon"), F.col("lat"), geo.utm_zone(F.col("lon")))
    located = views.sites(spark, sf).where(F.col("lat").isNotNull())
    return located.select("site_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def utm_project_south(spark, sf):
    """The same sites mirrored at the equator."""
    x, y = geo.utm(F.col("lon"), -F.col("lat"), geo.utm_zone(F.col("lon")))
    located = views.sites(spark, sf).where(F.col("lat").isNotNull())
    return located.select("site_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def zonal_counts(spark, sf):
    """Counts from a raster stored as blocks with its pyramid."""
    return zonal.zonal_counts(views.site_rings(spark, sf), stage_raster(views.pixels(spark, sf)), "site_id")


def zonal_majority(spark, sf):
    shapes = views.site_rings(spark, sf).select(F.col("site_id").alias("parcel_id"), "rings")
    labelled = zonal.label_from_raster(shapes, views.pixels(spark, sf))
    return labelled.select(F.col("parcel_id").alias("site_id"), "crop_code", "crop_name")


def label_normalize(spark, sf):
    return views.label_source(spark, sf).select(
        "parcel_id", labels.normal_label(F.col("crops_raw")).alias("crop_name"), labels.crop_code(F.col("code_raw")).alias("crop_code")
    )


def label_join(spark, sf):
    from parcelspark.sources.parcels import label_from_table

    part = views.table(spark, sf, "part")
    known = part.where(F.col("p_size") % 5 != 0).select(
        F.col("p_partkey").alias("parcel_id"), F.col("p_size").alias("crop_code"), F.col("p_type").alias("crop_name")
    )
    return label_from_table(views.label_source(spark, sf).select("parcel_id"), known)


def code_lookup(spark, sf):
    coded = views.label_source(spark, sf).select("parcel_id", labels.crop_code(F.col("code_raw")).alias("crop_code"))
    return labels.name_codes(coded)


def props_flatten(spark, sf):
    """Attributes under `props` join the top-level ones; `kind` exists on top and stays as it is."""
    nested = F.regexp_replace("props", r"\}\s*$", ', "kind": "nested"}')
    properties = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("props"), nested)
    flat = views.table(spark, sf, "events").select("event_id", flatten_attributes(properties).alias("a"))
    return flat.select("event_id", F.col("a")["kind"].alias("kind"), F.col("a")["k"].cast("int").alias("k"))


# --- encoding ------------------------------------------------------------------------------------


def time_encoding(spark, sf):
    e = encoding.time_encoding(F.col("obs_date"))
    names = ("week_sin", "week_cos", "hour_sin", "hour_cos")
    return _observations(spark, sf).select("parcel_id", text("obs_date"), e.alias("e")).select(
        "parcel_id", "obs_date", *[F.round(F.col("e")[i], 6).alias(n) for i, n in enumerate(names)]
    )


def latlon_encoding(spark, sf):
    e = encoding.place_encoding(F.col("lat"), F.col("lon"))
    located = views.sites(spark, sf).where(F.col("lat").isNotNull())
    names = ("sin_lat", "cos_lat", "sin_lon", "cos_lon")
    return located.select("site_id", e.alias("e")).select(
        "site_id", *[F.round(F.col("e")[i], 6).alias(n) for i, n in enumerate(names)]
    )


def parcel_seed(spark, sf):
    return _parcels(spark, sf).select("parcel_id", encoding.parcel_seed(F.col("parcel_id")).alias("seed"))


def mock_embed(spark, sf):
    made = encode.mock_embeddings(_observations(spark, sf), 768)
    return made.select("parcel_id", text("obs_date"), F.round(norm(F.col("embedding")), 4).alias("norm"))


def encode_chips(spark, sf):
    """A band-mean encoder in place of a model, run in batches."""

    def make_encoder():
        return lambda pixels, time, place, gsd, waves: pixels.mean(axis=(2, 3))

    made = encode.embed_chips(_vector_chips(spark, sf), make_encoder, "band-means", (4, 4, 4))
    # Sixteen pixels in ten-thousandths: as whole numbers the means are free of float noise.
    return made.select(F.col("parcel_id").alias("vec_id"), F.posexplode("embedding").alias("band", "mean")).select(
        "vec_id", "band", F.round(F.col("mean").cast("double") * 160_000).cast("long").alias("pixel_sum")
    )


def embed_todo(spark, sf):
    """Observations without a result of the current encoder: a quarter has one, another quarter an old one."""
    rows = views.labelled_observations(spark, sf).select("vec_id", "parcel_id", "obs_date")
    version = F.when(F.col("vec_id") % 4 == 1, "v2").when(F.col("vec_id") % 4 == 2, "v1")
    done = rows.withColumn("encoder_version", version).where(F.col("encoder_version").isNotNull())
    return incremental.pending_for_version(rows, done, "v2").select("parcel_id", text("obs_date"))


# --- training ------------------------------------------------------------------------------------


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    base = Base(spark, sf)
    classes = training.eligible_classes(base.parcels, TARGET_CLASSES, 10)
    return training.manifest(base.parcels, base.observations, classes)


def class_eligibility(spark, sf):
    return training.eligible_classes(_parcels(spark, sf), TARGET_CLASSES, 10)


def dropped_classes(spark, sf):
    return training.dropped_classes(_parcels(spark, sf), TARGET_CLASSES, 10)


def manifest_eligible(spark, sf):
    return _samples(spark, sf).withColumn("date", F.col("date").cast("string"))


def stratified_split(spark, sf):
    return training.stratified_split(_samples(spark, sf)).select("chip_path", "crop_class_id", "split")


def augment(spark, sf):
    changed = training.augment(_vector_chips(spark, sf), ["parcel_id"])
    bands = changed.select(F.col("parcel_id").alias("vec_id"), F.posexplode("pixels").alias("band", "values"))
    return bands.select("vec_id", "band", F.posexplode("values").alias("px", "value"))


def linear_head(spark, sf):
    split = stage(training.stratified_split(_samples(spark, sf)), "split")
    vectors = _observations(spark, sf).withColumnRenamed("obs_date", "date")
    samples = stage(split.join(vectors, ["parcel_id", "date"]), "head-samples")
    predicted = training.head_predictions(training.linear_head(samples), samples.where(F.col("split") == "test"))
    return predicted.select("chip_path", "crop_class_id", "predicted_class_id")


def linear_head_totals(spark, sf):
    """Predicted probabilities of the training split, summed per class: the class counts, at the optimum."""
    split = stage(training.stratified_split(_samples(spark, sf)), "split")
    vectors = _observations(spark, sf).withColumnRenamed("obs_date", "date")
    samples = stage(split.join(vectors, ["parcel_id", "date"]), "head-samples")
    model = training.linear_head(samples, max_iter=200)
    totals = training.class_totals(model, samples.where(F.col("split") == "train")).where(F.col("total") > 1e-6)
    return totals.select("crop_class_id", F.round("total", 1).alias("total"))


# --- explanations --------------------------------------------------------------------------------


def trajectory_flags(spark, sf):
    flags = explain.trajectory_flags(F.col("distance_trajectory"), F.lit(FIXED.green))
    return _scores(spark, sf).select("parcel_id", F.concat_ws(",", flags).alias("flags"))


def trajectory_summary(spark, sf):
    s = explain.distance_summary(F.col("distance_trajectory"))
    return _scores(spark, sf).select("parcel_id", s.alias("s")).where(F.col("s").isNotNull()).select(
        "parcel_id", *[F.col(f"s.{c}").alias(c) for c in ("mean", "max", "min", "std", "n_points")]
    )


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    result = _result(spark, sf)
    return explain.build_payloads(result.scores, result.thresholds, SEASON)


def explain_payload(spark, sf):
    p = lambda name: F.col(f"payload.{name}").alias(name.split(".")[-1])
    joined = lambda name: F.concat_ws(",", f"payload.{name}").alias(name)
    return _payloads(spark, sf).select(
        "parcel_id", p("crop_name"), p("health_score"), p("status"), p("n_observations"),
        F.col("payload.max_deviation_date").cast("string").alias("max_deviation_date"),
        F.col("payload.distance_summary.mean").alias("mean_distance"),
        joined("trajectory_flags"), joined("data_quality_flags"),
        p("context.green_threshold"), p("context.red_threshold"), p("context.scoring_method"),
    )


def explained_scores(spark, sf):
    result = _result(spark, sf)
    scores = stage(result.scores, "scores")
    payloads = explain.build_payloads(scores, result.thresholds, SEASON)
    made = explain.explain_parcels(payloads, generated_at="2024-11-01 00:00:00")
    check = F.get_json_object("explanation_json", "$.consistency_check").alias("consistency_check")
    return explain.with_explanations(scores, made).select(
        "parcel_id", "status", "llm_status", "llm_confidence", check
    )


def upsert_explanations(spark, sf):
    row = lambda df, origin: df.select("parcel_id", "status", F.lit(origin).alias("origin"))
    fixed, adaptive = _two_scores(spark, sf)
    urgent = adaptive.where(F.col("status").isin("RED", "YELLOW"))
    return replace_by_key(row(fixed, "old"), row(urgent, "new"), ["parcel_id"])


def reuse_unchanged(spark, sf):
    keyed = lambda df: df.select("parcel_id", F.md5(F.concat_ws("|", "parcel_id", "status")).alias("payload_hash"))
    fixed, adaptive = _two_scores(spark, sf)
    reuse, todo = incremental.split_unchanged(keyed(fixed), keyed(adaptive))
    mark = lambda df, action: df.select("parcel_id", F.lit(action).alias("action"))
    return mark(reuse, "reuse").unionByName(mark(todo, "todo"))


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Generator replies of six kinds: valid, fenced, aliases, bad value, cut off, over-long."""
    kinds = [
        '{"status":"normal","summary":"fine","possible_causes":["a"],"confidence":"high","recommended_action":"none",'
        '"evidence_used":["x","y"],"consistency_check":"consistent"}',
        'Here:\n```json\n{"status":"critical","summary":"bad","confidence":"Moderate","recommended_action":"go"}\n```',
        '{"status":" YELLOW ","summary":"alias","possible_causes":[],"confidence":"very high","recommended_action":"look",'
        '"consistency_check":"not supported"}',
        '{"status":"Green","summary":"enum","confidence":"certain","recommended_action":"x"}',
        '{"status":"normal","summary":"cut off',
        '{"status":"normal","summary":"' + "s" * 501 + '","confidence":"low","recommended_action":"x"}',
    ]
    colour = F.when(F.col("toxic") == 1, "RED").when(F.col("quality") == 1, "GREEN").otherwise("YELLOW")
    reply = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 6).cast("int"))
    return views.table(spark, sf, "labels").select("doc_id", colour.alias("colour"), reply.alias("reply"))


def explanation_validate(spark, sf):
    judged = replies.with_validated(_replies(spark, sf), "reply", "colour", "e")
    return judged.select(
        "doc_id", "colour", F.col("e").isNotNull().alias("valid"), F.col("e.status").alias("status"),
        F.col("e.confidence").alias("confidence"), F.col("e.consistency_check").alias("consistency_check"),
    )


def generated_explanations(spark, sf):
    """The generator path with a stand-in text generator that fails on some first attempts."""

    def make_generator():
        import json

        def generate(messages, temperature):
            for _, user in messages:
                record = json.loads(user[user.index("{") :])
                broken = record["n_observations"] % 2 == 1 and temperature < 0.2
                yield "no json" if broken else json.dumps(
                    {"status": record["status"], "summary": "ok", "confidence": "low", "recommended_action": "look"}
                )

        return generate

    made = explain.explain_parcels(_payloads(spark, sf), make_generator, model="stand-in", profile="test", generated_at="2024-11-01 00:00:00")
    return made.select("parcel_id", "llm_status", "llm_confidence", "llm_model")


# --- streams -------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, copies: int = 1, files: int = 8) -> DataFrame:
    """The observations as files that arrive one by one, each with dates from all over the season."""
    folder = _folder(spark, "intake")
    seen = views.labelled_observations(spark, sf).select(
        "parcel_id", "crop_name", "obs_date", F.col("obs_date").cast("timestamp").alias("seen_at"), "embedding"
    )
    copied = seen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    dealt = copied.repartition(files, F.xxhash64("parcel_id", "obs_date", "copy")).drop("copy")
    dealt.write.parquet(folder)
    return intake.read_intake(spark, folder, files_per_trigger=1)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_intake(spark, sf):
    """Arrived observations once each, although every row comes twice, mostly in different batches."""
    out = _folder(spark, "arrivals")
    intake.store_arrivals(_stream(spark, sf, copies=2), out, f"{out}-progress").awaitTermination()
    return spark.read.parquet(out).select("parcel_id", text("obs_date"))


def stream_bin_counts(spark, sf):
    out = _folder(spark, "bin-counts")
    query = intake.upsert_stream(intake.bin_counts(_stream(spark, sf), SEASON), out, ["crop_name", "bin_start"], f"{out}-progress")
    query.awaitTermination()
    return spark.read.parquet(out).select("crop_name", text("bin_start"), "n_obs")


def stream_scores(spark, sf):
    """Scores built up batch by batch against frozen profiles equal the scores of one batch run."""
    out = _folder(spark, "stream-scores")
    base = Base(spark, sf)
    query = intake.score_stream(
        _stream(spark, sf), stage(base.parcels, "parcels"), base.profiles(), (FIXED.green, FIXED.red),
        f"{out}/scores", f"{out}/progress", SEASON, FIXED,
    )
    query.awaitTermination()
    return _score_columns(spark.read.parquet(f"{out}/scores"))


QUERIES = {
    "crop_status_summary": crop_status_summary,
    "season_bins": season_bin_counts,
    "crop_profiles": crop_profiles,
    "profile_coverage": profile_coverage,
    "parcel_scores_fixed": parcel_scores_fixed,
    "parcel_scores_adaptive": parcel_scores_adaptive,
    "parcel_scores_bucketed": parcel_scores_bucketed,
    "season_bins_sql": season_bins_sql,
    "effective_thresholds": effective_thresholds,
    "distance_trajectory": distance_trajectory,
    "max_deviation_date": max_deviation_date,
    "observation_weights": observation_weights,
    "status_counts_pct": status_counts_pct,
    "temporal_coverage": temporal_coverage,
    "top10_worst": top10_worst,
    "alert_list": alert_list,
    "score_histogram": score_histogram,
    "crop_kpis": crop_kpis,
    "class_balance": class_balance,
    "label_overview": label_overview,
    "inventory": inventory,
    "trajectory_colours": trajectory_colours,
    "region_selection": region_selection,
    "monitored_crops": monitored_crops,
    "campaign_rollup": campaign_rollup,
    "campaign_report": campaign_report,
    "mean_vectors": mean_vector_values,
    "unit_norms": unit_norms,
    "knn_one": knn_one,
    "knn_all": knn_all,
    "mislabel_scan": mislabel_scan,
    "knn_all_cells": knn_all_cells,
    "spatial_knn_cells": spatial_knn_cells,
    "crop_profiles_large": crop_profiles_large,
    "parcel_scores_salted": parcel_scores_salted,
    "neighbor_roles": neighbor_roles,
    "spatial_knn": spatial_knn,
    "spatial_knn_capped": spatial_knn_capped,
    "retrieval_bundle_long": retrieval_bundle_long,
    "scene_filter": scene_filter,
    "best_scene_per_date": best_scene_per_date,
    "scene_cap": scene_cap,
    "cloud_stats": cloud_stats,
    "band_resolve": band_resolve,
    "chip_plan": chip_plan,
    "chip_todo": chip_todo,
    "best_scene_per_cell": best_scene_per_cell,
    "chip_plan_covered": chip_plan_covered,
    "scene_index": scene_index,
    "chip_bounds": chip_bounds,
    "nodata_fraction": nodata_fraction,
    "chip_rgb": chip_rgb,
    "chip_outcomes": chip_outcomes,
    "resample": resample,
    "total_bounds": total_bounds,
    "polygon_area_centroid": polygon_area_centroid,
    "albers_project": albers_project,
    "utm_project": utm_project,
    "utm_project_south": utm_project_south,
    "zonal_counts": zonal_counts,
    "zonal_majority": zonal_majority,
    "label_normalize": label_normalize,
    "label_join": label_join,
    "code_lookup": code_lookup,
    "props_flatten": props_flatten,
    "time_encoding": time_encoding,
    "latlon_encoding": latlon_encoding,
    "parcel_seed": parcel_seed,
    "mock_embed": mock_embed,
    "encode_chips": encode_chips,
    "embed_todo": embed_todo,
    "class_eligibility": class_eligibility,
    "dropped_classes": dropped_classes,
    "manifest_eligible": manifest_eligible,
    "stratified_split": stratified_split,
    "augment": augment,
    "linear_head": linear_head,
    "linear_head_totals": linear_head_totals,
    "trajectory_flags": trajectory_flags,
    "trajectory_summary": trajectory_summary,
    "explain_payload": explain_payload,
    "explained_scores": explained_scores,
    "upsert_explanations": upsert_explanations,
    "reuse_unchanged": reuse_unchanged,
    "explanation_validate": explanation_validate,
    "generated_explanations": generated_explanations,
    "stream_intake": stream_intake,
    "stream_bin_counts": stream_bin_counts,
    "stream_scores": stream_scores,
    **source_queries.QUERIES,
}
