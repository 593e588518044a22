"""Scene catalogue: predicates, asset choice, best scene per date or per ground cell and date, caps, coverage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.ground import CELL_DEG, boxes, ground_cell

# Catalogue asset names of the spectral bands.
BAND_ALIASES = {
    "B02": "blue",
    "B03": "green",
    "B04": "red",
    "B05": "rededge1",
    "B06": "rededge2",
    "B07": "rededge3",
    "B08": "nir",
    "B8A": "nir08",
    "B09": "nir09",
    "B11": "swir16",
    "B12": "swir22",
}
DEFAULT_BANDS = ["B02", "B03", "B04", "B08", "B05", "B06", "B07", "B8A", "B11", "B12"]


def filter_scenes(
    scenes: DataFrame,
    start: str,
    end: str,
    max_cloud: float = 20,
    collection: str | None = None,
    bbox: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Scenes of a collection inside a date range, below a cloud limit and meeting a bounding box."""
    kept = scenes.where(F.col("scene_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    kept = kept.where(F.col("cloud_cover") < max_cloud)
    if collection is not None:
        kept = kept.where(F.col("collection") == collection)
    if bbox is not None:
        west, south, east, north = bbox
        kept = kept.where(
            F.exists(
                boxes(F.col("bbox")),
                lambda b: (b["west"] <= east) & (b["east"] >= west) & (b["south"] <= north) & (b["north"] >= south),
            )
        )
    return kept


def resolve_bands(scenes: DataFrame, bands: list[str] = DEFAULT_BANDS) -> DataFrame:
    """Replace `assets` by `asset_urls` (band to address), trying the band name and then its alias.

    Scenes without any matching band are dropped.
    """
    assets = F.col("assets")
    address = lambda b: F.coalesce(
        F.nullif(F.try_element_at(assets, F.lit(b)), F.lit("")), F.try_element_at(assets, F.lit(BAND_ALIASES.get(b, "")))
    )
    entries = F.array(*[F.struct(F.lit(b).alias("band"), address(b).alias("url")) for b in bands])
    found = F.filter(entries, lambda e: e["url"].isNotNull())
    return scenes.withColumn("asset_urls", F.map_from_entries(found)).where(F.size("asset_urls") > 0).drop("assets")


def least_cloudy(scenes: DataFrame, *keys: str) -> DataFrame:
    """The least cloudy scene of every group; ties take the smaller id. Combined on the map side."""
    whole = F.struct(*scenes.columns)
    missing_last = F.coalesce(F.col("cloud_cover"), F.lit(float("inf")))
    best = scenes.groupBy(*keys).agg(F.min_by(whole, F.struct(missing_last, "scene_id")).alias("_best"))
    return best.select("_best.*")


def best_per_date(scenes: DataFrame) -> DataFrame:
    """The least cloudy scene of every date, where one scene shows the whole extent."""
    return least_cloudy(scenes, "scene_date")


def over_cells(scenes: DataFrame, cell_deg: float = CELL_DEG) -> DataFrame:
    """Each scene once for every ground cell (cell_x, cell_y) that its bounding box touches."""
    b = F.col("_box")
    (west, south), (east, north) = ground_cell(b["west"], b["south"], cell_deg), ground_cell(b["east"], b["north"], cell_deg)
    wide = scenes.withColumn("_box", F.explode(boxes(F.col("bbox"))))
    wide = wide.withColumn("cell_x", F.explode(F.sequence(west, east)))
    return wide.withColumn("cell_y", F.explode(F.sequence(south, north))).drop("_box")


def best_per_cell(scenes: DataFrame, cell_deg: float = CELL_DEG) -> DataFrame:
    """The least cloudy scene of every ground cell and date."""
    return least_cloudy(over_cells(scenes, cell_deg), "cell_x", "cell_y", "scene_date")


def cap_scenes(scenes: DataFrame, max_scenes: int | None) -> DataFrame:
    """Keep the earliest dates; late dates are what a cap drops."""
    ordered = scenes.orderBy("scene_date", "scene_id")
    return ordered.limit(max_scenes) if max_scenes else ordered


def question(bands: list[str] | None = None, **predicates) -> str:
    """What a search asked for besides its dates, as a text that can be stored and compared."""
    return json.dumps({"bands": sorted(bands or []), **predicates}, sort_keys=True, default=list)


def scene_index(
    scenes: DataFrame, start: str, end: str, max_scenes: int | None = None, bands: list[str] | None = None, **predicates
) -> DataFrame:
    """All scenes found where footprints tell what they show, else one per date; range and question are kept.

    `max_scenes` keeps the earliest ones, and only if it is given.
    """
    found = filter_scenes(scenes, start, end, **predicates)
    if "bbox" not in scenes.columns:
        found = best_per_date(found)
    return cap_scenes(found, max_scenes).select(
        "*",
        F.lit(start).cast("date").alias("queried_from"),
        F.lit(end).cast("date").alias("queried_to"),
        F.lit(question(bands, **predicates)).alias("queried_for"),
    )


def covers(index: DataFrame, start: str, end: str, asked: str | None = None) -> bool:
    """Whether a stored index answers a range, by its queried range, else by its first and last date.

    With `asked` (see `question`) it must also be the answer to the same question.
    """
    first, last = ("queried_from", "queried_to") if "queried_from" in index.columns else ("scene_date", "scene_date")
    wanted = [F.min(first).cast("string").alias("lo"), F.max(last).cast("string").alias("hi")]
    if asked is not None:
        if "queried_for" not in index.columns:
            return False
        wanted += [F.min("queried_for").alias("least"), F.max("queried_for").alias("most")]
    span = index.agg(*wanted).first()
    if span["lo"] is None or span["lo"] > start or span["hi"] < end:
        return False
    return asked is None or span["least"] == span["most"] == asked


def cloud_stats(scenes: DataFrame) -> DataFrame:
    return scenes.agg(
        F.count(F.lit(1)).alias("n_scenes"),
        F.countDistinct("scene_date").alias("n_dates"),
        F.avg("cloud_cover").alias("avg_cloud"),
    )
