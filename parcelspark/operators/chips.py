"""Image chips: plan, windows, assembly from raster tiles, nodata filter, previews."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions.geo import chip_bounds
from parcelspark.operators.ground import shown_points
from parcelspark.operators.scenes import best_per_date, least_cloudy
from parcelspark.session import lookup_join, stage

WINDOWS_PER_CUT = 128  # windows of one list; a piece has at most a tile's pixels

PREVIEW_BANDS = ("B04", "B03", "B02")


def chip_plan(parcels: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every parcel on every scene date, where each scene shows all parcels: (parcel_id, scene_id, scene_date).

    Scenes are reduced to one per date, so their list has at most one entry per day of the season. It
    reaches the parcels as a scalar subquery and is unfolded there; no join takes place.
    """
    dates = best_per_date(scenes).agg(F.array_sort(F.collect_list(F.struct("scene_date", "scene_id")))).scalar()
    return parcels.select("parcel_id", F.explode(dates).alias("_s")).select("parcel_id", "_s.scene_id", "_s.scene_date")


def covered_plan(parcels: DataFrame, scenes: DataFrame, **cells) -> DataFrame:
    """Every parcel on every date with a scene that shows its centre: (parcel_id, scene_id, scene_date).

    The footprint of a scene decides, where there is one, else its bounding box; of several scenes of a date the least
    cloudy one is taken. Parcels without a centre, and those no scene shows, have no row.
    """
    known = [c for c in ("scene_id", "scene_date", "cloud_cover", "bbox", "footprint") if c in scenes.columns]
    # Scenes of the same place and date show the same parcels.
    place = [c for c in ("bbox", "footprint") if c in known]
    clear = least_cloudy(scenes.select(*known), *place, "scene_date")
    met = shown_points(parcels, "parcel_id", "centroid_lon", "centroid_lat", clear, least_per="scene_date", **cells)
    met = met.select("parcel_id", "scene_id", "scene_date", "cloud_cover")
    return least_cloudy(met, "parcel_id", "scene_date").select("parcel_id", "scene_id", "scene_date")


def cap_parcels(parcels: DataFrame, max_parcels: int | None) -> DataFrame:
    return parcels.orderBy("parcel_id").limit(max_parcels) if max_parcels else parcels


def zero_pixel(value: Column) -> Column:
    return value == 0


def nodata_fraction(pixels: Column, empty=zero_pixel) -> Column:
    """Share of pixels that are empty in every band; `pixels` is one array per band."""
    positions = F.sequence(F.lit(0), F.size(F.get(pixels, F.lit(0))) - 1)
    blank = F.filter(positions, lambda i: F.forall(pixels, lambda band: empty(F.get(band, i))))
    return F.size(blank) / F.size(positions)


def keep_covered(chips: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Drop chips with more nodata than the threshold."""
    return chips.where(nodata_fraction(F.col("pixels")) <= threshold)


def chip_outcome(chips: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Label planned chips: extracted, skipped_nodata, or skipped_error where pixels are missing."""
    outcome = (
        F.when(F.col("pixels").isNull(), "skipped_error")
        .when(nodata_fraction(F.col("pixels")) > threshold, "skipped_nodata")
        .otherwise("extracted")
    )
    return chips.withColumn("outcome", outcome)


def count_outcomes(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    return rows.groupBy(F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


OUTCOMES = ("extracted", "skipped_nodata", "skipped_error")


def outcome_metrics(outcome: str = "outcome") -> list[Column]:
    """The number of rows of each outcome, as aggregates to observe while the rows are written."""
    return [F.count(F.when(F.col(outcome) == name, F.lit(1))).alias(name) for name in OUTCOMES]


def observed_outcomes(spark: SparkSession, seen: Observation) -> DataFrame:
    """What `count_outcomes` gives, from the pass that wrote the rows."""
    rows = [(name, seen.get[name]) for name in OUTCOMES if seen.get[name]]
    return spark.createDataFrame(rows, "outcome string, n long")


def rgb_preview(chips: DataFrame) -> DataFrame:
    """Three bands scaled to [0, 1] for display, in the order red, green, blue."""

    def scaled(band: str, default: int) -> Column:
        index = F.array_position("bands", band)
        at = F.when(index > 0, index - 1).otherwise(F.lit(default)).cast("int")
        return F.transform(F.get("pixels", at), lambda v: F.least(F.greatest(v / 3000.0, F.lit(0.0)), F.lit(1.0)))

    red, green, blue = (scaled(b, d) for b, d in zip(PREVIEW_BANDS, (2, 1, 0)))
    return chips.select("parcel_id", "obs_date", red.alias("red"), green.alias("green"), blue.alias("blue"))


def first_chips(chips: DataFrame, parcel_id: str, n: int = 12) -> DataFrame:
    return chips.where(F.col("parcel_id") == parcel_id).orderBy("obs_date").limit(n)


def windows(
    plan: DataFrame, parcels: DataFrame, size_px: int = 224, resolution_m: float = 10.0, project=None
) -> DataFrame:
    """Chip windows in raster coordinates: the plan with west, south, east, north.

    `project` maps (lon, lat) to the raster system; without it the window stays in degrees.
    """
    b = chip_bounds(F.col("centroid_lon"), F.col("centroid_lat"), size_px, resolution_m)
    placed = parcels.select("parcel_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"), b.alias("_b"))
    placed = placed.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if project is None:
        edges = [F.col(f"_b.{side}").alias(side) for side in ("west", "south", "east", "north")]
    else:
        corners = [
            project(F.col(f"_b.{x}"), F.col(f"_b.{y}")) for x in ("west", "east") for y in ("south", "north")
        ]
        xs, ys = [c[0] for c in corners], [c[1] for c in corners]
        edges = [
            F.least(*xs).alias("west"), F.least(*ys).alias("south"),
            F.greatest(*xs).alias("east"), F.greatest(*ys).alias("north"),
        ]
    return plan.join(placed.select("parcel_id", "lat", "lon", *edges), "parcel_id")


def bilinear(canvas: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sample an image at fractional positions, where pixel centres are at n + 0.5; edges repeat."""
    height, width = canvas.shape
    y, x = np.clip(rows - 0.5, 0, height - 1), np.clip(cols - 0.5, 0, width - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = canvas[np.ix_(y0, x0)] * (1 - fx) + canvas[np.ix_(y0, x1)] * fx
    low = canvas[np.ix_(y1, x0)] * (1 - fx) + canvas[np.ix_(y1, x1)] * fx
    return top * (1 - fy) + low * fy


EDGES = ("west", "south", "east", "north")


def wanted_tiles(
    windowed: DataFrame, bands: list[str], band_res: dict[str, float], tile_px: int, per_cut: int
) -> DataFrame:
    """(scene_id, band, res, tx, ty, salt, windows): the windows that want a tile, in lists of about `per_cut`.

    Tiles that more windows want have several salts, by their measured number, so a tile that nearly all windows
    want is spread over as many tasks as its windows fill lists.
    """
    wanted = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(band_res[b])).alias("res")) for b in bands])
    side, margin = F.col("res") * tile_px, F.col("res")
    span = lambda low, high: F.sequence(
        F.floor((low - margin) / side).cast("int"), F.floor((high + margin) / side).cast("int")
    )
    requests = (
        windowed.select("parcel_id", "scene_id", *EDGES, F.inline(wanted))
        .withColumn("tx", F.explode(span(F.col("west"), F.col("east"))))
        .withColumn("ty", F.explode(span(F.col("south"), F.col("north"))))
    )
    tile = ["scene_id", "band", "tx", "ty"]
    crowded = requests.groupBy(*tile).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_cut)
    crowded = stage(crowded.select(*tile, F.ceil(F.col("_n") / per_cut).cast("int").alias("_salts")), "crowded-tiles")
    salted = lookup_join(requests, crowded, tile, 128 * crowded.count(), ["parcel_id", *EDGES])
    salt = F.pmod(F.xxhash64("parcel_id", *EDGES), F.coalesce("_salts", F.lit(1))).cast("int")
    return salted.groupBy(*tile, "res", salt.alias("salt")).agg(
        F.collect_list(F.struct("parcel_id", *EDGES)).alias("windows")
    )


def cut_pieces(pixels: np.ndarray, west, south, east, north, res: float, tx: int, ty: int, tile_px: int):
    """Cut all windows (arrays of edges) out of one tile at once: (window, row0, col0, height, width, values in a row)."""
    x0, y0 = tx * tile_px, -(ty + 1) * tile_px
    c0 = np.maximum(np.floor(west / res).astype(np.int64) - 1, x0)
    c1 = np.minimum(np.ceil(east / res).astype(np.int64) + 1, x0 + tile_px)
    r0 = np.maximum(np.floor(-north / res).astype(np.int64) - 1, y0)
    r1 = np.minimum(np.ceil(-south / res).astype(np.int64) + 1, y0 + tile_px)
    met = np.flatnonzero((c0 < c1) & (r0 < r1))
    r0, c0, height, width = r0[met], c0[met], (r1 - r0)[met], (c1 - c0)[met]
    size = height * width
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(width, size)
    row, col = np.repeat(r0 - y0, size) + at // wide, np.repeat(c0 - x0, size) + at % wide
    return met, r0, c0, height, width, pixels[row * tile_px + col]


def tile_jobs(
    windowed: DataFrame, tiles: DataFrame, bands: list[str], band_res: dict[str, float], tile_px: int, per_cut: int
) -> DataFrame:
    """A row for each wanted tile and list of windows: the unit of work, and the only place where tiles travel."""
    tile = ["scene_id", "band", "tx", "ty"]
    wanted = stage(wanted_tiles(windowed, bands, band_res, tile_px, per_cut), "tile-windows")
    salts = wanted.groupBy(*tile).agg(F.max("salt").alias("_last"))
    asked = lookup_join(
        tiles.select(*tile, "pixels"), salts, tile, 128 * salts.count(), ["tx", "ty"], how="inner"
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    return wanted.join(asked.drop("_last"), [*tile, "salt"]).select(*tile, "res", "windows", "pixels")


def cut_tiles(jobs: DataFrame, tile_px: int) -> DataFrame:
    """One row per window and tile it meets: the pixels of the tile inside the window, and their place."""
    types = {f.name: f.dataType.simpleString() for f in jobs.schema["windows"].dataType.elementType} | dict(jobs.dtypes)
    schema = (
        f"parcel_id {types['parcel_id']}, scene_id {types['scene_id']}, band string, res double, west double, "
        "south double, east double, north double, row0 long, col0 long, height int, width int, part array<int>"
    )

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                head = {c: batch.column(c)[i] for c in ("scene_id", "band", "res")}
                asked = batch.column("windows")[i].values
                edges = [asked.field(e).to_numpy(zero_copy_only=False).astype(float) for e in EDGES]
                pixels = batch.column("pixels")[i].values.to_numpy(zero_copy_only=False)
                tx, ty = batch.column("tx")[i].as_py(), batch.column("ty")[i].as_py()
                met, row0, col0, height, width, values = cut_pieces(pixels, *edges, head["res"].as_py(), tx, ty, tile_px)
                if not len(met):
                    continue
                starts = np.concatenate([[0], np.cumsum(height * width)]).astype(np.int32)
                columns = {
                    "parcel_id": asked.field("parcel_id").take(pa.array(met)),
                    **{c: pa.repeat(v, len(met)) for c, v in head.items()},
                    **{e: pa.array(v[met]) for e, v in zip(EDGES, edges, strict=True)},
                    "row0": pa.array(row0),
                    "col0": pa.array(col0),
                    "height": pa.array(height.astype(np.int32)),
                    "width": pa.array(width.astype(np.int32)),
                    "part": pa.ListArray.from_arrays(pa.array(starts), pa.array(values.astype(np.int32))),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return jobs.mapInArrow(cut, schema)


def extract_chips(
    windowed: DataFrame,
    tiles: DataFrame,
    bands: list[str],
    band_res: dict[str, float],
    tile_px: int = 256,
    size_px: int = 224,
    gsd: float = 10.0,
    per_cut: int = WINDOWS_PER_CUT,
) -> DataFrame:
    """Cut chips out of raster tiles and resample them to `size_px` by bilinear interpolation.

    `tiles` has (scene_id, band, tx, ty, pixels): square tiles of `tile_px` pixels, row by row from
    the north, where tile (tx, ty) spans [tx, tx+1) x [ty, ty+1) in units of tile_px * res. A tile is read
    once for all windows that want it, and only the pieces cut out of it are shuffled. A chip with a
    band that no tile covers has null pixels.
    """
    types = dict(windowed.dtypes)
    pieces = cut_tiles(tile_jobs(windowed, tiles, bands, band_res, tile_px, per_cut), tile_px)

    def frame(r) -> tuple[float, float, float, float]:
        """Window edges in global pixel units; rows count southwards."""
        return r.west / r.res, r.east / r.res, -r.north / r.res, -r.south / r.res

    def assemble(batches):
        centres = (np.arange(size_px) + 0.5) / size_px
        for batch in batches:
            values = []
            for r in batch.itertuples(index=False):
                left, right, top, bottom = frame(r)
                row0, col0 = min(p["row0"] for p in r.parts), min(p["col0"] for p in r.parts)
                canvas = np.zeros(
                    (
                        max(p["row0"] + p["height"] for p in r.parts) - row0,
                        max(p["col0"] + p["width"] for p in r.parts) - col0,
                    )
                )
                for p in r.parts:
                    y, x = p["row0"] - row0, p["col0"] - col0
                    canvas[y : y + p["height"], x : x + p["width"]] = np.asarray(p["part"]).reshape(p["height"], p["width"])
                rows, cols = top + centres * (bottom - top) - row0, left + centres * (right - left) - col0
                values.append(np.rint(bilinear(canvas, rows, cols)).astype(int).ravel())
            yield pd.DataFrame(
                {"parcel_id": batch["parcel_id"], "scene_id": batch["scene_id"], "band": batch["band"], "values": values}
            )

    layer_schema = (
        f"parcel_id {types['parcel_id']}, scene_id {types['scene_id']}, band string, values array<int>"
    )
    # A group is one band of one chip: the few tiles its window meets.
    window_keys = ["parcel_id", "scene_id", "band", "res", "west", "south", "east", "north"]
    parts = F.collect_list(F.struct("row0", "col0", "height", "width", "part")).alias("parts")
    layers = pieces.groupBy(*window_keys).agg(parts).mapInPandas(assemble, layer_schema)
    order = F.array(*[F.lit(b) for b in bands])
    stacked = layers.groupBy("parcel_id", "scene_id").agg(
        F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("band")).alias("i"), "values"))).alias("_l")
    )
    complete = F.when(F.size("_l") == len(bands), F.transform("_l", lambda e: e["values"]))
    return windowed.select("parcel_id", "scene_id", "scene_date", "lat", "lon").join(
        stacked.select("parcel_id", "scene_id", complete.alias("pixels")), ["parcel_id", "scene_id"], "left"
    ).select(
        "parcel_id", F.col("scene_date").alias("obs_date"), "scene_id", "lat", "lon", F.lit(gsd).alias("gsd"),
        order.alias("bands"), "pixels", F.lit(size_px).alias("height"), F.lit(size_px).alias("width"),
    )
