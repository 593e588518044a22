"""Points and footprints on the ground, joined by cells that are split where it is crowded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.geo import edges
from parcelspark.session import lookup_join, parallelism, stage

CELL_DEG = 0.5  # cells of level 0
FINEST = 10  # halvings of a cell at most: about 50 m


def boxes(bbox: Column) -> Column:
    """The boxes (west, south, east, north) of a bounding box; one across the antimeridian makes two."""
    box = lambda west, east: F.struct(west.alias("west"), bbox[1].alias("south"), east.alias("east"), bbox[3].alias("north"))
    halves = F.array(box(bbox[0], F.lit(180.0)), box(F.lit(-180.0), bbox[2]))
    return F.when(bbox[0] > bbox[2], halves).otherwise(F.array(box(bbox[0], bbox[2])))


def in_box(bbox: Column, lon: Column, lat: Column) -> Column:
    return F.exists(boxes(bbox), lambda b: lon.between(b["west"], b["east"]) & lat.between(b["south"], b["north"]))


def in_polygon(all_edges: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies in a polygon or on its border, by the parity of the edges on one side."""

    def cross(e: Column) -> Column:
        return (e["x1"] - e["x0"]) * (lat - e["y0"]) - (e["y1"] - e["y0"]) * (lon - e["x0"])

    border = F.exists(
        all_edges,
        lambda e: (cross(e) == 0)
        & lon.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"]))
        & lat.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"])),
    )
    right = F.filter(
        all_edges, lambda e: ((e["y0"] > lat) != (e["y1"] > lat)) & (F.signum(cross(e)) == F.signum(e["y1"] - e["y0"]))
    )
    return border | (F.size(right) % 2 == 1)


def edge_in_box(all_edges: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether an edge of a polygon may meet a box, which is taken a little larger."""
    eps = F.lit(1e-9)

    def met(e: Column) -> Column:
        overlap = (
            (F.greatest(e["x0"], e["x1"]) >= west - eps) & (F.least(e["x0"], e["x1"]) <= east + eps)
            & (F.greatest(e["y0"], e["y1"]) >= south - eps) & (F.least(e["y0"], e["y1"]) <= north + eps)
        )
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        away = [dx * (y - e["y0"]) - dy * (x - e["x0"]) for x in (west, east) for y in (south, north)]
        apart = (F.least(*away) > eps) | (F.greatest(*away) < -eps)
        return overlap & ~apart

    return F.exists(all_edges, met)


def meets_box(all_edges: Column, *box: Column) -> Column:
    """Whether a polygon may have a point in a box (west, south, east, north): an edge meets it, or it holds its centre.

    Boxes are taken a little larger, so what is left out lies apart for certain.
    """
    west, south, east, north = box
    return edge_in_box(all_edges, *box) | in_polygon(all_edges, (west + east) / 2, (south + north) / 2)


def covers_box(all_edges: Column, *box: Column) -> Column:
    """Whether a polygon holds every point of a box for certain: no edge comes near it, and it holds its centre."""
    west, south, east, north = box
    return ~edge_in_box(all_edges, *box) & in_polygon(all_edges, (west + east) / 2, (south + north) / 2)


def undominated(covered: DataFrame, cell_deg: float, per: str) -> DataFrame:
    """Scenes in cells without those that cannot be the least cloudy one of any point there on any value of `per`.

    Where a scene covers a whole cell, all cloudier ones of the same value (ties: larger ids) are out of the question.
    """
    covered = stage(covered, "covered-cells")
    b, shape = F.col("_box"), F.col("_edges")
    side = F.lit(cell_deg) / F.pow(F.lit(2.0), F.col("level"))
    west, south = F.col("cx") * side, F.col("cy") * side
    box = (west, south, west + side, south + side)
    eps = F.lit(1e-9)
    boxed = (b["west"] <= west - eps) & (b["east"] >= box[2] + eps) & (b["south"] <= south - eps) & (b["north"] >= box[3] + eps)
    whole = boxed & (shape.isNull() | covers_box(shape, *box))
    order = F.struct(F.coalesce("cloud_cover", F.lit(float("inf"))).alias("cloud"), "scene_id")
    cell = ["level", "cx", "cy", "_per"]
    covered = covered.withColumn("_per", F.struct(per))  # null values meet inside a struct
    least = stage(covered.where(whole).groupBy(*cell).agg(F.min(order).alias("_least")), "least-cloudy")
    known = lookup_join(covered, least, cell, 160 * least.count(), ["scene_id"])
    return known.where(F.col("_least").isNull() | (order <= F.col("_least"))).drop("_per", "_least")


def ground_cell(lon: Column, lat: Column, cell_deg: float) -> tuple[Column, Column]:
    return F.floor(lon / cell_deg).cast("int"), F.floor(lat / cell_deg).cast("int")


def crowded_cells(points: DataFrame, cell_deg: float, crowd: int, finest: int) -> tuple[DataFrame, DataFrame]:
    """(crowded, leaves) of points with _fx, _fy, their cells of the finest level.

    crowded: level, cx, cy, n - cells of more than `crowd` points. leaves: _fx, _fy, level, cx, cy, salts - the cell
    each finest cell's points belong to: the largest one that is not crowded. A finest cell can be crowded itself; then
    its points are dealt to several salts.
    """
    counts = stage(points.groupBy("_fx", "_fy").agg(F.count(F.lit(1)).alias("n")), "ground-counts")
    shifted = lambda c: F.expr(f"shiftright({c}, {finest} - level)")
    levels = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(finest))))
    placed = levels.select("_fx", "_fy", "level", shifted("_fx").alias("cx"), shifted("_fy").alias("cy"), "n")
    crowded = placed.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n")).where(F.col("n") > crowd)
    crowded = stage(crowded, "crowded-cells")
    # A cell's crowded ancestors are its first levels, so their number is the level it belongs to.
    known = lookup_join(
        placed.drop("n"), crowded, ["level", "cx", "cy"], 64 * crowded.count(), ["_fx", "_fy"]
    )
    depth = known.groupBy("_fx", "_fy").agg(F.count("n").alias("_depth"), F.max_by("n", "level").alias("_most"))
    level = F.least("_depth", F.lit(finest)).cast("int")
    leaves = depth.select(
        "_fx", "_fy", level.alias("level"),
        F.when(F.col("_depth") > finest, F.ceil(F.col("_most") / crowd)).otherwise(F.lit(1)).cast("int").alias("salts"),
    )
    leaves = leaves.select("*", shifted("_fx").alias("cx"), shifted("_fy").alias("cy"))
    return crowded, stage(leaves, "ground-leaves")


def shown_points(
    points: DataFrame, key: str, lon: str, lat: str, scenes: DataFrame,
    cell_deg: float = CELL_DEG, crowd: int | None = None, finest: int = FINEST, least_per: str | None = None,
) -> DataFrame:
    """The columns of `scenes` and `key` for every point a scene shows: by its `footprint` rings, else its `bbox`.

    Both sides meet by equality on a cell. Cells are split in four as long as they hold more than `crowd` points (by
    default a small share of what a task gets), so a region with most points makes many cells and no task gets
    them all; a scene is copied only to the cells that its footprint meets. Points without coordinates meet nothing.

    With `least_per` only the least cloudy scene of every point and value of that column has to come: others are left out
    where a whole cell shows that they are not (without their footprints and boxes), so that a cell keeps few
    scenes of a value however many there are.
    """
    spark = points.sparkSession
    size = cell_deg / 2**finest
    fine = lambda c: F.floor(F.col(c) / size).cast("long")
    placed = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(
        key, F.col(lon).alias("_lon"), F.col(lat).alias("_lat"), fine(lon).alias("_fx"), fine(lat).alias("_fy")
    )
    if crowd is None:
        crowd = max(1, placed.count() // (16 * parallelism(spark)))
    crowded, leaves = crowded_cells(placed, cell_deg, crowd, finest)
    salt = F.pmod(F.xxhash64(key, "_lon", "_lat"), F.col("salts")).cast("int")
    dealt = lookup_join(placed, leaves, ["_fx", "_fy"], 64 * leaves.count(), [key, "_lon", "_lat"], how="inner")
    dealt = dealt.select(key, "_lon", "_lat", "level", "cx", "cy", salt.alias("salt"))

    if "footprint" in scenes.columns:
        rings = F.when(F.col("footprint").isNotNull(), F.flatten(F.transform("footprint", edges)))
    else:
        rings = F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    columns = [c for c in scenes.columns if least_per is None or c not in ("bbox", "footprint")]
    shape = F.col("_edges")
    covered = scenes.withColumn("_edges", rings).withColumn("_box", F.explode(boxes(F.col("bbox"))))
    first, last = lambda c: F.floor(F.col(c) / cell_deg).cast("long"), lambda c: F.floor(F.col(c) / cell_deg).cast("long")
    covered = covered.withColumn("cx", F.explode(F.sequence(first("_box.west"), last("_box.east"))))
    covered = covered.withColumn("cy", F.explode(F.sequence(first("_box.south"), last("_box.north"))))
    covered = covered.withColumn("level", F.lit(0)).select(*columns, "_edges", "_box", "level", "cx", "cy")

    deepest = crowded.agg(F.max("level")).first()[0]
    levels = range(0, min(finest, -1 if deepest is None else deepest + 1))
    for level in levels:
        split_here = crowded.where(F.col("level") == level).select("cx", "cy", F.lit(True).alias("_split"))
        met = lookup_join(
            covered, split_here.withColumn("level", F.lit(level)), ["level", "cx", "cy"], 64 * split_here.count(), ["scene_id"]
        )
        child = lambda i, j: F.struct(
            F.lit(level + 1).alias("level"), (F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy"), F.lit(True).alias("_new")
        )
        same = F.struct("level", "cx", "cy", F.lit(False).alias("_new"))
        parts = F.when(F.col("_split"), F.array(*[child(i, j) for i in (0, 1) for j in (0, 1)])).otherwise(F.array(same))
        covered = met.select(*columns, "_edges", "_box", F.inline(parts))
        side = F.lit(cell_deg / 2 ** (level + 1))
        west, south = F.col("cx") * side, F.col("cy") * side
        on_box = (
            (F.col("_box.west") <= west + side + 1e-9) & (F.col("_box.east") >= west - 1e-9)
            & (F.col("_box.south") <= south + side + 1e-9) & (F.col("_box.north") >= south - 1e-9)
        )
        on_shape = shape.isNull() | meets_box(shape, west, south, west + side, south + side)
        covered = covered.where(~F.col("_new") | (on_box & on_shape))
        covered = covered.drop("_new")
        if least_per is not None and level % 3 == 1 and level + 1 < len(levels):  # each time the scenes' copies are written; levels between add few
            covered = undominated(covered, cell_deg, least_per)
    if least_per is not None:
        covered = undominated(covered, cell_deg, least_per)

    cells = leaves.select("level", "cx", "cy", "salts").distinct()
    wide = lookup_join(covered, cells, ["level", "cx", "cy"], 64 * leaves.count(), ["scene_id"], how="inner")
    wide = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    wide = wide.select(*columns, "_edges", "_box", "level", "cx", "cy", "salt")
    lon_, lat_ = F.col("_lon"), F.col("_lat")
    b = F.col("_box")
    boxed = lon_.between(b["west"], b["east"]) & lat_.between(b["south"], b["north"])
    inside = boxed & (shape.isNull() | in_polygon(shape, lon_, lat_))
    return dealt.join(wide, ["level", "cx", "cy", "salt"]).where(inside).select(key, *columns)
