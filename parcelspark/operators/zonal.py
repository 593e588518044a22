"""Zonal majority: the land-cover class covering most cells a parcel touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.geo import edges, polygon_bounds, project_rings, touched_runs
from parcelspark.functions.labels import name_codes
from parcelspark.session import lookup_join, spread_rows, stage
from parcelspark.sources.raster import BLOCK, ROW_BYTES, Raster, packed

NEW, CUT, INSIDE, OUTSIDE = -1, 0, 1, 2  # how a square lies to a polygon
CROWDED = 20_000  # parcels of one block that are met apart from the others


def _met(e: Column, low_x: Column, low_y: Column, side: Column) -> Column:
    """Whether an edge may pass through a closed square; errs on the side of yes by far less than a cell."""
    eps = F.lit(1e-6)
    x0, y0, x1, y1 = low_x - eps, low_y - eps, low_x + side + eps, low_y + side + eps
    overlap = (
        (F.greatest(e["x0"], e["x1"]) >= x0) & (F.least(e["x0"], e["x1"]) <= x1)
        & (F.greatest(e["y0"], e["y1"]) >= y0) & (F.least(e["y0"], e["y1"]) <= y1)
    )
    dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
    away = [dx * (y - e["y0"]) - dy * (x - e["x0"]) for x in (x0, x1) for y in (y0, y1)]
    slack = F.lit(1e-9) * (F.abs(dx) + F.abs(dy) + 1) * (side + 1)
    apart = (F.least(*away) > slack) | (F.greatest(*away) < -slack)
    return overlap & ~apart


def _holds(all_edges: Column, x: Column, y: Column) -> Column:
    """Whether a point that no edge passes lies in the polygon, by the parity of the edges to its left."""
    left = F.filter(
        all_edges,
        lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"]) < x),
    )
    return F.size(left) % 2 == 1


def cover(parcels: DataFrame, key: str, block: int, levels: int) -> DataFrame:
    """(key, edges, level, node_x, node_y, whole): squares of blocks that cover a polygon.

    `whole` squares lie inside the polygon and are as large as possible; all others are single blocks that an edge
    meets. Squares are split level by level, from the level at which a polygon spans at most a few of them.
    """
    shapes = spread_rows(parcels.where(F.size("rings") > 0).select(key, "rings"), key)
    shapes = shapes.select(key, F.flatten(F.transform("rings", edges)).alias("edges"), polygon_bounds(F.col("rings")).alias("_b"))
    shapes = shapes.where(F.col("_b.min_lon").isNotNull() & F.col("_b.min_lat").isNotNull())
    span = F.greatest(F.col("_b.max_lon") - F.col("_b.min_lon"), F.col("_b.max_lat") - F.col("_b.min_lat")) / block
    top = F.least(F.greatest(F.floor(F.log2(F.greatest(span, F.lit(1.0)))), F.lit(0)), F.lit(levels)).cast("int")
    side = F.pow(F.lit(2.0), F.col("level")) * block
    first = lambda c: F.floor(F.col(f"_b.min_{c}") / side).cast("long")
    last = lambda c: F.greatest(F.ceil(F.col(f"_b.max_{c}") / side) - 1, F.floor(F.col(f"_b.min_{c}") / side)).cast("long")
    nodes = (
        shapes.select(key, "edges", "_b", top.alias("level"))
        .withColumn("node_x", F.explode(F.sequence(first("lon"), last("lon"))))
        .withColumn("node_y", F.explode(F.sequence(first("lat"), last("lat"))))
        .select(key, "edges", "level", "node_x", "node_y", F.lit(NEW).alias("_state"))
    )

    def judged(nodes: DataFrame) -> DataFrame:
        """New squares are cut by an edge, inside, or outside; those outside go."""
        low_x, low_y = F.col("node_x") * side, F.col("node_y") * side
        cut = F.exists("edges", lambda e: _met(e, low_x, low_y, side))
        inside = _holds(F.col("edges"), low_x + side / 2, low_y + side / 2)
        fresh = F.when(cut, F.lit(CUT)).when(inside, F.lit(INSIDE)).otherwise(F.lit(OUTSIDE))
        state = F.when(F.col("_state") == NEW, fresh).otherwise(F.col("_state"))
        return nodes.withColumn("_state", state).where(F.col("_state") != OUTSIDE)

    nodes = judged(nodes)
    same = F.struct("level", "node_x", "node_y", "_state")
    for level in range(levels, 0, -1):
        quarter = lambda i, j: F.struct(
            (F.col("level") - 1).alias("level"), (F.col("node_x") * 2 + i).alias("node_x"),
            (F.col("node_y") * 2 + j).alias("node_y"), F.lit(NEW).alias("_state"),
        )
        split = (F.col("level") == level) & (F.col("_state") == CUT)
        parts = F.when(split, F.array(*[quarter(i, j) for i in (0, 1) for j in (0, 1)])).otherwise(F.array(same))
        nodes = judged(nodes.select(key, "edges", F.inline(parts)))
    return nodes.withColumn("whole", F.col("_state") == INSIDE).drop("_state")


def edge_cells(covered: DataFrame, key: str, block: int) -> DataFrame:
    """(key, block_x, block_y, cells): the places inside each met block of the unit cells the polygon touches."""
    x0, y0 = F.col("node_x") * block, F.col("node_y") * block

    def in_row(i: Column) -> Column:
        runs = touched_runs(F.col("edges"), y0 + i)
        near = F.filter(runs, lambda r: (r["low"] < x0 + block) & (r["high"] >= x0))
        cells = F.transform(
            near, lambda r: F.sequence(F.greatest(r["low"], x0) - x0, F.least(r["high"], x0 + block - 1) - x0)
        )
        return F.transform(F.array_distinct(F.flatten(cells)), lambda x: (i * block + x).cast("int"))

    rows = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), in_row)
    met = covered.where(~F.col("whole")).select(
        key, F.col("node_x").alias("block_x"), F.col("node_y").alias("block_y"), F.flatten(rows).alias("cells")
    )
    return met.where(F.size("cells") > 0)


def touched_cells(parcels: DataFrame, key: str = "parcel_id", block: int = BLOCK, levels: int = 4) -> DataFrame:
    """(key, x, y) of every unit cell a polygon in pixel units overlaps, one row a cell."""
    covered = cover(parcels, key, block, levels)
    met = edge_cells(covered, key, block).select(key, "block_x", "block_y", F.explode("cells").alias("i"))
    x, y = F.col("block_x") * block + F.col("i") % block, F.col("block_y") * block + F.floor(F.col("i") / block)
    met = met.select(key, x.cast("long").alias("x"), y.cast("long").alias("y"))
    side = F.expr(f"shiftleft({block}L, level)")
    span = lambda c: F.explode(F.sequence(F.col(c) * side, F.col(c) * side + side - 1))
    whole = covered.where("whole").select(key, "node_y", side.alias("_side"), span("node_x").alias("x"))
    down = F.explode(F.sequence(F.col("node_y") * F.col("_side"), F.col("node_y") * F.col("_side") + F.col("_side") - 1))
    return met.unionByName(whole.select(key, "x", down.alias("y")))


def zonal_counts(parcels: DataFrame, raster: Raster | DataFrame, key: str = "parcel_id") -> DataFrame:
    """Touched cells per parcel and class: (key, code, n).

    Squares inside a parcel are counted from the raster's class counts, and only blocks that an edge meets are opened. A
    raster given as single pixels (x, y, code) is packed first, as far as the parcels reach, without a pyramid: store it
    (`write_raster`) where it is used again.
    """
    if isinstance(raster, DataFrame):
        raster = packed(_within(parcels, raster))
    covered = stage(cover(parcels, key, raster.block, raster.levels), "zonal-cover")
    nodes = covered.where("whole").select(key, "level", "node_x", "node_y")
    whole = nodes.join(raster.pyramid, ["level", "node_x", "node_y"]).select(key, F.inline("classes"))

    met = edge_cells(covered, key, raster.block)
    place = ["block_x", "block_y"]
    blocks = raster.blocks.select(*place, "codes")
    crowded = covered.where(~F.col("whole")).groupBy(F.col("node_x").alias("block_x"), F.col("node_y").alias("block_y"))
    crowded = crowded.count().where(F.col("count") > CROWDED).select(*place)
    hot = crowded.count()
    opened = []
    if hot:
        # Blocks that very many parcels meet: few, so they travel to the parcels.
        crowded = stage(crowded, "crowded-blocks")
        few = blocks.join(F.broadcast(crowded), place) if hot * ROW_BYTES < 1 << 27 else blocks.join(crowded, place)
        size = hot * (4 * raster.block**2 + ROW_BYTES)
        opened.append(lookup_join(met, few, place, size, [key], how="inner"))
        met = lookup_join(met.withColumn("_k", F.col(key)), crowded.withColumn("_hot", F.lit(1)), place, hot * ROW_BYTES, ["_k"])
        met = met.where(F.col("_hot").isNull()).drop("_hot", "_k")
    opened.append(met.join(blocks, place))
    for found in opened:
        codes = F.transform("cells", lambda i: F.get(F.col("codes"), i))
        found = found.select(key, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
        whole = whole.unionByName(found.select(key, "code", F.lit(1).cast("long").alias("n")))
    return whole.groupBy(key, "code").agg(F.sum("n").alias("n"))


def _within(parcels: DataFrame, pixels: DataFrame) -> DataFrame:
    """The pixels in the extent of the parcels."""
    box = parcels.select(polygon_bounds(F.col("rings")).alias("b")).agg(
        F.floor(F.min("b.min_lon")).alias("west"), F.floor(F.min("b.min_lat")).alias("south"),
        F.ceil(F.max("b.max_lon")).alias("east"), F.ceil(F.max("b.max_lat")).alias("north"),
    ).first()
    if box["west"] is None:
        return pixels.limit(0)
    return pixels.where(F.col("x").between(box["west"], box["east"]) & F.col("y").between(box["south"], box["north"]))


def zonal_majority(parcels: DataFrame, raster: Raster | DataFrame, key: str = "parcel_id") -> DataFrame:
    """(key, crop_code): the most frequent class, ties to the smallest code, null without any cell."""
    major = zonal_counts(parcels, raster, key).groupBy(key).agg(
        F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("crop_code")
    )
    return parcels.select(key).join(major, key, "left")


def label_from_raster(parcels: DataFrame, pixels: Raster | DataFrame, project=None) -> DataFrame:
    """Replace the labels of parcels by their zonal majority.

    `project` maps (lon, lat) to raster columns and rows, for instance Albers metres scaled to the grid.
    """
    plain = parcels.drop("crop_code", "crop_name")
    shapes = plain if project is None else plain.withColumn("rings", project_rings(F.col("rings"), project))
    codes = zonal_majority(shapes.select("parcel_id", "rings"), pixels)
    return name_codes(plain.join(codes, "parcel_id", "left"))
