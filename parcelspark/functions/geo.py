"""Geometry on nested arrays: polygons, distances, chip windows, map projections.

A polygon is `array<array<struct<lon,lat>>>`: rings of vertices, the first ring being the shell.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import atanh, radians, sin, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.expressions import let

# Mean Earth radius and metres per degree used for chip windows.
EARTH_RADIUS_KM = 6371.0
METRES_PER_DEGREE = 111_320.0

RINGS_TYPE = "array<array<struct<lon:double,lat:double>>>"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return EARTH_RADIUS_KM * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def chip_bounds(lon: Column, lat: Column, size_px: int = 224, resolution_m: float = 10.0) -> Column:
    """Window of a chip centred on a point, in degrees."""
    half = size_px * resolution_m / 2.0
    dlon = half / (METRES_PER_DEGREE * F.cos(F.radians(lat)))
    dlat = half / METRES_PER_DEGREE
    return F.struct(
        (lon - dlon).alias("west"), (lat - dlat).alias("south"),
        (lon + dlon).alias("east"), (lat + dlat).alias("north"),
    )


def edges(ring: Column) -> Column:
    """Edges (x0, y0, x1, y1) of a ring; an open ring is closed."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(
            a["lon"].alias("x0"), a["lat"].alias("y0"), b["lon"].alias("x1"), b["lat"].alias("y1")
        ),
    )


def _ring_moments(ring: Column, ox: Column, oy: Column) -> Column:
    """Unsigned area and first moments of a ring about a nearby origin."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc: Column, e: Column) -> Column:
        x0, y0, x1, y1 = e["x0"] - ox, e["y0"] - oy, e["x1"] - ox, e["y1"] - oy
        cross = x0 * y1 - x1 * y0
        return F.struct(
            (acc["a"] + cross / 2).alias("a"),
            (acc["mx"] + (x0 + x1) * cross / 6).alias("mx"),
            (acc["my"] + (y0 + y1) * cross / 6).alias("my"),
        )

    def unsigned(m: Column) -> Column:
        turn = F.signum(m["a"])
        return F.struct(
            (m["a"] * turn).alias("a"), (m["mx"] * turn).alias("mx"), (m["my"] * turn).alias("my")
        )

    return F.aggregate(edges(ring), zero, add, unsigned)


def first_vertex(rings: Column) -> Column:
    return F.get(F.get(rings, F.lit(0)), F.lit(0))


def polygon_centroid(rings: Column) -> Column:
    """Struct (area, lon, lat), shell minus holes, in the units of the coordinates."""

    def measured(rings: Column, origin: Column) -> Column:
        ox, oy = origin["lon"], origin["lat"]
        parts = F.transform(
            rings,
            lambda ring, i: F.struct(
                F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign"), _ring_moments(ring, ox, oy).alias("m")
            ),
        )
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
        add = lambda acc, r: F.struct(*[(acc[k] + r["sign"] * r["m"][k]).alias(k) for k in ("a", "mx", "my")])
        area = lambda t: F.nullif(t["a"], F.lit(0.0))
        finish = lambda t: F.struct(
            t["a"].alias("area"), (ox + t["mx"] / area(t)).alias("lon"), (oy + t["my"] / area(t)).alias("lat")
        )
        return F.aggregate(parts, zero, add, finish)

    return let(rings, lambda r: let(first_vertex(r), lambda o: measured(r, o)))


def polygon_area(rings: Column) -> Column:
    """Area in squared units of the coordinates."""
    return polygon_centroid(rings)["area"]


def polygon_bounds(rings: Column) -> Column:
    xs = F.transform(F.flatten(rings), lambda v: v["lon"])
    ys = F.transform(F.flatten(rings), lambda v: v["lat"])
    return F.struct(
        F.array_min(xs).alias("min_lon"), F.array_min(ys).alias("min_lat"),
        F.array_max(xs).alias("max_lon"), F.array_max(ys).alias("max_lat"),
    )


def total_bounds(parcels: DataFrame, buffer_deg: float = 0.01) -> DataFrame:
    """One row: extent of all polygons with a margin, and its midpoint."""
    box = parcels.select(polygon_bounds(F.col("rings")).alias("b"))
    return (
        box.agg(
            F.min("b.min_lon").alias("w"), F.min("b.min_lat").alias("s"),
            F.max("b.max_lon").alias("e"), F.max("b.max_lat").alias("n"),
        )
        .select(
            (F.col("w") - buffer_deg).alias("west"), (F.col("s") - buffer_deg).alias("south"),
            (F.col("e") + buffer_deg).alias("east"), (F.col("n") + buffer_deg).alias("north"),
            ((F.col("w") + F.col("e")) / 2).alias("mid_lon"), ((F.col("s") + F.col("n")) / 2).alias("mid_lat"),
        )
    )


def touched_runs(all_edges: Column, y: Column) -> Column:
    """Runs (low, high) of the unit cells [x, x+1) x [y, y+1) that a polygon overlaps in one row of cells.

    A cell counts if an edge passes through its interior or the polygon contains its centre. Edges are
    clipped to the row, crossings of the row's middle line are paired, and both give runs of columns, which
    may overlap; the cost depends on the number of edges, not of cells.
    """
    top = y + 1

    def run(low: Column, high: Column) -> Column:
        return F.struct(F.floor(low).cast("long").alias("low"), (F.ceil(high) - 1).cast("long").alias("high"))

    def clipped(e: Column) -> Column:
        at = lambda level: e["x0"] + (level - e["y0"]) * (e["x1"] - e["x0"]) / _safe(e["y1"] - e["y0"])
        flat = e["y0"] == e["y1"]
        first = F.when(flat, e["x0"]).otherwise(at(F.greatest(F.least(e["y0"], e["y1"]), y.cast("double"))))
        last = F.when(flat, e["x1"]).otherwise(at(F.least(F.greatest(e["y0"], e["y1"]), top.cast("double"))))
        return run(F.least(first, last), F.greatest(first, last))

    middle = y + 0.5
    inside = F.filter(all_edges, lambda e: (F.least(e["y0"], e["y1"]) < top) & (F.greatest(e["y0"], e["y1"]) > y))
    crossing = F.filter(all_edges, lambda e: (e["y0"] > middle) != (e["y1"] > middle))
    xs = F.array_sort(
        F.transform(crossing, lambda e: e["x0"] + (middle - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"]))
    )
    # Centres between the 1st and 2nd, 3rd and 4th crossing: column c with x1 < c + 0.5 < x2.
    starts = F.filter(xs, lambda _, i: i % 2 == 0)
    ends = F.filter(xs, lambda _, i: i % 2 == 1)
    spans = F.zip_with(
        starts, ends,
        lambda p, q: F.struct(
            (F.floor(p - 0.5) + 1).cast("long").alias("low"), (F.ceil(q - 0.5) - 1).cast("long").alias("high")
        ),
    )
    return F.filter(F.concat(F.transform(inside, clipped), spans), lambda r: r["low"] <= r["high"])


def _safe(d: Column) -> Column:
    return F.when(d == 0, F.lit(1.0)).otherwise(d)


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


# Published ellipsoids.
GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)


def albers(lon: Column, lat: Column, ellipsoid: Ellipsoid = GRS80) -> tuple[Column, Column]:
    """Albers equal area with the parameters of EPSG:5070 (parallels 29.5 and 45.5, origin 23 N 96 W)."""
    e2, e = ellipsoid.e2, sqrt(ellipsoid.e2)

    def q_of(s):
        return (1 - e2) * (s / (1 - e2 * s * s) + F.atanh(F.lit(e) * s) / e)

    def q_at(degrees: float) -> float:
        s = sin(radians(degrees))
        return (1 - e2) * (s / (1 - e2 * s * s) + atanh(e * s) / e)

    def m2_at(degrees: float) -> float:
        s = sin(radians(degrees))
        return (1 - s * s) / (1 - e2 * s * s)

    q1, q2, q0 = q_at(29.5), q_at(45.5), q_at(23.0)
    n = (m2_at(29.5) - m2_at(45.5)) / (q2 - q1)
    c = m2_at(29.5) + n * q1
    rho = ellipsoid.a * F.sqrt(c - n * q_of(F.sin(F.radians(lat)))) / n
    rho0 = ellipsoid.a * sqrt(c - n * q0) / n
    theta = n * F.radians(lon + 96.0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def utm(
    lon: Column, lat: Column, zone: Column, ellipsoid: Ellipsoid = WGS84, south: Column | None = None
) -> tuple[Column, Column]:
    """Transverse Mercator of a UTM zone by the Krueger series to third order.

    Southern zones count northings from 10,000 km below the equator. A point's own latitude chooses the hemisphere
    unless `south` says it, as for shapes that cross the equator.
    """
    n = ellipsoid.f / (2 - ellipsoid.f)
    radius = ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    e = sqrt(ellipsoid.e2)
    scale = 0.9996 * radius

    def series(angles: Column) -> Column:
        xi, eta = angles["xi"], angles["eta"]
        east, north = eta, xi
        for j, a in enumerate(alpha, start=1):
            east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct((500_000.0 + scale * east).alias("x"), (scale * north).alias("y"))

    def angles(t: Column) -> Column:
        dl = F.radians(lon - (zone * 6 - 183))
        return F.struct(
            F.atan2(t, F.cos(dl)).alias("xi"), F.atanh(F.sin(dl) / F.sqrt(1 + t * t)).alias("eta")
        )

    conformal = lambda s: F.sinh(F.atanh(s) - e * F.atanh(e * s))
    point = let(let(conformal(F.sin(F.radians(lat))), angles), series)
    below = (lat < 0) if south is None else south
    return point["x"], point["y"] + F.when(below, F.lit(10_000_000.0)).otherwise(F.lit(0.0))


def project_rings(rings: Column, project) -> Column:
    """Apply a projection `(lon, lat) -> (x, y)` to every vertex."""

    def vertex(v: Column) -> Column:
        x, y = project(v["lon"], v["lat"])
        return F.struct(x.alias("lon"), y.alias("lat"))

    return F.transform(rings, lambda ring: F.transform(ring, vertex))


def polygon_area_m2(rings: Column) -> Column:
    """Area in square metres in the UTM zone of the polygon's first vertex."""
    zone = utm_zone(first_vertex(rings)["lon"])
    north = F.lit(False)  # one origin for all vertices
    projected = let(zone, lambda z: project_rings(rings, lambda lon, lat: utm(lon, lat, z, south=north)))
    return polygon_area(projected)


def parts_of(rings: Column, part_rings: Column) -> Column:
    """The polygons of a shape from its rings in turn and the number of rings of each; without numbers one polygon."""
    before = lambda i: F.aggregate(F.slice(part_rings, 1, i), F.lit(0), lambda a, n: a + n)
    several = F.transform(part_rings, lambda n, i: F.slice(rings, before(i) + 1, n))
    return F.when(rings.isNull(), F.lit(None)).when(part_rings.isNull(), F.array(rings)).otherwise(several)


def shape_of(df: DataFrame) -> Column:
    """The polygons of a row with `rings` and, for shapes of several polygons, `part_rings`."""
    numbers = F.col("part_rings") if "part_rings" in df.columns else F.lit(None).cast("array<int>")
    return parts_of(F.col("rings"), numbers)


def parts_area_m2(parts: Column) -> Column:
    """Square metres of a shape of several polygons, each a list of rings."""
    return F.aggregate(
        F.transform(parts, polygon_area_m2), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))
    )


def parts_centroid(parts: Column) -> Column:
    """Struct (area, lon, lat) of a shape of several polygons, each weighing as much as its area."""
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))

    def add(acc: Column, c: Column) -> Column:
        weighed = lambda k: acc[k] + F.coalesce(c["area"] * c[k], F.lit(0.0))
        area = acc["area"] + F.coalesce(c["area"], F.lit(0.0))
        return F.struct(area.alias("area"), weighed("lon").alias("lon"), weighed("lat").alias("lat"))

    def finish(t: Column) -> Column:
        area = F.nullif(t["area"], F.lit(0.0))
        return F.struct(t["area"].alias("area"), (t["lon"] / area).alias("lon"), (t["lat"] / area).alias("lat"))

    return F.aggregate(F.transform(parts, polygon_centroid), zero, add, finish)
