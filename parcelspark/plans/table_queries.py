"""Registered queries that store what a campaign makes, read it back, or take a rule to its limits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import encoding, replies
from parcelspark.operators import chips, explain, report, retrieval, scenes, scoring, similarity, training
from parcelspark.plans import driver_queries as base
from parcelspark.plans import driver_views as views
from parcelspark.plans.driver_queries import ADAPTIVE, FIXED, SEASON, Base, text
from parcelspark.session import stage, staging_folder
from parcelspark.sources import catalog, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"


PAGE_ITEMS = 1000  # items of one collection


def _collections(items: int = PAGE_ITEMS):
    """Items, one a row, in collections of at most `items`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pages = [pdf["value"].iloc[i : i + items] for i in range(0, len(pdf), items)]
            yield pd.DataFrame({"value": ['{"type":"FeatureCollection","features":[' + ",".join(page) + "]}" for page in pages]})

    return run


def catalog_items(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes written as item collections and as single items, and read as a catalogue."""
    folder = _folder(spark, "items")
    found = views.slanted(spark, sf)
    point = lambda v: F.array(v["lon"], v["lat"])
    rings = F.transform("footprint", lambda ring: F.transform(ring, point))
    properties = F.to_json(F.struct(F.concat(F.col("scene_date").cast("string"), F.lit("T10:00:00Z")).alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover")))
    shape = F.when(F.col("scene_id") % 5 == 0, F.lit("null")).otherwise(
        F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(rings), F.lit("}"))
    )
    item = F.concat(
        F.lit('{"type":"Feature","id":"s'), "scene_id", F.lit('","collection":"'), "collection", F.lit('","bbox":'), F.to_json("bbox"),
        F.lit(',"geometry":'), shape, F.lit(',"properties":'), properties,
        F.lit(',"assets":{"blue":{"href":"u/'), "scene_id", F.lit('/blue"},"B04":{"href":"u/'), "scene_id", F.lit('/red"}}}'),
    )
    rows = found.select("scene_id", item.alias("value"))
    rows = rows.where(F.col("value").isNotNull())
    # One collection a file, as a search service answers: in pages. Single items are many and tiny, so they come one a line.
    pages = rows.where("scene_id % 50 <> 0").select("value").mapInPandas(_collections(), "value string")
    pages.withColumn("part", F.xxhash64(F.monotonically_increasing_id())).write.partitionBy("part").text(f"{folder}/collections")
    rows.where("scene_id % 50 = 0").select("value").write.text(f"{folder}/items")
    listed = catalog.read_scene_items(spark, f"{folder}/collections").unionByName(
        catalog.read_scene_items(spark, f"{folder}/items", by_line=True)
    )
    usable = scenes.resolve_bands(listed, ["B02", "B04", "B08"])
    return usable.select(
        "scene_id", "collection", text("scene_date"), "cloud_cover", F.round(F.col("bbox")[2], 6).alias("east"),
        F.size(F.flatten("footprint")).alias("n_points"),
        F.array_join(F.transform(F.array_sort(F.map_entries("asset_urls")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("urls"),
    )


def stored_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels, scene index, profiles and search index of a campaign as they come back from storage."""
    made = Base(spark, sf)
    scored = made.score(made.profiles(), FIXED).scores
    index = scenes.scene_index(views.footprints(spark, sf), "2024-01-05", "2024-01-25", max_cloud=20)
    written = {
        "parcels": (made.parcels, F.col("area_ha")),
        "scenes": (index, F.datediff("scene_date", "queried_from").cast("double")),
        "profiles": (made.profiles(), F.col("n_obs").cast("double")),
        "vectors": (similarity.parcel_vectors(scored, made.observations), F.size("unit").cast("double")),
    }
    out = None
    for name, (table, number) in written.items():
        back = tables.write_table(table, f"{_folder(spark, 'stored')}/{name}")
        row = back.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(number).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


def summary_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The summary per crop as one CSV file with a header."""
    folder = _folder(spark, "summary")
    made = Base(spark, sf)
    summary = report.crop_summary(made.score(made.profiles(), ADAPTIVE).scores)
    tables.write_csv(summary, folder)
    return spark.read.schema(summary.schema).option("header", True).csv(folder)


def report_json(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the campaign report, read from its JSON file."""
    folder = _folder(spark, "report")
    made = Base(spark, sf)
    result = made.score(made.profiles(), FIXED)
    season = {"start_date": SEASON.start, "end_date": SEASON.end}
    tables.write_json_row(report.campaign_report(result.scores, result.thresholds, season, "driver"), folder)
    return spark.read.schema("total_parcels long, status_counts map<string,long>").json(folder).select(
        "total_parcels", F.explode("status_counts").alias("status", "n")
    )


def manifest_files(spark: SparkSession, sf: str) -> DataFrame:
    """The split manifests as CSV folders, and the class names from the mapping file."""
    folder = _folder(spark, "manifests")
    splits = stage(training.stratified_split(base._samples(spark, sf)), "split")
    tables.write_manifests(splits, folder)
    tables.write_class_mapping(splits.select("crop_class_id", "crop_name").distinct(), f"{folder}-classes")
    mapping = spark.read.schema("value string").text(f"{folder}-classes")
    names = mapping.select(F.explode(F.from_json("value", "map<string,string>")).alias("crop_class_id", "mapped_name"))
    back = spark.read.option("header", True).csv(folder).withColumn("crop_class_id", F.col("crop_class_id").cast("int"))
    back = back.join(names.withColumn("crop_class_id", F.col("crop_class_id").cast("int")), "crop_class_id")
    return back.select("chip_path", "crop_class_id", "split", "mapped_name")


def training_augment(spark: SparkSession, sf: str) -> DataFrame:
    """Augmented chips per class and copy: those of the training split only."""
    splits = stage(training.stratified_split(base._samples(spark, sf)), "split")
    level = F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("int"))
    seen = views.observations(views.labelled_observations(spark, sf))
    cut = seen.select(
        "parcel_id", "obs_date", F.array(*[F.slice(level, 1 + 16 * i, 16) for i in range(4)]).alias("pixels"),
        F.lit(4).alias("height"), F.lit(4).alias("width"),
    )
    made = training.training_chips(cut, splits.withColumn("date", F.col("date").cast("date")), copies=3)
    whole = F.size("pixels") * F.size(F.get("pixels", 0))
    return made.groupBy("crop_class_id", "copy").agg(F.count(F.lit(1)).alias("n"), F.min(whole).alias("least_values"))


def index_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Which date ranges a scene table without a recorded question answers."""
    index = views.scenes(spark, sf).where("scene_id % 3 = 0")
    span = index.agg(F.min("scene_date").alias("a"), F.max("scene_date").alias("b")).first()
    asked = [("2024-01-02", "2024-01-20"), (str(span["a"]), str(span["b"])), ("2023-12-31", "2024-01-20"), ("2024-01-10", "2031-01-01")]
    rows = [(i, scenes.covers(index, start, end)) for i, (start, end) in enumerate(asked)]
    return spark.createDataFrame(rows, "question int, covered boolean")


def capped_parcels(spark: SparkSession, sf: str) -> DataFrame:
    """The first parcels of a run with a cap, and the first chips of one parcel."""
    sites = views.sites(spark, sf).select(F.col("site_id").alias("parcel_id"), "crop_name")
    seen = views.observations(views.labelled_observations(spark, sf))
    first = chips.first_chips(seen, "p3000", 3).select("parcel_id", text("obs_date"))
    capped = chips.cap_parcels(sites, 25).select(F.concat(F.lit("p"), "parcel_id").alias("parcel_id"), F.lit(None).cast("string").alias("obs_date"))
    return capped.unionByName(first)


def far_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of parcels whose observations all lie beyond the tolerance: 0.0 and GRAY."""
    made = Base(spark, sf)
    late = made.observations.withColumn("obs_date", F.date_add("obs_date", 400))
    scored = scoring.score_parcels(made.parcels, late, made.profiles(), SEASON, FIXED).scores
    return scored.select("parcel_id", "health_score", "status", "n_observations")


def geometry_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Score rows with their shapes: one row a score, null without a parcel, several where a parcel comes twice."""
    shapes = views.site_rings(spark, sf).select(F.col("site_id").alias("parcel_id"), "rings").where("parcel_id % 10 <> 3")
    shapes = shapes.unionByName(shapes.where("parcel_id % 10 = 4"))
    scores = views.sites(spark, sf).select(F.col("site_id").alias("parcel_id"), "crop_name").where("parcel_id % 7 <> 1")
    found = tables.attach_geometry(scores, shapes)
    return found.groupBy("parcel_id", "crop_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count("rings").alias("n_shapes"))


def place_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Places of rows, from shapes of two polygons where a coordinate is missing."""
    corner = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    square = lambda x: F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))
    rows = views.sites(spark, sf).select(
        "site_id", F.when(F.col("site_id") % 3 != 0, F.col("lat")).alias("centroid_lat"), F.col("lon").alias("centroid_lon"),
        F.array(square(x), square(x + 50)).alias("rings"), F.array(F.lit(1), F.lit(1)).alias("part_rings"),
    )
    lat, lon = retrieval.place(rows)
    return rows.select("site_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def band_wavelengths(spark: SparkSession, sf: str) -> DataFrame:
    """Wavelengths of band lists, 0 for unknown bands."""
    names = [*encoding.WAVELENGTHS, "B99"]
    band = lambda i: F.get(F.array(*[F.lit(b) for b in names]), ((F.col("p_size") + i) % len(names)).cast("int"))
    rows = views.table(spark, sf, "part").select("p_partkey", F.array(band(0), band(5)).alias("bands"))
    found = encoding.wavelengths(F.col("bands"))
    return rows.select("p_partkey", F.get(found, 0).alias("first"), F.get(found, 1).alias("second"))


def payload_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of small payloads, null fields included: SHA-256 of their JSON with the keys in order."""
    rows = views.sites(spark, sf)
    payload = F.struct("crop_name", "lat", "site_id")
    return rows.select("site_id", explain.payload_hash(payload).alias("payload_hash"))


def fallback_explanations(spark: SparkSession, sf: str) -> DataFrame:
    """What takes the place of replies that failed, by colour, an unknown one included."""
    colour = F.get(F.array(*[F.lit(c) for c in ("GREEN", "YELLOW", "RED", "GRAY", "BLUE")]), (F.col("site_id") % 5).cast("int"))
    rows = views.sites(spark, sf).select("site_id", replies.fallback(colour, "invalid_reply").alias("e"))
    return rows.select("site_id", "e.status", "e.confidence", "e.consistency_check", F.size("e.possible_causes").alias("n_causes"), F.get("e.evidence_used", 0).alias("evidence"))


def request_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Request texts with and without retrieved context, chosen by whether the bundle has any."""
    hit = F.struct(F.lit("p1").alias("parcel_id"))
    rows = views.sites(spark, sf).select(
        "site_id", F.struct("crop_name", "site_id").alias("payload"),
        F.struct(
            F.when(F.col("site_id") % 2 == 0, F.array(hit)).otherwise(F.array().cast("array<struct<parcel_id:string>>")).alias("similar_parcels"),
            F.array().cast("array<struct<parcel_id:string>>").alias("spatial_neighbors"),
            F.when(F.col("site_id") % 3 == 0, F.lit("bins")).alias("reference_context"),
            F.array(F.lit("note")).alias("retrieval_notes"),
        ).alias("bundle"),
    )
    message = explain.user_message(F.col("payload"), "bundle")
    return rows.select(
        "site_id", F.contains(message, F.lit("parcel_analytics")).alias("enriched"),
        F.contains(message, F.lit("retrieval_notes")).alias("with_notes"),
        F.contains(message, F.concat(F.lit('"site_id" : '), "site_id")).alias("with_payload"),
    )


def trajectory_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectories from their JSON texts, broken ones included."""
    size = F.col("p_size")
    value = (
        F.when(size % 4 == 0, F.lit("[0.1, 0.25")).when(size % 4 == 1, F.lit(None).cast("string"))
        .when(size % 4 == 2, F.lit("nothing")).otherwise(F.concat(F.lit("[0.5, "), size.cast("string"), F.lit("]")))
    )
    parsed = explain.parse_trajectory(value)
    total = F.aggregate(parsed, F.lit(0.0), lambda a, v: a + v)
    return views.table(spark, sf, "part").select("p_partkey", F.size(parsed).alias("n"), total.alias("total"))


def relabelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labels replaced by those of another raster."""
    shapes = views.site_rings(spark, sf).select(F.col("site_id").alias("parcel_id"), "rings", F.lit("old").alias("crop_name"), F.lit(-1).alias("crop_code"))
    found = training.relabel(shapes, views.pixels(spark, sf).withColumn("code", F.col("code") + 1))
    return found.select(F.col("parcel_id").alias("site_id"), "crop_code")


QUERIES = {
    f.__name__: f
    for f in (
        catalog_items, stored_tables, summary_csv, report_json, manifest_files, training_augment, index_reuse, capped_parcels,
        far_dates, geometry_attach, place_fallback, band_wavelengths, payload_hashes, fallback_explanations, request_texts,
        trajectory_texts, relabelled,
    )
}


def selects(known: dict[str, str]) -> dict[str, str]:
    """SQL twins, some built on those of other queries."""
    names = [*encoding.WAVELENGTHS, "B99"]
    waves = ", ".join(f"({i}, {encoding.WAVELENGTHS.get(b, 0.0)}::DOUBLE)" for i, b in enumerate(names))
    return {
        "catalog_items": """SELECT concat('s', CAST(scene_id AS VARCHAR)) AS scene_id, collection, CAST(scene_date AS VARCHAR) AS scene_date, cloud_cover,
            round(west + 0.34::DOUBLE, 6) AS east, CASE WHEN scene_id % 5 <> 0 THEN 4 END AS n_points,
            concat('B02=u/', CAST(scene_id AS VARCHAR), '/blue,B04=u/', CAST(scene_id AS VARCHAR), '/red') AS urls FROM footprints""",
        "stored_tables": """SELECT 'parcels' AS name, count(*) AS n, sum(area_ha) AS total FROM parcels
            UNION ALL SELECT 'scenes', count(*), CAST(sum(scene_date - DATE '2024-01-05') AS DOUBLE) FROM footprints
              WHERE scene_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND cloud_cover < 20
            UNION ALL SELECT 'profiles', count(*), CAST(sum(n_obs) AS DOUBLE) FROM prof WHERE pos = 0
            UNION ALL SELECT 'vectors', count(*), CAST(64 * count(*) AS DOUBLE) FROM (SELECT DISTINCT parcel_id FROM obs) o""",
        "summary_csv": known["crop_status_summary"],
        "report_json": """SELECT (SELECT count(*) FROM fixed_scores) AS total_parcels, status, count(*) AS n FROM fixed_scores GROUP BY status""",
        "manifest_files": f"""SELECT s.chip_path, CAST(s.crop_class_id AS INT) AS crop_class_id, s.split, c.crop_name AS mapped_name
            FROM ({known["stratified_split"]}) s JOIN classes c USING (crop_class_id)""",
        "training_augment": f"""SELECT CAST(crop_class_id AS INT) AS crop_class_id, CAST(copy AS INT) AS copy, count(*) AS n, 64 AS least_values
            FROM ({known["stratified_split"]}) s, (VALUES (1), (2), (3)) v(copy) WHERE split = 'train' GROUP BY ALL""",
        "index_reuse": """SELECT q AS question, lo <= a AND hi >= b AS covered FROM (SELECT min(scene_date) AS lo, max(scene_date) AS hi FROM scenes WHERE scene_id % 3 = 0) s,
            (SELECT 0 AS q, DATE '2024-01-02' AS a, DATE '2024-01-20' AS b UNION ALL SELECT 1, min(scene_date), max(scene_date) FROM scenes WHERE scene_id % 3 = 0
             UNION ALL SELECT 2, DATE '2023-12-31', DATE '2024-01-20' UNION ALL SELECT 3, DATE '2024-01-10', DATE '2031-01-01') asked""",
        "capped_parcels": """SELECT concat('p', CAST(site_id AS VARCHAR)) AS parcel_id, CAST(NULL AS VARCHAR) AS obs_date FROM (SELECT site_id FROM sites ORDER BY site_id LIMIT 25) s
            UNION ALL SELECT parcel_id, CAST(obs_date AS VARCHAR) FROM (SELECT parcel_id, obs_date FROM obs WHERE parcel_id = 'p3000' ORDER BY obs_date LIMIT 3) o""",
        "far_dates": """SELECT parcel_id, CASE WHEN crop_name IN (SELECT crop_name FROM centres) THEN 0.0::DOUBLE END AS health_score, 'GRAY' AS status,
            n_observations FROM base""",
        "geometry_attach": """SELECT site_id AS parcel_id, crop_name, CAST(CASE WHEN site_id % 10 = 4 THEN 2 ELSE 1 END AS BIGINT) AS n_rows,
            CAST(CASE WHEN site_id % 10 = 4 THEN 2 WHEN site_id % 10 = 3 THEN 0 ELSE 1 END AS BIGINT) AS n_shapes FROM sites WHERE site_id % 7 <> 1""",
        "place_fallback": """SELECT site_id, round(CASE WHEN given THEN lat ELSE y0 + h / 2.0::DOUBLE END, 6) AS lat,
            round(CASE WHEN given THEN lon ELSE x0 + 25 + w / 2.0::DOUBLE END, 6) AS lon FROM (SELECT *, lat IS NOT NULL AND site_id % 3 <> 0 AS given FROM sites) s""",
        "band_wavelengths": f"""SELECT p_partkey, a.w AS first, b.w AS second FROM part JOIN (VALUES {waves}) a(i, w) ON a.i = p_size % {len(names)}
            JOIN (VALUES {waves}) b(i, w) ON b.i = (p_size + 5) % {len(names)}""",
        "payload_hashes": """SELECT site_id, sha256(concat('{"crop_name":"', crop_name, '","lat":', coalesce(CAST(lat AS VARCHAR), 'null'), ',"site_id":', CAST(site_id AS VARCHAR), '}')) AS payload_hash FROM sites""",
        "fallback_explanations": """SELECT site_id, CASE site_id % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'warning' WHEN 2 THEN 'critical' ELSE 'insufficient_data' END AS status,
            'low' AS confidence, 'unsupported' AS consistency_check, 0 AS n_causes, 'invalid_reply' AS evidence FROM sites""",
        "request_texts": """SELECT site_id, site_id % 2 = 0 OR site_id % 3 = 0 AS enriched, site_id % 2 = 0 OR site_id % 3 = 0 AS with_notes, true AS with_payload FROM sites""",
        "trajectory_texts": """SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 2 ELSE 0 END AS n, CASE WHEN p_size % 4 = 3 THEN 0.5 + p_size ELSE 0 END::DOUBLE AS total FROM part""",
        "relabelled": """SELECT s.site_id, CAST(z.code + 1 AS INT) AS crop_code FROM sites s LEFT JOIN (
            SELECT site_id, code, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, code) AS r FROM zonal) z ON z.site_id = s.site_id AND r = 1""",
    }
