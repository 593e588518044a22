"""Plain SQL twins of the registered queries, for checking results with another engine."""

from __future__ import annotations

from parcelspark.functions.labels import CROP_CODES
from parcelspark.functions.season import Season
from parcelspark.plans import source_queries, table_queries

SEASON = Season()
DAYS, BINS = SEASON.days, SEASON.n_bins

VIEWS = f"""
obs AS (
 SELECT vec_id, CASE WHEN label = 9 THEN NULL ELSE concat('crop_', CAST(label AS VARCHAR)) END AS crop_name,
  concat('p', CAST(label*1000 + CAST(floor(rn/5) AS INT) AS VARCHAR)) AS parcel_id,
  label*1000 + CAST(floor(rn/5) AS INT) AS pk,
  CAST(DATE '2024-04-15' + CAST((rn % 5)*40 + (label*3 + CAST(floor(rn/5) AS INT)*5) % 14
       + CASE WHEN rn % 11 = 7 THEN 25 ELSE 0 END AS INT) AS DATE) AS obs_date, embedding
 FROM (SELECT vec_id, label, embedding,
        CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) - 1 AS rn FROM embeddings) t),
parcels AS (
 SELECT DISTINCT parcel_id, crop_name,
  CAST(41 AS DOUBLE) + CAST(pk * 37 % 997 AS DOUBLE) / CAST(1000 AS DOUBLE) AS centroid_lat,
  CAST(-94 AS DOUBLE) + CAST(pk * 91 % 991 AS DOUBLE) / CAST(1000 AS DOUBLE) AS centroid_lon,
  CAST(1 + pk % 40 AS DOUBLE) AS area_ha, concat('t', CAST(pk % 3 AS VARCHAR)) AS tile_id,
  concat('0', CAST(pk % 4 AS VARCHAR), '_00') AS fragment_id, pk
 FROM obs),
sites AS (
 SELECT c_custkey AS site_id, c_mktsegment AS crop_name,
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(41 AS DOUBLE) + CAST(c_custkey * 37 % 997 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS lat,
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(-94 AS DOUBLE) + CAST(c_custkey * 91 % 991 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS lon,
  c_custkey * 7 % 90 AS x0, c_custkey * 13 % 45 AS y0, 3 + c_custkey % 5 AS w, 2 + c_custkey % 4 AS h
 FROM customer),
pixels AS (
 SELECT l_partkey % 100 AS x, l_suppkey % 50 AS y, 1 + min(l_orderkey * 10 + l_linenumber) % 6 AS code
 FROM lineitem GROUP BY l_partkey % 100, l_suppkey % 50),
scenes AS (
 SELECT event_id AS scene_id, CAST(ts AS DATE) AS scene_date, value AS cloud_cover, event_type AS collection FROM events),
label_source AS (
 SELECT p_partkey AS parcel_id, concat(p_type, ' / ', p_brand) AS crops_raw,
  CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS code_raw, p_type, p_size FROM part),
season AS (
 SELECT CAST(b AS INT) AS bin, DATE '{SEASON.start}' + CAST(b*14 AS INT) AS bin_start,
  DATE '{SEASON.start}' + CAST(least(b*14+14, {DAYS}) AS INT) AS bin_end,
  DATE '{SEASON.start}' + CAST(b*14 + (least(b*14+14, {DAYS}) - b*14) // 2 AS INT) AS bin_center
 FROM range({BINS}) r(b)),
elig AS (SELECT crop_name FROM parcels WHERE crop_name IS NOT NULL AND crop_name <> '' GROUP BY 1 HAVING count(*) >= 10),
prof AS (
 SELECT crop_name, bin, bin_center, pos, median(v) AS value, count(*) AS n_obs FROM (
  SELECT o.crop_name, s.bin, s.bin_center, CAST(unnest(o.embedding) AS DOUBLE) AS v,
   generate_subscripts(o.embedding, 1) - 1 AS pos
  FROM obs o JOIN elig USING (crop_name) JOIN season s ON o.obs_date >= s.bin_start AND o.obs_date < s.bin_end) t
 GROUP BY ALL HAVING count(*) >= 2),
centres AS (SELECT DISTINCT crop_name, bin, bin_center FROM prof),
near AS (
 SELECT parcel_id, crop_name, obs_date, bin, embedding FROM (
  SELECT o.*, c.bin, row_number() OVER (PARTITION BY o.parcel_id, o.obs_date
     ORDER BY abs(o.obs_date - c.bin_center), c.bin_center) AS r
  FROM obs o JOIN centres c ON o.crop_name = c.crop_name AND abs(o.obs_date - c.bin_center) <= 21) t WHERE r = 1),
dist AS (
 SELECT n.parcel_id, n.obs_date,
  1 - sum(n.v * p.value) / (sqrt(sum(n.v * n.v)) * sqrt(sum(p.value * p.value)) + 1e-10) AS d,
  CASE WHEN greatest(0, n.obs_date - DATE '{SEASON.start}') / CAST({DAYS} AS DOUBLE) < 0.3 THEN 1.5 ELSE 1.0 END AS w
 FROM (SELECT parcel_id, crop_name, obs_date, bin, CAST(unnest(embedding) AS DOUBLE) AS v,
        generate_subscripts(embedding, 1) - 1 AS pos FROM near) n
 JOIN prof p ON n.crop_name = p.crop_name AND n.bin = p.bin AND n.pos = p.pos
 GROUP BY n.parcel_id, n.obs_date),
agg AS (
 SELECT parcel_id, sum(d * w) / sum(w) AS raw FROM dist GROUP BY parcel_id),
worst AS (
 SELECT parcel_id, obs_date AS max_deviation_date FROM (
  SELECT parcel_id, obs_date, row_number() OVER (PARTITION BY parcel_id ORDER BY d DESC, obs_date) AS r FROM dist) t
 WHERE r = 1),
n_obs AS (SELECT parcel_id, count(*) AS n FROM obs GROUP BY parcel_id),
base AS (
 SELECT p.*, CASE WHEN a.raw IS NOT NULL THEN a.raw WHEN p.crop_name IN (SELECT crop_name FROM centres) THEN 0.0 END AS raw,
  a.raw IS NOT NULL AS matched, CASE WHEN p.crop_name IS NULL THEN 0 ELSE n.n END AS n_observations,
  w.max_deviation_date
 FROM parcels p LEFT JOIN agg a USING (parcel_id) LEFT JOIN worst w USING (parcel_id) LEFT JOIN n_obs n USING (parcel_id)),
lim AS (
 SELECT count(raw) AS n, avg(round(raw, 4)) + 0.5 * stddev_pop(round(raw, 4)) AS green,
  avg(round(raw, 4)) + 1.5 * stddev_pop(round(raw, 4)) AS red FROM base),
fixed_scores AS (
 SELECT *, round(raw, 4) AS health_score, CASE WHEN NOT matched THEN 'GRAY' WHEN raw < 0.6 THEN 'GREEN'
  WHEN raw < 0.75 THEN 'YELLOW' ELSE 'RED' END AS status FROM base),
adaptive_scores AS (
 SELECT base.*, round(raw, 4) AS health_score, CASE WHEN NOT matched OR lim.n < 5 THEN 'GRAY'
  WHEN round(raw, 4) < lim.green THEN 'GREEN' WHEN round(raw, 4) < lim.red THEN 'YELLOW' ELSE 'RED' END AS status
 FROM base, lim),
traj AS (
 SELECT parcel_id, obs_date, round(d, 4) AS d, CAST(round(round(d, 4) * 10000) AS BIGINT) AS t,
  row_number() OVER (PARTITION BY parcel_id ORDER BY obs_date) AS i, count(*) OVER (PARTITION BY parcel_id) AS n,
  round(d, 4) - lag(round(d, 4)) OVER (PARTITION BY parcel_id ORDER BY obs_date) AS step FROM dist),
flags AS (
 SELECT p.parcel_id, coalesce(max(n), 0) AS n,
  coalesce(max(n) >= 2 AND max(CASE WHEN i <= greatest(1, n // 3) THEN d END) > 0.6, false) AS early,
  coalesce(max(n) >= 3 AND min(CASE WHEN i > n - 3 THEN d END) > 0.6, false) AS late,
  coalesce(max(n) >= 3 AND count(CASE WHEN step > 0 THEN 1 END) > (max(n) - 1) * 0.6, false) AS rising,
  CAST((2 * sum(t) + count(t)) // nullif(2 * count(t), 0) AS DOUBLE) / 10000.0::DOUBLE AS mean_d, max(d) AS max_d, min(d) AS min_d,
  round(sqrt(CAST(count(t) * sum(t * t) - sum(t) * sum(t) AS DOUBLE)) / count(t)) / 10000.0::DOUBLE AS std_d
 FROM parcels p LEFT JOIN traj t USING (parcel_id) GROUP BY p.parcel_id),
means AS (
 SELECT parcel_id, pos, avg(v) AS m FROM (
  SELECT parcel_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM obs) t
 GROUP BY parcel_id, pos),
norms AS (SELECT parcel_id, sqrt(sum(m * m)) AS norm FROM means GROUP BY parcel_id),
unit AS (SELECT parcel_id, pos, m / (norm + 1e-12) AS u FROM means JOIN norms USING (parcel_id)),
vecs AS (SELECT parcel_id, list(u ORDER BY pos) AS u FROM unit GROUP BY parcel_id),
knn AS (
 SELECT parcel_id, neighbor_id, d, rank FROM (
  SELECT parcel_id, neighbor_id, d, row_number() OVER (PARTITION BY parcel_id ORDER BY round(d, 9), neighbor_id) AS rank FROM (
   SELECT a.parcel_id, b.parcel_id AS neighbor_id,
    1 - list_dot_product(a.u, b.u) AS d
   FROM vecs a JOIN vecs b ON a.parcel_id <> b.parcel_id) t) t2 WHERE rank <= 10),
geo AS (
 SELECT sa AS id, sb AS neighbor_id, round(6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km
 FROM (SELECT a.site_id AS sa, b.site_id AS sb,
   pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
  FROM sites a JOIN sites b ON a.site_id <> b.site_id WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL) t),
pgeo AS (
 SELECT parcel_id, neighbor_id, km, row_number() OVER (PARTITION BY parcel_id ORDER BY round(km, 6), neighbor_id) AS rank FROM (
  SELECT pa AS parcel_id, pb AS neighbor_id, 6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS km
  FROM (SELECT a.parcel_id AS pa, b.parcel_id AS pb,
    pow(sin(radians(b.centroid_lat - a.centroid_lat) / 2), 2)
    + cos(radians(a.centroid_lat)) * cos(radians(b.centroid_lat)) * pow(sin(radians(b.centroid_lon - a.centroid_lon) / 2), 2) AS h
   FROM parcels a JOIN parcels b ON a.parcel_id <> b.parcel_id) t) t2),
coverage AS (
 SELECT crop_name, count(*) AS n, CASE WHEN count(*) > 8
   THEN list(bin_center ORDER BY bin_center)[1:5] || list(bin_center ORDER BY bin_center)[-3:]
   ELSE list(bin_center ORDER BY bin_center)[1:5] END AS dates FROM centres GROUP BY crop_name),
footprints AS (
 SELECT *, CAST(-94 AS DOUBLE) + CAST(scene_id * 7 % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS west,
  CAST(41 AS DOUBLE) + CAST(scene_id * 3 % 8 AS DOUBLE) / CAST(10 AS DOUBLE) AS south FROM scenes),
best AS (
 SELECT scene_id, scene_date, cloud_cover, collection FROM (
  SELECT *, row_number() OVER (PARTITION BY scene_date ORDER BY cloud_cover, scene_id) AS r FROM scenes) t WHERE r = 1),
zonal AS (
 SELECT site_id, code, count(*) AS n FROM sites s JOIN pixels p
  ON p.x < s.x0 + s.w AND p.x + 1 > s.x0 AND p.y < s.y0 + s.h AND p.y + 1 > s.y0 GROUP BY site_id, code),
classes AS (
 SELECT crop_name, CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS crop_class_id FROM (
  SELECT c.crop_name, c.pos, count(p.parcel_id) AS n FROM (VALUES (0,'crop_8'),(1,'crop_3'),(2,'crop_0'),(3,'crop_5'),(4,'crop_1'),(5,'crop_99')) c(pos, crop_name)
  LEFT JOIN parcels p ON p.crop_name = c.crop_name GROUP BY c.crop_name, c.pos) t WHERE n >= 10),
samples AS (
 SELECT concat(o.parcel_id, '/', CAST(o.obs_date AS VARCHAR)) AS chip_path, c.crop_class_id, c.crop_name, o.parcel_id,
  CAST(o.obs_date AS VARCHAR) AS obs_day
 FROM obs o JOIN classes c USING (crop_name)),
codes AS (SELECT * FROM (VALUES {", ".join(f"({k},'{v}')" for k, v in CROP_CODES.items())}) t(crop_code, crop_name)),
replies AS (
 SELECT doc_id, CASE WHEN toxic = 1 THEN 'RED' WHEN quality = 1 THEN 'GREEN' ELSE 'YELLOW' END AS colour,
  CASE doc_id % 6
   WHEN 0 THEN '{{"status":"normal","summary":"fine","possible_causes":["a"],"confidence":"high","recommended_action":"none","evidence_used":["x","y"],"consistency_check":"consistent"}}'
   WHEN 1 THEN concat('Here:', chr(10), '```json', chr(10), '{{"status":"critical","summary":"bad","confidence":"Moderate","recommended_action":"go"}}', chr(10), '```')
   WHEN 2 THEN '{{"status":" YELLOW ","summary":"alias","possible_causes":[],"confidence":"very high","recommended_action":"look","consistency_check":"not supported"}}'
   WHEN 3 THEN '{{"status":"Green","summary":"enum","confidence":"certain","recommended_action":"x"}}'
   WHEN 4 THEN '{{"status":"normal","summary":"cut off'
   ELSE concat('{{"status":"normal","summary":"', repeat('s', 501), '","confidence":"low","recommended_action":"x"}}') END AS reply
 FROM labels)
"""


def _sql(select: str) -> str:
    return f"WITH {VIEWS.strip()}\n{select}"


MEAN = (
    "CAST((2 * sum(CAST(round(health_score * 10000) AS BIGINT)) + count(health_score)) // nullif(2 * count(health_score), 0) AS DOUBLE)"
    " / 10000.0::DOUBLE"
)
STATUS_COUNTS = (
    "count(CASE WHEN status='GREEN' THEN 1 END) AS green, count(CASE WHEN status='YELLOW' THEN 1 END) AS yellow, "
    "count(CASE WHEN status='RED' THEN 1 END) AS red, count(CASE WHEN status='GRAY' THEN 1 END) AS gray"
)
SCORE_COLUMNS = (
    "parcel_id, crop_name, health_score, status, n_observations, "
    "CAST(CASE WHEN matched THEN max_deviation_date END AS VARCHAR) AS max_deviation_date"
)
MERGED_FLAGS = (
    "concat_ws(',', CASE WHEN early THEN 'early_deviation' END, CASE WHEN late THEN 'persistent_deviation' END, "
    "CASE WHEN rising THEN 'worsening_trend' END)"
)

SELECTS = {
    "crop_status_summary": f"""SELECT crop_name, count(*) AS total, {STATUS_COUNTS}, {MEAN} AS avg_health_score
        FROM adaptive_scores WHERE crop_name IS NOT NULL GROUP BY crop_name""",
    "season_bins": """SELECT s.bin, CAST(s.bin_start AS VARCHAR) AS bin_start, CAST(s.bin_end AS VARCHAR) AS bin_end,
        CAST(s.bin_center AS VARCHAR) AS bin_center, count(o.parcel_id) AS n_obs
        FROM season s LEFT JOIN obs o ON o.obs_date >= s.bin_start AND o.obs_date < s.bin_end GROUP BY ALL""",
    "season_bins_sql": f"""SELECT c.crop_name, b.bin, CAST(b.lo AS VARCHAR) AS bin_start, CAST(b.hi AS VARCHAR) AS bin_end,
        CAST(b.lo + CAST((b.hi - b.lo) // 2 AS INT) AS VARCHAR) AS bin_center, count(o.obs_date) AS n_obs
        FROM (SELECT DISTINCT crop_name, CAST(7 * (1 + CAST(substr(crop_name, 6) AS INT) % 3) AS INT) AS step FROM obs WHERE crop_name IS NOT NULL) c
        JOIN (SELECT step, CAST(i AS INT) AS bin, DATE '{SEASON.start}' + CAST(i * step AS INT) AS lo, DATE '{SEASON.start}' + CAST(least(i * step + step, {DAYS}) AS INT) AS hi
          FROM (VALUES (7), (14), (21)) s(step), range(30) r(i) WHERE i * step < {DAYS}) b ON b.step = c.step
        LEFT JOIN obs o ON o.crop_name = c.crop_name AND o.obs_date >= b.lo AND o.obs_date < b.hi GROUP BY ALL""",
    "crop_profiles": """SELECT crop_name, CAST(bin_center AS VARCHAR) AS bin_center, n_obs, CAST(pos AS INT) AS pos,
        round(value, 6) + 0.0::DOUBLE AS value FROM prof""",
    "profile_coverage": """SELECT crop_name, n AS n_temporal_bins, array_to_string([CAST(x AS VARCHAR) FOR x IN dates], ',') AS bin_sample_dates
        FROM coverage""",
    "parcel_scores_fixed": f"SELECT {SCORE_COLUMNS} FROM fixed_scores",
    "parcel_scores_adaptive": f"SELECT {SCORE_COLUMNS} FROM adaptive_scores",
    "effective_thresholds": "SELECT 'adaptive' AS method, round(green, 6) AS green, round(red, 6) AS red FROM lim",
    "distance_trajectory": "SELECT parcel_id, CAST(obs_date AS VARCHAR) AS obs_date, d AS distance FROM traj",
    "max_deviation_date": "SELECT parcel_id, CAST(max_deviation_date AS VARCHAR) AS max_deviation_date FROM worst",
    "observation_weights": f"""SELECT parcel_id, CAST(obs_date AS VARCHAR) AS obs_date,
        round(greatest(0, obs_date - DATE '{SEASON.start}') / CAST({DAYS} AS DOUBLE), 6) AS season_fraction,
        CASE WHEN greatest(0, obs_date - DATE '{SEASON.start}') / CAST({DAYS} AS DOUBLE) < 0.3 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM obs""",
    "status_counts_pct": """SELECT status, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fixed_scores), 1) AS pct,
        CASE WHEN status <> 'GRAY' THEN round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fixed_scores WHERE status <> 'GRAY'), 0) END AS monitored_pct
        FROM fixed_scores GROUP BY status""",
    "temporal_coverage": """SELECT round(avg(n_observations), 1) AS mean_observations, min(n_observations) AS min_observations,
        max(n_observations) AS max_observations, round(quantile_cont(n_observations, 0.5), 1) AS median_observations FROM fixed_scores""",
    "top10_worst": f"SELECT {SCORE_COLUMNS} FROM fixed_scores WHERE health_score IS NOT NULL ORDER BY health_score DESC, parcel_id LIMIT 10",
    "alert_list": """SELECT parcel_id, fragment_id, crop_name, health_score, status, n_observations,
        CAST(max_deviation_date AS VARCHAR) AS max_deviation_date, area_ha FROM fixed_scores WHERE status IN ('RED', 'YELLOW')""",
    "score_histogram": """SELECT crop_name, CAST(CASE WHEN lo = hi THEN 1 ELSE least((CAST(round(health_score * 10000) AS BIGINT) - lo) * 30 // (hi - lo) + 1, 30) END AS INT) AS bin,
        count(*) AS n FROM fixed_scores JOIN (SELECT crop_name, min(CAST(round(health_score * 10000) AS BIGINT)) AS lo,
          max(CAST(round(health_score * 10000) AS BIGINT)) AS hi
         FROM fixed_scores WHERE status <> 'GRAY' GROUP BY crop_name) m USING (crop_name) WHERE status <> 'GRAY' GROUP BY ALL""",
    "crop_kpis": f"""SELECT crop_name, count(*) AS parcels, {MEAN} AS avg_health_score,
        count(CASE WHEN status = 'RED' THEN 1 END) AS red_alerts FROM fixed_scores WHERE status <> 'GRAY' AND crop_name IS NOT NULL GROUP BY crop_name""",
    "class_balance": """SELECT crop_name, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM parcels), 1) AS pct
        FROM parcels WHERE crop_name IS NOT NULL GROUP BY crop_name""",
    "label_overview": """SELECT CAST(sum(n) AS BIGINT) AS parcels, CAST(sum(CASE WHEN crop_name IS NOT NULL THEN n END) AS BIGINT) AS labelled,
        CAST(coalesce(sum(CASE WHEN crop_name IS NULL THEN n END), 0) AS BIGINT) AS unlabelled, count(crop_name) AS crops,
        (SELECT crop_name FROM parcels WHERE crop_name IS NOT NULL GROUP BY crop_name ORDER BY count(*) DESC, crop_name LIMIT 1) AS most_common,
        round(max(CASE WHEN crop_name IS NOT NULL THEN n END) * 100.0::DOUBLE / sum(n), 1) AS most_common_pct
        FROM (SELECT crop_name, count(*) AS n FROM parcels GROUP BY crop_name) t""",
    "inventory": """SELECT (SELECT count(*) FROM parcels) AS parcels, (SELECT count(DISTINCT scene_date) FROM scenes) AS scene_dates,
        count(*) AS chips, count(DISTINCT parcel_id) AS parcels_with_chips, count(*) AS embeddings,
        round(count(*)::DOUBLE / count(DISTINCT parcel_id), 1) AS dates_per_parcel,
        count(DISTINCT parcel_id) * (SELECT count(DISTINCT scene_date) FROM scenes) AS possible_chips FROM obs""",
    "trajectory_colours": """SELECT parcel_id, CAST(obs_date AS VARCHAR) AS obs_date, d AS distance,
        CASE WHEN d < 0.6 THEN 'green' WHEN d < 0.75 THEN 'orange' ELSE 'red' END AS colour FROM traj""",
    "region_selection": f"""SELECT {SCORE_COLUMNS}, tile_id, fragment_id FROM fixed_scores
        WHERE tile_id IN ('t0', 't2') AND fragment_id IN ('00_00', '01_00', '03_00')""",
    "monitored_crops": "SELECT DISTINCT crop_name FROM fixed_scores WHERE status <> 'GRAY' AND crop_name IS NOT NULL",
    "campaign_rollup": f"""SELECT coalesce(crop_name, 'all') AS crop_name, count(*) AS total, {STATUS_COUNTS},
        {MEAN} AS avg_health_score FROM fixed_scores WHERE crop_name IS NOT NULL GROUP BY ROLLUP (crop_name)""",
    "trajectory_flags": f"SELECT parcel_id, {MERGED_FLAGS} AS flags FROM flags",
    "trajectory_summary": """SELECT parcel_id, mean_d AS mean, max_d AS max, min_d AS min, std_d AS std, CAST(n AS INT) AS n_points
        FROM flags WHERE n > 0""",
    "explain_payload": f"""SELECT s.parcel_id, s.crop_name, s.health_score, s.status, s.n_observations,
        CAST(CASE WHEN matched THEN s.max_deviation_date END AS VARCHAR) AS max_deviation_date, f.mean_d AS mean_distance,
        {MERGED_FLAGS} AS trajectory_flags,
        concat_ws(',', CASE WHEN f.n < 3 THEN 'few_observations' END, CASE WHEN s.status = 'GRAY' THEN 'insufficient_data' END) AS data_quality_flags,
        0.6::DOUBLE AS green_threshold, 0.75::DOUBLE AS red_threshold, 'fixed' AS scoring_method
        FROM fixed_scores s JOIN flags f USING (parcel_id)""",
    "campaign_report": f"""SELECT 'total_parcels' AS section, 'driver' AS key, CAST(count(*) AS DOUBLE) AS value FROM fixed_scores
        UNION ALL SELECT 'status_counts', status, CAST(count(*) AS DOUBLE) FROM fixed_scores GROUP BY status
        UNION ALL SELECT 'status_pct', status, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fixed_scores), 1) FROM fixed_scores GROUP BY status
        UNION ALL SELECT 'crop_breakdown.total', crop_name, CAST(count(*) AS DOUBLE) FROM fixed_scores WHERE crop_name IS NOT NULL GROUP BY crop_name
        UNION ALL SELECT 'crop_breakdown.avg_health_score', crop_name, {MEAN} FROM fixed_scores WHERE crop_name IS NOT NULL GROUP BY crop_name
        UNION ALL SELECT 'top10_worst.health_score', parcel_id, health_score FROM (
          SELECT parcel_id, health_score FROM fixed_scores WHERE health_score IS NOT NULL ORDER BY health_score DESC, parcel_id LIMIT 10) t
        UNION ALL SELECT 'temporal_coverage', 'mean_observations', round(avg(n_observations), 1) FROM fixed_scores
        UNION ALL SELECT 'temporal_coverage', 'min_observations', CAST(min(n_observations) AS DOUBLE) FROM fixed_scores
        UNION ALL SELECT 'temporal_coverage', 'max_observations', CAST(max(n_observations) AS DOUBLE) FROM fixed_scores
        UNION ALL SELECT 'temporal_coverage', 'median_observations', round(quantile_cont(n_observations, 0.5), 1) FROM fixed_scores
        UNION ALL SELECT 'thresholds', 'green', 0.6::DOUBLE UNION ALL SELECT 'thresholds', 'red', 0.75::DOUBLE""",
    "mean_vectors": "SELECT parcel_id, CAST(pos AS INT) AS pos, round(m, 6) + 0.0::DOUBLE AS value FROM means",
    "unit_norms": "SELECT parcel_id, round(sqrt(sum(u * u)), 6) AS norm FROM unit GROUP BY parcel_id",
    "knn_one": """SELECT neighbor_id AS parcel_id, crop_name, round(1 - d, 6) AS similarity, round(d, 6) AS cosine_distance
        FROM knn JOIN parcels p ON p.parcel_id = neighbor_id WHERE knn.parcel_id = 'p3000'""",
    "knn_all": """SELECT knn.parcel_id, neighbor_id, p.crop_name AS neighbor_crop, round(1 - d, 6) AS similarity,
        round(d, 6) AS cosine_distance, CAST(rank AS INT) AS rank FROM knn JOIN parcels p ON p.parcel_id = neighbor_id""",
    "mislabel_scan": """SELECT parcel_id, crop_name, round(diff::DOUBLE / lab, 4) AS neighbor_diff_fraction, diff AS diff_neighbors, lab AS labeled_neighbors
        FROM (SELECT k.parcel_id, a.crop_name, count(CASE WHEN b.crop_name <> a.crop_name THEN 1 END) AS diff, count(b.crop_name) AS lab
         FROM knn k JOIN parcels a ON a.parcel_id = k.parcel_id JOIN parcels b ON b.parcel_id = k.neighbor_id
         WHERE a.crop_name IS NOT NULL GROUP BY k.parcel_id, a.crop_name) t WHERE lab > 0 AND diff::DOUBLE / lab >= 0.9""",
    "neighbor_roles": """SELECT k.parcel_id, k.neighbor_id, b.crop_name,
        CASE WHEN a.crop_name <> b.crop_name THEN 'neighbor_diff' ELSE 'neighbor_same' END AS map_role,
        concat('cos_sim=', printf('%.3f', 1 - d), CASE WHEN a.crop_name <> b.crop_name THEN ', labels differ' ELSE '' END) AS similarity_note
        FROM knn k JOIN parcels a ON a.parcel_id = k.parcel_id JOIN parcels b ON b.parcel_id = k.neighbor_id
        UNION ALL SELECT parcel_id, parcel_id, crop_name, 'query', 'the query itself' FROM parcels""",
    "spatial_knn": """SELECT id AS site_id, neighbor_id, km AS distance_km, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, neighbor_id) AS rank FROM geo) t WHERE rank <= 5""",
    "spatial_knn_capped": """SELECT id AS site_id, neighbor_id, km AS distance_km, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, neighbor_id) AS rank FROM geo WHERE km <= 3.0) t WHERE rank <= 8""",
    "retrieval_bundle_long": """SELECT k.parcel_id, 'similar' AS kind, CAST(k.rank AS INT) AS rank, k.neighbor_id AS item,
         round(k.d, 6) AS measure, s.status AS status FROM knn k JOIN fixed_scores s ON s.parcel_id = k.neighbor_id WHERE k.rank <= 5
        UNION ALL SELECT g.parcel_id, 'spatial', CAST(g.rank AS INT), g.neighbor_id, round(g.km, 4), s.status FROM pgeo g
         JOIN fixed_scores s ON s.parcel_id = g.neighbor_id WHERE g.rank <= 5
        UNION ALL SELECT p.parcel_id, 'reference', 0, array_to_string([CAST(x AS VARCHAR) FOR x IN c.dates], ','), CAST(c.n AS DOUBLE), NULL
         FROM parcels p JOIN coverage c ON c.crop_name = p.crop_name
        UNION ALL SELECT p.parcel_id, 'note', 0, 'no_reference_profile_for_crop', NULL, NULL FROM parcels p
         WHERE p.crop_name IS NOT NULL AND p.crop_name NOT IN (SELECT crop_name FROM coverage)""",
    "scene_filter": """SELECT scene_id, CAST(scene_date AS VARCHAR) AS scene_date, cloud_cover FROM scenes
        WHERE collection = 'view' AND scene_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND cloud_cover < 20""",
    "best_scene_per_date": "SELECT scene_id, CAST(scene_date AS VARCHAR) AS scene_date, cloud_cover FROM best",
    "scene_cap": """SELECT scene_id, CAST(scene_date AS VARCHAR) AS scene_date, cloud_cover FROM best ORDER BY scene_date LIMIT 20""",
    "cloud_stats": """SELECT count(*) AS n_scenes, count(DISTINCT scene_date) AS n_dates, round(avg(cloud_cover), 6) AS avg_cloud
        FROM scenes WHERE cloud_cover < 20""",
    "band_resolve": """SELECT scene_id, b02, b04, CAST((b02 IS NOT NULL)::INT + (b04 IS NOT NULL)::INT AS INT) AS n_bands FROM (
        SELECT scene_id, CASE WHEN collection <> 'error' THEN concat('s/', CAST(scene_id AS VARCHAR), CASE WHEN scene_id % 3 = 0 THEN '/blue' ELSE '/B02' END) END AS b02,
         CASE WHEN collection = 'click' THEN concat('s/', CAST(scene_id AS VARCHAR), '/red') END AS b04 FROM scenes) t
        WHERE b02 IS NOT NULL OR b04 IS NOT NULL""",
    "best_scene_per_cell": """SELECT cell_x, cell_y, scene_id, CAST(scene_date AS VARCHAR) AS scene_date, cloud_cover FROM (
         SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y, scene_date ORDER BY cloud_cover, scene_id) AS r FROM (
          SELECT f.*, CAST(x AS INT) AS cell_x, CAST(y AS INT) AS cell_y FROM footprints f, range(-190, -184) a(x), range(80, 86) b(y)
          WHERE x BETWEEN floor(west / 0.5::DOUBLE) AND floor((west + 0.3::DOUBLE) / 0.5::DOUBLE)
           AND y BETWEEN floor(south / 0.5::DOUBLE) AND floor((south + 0.2::DOUBLE) / 0.5::DOUBLE)) t) u WHERE r = 1""",
    "chip_plan_covered": """SELECT site_id AS parcel_id, scene_id, CAST(scene_date AS VARCHAR) AS scene_date FROM (
         SELECT site_id, scene_id, scene_date, row_number() OVER (PARTITION BY site_id, scene_date ORDER BY cloud_cover, scene_id) AS r
         FROM sites JOIN footprints ON (0.3::DOUBLE - 0.0::DOUBLE) * (lat - south - 0.0005::DOUBLE) > (0.0405::DOUBLE - 0.0005::DOUBLE) * (lon - west - 0.0::DOUBLE)
          AND (0.34::DOUBLE - 0.3::DOUBLE) * (lat - south - 0.0405::DOUBLE) > (0.2405::DOUBLE - 0.0405::DOUBLE) * (lon - west - 0.3::DOUBLE)
          AND (0.04::DOUBLE - 0.34::DOUBLE) * (lat - south - 0.2405::DOUBLE) > (0.2005::DOUBLE - 0.2405::DOUBLE) * (lon - west - 0.34::DOUBLE)
          AND (0.0::DOUBLE - 0.04::DOUBLE) * (lat - south - 0.2005::DOUBLE) > (0.0005::DOUBLE - 0.2005::DOUBLE) * (lon - west - 0.04::DOUBLE)) t WHERE r = 1""",
    "scene_index": """SELECT scene_id, CAST(scene_date AS VARCHAR) AS scene_date, cloud_cover, '2024-01-05' AS queried_from, '2024-01-25' AS queried_to
        FROM footprints WHERE scene_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND cloud_cover < 20
         AND west <= -93.25::DOUBLE AND west + 0.3::DOUBLE >= -93.55::DOUBLE AND south <= 41.45::DOUBLE AND south + 0.2::DOUBLE >= 41.25::DOUBLE""",
    "chip_plan": "SELECT site_id AS parcel_id, scene_id, CAST(scene_date AS VARCHAR) AS scene_date FROM sites CROSS JOIN best",
    "chip_todo": """SELECT site_id AS parcel_id, CAST(scene_date AS VARCHAR) AS scene_date FROM sites CROSS JOIN best
        WHERE NOT (site_id + day(scene_date)) % 3 = 0""",
    "chip_bounds": """SELECT site_id, round(lon - 1120.0 / (111320.0 * cos(radians(lat))), 8) AS west, round(lat - 1120.0 / 111320.0, 8) AS south,
        round(lon + 1120.0 / (111320.0 * cos(radians(lat))), 8) AS east, round(lat + 1120.0 / 111320.0, 8) AS north FROM sites WHERE lat IS NOT NULL""",
    "total_bounds": """SELECT round(min(x0) - 0.01::DOUBLE, 6) AS west, round(min(y0) - 0.01::DOUBLE, 6) AS south, round(max(x0 + w) + 0.01::DOUBLE, 6) AS east,
        round(max(y0 + h) + 0.01::DOUBLE, 6) AS north, round((min(x0) + max(x0 + w)) / 2.0::DOUBLE, 6) AS mid_lon,
        round((min(y0) + max(y0 + h)) / 2.0::DOUBLE, 6) AS mid_lat FROM sites""",
    "polygon_area_centroid": """SELECT site_id, CAST(w * h AS DOUBLE) AS area, round(x0 + w / 2.0::DOUBLE, 6) AS lon, round(y0 + h / 2.0::DOUBLE, 6) AS lat FROM sites""",
    "zonal_counts": "SELECT site_id, CAST(code AS INT) AS code, n FROM zonal",
    "zonal_majority": """SELECT s.site_id, CAST(z.code AS INT) AS crop_code, CASE WHEN z.code IS NOT NULL THEN c.crop_name END AS crop_name FROM sites s
        LEFT JOIN (SELECT site_id, code, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, code) AS r FROM zonal) z
         ON z.site_id = s.site_id AND r = 1 LEFT JOIN codes c ON c.crop_code = z.code""",
    "nodata_fraction": """SELECT vec_id, count(CASE WHEN m < 0.1 THEN 1 END) / 16.0::DOUBLE AS nodata,
        count(CASE WHEN m < 0.1 THEN 1 END) / 16.0::DOUBLE <= 0.3 AS kept FROM (
         SELECT vec_id, (pos % 16) AS px, max(abs(v)) AS m FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v,
          generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) t GROUP BY vec_id, (pos % 16)) t2 GROUP BY vec_id""",
    "time_encoding": """SELECT parcel_id, CAST(obs_date AS VARCHAR) AS obs_date, round(sin(dayofyear(obs_date) / 365.25::DOUBLE * 2 * pi()), 6) AS week_sin,
        round(cos(dayofyear(obs_date) / 365.25::DOUBLE * 2 * pi()), 6) AS week_cos, 0.0::DOUBLE AS hour_sin, 1.0::DOUBLE AS hour_cos FROM obs""",
    "latlon_encoding": """SELECT site_id, round(sin(radians(lat)), 6) AS sin_lat, round(cos(radians(lat)), 6) AS cos_lat,
        round(sin(radians(lon)), 6) AS sin_lon, round(cos(radians(lon)), 6) AS cos_lon FROM sites WHERE lat IS NOT NULL""",
    "parcel_seed": "SELECT DISTINCT parcel_id, CAST(concat('0x', substr(md5(parcel_id), 1, 8)) AS BIGINT) AS seed FROM parcels",
    "label_normalize": """SELECT parcel_id, replace(replace(lower(crops_raw), '/', '_'), ' ', '_') AS crop_name, TRY_CAST(code_raw AS INT) AS crop_code FROM label_source""",
    "label_join": """SELECT s.parcel_id, l.crop_code, l.crop_name FROM label_source s LEFT JOIN (
        SELECT parcel_id, p_size AS crop_code, p_type AS crop_name FROM label_source WHERE p_size % 5 <> 0) l USING (parcel_id)""",
    "code_lookup": """SELECT s.parcel_id, TRY_CAST(code_raw AS INT) AS crop_code,
        CASE WHEN TRY_CAST(code_raw AS INT) IS NOT NULL THEN coalesce(c.crop_name, 'unknown') END AS crop_name
        FROM label_source s LEFT JOIN codes c ON c.crop_code = TRY_CAST(code_raw AS INT)""",
    "props_flatten": """SELECT event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
    "manifest_eligible": "SELECT chip_path, crop_class_id, crop_name, parcel_id, obs_day AS date FROM samples",
    "class_eligibility": "SELECT crop_name, crop_class_id FROM classes",
    "dropped_classes": """SELECT c.crop_name, count(p.parcel_id) AS n FROM (VALUES ('crop_8'),('crop_3'),('crop_0'),('crop_5'),('crop_1'),('crop_99')) c(crop_name)
        LEFT JOIN parcels p ON p.crop_name = c.crop_name GROUP BY c.crop_name HAVING count(p.parcel_id) < 10""",
    "stratified_split": """SELECT chip_path, crop_class_id, CASE WHEN r <= round(n * 0.1) THEN 'test'
        WHEN r <= round(n * 0.1) + round((n - round(n * 0.1)) * (0.1 / (0.8 + 0.1))) THEN 'val' ELSE 'train' END AS split FROM (
         SELECT *, row_number() OVER (PARTITION BY crop_class_id ORDER BY md5(concat('42:', chip_path)), chip_path) AS r,
          count(*) OVER (PARTITION BY crop_class_id) AS n FROM samples) t""",
    "upsert_explanations": """SELECT parcel_id, status, 'new' AS origin FROM adaptive_scores WHERE status IN ('RED', 'YELLOW')
        UNION ALL SELECT parcel_id, status, 'old' FROM fixed_scores WHERE parcel_id NOT IN (SELECT parcel_id FROM adaptive_scores WHERE status IN ('RED', 'YELLOW'))""",
    "reuse_unchanged": """SELECT f.parcel_id, CASE WHEN md5(concat(f.parcel_id, '|', f.status)) = md5(concat(a.parcel_id, '|', a.status)) THEN 'reuse' ELSE 'todo' END AS action
        FROM fixed_scores f JOIN adaptive_scores a USING (parcel_id)""",
    "embed_todo": """SELECT parcel_id, CAST(obs_date AS VARCHAR) AS obs_date FROM obs WHERE vec_id % 4 <> 1""",
    "explanation_validate": """SELECT doc_id, colour, st IS NOT NULL AS valid, st AS status, cf AS confidence,
        CASE WHEN st IS NULL THEN NULL WHEN st <> CASE colour WHEN 'GREEN' THEN 'normal' WHEN 'YELLOW' THEN 'warning' ELSE 'critical' END THEN 'unsupported'
         ELSE ck END AS consistency_check FROM (
         SELECT doc_id, colour, CASE WHEN ok THEN st END AS st, CASE WHEN ok THEN cf END AS cf, ck FROM (
          SELECT *, coalesce(st IN ('normal', 'warning', 'critical', 'insufficient_data') AND cf IN ('low', 'medium', 'high')
            AND ck IN ('consistent', 'weakly_supported', 'unsupported') AND length(sm) <= 500 AND ac IS NOT NULL, false) AS ok FROM (
           SELECT doc_id, colour, CASE trim(s) WHEN 'GREEN' THEN 'normal' WHEN 'YELLOW' THEN 'warning' WHEN 'RED' THEN 'critical'
              WHEN 'GRAY' THEN 'insufficient_data' ELSE CASE lower(trim(s)) WHEN 'green' THEN CASE WHEN trim(s) = 'green' THEN 'normal' ELSE 'green' END ELSE lower(trim(s)) END END AS st,
             CASE lower(trim(c)) WHEN 'moderate' THEN 'medium' WHEN 'very high' THEN 'high' WHEN 'very low' THEN 'low' ELSE lower(trim(c)) END AS cf,
             CASE WHEN k IS NULL THEN 'consistent' WHEN lower(trim(k)) = 'not supported' THEN 'unsupported' ELSE replace(lower(trim(k)), ' ', '_') END AS ck, sm, ac
           FROM (SELECT doc_id, colour, json_extract_string(j, '$.status') AS s, json_extract_string(j, '$.confidence') AS c,
              json_extract_string(j, '$.consistency_check') AS k, json_extract_string(j, '$.summary') AS sm, json_extract_string(j, '$.recommended_action') AS ac
            FROM (SELECT doc_id, colour, CASE WHEN json_valid(t) THEN t END AS j FROM (
              SELECT doc_id, colour, nullif(regexp_extract(reply, '\\{.*\\}', 0, 's'), '') AS t FROM replies) a) b) c) d) e) f""",
    "explained_scores": """SELECT parcel_id, status, CASE WHEN status = 'GRAY' OR n < 3 THEN 'insufficient_data' WHEN status = 'GREEN' THEN 'normal'
        WHEN status = 'YELLOW' THEN 'warning' ELSE 'critical' END AS llm_status, 'low' AS llm_confidence,
        CASE WHEN n < 3 AND status <> 'GRAY' THEN 'unsupported' ELSE 'consistent' END AS consistency_check
        FROM fixed_scores JOIN flags USING (parcel_id)""",
    "albers_project": """SELECT site_id, round(rho * sin(theta), 3) AS x, round(rho0 - rho * cos(theta), 3) AS y FROM (
        SELECT site_id, a * sqrt(c - n * q) / n AS rho, a * sqrt(c - n * q0) / n AS rho0, n * radians(lon + 96) AS theta FROM (
         SELECT site_id, lon, 6378137.0::DOUBLE AS a, q, q0, (m1 - m2) / (q2 - q1) AS n, m1 + (m1 - m2) / (q2 - q1) * q1 AS c FROM (
          SELECT site_id, lon, (1 - e2) * (sin(radians(lat)) / (1 - e2 * pow(sin(radians(lat)), 2)) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) AS q,
           (1 - e2) * (sin(radians(23)) / (1 - e2 * pow(sin(radians(23)), 2)) - ln((1 - e * sin(radians(23))) / (1 + e * sin(radians(23)))) / (2 * e)) AS q0,
           (1 - e2) * (sin(radians(29.5)) / (1 - e2 * pow(sin(radians(29.5)), 2)) - ln((1 - e * sin(radians(29.5))) / (1 + e * sin(radians(29.5)))) / (2 * e)) AS q1,
           (1 - e2) * (sin(radians(45.5)) / (1 - e2 * pow(sin(radians(45.5)), 2)) - ln((1 - e * sin(radians(45.5))) / (1 + e * sin(radians(45.5)))) / (2 * e)) AS q2,
           pow(cos(radians(29.5)), 2) / (1 - e2 * pow(sin(radians(29.5)), 2)) AS m1, pow(cos(radians(45.5)), 2) / (1 - e2 * pow(sin(radians(45.5)), 2)) AS m2
          FROM sites, (SELECT 2 / 298.257222101::DOUBLE - 1 / pow(298.257222101::DOUBLE, 2) AS e2, sqrt(2 / 298.257222101::DOUBLE - 1 / pow(298.257222101::DOUBLE, 2)) AS e) k
          WHERE lat IS NOT NULL) t1) t2) t3""",
    "chip_rgb": """SELECT vec_id, CAST(px AS INT) AS px, round(least(greatest(max(CASE WHEN b = 2 THEN v END) / 3000.0::DOUBLE, 0), 1), 6) AS red,
        round(least(greatest(max(CASE WHEN b = 1 THEN v END) / 3000.0::DOUBLE, 0), 1), 6) AS green,
        round(least(greatest(max(CASE WHEN b = 0 THEN v END) / 3000.0::DOUBLE, 0), 1), 6) AS blue FROM (
         SELECT vec_id, (pos // 16) AS b, pos % 16 AS px, CAST(round(v * 10000) AS INT) AS v FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v,
          generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) t) t2 GROUP BY vec_id, px""",
    "resample": """SELECT site_id AS parcel_id, CAST(j * 8 + i AS INT) AS px, CAST(round_even(
         (coalesce(a.code, 0) * (1 - fx) + coalesce(b.code, 0) * fx) * (1 - fy) + (coalesce(c.code, 0) * (1 - fx) + coalesce(d.code, 0) * fx) * fy, 0) AS INT) AS value
        FROM (SELECT site_id, i, j, CAST(floor(xs) AS BIGINT) AS xi, CAST(floor(ys) AS BIGINT) AS yi, xs - floor(xs) AS fx, ys - floor(ys) AS fy FROM (
         SELECT site_id, i, j, greatest(x0 + (i + 0.5::DOUBLE) * w / 8 - 0.5, 0) AS xs, greatest(y0 + h - (j + 0.5::DOUBLE) * h / 8 - 0.5, 0) AS ys
         FROM sites, range(8) p(i), range(8) q(j)) t0) t
        LEFT JOIN pixels a ON a.x = xi AND a.y = yi LEFT JOIN pixels b ON b.x = xi + 1 AND b.y = yi
        LEFT JOIN pixels c ON c.x = xi AND c.y = yi + 1 LEFT JOIN pixels d ON d.x = xi + 1 AND d.y = yi + 1""",
    "chip_outcomes": """SELECT CASE WHEN blank / 16.0::DOUBLE > 0.3 THEN 'skipped_nodata' ELSE 'extracted' END AS outcome, count(*) AS n FROM (
         SELECT vec_id, count(CASE WHEN m = 0 THEN 1 END) AS blank FROM (
          SELECT vec_id, pos % 16 AS px, max(abs(round(v * 10000))) AS m FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v,
           generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) t GROUP BY vec_id, pos % 16) t2 GROUP BY vec_id) t3 GROUP BY ALL""",
    "encode_chips": """SELECT vec_id, CAST(pos // 16 AS INT) AS band, CAST(sum(CAST(round(v * 10000) AS BIGINT)) AS BIGINT) AS pixel_sum FROM (
         SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) t GROUP BY vec_id, pos // 16""",
    "mock_embed": "SELECT parcel_id, CAST(obs_date AS VARCHAR) AS obs_date, 1.0::DOUBLE AS norm FROM obs",
    "augment": """SELECT t.vec_id, CAST(b AS INT) AS band, CAST(r * 4 + c AS INT) AS px,
         CAST(CASE WHEN (CAST(concat('0x', substr(md5(concat('42:b', CAST(b AS VARCHAR), ':', CAST(t.vec_id AS VARCHAR))), 1, 7)) AS BIGINT) / 268435456.0::DOUBLE) > 0.1 THEN e.value ELSE 0 END AS INT) AS value
        FROM (SELECT vec_id, b, r, c, CASE WHEN (CAST(concat('0x', substr(md5(concat('42:v:', CAST(vec_id AS VARCHAR))), 1, 7)) AS BIGINT) / 268435456.0::DOUBLE) > 0.5 THEN 3 - r ELSE r END AS r2, CASE WHEN (CAST(concat('0x', substr(md5(concat('42:h:', CAST(vec_id AS VARCHAR))), 1, 7)) AS BIGINT) / 268435456.0::DOUBLE) > 0.5 THEN 3 - c ELSE c END AS c2
         FROM embeddings, range(4) x(b), range(4) y(r), range(4) z(c)) t
        JOIN (SELECT vec_id, pos, round(v * 10000) AS value FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v,
         generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) u) e ON e.vec_id = t.vec_id AND e.pos = b * 16 + r2 * 4 + c2""",
    "generated_explanations": """SELECT parcel_id, CASE status WHEN 'GREEN' THEN 'normal' WHEN 'YELLOW' THEN 'warning' WHEN 'RED' THEN 'critical'
         ELSE 'insufficient_data' END AS llm_status, 'low' AS llm_confidence, 'stand-in' AS llm_model FROM fixed_scores""",
    "utm_project": """SELECT site_id, round(500000 + k * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 3) AS x,
         round(k * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 3) AS y FROM (
         SELECT site_id, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta, 0.9996 * 6378137.0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS k,
          n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS a1, 13 * n * n / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS a2, 61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS a3, 49561 * pow(n, 4) / 161280 AS a4 FROM (
          SELECT site_id, n, radians(lon - (least(greatest(floor((lon + 180) / 6) + 1, 1), 60) * 6 - 183)) AS dl,
           tan(radians(lat)) * sqrt(1 + sg * sg) - sg * sqrt(1 + pow(tan(radians(lat)), 2)) AS t FROM (
           SELECT site_id, lat, lon, n, sinh(e * atanh(e * sin(radians(lat)))) AS sg FROM sites,
            (SELECT f / (2 - f) AS n, sqrt(f * (2 - f)) AS e FROM (SELECT 1 / 298.257223563::DOUBLE AS f) q1) q2 WHERE lat IS NOT NULL) t1) t2) t3""",
    "stream_bin_counts": """SELECT crop_name, CAST(DATE '2024-04-15' + CAST(floor((obs_date - DATE '2024-04-15') / 14) AS INT) * 14 AS VARCHAR) AS bin_start,
        count(*) AS n_obs FROM obs GROUP BY ALL""",
    "stream_intake": """SELECT parcel_id, CAST(obs_date AS VARCHAR) AS obs_date FROM obs""",
    "stream_scores": f"SELECT {SCORE_COLUMNS} FROM fixed_scores",
}


SELECTS |= source_queries.SELECTS
SELECTS |= {
    "linear_head_totals": f"""SELECT CAST(crop_class_id AS INT) AS crop_class_id, CAST(count(*) AS DOUBLE) AS total
        FROM ({SELECTS["stratified_split"]}) s WHERE split = 'train' GROUP BY crop_class_id""",
    "knn_all_cells": SELECTS["knn_all"],
    "spatial_knn_cells": SELECTS["spatial_knn"],
    "crop_profiles_large": SELECTS["crop_profiles"],
    "parcel_scores_salted": SELECTS["parcel_scores_fixed"],
    "parcel_scores_bucketed": SELECTS["parcel_scores_fixed"],
}
SELECTS["utm_project_south"] = f"SELECT site_id, x, round(10000000 - y, 3) AS y FROM ({SELECTS['utm_project']}) north"


SELECTS |= table_queries.selects(SELECTS)


def oracle_sql() -> dict[str, str]:
    return {name: _sql(select) for name, select in SELECTS.items()}
