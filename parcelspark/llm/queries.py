"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm import (
    ann,
    collocations,
    html,
    mixing,
    neardup,
    packing,
    pii,
    quality,
    sharding,
    substrings,
    toxicity,
    whitening,
    windows,
)
from parcelspark.llm.common import table, words


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("draws")).cast("long").alias("taken"),
        "source",
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"), threshold=0.8)
    return found.select("doc_id", "class_id", "class_size")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("row_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = [e.rule for e in quality.estimate(docs, quality.default_rules())]
    text, found = F.col("text"), F.col("found")
    measured = docs.withColumn("found", words(text)).select(
        "doc_id",
        "text",
        "found",
        F.size(found).cast("long").alias("n_words"),
        quality.n_repeat_words(found).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Which rule rejects first depends on the measured order; whether one does, not.
    verdict = F.when(failed, F.lit("base")).otherwise(quality.cascade(text, found, ordered))
    return measured.select(
        "doc_id",
        "n_words",
        quality.word_chars(found).alias("word_chars"),
        quality.n_symbols(text).alias("n_symbols"),
        quality.n_dup_lines(text).alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        verdict.isNull().alias("kept"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs.select("doc_id", "text"), toxicity.learn(docs, labels))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.keep_first(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=16, scale=64, offset=1_000_000)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, covered_pct=80, top=2000)


def op13_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = windows.pack(table(spark, sf_dir, "documents"), capacity=4096)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "source")


# The words of a text in SQL.
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op4_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, sh, count(*) AS c FROM (
    SELECT doc_id, unnest(list_transform(range(greatest(len(w) - 4, least(len(w), 1))),
                                         lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS sh FROM d)
  GROUP BY doc_id, sh),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS k
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM overlap JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM sym UNION SELECT r.doc_id, y.b FROM reach r JOIN sym y ON y.a = r.other),
classes AS (
  SELECT d.doc_id, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS class_id
  FROM d LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM classes""",
    "op6_quality": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (
    SELECT doc_id, i, array_to_string(w[i + 1 : i + 3], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 0))) AS i FROM d))),
rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM win, (VALUES (0), (1), (2)) o(j) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\x0C\\r]')) AS l FROM d),
m AS (
  SELECT d.doc_id, w, l, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[ \\t\\n\\x0B\\x0C\\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 3)) AS table_rows
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR (n_words >= 50 AND len(list_distinct(w)) < 0.1 * n_words)
    OR n_dup_lines > 0.5 * greatest(len(l), 1)
    OR table_rows > 0.5 * greatest(len(l), 1)
    OR (n_words > 0 AND NOT (CAST(word_chars AS DOUBLE) / n_words BETWEEN 2.5 AND 12.0))
    OR n_symbols > 0.1 * greatest(n_words, 1)) AS kept
FROM b""",
    "op10_substrings": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM (
    SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 19, 0))) AS i FROM d))),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
cov AS (
  SELECT doc_id, x, word.i AS i,
    max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY word.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN win USING (doc_id, i)),
kept AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t
  FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_collocations": """
WITH w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
          unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, s, phrase, count(*) AS a FROM (
    SELECT lang, s, unnest(list_transform(range(greatest(len(w) - s + 1, 0)), lambda i: array_to_string(w[i + 1 : i + s], ' '))) AS phrase
    FROM w, (VALUES (1), (2), (3), (4)) sizes(s))
  GROUP BY lang, s, phrase HAVING count(*) >= 30),
cut AS (
  SELECT lang, phrase, s, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS first,
    array_to_string(string_split(phrase, ' ')[k + 1 : s], ' ') AS rest
  FROM f, (VALUES (1), (2), (3)) cuts(k) WHERE k < s),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(string_split(phrase, ' ')[i : i + z - 1], ' ') AS part
    FROM f, (VALUES (2), (3)) sizes(z), (VALUES (1), (2), (3)) starts(i) WHERE z < s AND i + z - 1 <= s)
  GROUP BY lang, part)
SELECT t.lang, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank,
  w.phrase, w.a, l, r, n, score
FROM weakest w JOIN total t ON t.lang = w.lang LEFT JOIN inside i ON i.lang = w.lang AND i.part = w.phrase
WHERE i.longer IS NULL OR 100 * CAST(i.longer AS HUGEINT) < 80 * w.a
QUALIFY rank <= 2000""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_html": op2_html,
    "op3_mixing": op3_mixing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_nearest": op8_nearest,
    "op9_toxicity": op9_toxicity,
    "op10_substrings": op10_substrings,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_windows": op13_windows,
}
