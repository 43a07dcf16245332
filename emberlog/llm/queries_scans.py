"""Registered queries of the licence, secret and line operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table
from .licenses import DICE, TEMPLATES, licences
from .line_dedup import dropped_lines
from .secrets import secrets


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_candidates", "n_secrets", F.sha2(F.array_join("secrets", "\n").cast("binary"), 256).alias("secrets_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _pairs(words: str) -> str:
    many = f"list_transform(range(1, len({words})), lambda i: {words}[i] || chr(9) || {words}[i + 1])"
    return f"CASE WHEN len({words}) = 1 THEN {words} ELSE list_distinct({many}) END"


OP3_SQL = f"""
WITH t0 AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_quote(a)}, {_quote(b)})" for i, (a, b) in enumerate(TEMPLATES))}) AS v(template, licence, text)),
t1 AS (SELECT template, licence, {_words("text")} AS words FROM t0),
t AS (SELECT template, licence, {_pairs("words")} AS pairs FROM t1),
tb AS (SELECT template, licence, len(pairs) AS size, unnest(pairs) AS pair FROM t),
cut AS (
  SELECT doc_id, 'line' AS kind, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
  UNION ALL
  SELECT doc_id, 'paragraph', regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n') FROM documents
  UNION ALL
  SELECT doc_id, 'sentence', flatten(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_split_to_array(l, '[.!?][ \\t]+')), lambda a: len(a) > 1))
  FROM documents
),
p0 AS (SELECT doc_id, kind, unnest(parts) AS passage, generate_subscripts(parts, 1) AS number FROM cut),
p1 AS (SELECT doc_id, kind, number, {_words("passage")} AS words FROM p0 WHERE kind <> 'paragraph' OR contains(passage, chr(10))),
p AS (SELECT doc_id, kind, number, {_pairs("words")} AS pairs FROM p1 WHERE len(words) > 0),
pb AS (SELECT doc_id, kind, number, len(pairs) AS n, unnest(pairs) AS pair FROM p),
s AS (
  SELECT doc_id, kind, number, licence, template, 2.0 * count(*) / (n + size) AS dice
  FROM pb JOIN tb USING (pair) GROUP BY doc_id, kind, number, n, template, licence, size
),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, number ORDER BY dice DESC, template) AS rank FROM s WHERE dice >= {DICE}),
hits AS (
  SELECT doc_id, count(*) AS n_passages, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, max(dice) AS best_dice
  FROM best WHERE rank = 1 GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_passages, 0) AS n_passages, coalesce(licences, '') AS licences, CAST(round(best_dice, 6) AS DOUBLE) AS best_dice
FROM documents d LEFT JOIN hits USING (doc_id)
"""

QUERIES = {"op3_license_scan": op3_license_scan, "op7_secret_scan": op7_secret_scan, "op8_line_dedup": op8_line_dedup}
SQL = {"op3_license_scan": OP3_SQL}
