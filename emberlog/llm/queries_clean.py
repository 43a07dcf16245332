"""Registered query of benchmark decontamination, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, table
from .decontaminate import WINDOW, contamination


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k_id", "k_hash")


def _words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def contamination_sql(documents: str = "documents") -> str:
    """WITH clauses (without WITH) whose last, contamination, has op10's rows over `documents`."""
    n = WINDOW
    return f"""
d AS (SELECT doc_id, {_words("text")} AS words FROM {documents}),
i AS (SELECT item_id, {_words("text")} AS words FROM benchmark),
w AS (
  SELECT DISTINCT item_id, array_to_string(words[s : s + {n} - 1], ' ') AS win, least(len(words), {n}) AS size
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {n} + 1, 1) + 1)) AS s FROM i WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT size FROM w),
cand AS (
  SELECT doc_id, s, size, array_to_string(words[s : s + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM d, sizes WHERE len(words) >= size)
),
occ AS (SELECT DISTINCT doc_id, s, cand.size, item_id FROM cand JOIN w USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM occ) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id
),
contamination AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
         sha256(coalesce(ids, '')) AS items_sha256,
         coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
  FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
)"""


QUERIES = {"op10_decontamination": op10_decontamination}
SQL = {"op10_decontamination": f"WITH {contamination_sql()} SELECT * FROM contamination"}
