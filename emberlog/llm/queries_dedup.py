"""Registered queries of the dedup operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, table
from .exact_dedup import exact_groups
from .jaccard_join import jaccard_classes


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup, "op5_jaccard_join": op5_jaccard_join}
SQL = {"op4_exact_dedup": OP4_SQL}
