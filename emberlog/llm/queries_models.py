"""Registered queries of the trained classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import fit_quality, score_quality
from .toxicity import fit_toxicity, score_toxicity


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_quality": op1_quality, "op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
