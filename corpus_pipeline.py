"""Corpus pipeline: toxicity filter, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gets the whole of what its predecessor kept, written as Parquet
and read again; all but the last return the columns of documents. In every stage a null text counts as an empty
one, null ids are allowed, rows repeated in id and text are decided on alike (but exact and near dedup leave one
of them), and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm.common import materialize, table
from emberlog.llm.decontaminate import clean
from emberlog.llm.exact_dedup import keep_exact
from emberlog.llm.jaccard_join import keep_one
from emberlog.llm.packing import pack
from emberlog.llm.queries_tokens import tokenizer_path
from emberlog.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows of docs, doesn't reject."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest id, of each group of equal texts."""
    return keep_exact(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of documents of five-word similarity 0.8 or more."""
    return keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the trained classifier, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
