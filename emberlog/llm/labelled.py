"""Bounded, deterministic samples of labelled rows, and the fold that no model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most `rows` labelled ids outside the held-out fold, in an order free of content.

    The ids are those of the smallest hashes, so the sample is the same at every run and needs no collect.
    Of several labels for one id the largest holds; rows without id or label are left out.
    """
    picked = labels.select(F.col(id_col).alias("l_id"), F.col(label).cast("int").alias("label")).dropna()
    picked = picked.filter(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)  # bounds the broadcast below
    keyed = docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return keyed.join(F.broadcast(picked), F.col("d_id") == F.col("l_id")).select("d_id", "text", "label")
