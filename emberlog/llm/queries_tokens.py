"""Registered query of packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def tokenizer_path() -> str:
    """Where the public byte-level BPE file lies; every machine has the package that holds it."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
