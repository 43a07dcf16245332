"""The session that commands of this library run in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_spark(name: str, **options: str) -> SparkSession:
    """A session in UTC, as event times are wall-clock values; options and the submit command's settings hold besides."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    for key, value in options.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # also where a session was there already
    return spark
