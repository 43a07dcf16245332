"""Command: the streaming job, configured by environment, until a query ends."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..sources.session import build_spark
from .job import read_folder, read_kafka, run


def configured(env: dict[str, str]) -> dict[str, str]:
    """Settings with their defaults. LOG_INBOX, if set, is a folder of envelopes to read instead of the topic."""
    return {
        "servers": env.get("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"), "topic": env.get("KAFKA_TOPIC", "log-events"), "starting": env.get("KAFKA_STARTING_OFFSETS", "latest"),
        "inbox": env.get("LOG_INBOX", ""), "out": env.get("LOG_TABLES", "log_tables"), "checkpoints": env.get("LOG_CHECKPOINTS", "log_checkpoints"), "once": env.get("LOG_ONCE", ""),
    }


def messages(spark: SparkSession, settings: dict[str, str]) -> DataFrame:
    if settings["inbox"]:
        return read_folder(spark, settings["inbox"])
    return read_kafka(spark, settings["servers"], settings["topic"], settings["starting"])


def main(env: dict[str, str] | None = None) -> int:
    settings = configured(dict(os.environ) if env is None else env)
    spark = build_spark("log-stream")
    queries = run(messages(spark, settings), settings["out"], settings["checkpoints"], bool(settings["once"]))
    if settings["once"]:
        for q in queries:
            q.awaitTermination()
    else:
        spark.streams.awaitAnyTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
