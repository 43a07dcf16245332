"""Streaming: envelopes or lines in, three idempotent sinks out.

Each sink writes a micro-batch to its own batch_id folder and overwrites it on a second attempt, so a restart
from the checkpoint leaves every row once. Windows are emitted again when they change; `latest` reads the
last emission of each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import flag_static, windowed_metrics
from ..sources.log_lines import parse_lines, parse_messages

WATERMARK = "2 minutes"
TRIGGER = "30 seconds"


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """Envelopes of a topic; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return reader.option("subscribe", topic).option("startingOffsets", starting).load()


def read_folder(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Envelopes from text files that appear in a folder, one on a line."""
    reader = spark.readStream.schema("value string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def parsed(messages: DataFrame) -> DataFrame:
    return parse_messages(messages)


def windowed(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Block windows with late data beyond the watermark left out."""
    return windowed_metrics(events.withWatermark("event_time", watermark))


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: a batch replaces what an earlier attempt at it left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = False, trigger: str = TRIGGER) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(batch_sink(path))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()


def run(messages: DataFrame, out: str, checkpoints: str, once: bool = False) -> list[StreamingQuery]:
    """Starts the three queries: raw_events (append), windowed_metrics and incidents (update)."""
    events = parsed(messages)
    counted = windowed(events)
    flagged = flag_static(counted)
    return [
        start(events, f"{out}/raw_events", f"{checkpoints}/raw_events", "append", once),
        start(counted, f"{out}/windowed_metrics", f"{checkpoints}/windowed_metrics", "update", once),
        start(flagged, f"{out}/incidents", f"{checkpoints}/incidents", "update", once),
    ]


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that a sink wrote, with batch_id."""
    return spark.read.schema(f"{schema}, batch_id long").parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """Of each block window, the row of the last batch that emitted it."""
    order = Window.partitionBy("block_id", "window_start", "window_end").orderBy(F.desc("batch_id"))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "batch_id")


__all__ = ["batch_sink", "latest", "parse_lines", "parsed", "read_folder", "read_kafka", "run", "start", "stored", "windowed"]
