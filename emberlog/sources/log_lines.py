"""Log lines: schemas, parsing, and the synthetic log that stands in for a recorded one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The line grammar (date, time, pid, level, component, message), the block pattern and the
#: format of date and time put together.
LINE = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([^:]+):\s+(.*)$"
FIELDS = ["log_date", "log_time", "pid", "level", "component", "message"]
BLOCK = r"(blk_-?\d+)"
TIME_FORMAT = "yyMMddHHmmss"

RAW_SCHEMA = "raw_line string, log_date string, log_time string, pid string, level string, component string, message string, block_id string, event_time timestamp_ntz"
WINDOW_SCHEMA = "window_start timestamp_ntz, window_end timestamp_ntz, block_id string, event_count long, error_count long, warn_count long"
INCIDENT_SCHEMA = WINDOW_SCHEMA + ", is_incident boolean, detected_at timestamp"
LABEL_SCHEMA = "block_id string, label string"


def parse_lines(lines: DataFrame, raw: str = "raw_line") -> DataFrame:
    """Parsed events of RAW_SCHEMA, with event_time as timestamp; works on batches and streams.

    A line that doesn't match, has an impossible time, or names no block is dropped; of several blocks on a
    line the first counts. A null line is dropped.
    """
    fields = [F.regexp_extract(raw, LINE, i + 1).alias(name) for i, name in enumerate(FIELDS)]
    out = lines.select(F.col(raw).alias("raw_line"), *fields, F.regexp_extract(raw, BLOCK, 1).alias("block_id"))
    time = F.try_to_timestamp(F.concat("log_date", "log_time"), F.lit(TIME_FORMAT))
    return out.withColumn("event_time", time).filter("event_time is not null and block_id <> ''")


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Parsed events of JSON envelopes {"raw", "ingest_ts"}; malformed ones are dropped."""
    return parse_lines(messages.select(F.get_json_object(F.col(value).cast("string"), "$.raw").alias("raw_line")))


def at_rest(events: DataFrame) -> DataFrame:
    """Times as wall-clock values, as tables hold them."""
    kinds = dict(events.dtypes)
    return events.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "timestamp" and c != "detected_at" else F.col(c) for c in events.columns])


def synthetic_lines(events: DataFrame) -> DataFrame:
    """(event_id, raw_line): log lines by integer rules from the events table."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    div = lambda c, n: F.expr(f"{c} div {n}")
    shift = F.when(kind == "click", 1).when((kind == "view") & (u % 15 == 0), 2).otherwise(0)
    part = F.when(u % 5 == 0, (div("event_id", 24) + shift) % 8).otherwise((e * 7 + u) % 8)
    block = F.when(u % 10 == 0, -(1000 + div("event_id", 24))).when(u % 10 == 5, -(900000 + div("event_id", 112))).otherwise(u)
    level = F.when(kind == "error", F.when(e % 3 == 0, "ERROR").otherwise("WARN")).otherwise("INFO")
    time = F.timestamp_seconds(F.unix_seconds(F.lit("2008-11-09 20:35:18+00:00").cast("timestamp")) + div("event_id", 8))
    stamp = F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyMMdd HHmmss")
    message = F.concat(F.lit("Event "), kind, F.lit(" block blk_"), block.cast("string"))
    line = F.concat_ws(" ", stamp, (e % 900 + 1).cast("string"), level, F.concat(F.lit("dfs.C"), part.cast("string"), F.lit(":")), message)
    return events.select("event_id", line.alias("raw_line"))


def raw_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_rest(parse_lines(synthetic_lines(spark.read.parquet(f"{sf_dir}/events.parquet")).select("raw_line")))


def ground_truth_labels(raw: DataFrame) -> DataFrame:
    """(block_id, label): one row a labelled block, by the number in its name."""
    n = F.abs(F.regexp_extract("block_id", r"(-?\d+)$", 1).cast("long"))
    blocks = raw.select("block_id").distinct().withColumn("n", n).filter("n % 23 <> 0")
    return blocks.select("block_id", F.when(F.col("n") % 7 % 3 == 0, F.when(F.col("n") % 7 == 6, "Normal").otherwise("Anomaly")).otherwise("Normal").alias("label"))


def load_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a CSV file with a header, by position; quotes and outer blanks go, a bad row fails the load."""
    read = spark.read.schema(LABEL_SCHEMA).options(header=True, quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST", enforceSchema=True)
    return read.csv(path).select(F.trim("block_id").alias("block_id"), F.trim("label").alias("label"))
