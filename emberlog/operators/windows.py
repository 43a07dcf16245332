"""Minute windows by block and by component, the static rule, and z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the static rule and the rolling score.
WARN_THRESHOLD = 3
HISTORY = 5
DIRECTION = 3


def count_level(level: str) -> Column:
    """Case-sensitive count of a level."""
    return F.count_if(F.coalesce(F.col("level") == level, F.lit(False)))


def windowed_metrics(events: DataFrame) -> DataFrame:
    """Events, errors and warnings of each block in each minute; works on batches and streams."""
    by = events.groupBy(F.window("event_time", "1 minute"), "block_id")
    counts = by.agg(F.count("*").alias("event_count"), count_level("ERROR").alias("error_count"), count_level("WARN").alias("warn_count"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "block_id", "event_count", "error_count", "warn_count")


def flag_static(windows: DataFrame) -> DataFrame:
    """The windows that the static rule flags, with is_incident and detected_at."""
    hit = (F.col("error_count") > 0) | (F.col("warn_count") >= WARN_THRESHOLD)
    return windows.filter(hit).withColumn("is_incident", F.lit(True)).withColumn("detected_at", F.current_timestamp())


def component_activity(raw: DataFrame) -> DataFrame:
    start = F.date_trunc("minute", F.col("event_time")).cast("timestamp_ntz")
    rows = raw.filter("event_time is not null and component is not null").withColumn("window_start", start)
    counts = rows.groupBy("window_start", "component").agg(F.count("*").alias("event_count"), count_level("ERROR").alias("error_count"), count_level("WARN").alias("warn_count"))
    return counts.select("window_start", (F.col("window_start") + F.expr("interval 1 minute")).alias("window_end"), "component", "event_count", "error_count", "warn_count")


def rolling_stats(activity: DataFrame) -> DataFrame:
    """Count, mean and deviation of a component's HISTORY observed minutes before each, this one excluded."""
    past = Window.partitionBy("component").orderBy("window_start").rowsBetween(-HISTORY, -1)
    return activity.withColumns({
        "history_count": F.count("*").over(past), "rolling_mean": F.avg("event_count").over(past), "rolling_stddev": F.stddev_samp("event_count").over(past),
    })


def zscores(rolling: DataFrame) -> DataFrame:
    z = F.round((F.col("event_count") - F.col("rolling_mean")) / F.col("rolling_stddev"), 3)
    rows = rolling.filter((F.col("history_count") >= HISTORY) & (F.col("rolling_stddev") > 0)).withColumn("z_score", z)
    return rows.withColumn("rolling_mean", F.round("rolling_mean", 2)).withColumn("rolling_stddev", F.round("rolling_stddev", 2))


def zscore_blocks(scores: DataFrame, raw: DataFrame) -> DataFrame:
    """Different blocks with an event of the component in the scored minute.

    Windows are aligned to minutes, so the range join is an equality on the truncated time.
    """
    seen = raw.filter("block_id <> ''").select("component", F.date_trunc("minute", "event_time").cast("timestamp_ntz").alias("window_start"), "block_id").distinct()
    return scores.join(seen, ["component", "window_start"]).select("window_start", "window_end", "component", "event_count", "z_score", "block_id")


def global_zscores(windows: DataFrame) -> DataFrame:
    """Adds the unrounded z-score of event_count over all windows."""
    stats = windows.agg(F.avg("event_count").alias("mean"), F.stddev_samp("event_count").alias("sd"))
    z = (F.col("event_count") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return windows.crossJoin(F.broadcast(stats)).withColumn("z", z).drop("mean", "sd")


def direction(z: Column) -> Column:
    return F.when(z >= DIRECTION, "POSITIVE_SPIKE").when(z <= -DIRECTION, "NEGATIVE_DROP").otherwise("NORMAL_RANGE")
