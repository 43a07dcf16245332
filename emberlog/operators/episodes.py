"""Incident order, gaps and episodes (gaps and islands), batch and session form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import number_rows, running_total, with_neighbour
from ..functions.scalars import average, percent, seconds_between

#: An incident that starts more than so many seconds after the one before begins an episode.
GAP_SECONDS = 2


def timeline(incidents: DataFrame, features: DataFrame) -> DataFrame:
    """Incidents with their times, numbered by (first_event_time, block_id), and the start before."""
    rows = incidents.join(features.select("block_id", "first_event_time", "last_event_time"), "block_id")
    rows = number_rows(rows, F.col("first_event_time"), F.col("block_id"))
    rows = with_neighbour(rows, "first_event_time", "prev_incident_start")
    return rows.withColumn("gap_seconds", seconds_between("prev_incident_start", "first_event_time"))


def episode_members(line: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """timeline rows with episode_id."""
    new = F.when(F.col("gap_seconds").isNull() | (F.col("gap_seconds") > gap), 1).otherwise(0)
    return running_total(line.withColumn("is_new", new), "is_new", "episode_id")


def incident_episodes(members: DataFrame) -> DataFrame:
    rows = members.groupBy("episode_id").agg(
        F.min("first_event_time").alias("episode_start"), F.max("last_event_time").alias("episode_end"),
        F.count("*").alias("n_incidents"), F.count_distinct("block_id").alias("n_distinct_blocks"),
        F.count_if(F.col("severity") == "HIGH").alias("n_high_severity"), F.count_if(F.col("severity") == "MEDIUM").alias("n_medium_severity"),
        F.sum("event_count").alias("total_events"), average("events_per_second", 4).alias("avg_events_per_second"),
        F.round(F.max("events_per_second"), 4).alias("max_events_per_second"), average("component_diversity", 4).alias("avg_component_diversity"),
    )
    return rows.withColumn("episode_duration_seconds", seconds_between("episode_start", "episode_end"))


def session_episodes(line: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Start, end of starts and size of each episode by session windows; fit for streams.

    Starts are taken as whole seconds, of which the session merges those up to gap apart.
    """
    at = F.date_trunc("second", F.col("first_event_time"))
    rows = line.groupBy(F.session_window(at, f"{gap} seconds")).agg(F.count("*").alias("n_incidents"), F.min("first_event_time").alias("episode_start"), F.max("first_event_time").alias("last_start"))
    return rows.drop("session_window")


def episode_purity(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of anomalies among each episode's labelled blocks."""
    rows = members.join(labels, "block_id").groupBy("episode_id").agg(
        F.count("*").alias("n_blocks"), F.count_if(F.col("label") == "Anomaly").alias("true_positives"), F.count_if(F.col("label") == "Normal").alias("false_positives")
    )
    return rows.withColumn("purity_pct", percent("true_positives", "n_blocks"))
