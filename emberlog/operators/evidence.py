"""Evidence of incidents and episodes for root-cause summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent

EVIDENCE = ["block_id", "severity", "detection_reason", "event_count", "component_count", "active_duration_seconds", "events_per_second", "events_per_component", "component_diversity", "level", "component", "message", "event_time"]


def incident_evidence(incidents: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw events in the windows of statically flagged blocks (half-open range)."""
    r = raw.select("block_id", "level", "component", "message", "event_time", F.date_trunc("minute", "event_time").cast("timestamp_ntz").alias("window_start"))
    return incidents.join(r, ["block_id", "window_start"]).select("block_id", "window_start", "window_end", "event_count", "error_count", "warn_count", "event_time", "level", "component", "message")


def evidence_behavioral(incidents: DataFrame, derived: DataFrame, raw: DataFrame) -> DataFrame:
    i = incidents.select("block_id", "severity", "detection_reason").join(derived, "block_id")
    return i.join(raw.select("block_id", "level", "component", "message", "event_time"), "block_id").select(EVIDENCE)


def block_evidence(evidence: DataFrame, block_id: str) -> DataFrame:
    return evidence.filter(F.col("block_id") == block_id).orderBy("event_time")


def component_breakdown(evidence: DataFrame, members: DataFrame, episode_id: int) -> DataFrame:
    own = members.filter(F.col("episode_id") == episode_id).select("block_id")
    return evidence.join(own, "block_id").groupBy("component", "level").agg(F.count("*").alias("event_count")).orderBy(F.desc("event_count"), "component", "level")


def episode_sample(evidence: DataFrame, members: DataFrame, episode_id: int, size: int = 25) -> DataFrame:
    """Rows of the episode by the order of their digest: a sample that is the same at every run."""
    own = members.filter(F.col("episode_id") == episode_id).select("block_id")
    columns = ["block_id", "event_time", "component", "level", "message"]
    text = F.concat_ws("~", "block_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), "component", "level", "message")
    return evidence.join(own, "block_id").select(columns).withColumn("digest", F.md5(text.cast("binary"))).orderBy("digest").limit(size).drop("digest")


def labelled_purity(members: DataFrame, labels: DataFrame, episode_id: int) -> DataFrame:
    """One row, also for an episode without labels: counts and the share of anomalies."""
    rows = members.filter(F.col("episode_id") == episode_id).join(labels, "block_id")
    out = rows.agg(F.count("*").alias("labelled_blocks"), F.count_if(F.col("label") == "Anomaly").alias("anomaly_blocks"), F.count_if(F.col("label") == "Normal").alias("normal_blocks"))
    return out.withColumn("purity_pct", percent("anomaly_blocks", "labelled_blocks"))
