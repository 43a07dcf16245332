"""Block behaviour: features, scores, rules, severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, seconds_between

#: Fixed values of features, scores and rules.
COMPONENTS = 8.0
LOW_DIVERSITY = 0.35
SLOW, FAST = 0.75, 1.25
BRIEF, SHORT, MEDIUM = 10, 15, 30
REASON = "SHORT_DURATION_LOW_COMPONENT_DIVERSITY"


def block_features(raw: DataFrame) -> DataFrame:
    level = F.upper("level")
    rows = raw.filter("block_id is not null").groupBy("block_id").agg(
        F.count("*").alias("event_count"),
        F.count_distinct("component").alias("component_count"),
        F.count_distinct("level").alias("level_count"),
        F.count_if(F.coalesce(level == "ERROR", F.lit(False))).alias("error_count"),
        F.count_if(F.coalesce(level.isin("WARN", "WARNING"), F.lit(False))).alias("warn_count"),
        F.min("event_time").alias("first_event_time"),
        F.max("event_time").alias("last_event_time"),
    )
    return rows.withColumn("active_duration_seconds", seconds_between("first_event_time", "last_event_time"))


def message_features(raw: DataFrame) -> DataFrame:
    """Totals, different components and messages, and lifetime of each block."""
    rows = raw.filter("block_id is not null and event_time is not null").groupBy("block_id").agg(
        F.count("*").alias("total_events"), F.count_distinct("component").alias("unique_components"), F.count_distinct("message").alias("unique_messages"),
        F.min("event_time").alias("lo"), F.max("event_time").alias("hi"),
    )
    return rows.withColumn("lifetime_seconds", seconds_between("lo", "hi")).drop("lo", "hi")


def block_derived(features: DataFrame) -> DataFrame:
    """Rates of the features; a block of no duration has no events_per_second."""
    return features.select(
        "block_id", "event_count", "component_count", "active_duration_seconds",
        F.round(ratio("event_count", "active_duration_seconds"), 4).alias("events_per_second"),
        F.round(ratio("event_count", "component_count"), 4).alias("events_per_component"),
        F.round(F.col("component_count") / F.lit(COMPONENTS), 4).alias("component_diversity"),
        F.when(F.col("active_duration_seconds") <= MEDIUM, 1).otherwise(0).alias("short_lived_flag"),
    )


def _d() -> Column:
    return F.col("active_duration_seconds")


def _e() -> Column:
    return F.col("events_per_second")


def _low() -> Column:
    return F.col("component_diversity") < LOW_DIVERSITY


def rule(name: str) -> Column:
    """Rules A to D; unknown where a rate is null and decides."""
    if name == "A":
        return (_d() <= BRIEF) & (_e() < SLOW) & _low()
    if name == "B":
        return (_d() <= BRIEF) & (_e() < FAST) & _low()
    if name == "C":
        return (_d() <= SHORT) & _low()
    return rule("B") | (_d().between(BRIEF + 1, SHORT) & (_e() >= FAST) & ~_low())


def anomaly_scores(derived: DataFrame) -> DataFrame:
    """Score 0 to 6 from duration, rate and diversity; a null rate adds nothing."""
    score = (
        F.when(_d() <= BRIEF, 3).when(_d() <= SHORT, 2).when(_d() <= MEDIUM, 1).otherwise(0)
        + F.when(_e() >= FAST, 2).when(_e() >= SLOW, 1).otherwise(0)
        + F.when(_low(), 1).otherwise(0)
    )
    return derived.drop("short_lived_flag").withColumn("anomaly_score", score)


def bands(scores: DataFrame) -> DataFrame:
    return scores.withColumns({
        "duration_band": F.when(_d() <= BRIEF, "<=10s").when(_d() <= SHORT, "11-15s").when(_d() <= MEDIUM, "16-30s").otherwise(">30s"),
        "eps_band": F.when(_e() >= FAST, ">=1.25").when(_e() >= SLOW, "0.75-1.25").otherwise("<0.75"),
        "diversity_band": F.when(_low(), "<0.35").otherwise(">=0.35"),
    })


def incidents_behavioral(derived: DataFrame) -> DataFrame:
    """Blocks that rule C flags; HIGH where rule D holds for certain, else MEDIUM."""
    return derived.filter(rule("C")).select(
        "block_id", "event_count", "component_count", "active_duration_seconds", "events_per_second", "component_diversity",
        F.lit(True).alias("is_incident"), F.when(rule("D"), "HIGH").otherwise("MEDIUM").alias("severity"),
        F.lit(REASON).alias("detection_reason"), F.current_timestamp().alias("detected_at"),
    )
