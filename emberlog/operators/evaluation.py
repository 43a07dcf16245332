"""Detector quality: confusion counts, precision, recall, F1, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import f1, percent, ratio

def is_anomaly() -> Column:
    return F.col("label") == "Anomaly"


def is_normal() -> Column:
    return F.col("label") == "Normal"


def thresholds(df: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Each row once for each threshold: an array that is exploded, not a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def detector_evaluation(detected: DataFrame, labels: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: all detected blocks against the observed anomalies; shares are 0.0 where they aren't defined.

    Unlabelled detections count as false positives.
    """
    seen = raw.filter("block_id is not null").select("block_id").distinct()
    actual = labels.filter(is_anomaly()).select("block_id").distinct().join(seen, "block_id", "left_semi").withColumn("a", F.lit(1))
    found = detected.filter("block_id is not null").select("block_id").distinct().withColumn("d", F.lit(1))
    both = actual.join(found, "block_id", "full_outer")
    n = both.agg(
        F.count("d").alias("detected_blocks"), F.count("a").alias("actual_anomalies"), F.count(F.col("a") + F.col("d")).alias("true_positives"),
        F.count_if(F.col("a").isNull()).alias("false_positives"), F.count_if(F.col("d").isNull()).alias("false_negatives"),
    ).crossJoin(seen.agg(F.count("*").alias("blocks_seen")))
    p, r = F.coalesce(ratio("true_positives", "detected_blocks"), F.lit(0.0)), F.coalesce(ratio("true_positives", "actual_anomalies"), F.lit(0.0))
    return n.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.coalesce(f1(p, r, 6), F.lit(0.0)).alias("f1_score"))


def confusion(df: DataFrame, by: list[str], predicted: Column) -> DataFrame:
    rows = df.groupBy(*by).agg(
        F.count_if(predicted & is_anomaly()).alias("true_positives"), F.count_if(predicted & is_normal()).alias("false_positives"),
        F.count_if(~predicted & is_anomaly()).alias("false_negatives"), F.count_if(~predicted & is_normal()).alias("true_negatives"),
    )
    flagged = F.col("true_positives") + F.col("false_positives")
    actual = F.col("true_positives") + F.col("false_negatives")
    return rows.select(
        "*", flagged.alias("flagged_blocks"), percent("true_positives", flagged).alias("precision_pct"), percent("true_positives", actual).alias("recall_pct"),
        f1(ratio("true_positives", flagged), ratio("true_positives", actual)).alias("f1_score"),
    )
