"""Star schema refresh: idempotent upserts by join, with stable surrogate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import number_rows


def _keyed(new: DataFrame, target: DataFrame | None, natural: str, key: str) -> DataFrame:
    """Rows of new with keys that follow the target's largest, in the order of the natural key."""
    rows = number_rows(new, F.col(natural)).drop("part")
    if target is None:
        return rows.withColumn(key, F.col("rn").cast("long")).drop("rn")
    top = target.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    return rows.crossJoin(F.broadcast(top)).withColumn(key, (F.col("rn") + F.col("top")).cast("long")).drop("rn", "top")


def dim_block(labels: DataFrame, raw: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Labelled blocks: labels are replaced, times kept where no new ones are seen, new blocks get new keys."""
    known = labels.filter("block_id is not null").groupBy("block_id").agg(F.max("label").alias("ground_truth_label"))
    seen = raw.filter("block_id is not null").groupBy("block_id").agg(F.min("event_time").alias("first_seen_at"), F.max("event_time").alias("last_seen_at"))
    source = known.join(seen, "block_id", "left")
    columns = ["block_key", "block_id", "ground_truth_label", "first_seen_at", "last_seen_at"]
    if target is None:
        return _keyed(source, None, "block_id", "block_key").select(columns)
    s, t = source.alias("s"), target.alias("t")
    both = t.join(s, "block_id", "left").select(
        "t.block_key", "block_id", F.when(F.col("s.ground_truth_label").isNotNull(), F.col("s.ground_truth_label")).otherwise(F.col("t.ground_truth_label")).alias("ground_truth_label"),
        F.coalesce("s.first_seen_at", "t.first_seen_at").alias("first_seen_at"), F.coalesce("s.last_seen_at", "t.last_seen_at").alias("last_seen_at"),
    )
    new = source.join(target.select("block_id"), "block_id", "left_anti")
    return both.unionByName(_keyed(new, target, "block_id", "block_key").select(columns))


def dim_date(windows: DataFrame, target: DataFrame | None = None) -> DataFrame:
    days = windows.filter("window_start is not null").select(F.to_date("window_start").alias("full_date")).distinct()
    if target is not None:
        days = days.join(target.select("full_date"), "full_date", "left_anti")
    d = F.col("full_date")
    rows = days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "full_date", F.year(d).alias("year_number"), F.quarter(d).alias("quarter_number"),
        F.month(d).alias("month_number"), F.date_format(d, "MMM").alias("month_name"), F.day(d).alias("day_number"), F.date_format(d, "EEE").alias("day_of_week"), (F.weekday(d) >= 5).alias("is_weekend"),
    )
    return rows if target is None else target.unionByName(rows)


def dim_component(raw: DataFrame, target: DataFrame | None = None) -> DataFrame:
    names = raw.filter("component is not null and trim(component) <> ''").select(F.col("component").alias("component_name")).distinct()
    if target is None:
        return _keyed(names, None, "component_name", "component_key").select("component_key", "component_name")
    new = names.join(target.select("component_name"), "component_name", "left_anti")
    return target.unionByName(_keyed(new, target, "component_name", "component_key").select(target.columns))


def latest_windows(incidents: DataFrame) -> DataFrame:
    """One row a block and window: the emission with most events (counts only grow)."""
    order = Window.partitionBy("block_id", "window_start", "window_end").orderBy(F.desc("event_count"), F.desc("error_count"), F.desc("warn_count"))
    return incidents.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


FACT_KEY = ["block_key", "date_key", "component_key", "window_start", "window_end"]


def fact_incident_events(incidents: DataFrame, raw: DataFrame, blocks: DataFrame, dates: DataFrame, components: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Events of each component in each flagged window of each labelled block; rows of the same key are replaced."""
    i = latest_windows(incidents).withColumn("full_date", F.to_date("window_start"))
    i = i.join(blocks.select("block_key", "block_id", "ground_truth_label"), "block_id").join(dates.select("date_key", "full_date"), "full_date")
    r = raw.filter("component is not null").select("block_id", "component", "level", "event_time", F.date_trunc("minute", "event_time").cast("timestamp_ntz").alias("minute"))
    # windows are whole minutes: equality of the truncated time is the half-open range
    rows = i.join(r, (i.block_id == r.block_id) & (i.window_start == r.minute)).drop(r.block_id)
    rows = rows.join(components.withColumnRenamed("component_name", "component"), "component")
    level = F.upper("level")
    hit = F.coalesce(F.col("is_incident") & (F.upper("ground_truth_label") == "ANOMALY"), F.lit(False))
    out = rows.groupBy(
        *FACT_KEY, F.col("event_count").alias("window_event_count"), F.col("error_count").alias("window_error_count"), F.col("warn_count").alias("window_warn_count"), "is_incident", hit.alias("is_true_positive")
    ).agg(
        F.count("event_time").alias("component_event_count"), F.count_if(F.coalesce(level == "ERROR", F.lit(False))).alias("component_error_count"), F.count_if(F.coalesce(level == "WARN", F.lit(False))).alias("component_warn_count")
    ).withColumn("loaded_at", F.current_timestamp())
    return out if target is None else target.join(out.select(*FACT_KEY), FACT_KEY, "left_anti").unionByName(out)
