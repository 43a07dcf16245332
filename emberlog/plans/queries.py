"""Every registered analytical query, as a function of a Store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.scalars import average, f1, percent, ratio, rounded
from ..operators import behavior, episodes, evaluation, evidence, star, windows
from ..operators.evaluation import is_anomaly, is_normal, thresholds
from ..sources import log_lines
from ..sources.replay import envelopes
from ..sources.scratch import scratch_path
from ..streaming import job
from .store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

Z_SWEEP = [1.5, 2.0, 2.5, 3.0, 3.5]
Z_LONG_SWEEP = [1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0]
GLOBAL_Z_SWEEP = [1.5, 2.0, 2.5, 3.0]
DURATIONS = [15, 30, 45, 60, 90, 120]
GRID_DURATIONS, GRID_EPS = [10, 15, 20, 30], [0.50, 0.75, 1.00, 1.25]
EPISODE_GAPS = [1, 2, 5, 10, 15, 20, 30]
#: Episode that the queries on a single one take.
EPISODE = 1
WINDOW_COLUMNS = ["block_id", "window_start", "window_end", "event_count", "error_count", "warn_count"]


def query(f: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Store(spark, sf_dir))
    return f


def _if(cond, value="block_id"):
    return F.when(cond, F.col(value))


def _n(cond):
    return F.count_if(F.coalesce(cond, F.lit(False)))


# -- raw events ---------------------------------------------------------------------------------------


@query
def raw_count(s):
    return s.count(s.raw, "raw_rows")


@query
def raw_unique_blocks(s):
    return s.raw.filter("block_id is not null").agg(F.count_distinct("block_id").alias("unique_blocks"))


@query
def level_distribution(s):
    return s.raw.groupBy("level").agg(F.count("*").alias("event_count")).orderBy(F.desc("event_count"), "level")


@query
def severity_text_search(s):
    hit = F.contains(F.upper("raw_line"), F.lit("ERROR")) | F.contains(F.upper("raw_line"), F.lit("WARN"))
    return s.raw.filter(hit).select("level", "raw_line").orderBy("raw_line").limit(30)


@query
def top_components(s):
    return s.raw.groupBy("component").agg(F.count("*").alias("event_count")).orderBy(F.desc("event_count"), "component").limit(20)


@query
def sample_events(s):
    return s.raw.filter("block_id is not null").select("raw_line", "level", "component", "message", "block_id", "event_time").orderBy("event_time", "raw_line").limit(20)


@query
def event_time_range(s):
    return s.raw.agg(F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))


@query
def raw_log_events(s):
    return s.raw


# -- block windows ------------------------------------------------------------------------------------


@query
def windows_count(s):
    return s.count(s.windows, "window_rows")


@query
def windowed_metrics(s):
    return s.windows


@query
def latest_windows(s):
    return s.windows.select(WINDOW_COLUMNS).orderBy(F.desc("window_start"), "block_id").limit(20)


@query
def window_severity_summary(s):
    return s.windows.agg(
        F.count("*").alias("total_windows"), _n(F.col("error_count") > 0).alias("windows_with_errors"), _n(F.col("warn_count") > 0).alias("windows_with_warnings"),
        F.max("error_count").alias("max_errors_in_window"), F.max("warn_count").alias("max_warnings_in_window"),
    )


@query
def severity_windows(s):
    return s.windows.filter("error_count > 0 or warn_count > 0").select(WINDOW_COLUMNS).orderBy(F.desc("error_count"), F.desc("warn_count"))


@query
def window_volume_stats(s):
    c = "event_count"
    return s.windows.agg(F.min(c).alias("min_events"), average(c, 6).alias("avg_events"), F.median(c).alias("median_events"), F.max(c).alias("max_events"), F.round(F.stddev_samp(c), 6).alias("stddev_events"))


@query
def static_incidents(s):
    return s.static_incidents.drop("detected_at")


# -- labels -------------------------------------------------------------------------------------------


@query
def labels_count(s):
    return s.count(s.labels, "total_rows")


@query
def label_histogram(s):
    return s.labels.groupBy("label").agg(F.count("*").alias("count")).orderBy("label")


@query
def label_quality(s):
    return s.labels.agg(_n(F.col("block_id").isNull() | (F.trim("block_id") == "")).alias("blank_block_ids"), _n(~F.col("label").isin("Normal", "Anomaly")).alias("unexpected_labels"))


@query
def label_distribution(s):
    return s.labels.groupBy("label").agg(F.count("*").alias("block_count")).orderBy(F.desc("block_count"))


@query
def label_sample(s):
    return s.labels.orderBy("block_id").limit(20)


@query
def label_duplicates(s):
    return s.labels.groupBy("block_id").agg(F.count("*").alias("label_rows")).filter("label_rows > 1").orderBy(F.desc("label_rows"))


@query
def stream_by_label(s):
    return s.labelled(s.raw).groupBy("label").agg(F.count_distinct("block_id").alias("unique_blocks"), F.count("*").alias("log_events")).orderBy(F.desc("unique_blocks"))


@query
def label_coverage(s):
    seen = s.raw.filter("block_id is not null").select("block_id").distinct().join(s.labels, "block_id", "left")
    return seen.agg(F.count("*").alias("streamed_blocks"), _n(is_normal()).alias("normal_blocks"), _n(is_anomaly()).alias("anomaly_blocks"), _n(F.col("label").isNull()).alias("unmatched_blocks"))


@query
def anomalous_blocks_top(s):
    rows = s.raw.join(s.labels.filter(is_anomaly()), "block_id").groupBy("block_id", "label")
    out = rows.agg(F.count("*").alias("event_count"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))
    return out.orderBy(F.desc("event_count"), "block_id").limit(30)


@query
def anomalous_sequences(s):
    rows = s.raw.join(s.labels.filter(is_anomaly()), "block_id")
    return rows.select("block_id", "event_time", "component", "level", "message").orderBy("block_id", "event_time", "component", "level", "message").limit(200)


@query
def window_stats_by_label(s):
    c = "event_count"
    return s.labelled(s.windows).groupBy("label").agg(
        F.count("*").alias("window_count"), average(c, 2).alias("avg_events_per_window"), F.median(c).alias("median_events_per_window"),
        F.max(c).alias("max_events_per_window"), F.round(F.stddev_samp(c), 2).alias("stddev_events"),
    )


@query
def largest_windows(s):
    return s.labelled(s.windows).select("label", *WINDOW_COLUMNS).orderBy(F.desc("event_count"), "block_id", "window_start").limit(30)


# -- z-scores over all windows ------------------------------------------------------------------------


@query
def global_zscore_top(s):
    rows = windows.global_zscores(s.windows).join(s.labels, "block_id", "left")
    top = rows.orderBy(F.abs("z").desc_nulls_first(), "block_id", "window_start").limit(30)
    return top.select("block_id", "label", "event_count", F.round("z", 2).alias("z_score"), "window_start", "window_end")


@query
def global_zscore_sweep(s):
    blocks = windows.global_zscores(s.windows).groupBy("block_id").agg(F.max(F.abs("z")).alias("max_z"))
    rows = thresholds(s.labelled(blocks), "threshold", GLOBAL_Z_SWEEP)
    over = F.col("max_z") >= F.col("threshold")
    out = rows.groupBy("threshold").agg(_n(over).alias("flagged_blocks"), _n(over & is_anomaly()).alias("true_anomalies"), _n(over & is_normal()).alias("false_positives"))
    return out.orderBy("threshold")


@query
def block_features_top(s):
    rows = s.labelled(behavior.message_features(s.raw))
    rank = F.when(is_anomaly(), 0).otherwise(1)
    return rows.orderBy(rank, F.desc("total_events"), "block_id").limit(50).select("block_id", "label", "total_events", "unique_components", "unique_messages", "lifetime_seconds")


@query
def feature_comparison(s):
    return s.labelled(behavior.message_features(s.raw)).groupBy("label").agg(
        F.count("*").alias("blocks"), average("total_events", 2).alias("avg_total_events"), average("unique_components", 2).alias("avg_unique_components"),
        average("unique_messages", 2).alias("avg_unique_messages"), average("lifetime_seconds", 2).alias("avg_lifetime_seconds"), F.median("lifetime_seconds").alias("median_lifetime_seconds"),
    )


@query
def scale_baseline(s):
    parts = [s.count(s.raw, "raw_rows"), s.count(s.windows, "window_rows"), s.count(s.static_incidents, "incident_rows"), s.raw.agg(F.count_distinct("block_id").alias("unique_blocks"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query
def recovery_counts(s):
    return s.raw.agg(F.count("*").alias("raw_rows"), F.count_distinct("block_id").alias("unique_blocks"))


# -- component minutes --------------------------------------------------------------------------------


@query
def component_window_activity(s):
    return s.activity


@query
def component_integrity(s):
    raw = s.raw.filter("event_time is not null and component is not null").agg(F.count("*").alias("raw_eligible_events"))
    both = raw.crossJoin(s.activity.agg(F.sum("event_count").alias("aggregated_events")))
    return both.withColumn("difference", F.col("raw_eligible_events") - F.col("aggregated_events"))


@query
def component_window_extent(s):
    return s.activity.agg(F.count("*").alias("component_window_rows"), F.count_distinct("component").alias("unique_components"), F.min("window_start").alias("first_window"), F.max("window_end").alias("last_window"))


@query
def component_window_sample(s):
    return s.activity.orderBy("window_start", "component").limit(30)


@query
def component_history(s):
    c = "event_count"
    return s.activity.groupBy("component").agg(
        F.count("*").alias("n_windows"), F.sum(c).alias("total_events"), average(c, 2).alias("avg_events_per_window"), F.median(c).alias("median_events_per_window"),
        F.max(c).alias("max_events_per_window"), F.round(F.stddev_samp(c), 2).alias("stddev_events"),
    ).orderBy(F.desc("n_windows"), "component")


@query
def history_buckets(s):
    n = F.col("n_windows")
    bucket = F.when(n < 10, "<10").when(n < 20, "10-19").when(n < 50, "20-49").otherwise("50+")
    rows = s.activity.groupBy("component").agg(F.count("*").alias("n_windows")).groupBy(bucket.alias("window_history_bucket")).agg(F.count("*").alias("components"))
    rank = F.array_position(F.array(*[F.lit(x) for x in ("<10", "10-19", "20-49", "50+")]), F.col("window_history_bucket"))
    return rows.orderBy(rank)


@query
def component_rolling_stats(s):
    return s.rolling.withColumn("rolling_mean", F.round("rolling_mean", 6)).withColumn("rolling_stddev", F.round("rolling_stddev", 6))


@query
def component_zscores(s):
    return s.zscores


@query
def zscore_scored_counts(s):
    return s.zscores.agg(F.count("*").alias("scored_observations"), F.count_distinct("component").alias("scored_components"), F.min("window_start").alias("first_scored_window"), F.max("window_start").alias("last_scored_window"))


@query
def zscore_by_component(s):
    z = "z_score"
    return s.zscores.groupBy("component").agg(
        F.count("*").alias("scored_windows"), average(z, 3).alias("avg_z_score"), F.round(F.min(z), 3).alias("min_z_score"), F.round(F.max(z), 3).alias("max_z_score"), F.round(F.max(F.abs(z)), 3).alias("max_abs_z_score")
    ).orderBy(F.desc("max_abs_z_score"), "component")


@query
def zscore_outliers(s):
    return s.zscores.drop("error_count", "warn_count").orderBy(F.abs("z_score").desc(), "component", "window_start").limit(50)


@query
def zscore_threshold_distribution(s):
    rows = thresholds(s.zscores, "threshold", Z_SWEEP)
    over = F.abs("z_score") >= F.col("threshold")
    out = rows.groupBy("threshold").agg(_n(over).alias("flagged_component_windows"), F.count("*").alias("all"))
    return out.select("threshold", "flagged_component_windows", percent("flagged_component_windows", "all").alias("flagged_percent")).orderBy("threshold")


@query
def zscore_block_candidates(s):
    return s.zblocks


def _block_peaks(s):
    """Each candidate block's largest |z|: distinct blocks over a threshold are blocks whose peak is."""
    return s.labelled(s.zblocks.groupBy("block_id").agg(F.max(F.abs("z_score")).alias("peak")))


def _sweep(s, values):
    rows = thresholds(_block_peaks(s), "threshold", values)
    over = F.col("peak") >= F.col("threshold")
    return rows.groupBy("threshold").agg(_n(over).alias("flagged"), _n(over & is_anomaly()).alias("hits"), _n(over & is_normal()).alias("misses"))


@query
def zscore_block_sweep(s):
    return _sweep(s, Z_SWEEP).select("threshold", F.col("flagged").alias("flagged_blocks"), F.col("hits").alias("true_anomaly_blocks"), F.col("misses").alias("false_positive_blocks")).orderBy("threshold")


@query
def zscore_precision_recall(s):
    total = s.labels.agg(_n(is_anomaly()).alias("total_anomaly_blocks"))
    rows = _sweep(s, Z_LONG_SWEEP).crossJoin(F.broadcast(total))
    return rows.select(
        "threshold", F.col("flagged").alias("flagged_blocks"), F.col("hits").alias("true_positives"), F.col("misses").alias("false_positives"), "total_anomaly_blocks",
        percent("hits", "flagged").alias("precision_pct"), percent("hits", "total_anomaly_blocks").alias("recall_pct"),
    ).orderBy("threshold")


@query
def zscore_direction(s):
    rows = s.labelled(s.zblocks).groupBy(windows.direction(F.col("z_score")).alias("z_direction")).agg(
        F.count("*").alias("component_block_rows"), F.count_distinct("block_id").alias("unique_blocks"),
        F.count_distinct(_if(is_anomaly())).alias("anomaly_blocks"), F.count_distinct(_if(is_normal())).alias("normal_blocks"),
    )
    rank = F.when(F.col("z_direction") == "POSITIVE_SPIKE", 1).when(F.col("z_direction") == "NEGATIVE_DROP", 2).otherwise(3)
    return rows.withColumn("anomaly_percent", percent("anomaly_blocks", "unique_blocks")).orderBy(rank)


# -- block behaviour ----------------------------------------------------------------------------------


@query
def block_population(s):
    return s.raw.filter("block_id is not null").agg(
        F.count("*").alias("total_events"), F.count_distinct("block_id").alias("unique_blocks"), F.count_distinct("component").alias("unique_components"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event")
    )


@query
def block_features(s):
    return s.features


@query
def block_features_summary(s):
    return s.features.agg(
        F.count("*").alias("feature_rows"), F.count_distinct("block_id").alias("unique_blocks"), average("event_count", 2).alias("avg_events_per_block"), F.median("event_count").alias("median_events_per_block"),
        F.max("event_count").alias("max_events_per_block"), average("component_count", 2).alias("avg_components_per_block"), F.max("component_count").alias("max_components_per_block"),
        F.sum("error_count").alias("total_errors"), F.sum("warn_count").alias("total_warnings"),
    )


@query
def most_active_blocks(s):
    return s.features.drop("first_event_time", "last_event_time").orderBy(F.desc("event_count"), "block_id").limit(30)


@query
def features_by_label(s):
    return s.labelled(s.features).groupBy("label").agg(
        F.count_distinct("block_id").alias("blocks"), average("event_count", 2).alias("avg_event_count"), F.median("event_count").alias("median_event_count"), average("component_count", 2).alias("avg_component_count"),
        average("error_count", 2).alias("avg_error_count"), average("warn_count", 2).alias("avg_warn_count"), average("active_duration_seconds", 2).alias("avg_active_duration_seconds"),
    ).orderBy("label")


@query
def label_stats(s):
    names = ["event_count", "component_count", "error_count", "warn_count", "active_duration_seconds"]
    return s.labelled(s.features).groupBy("label").agg(*[average(c, 9).alias(f"avg_{c}") for c in names]).orderBy("label")


@query
def block_derived(s):
    return s.derived


def _derived_figures(rows):
    return [
        F.count("*").alias("blocks"), average("events_per_second", 4).alias("avg_events_per_second"), average("events_per_component", 4).alias("avg_events_per_component"), average("component_diversity", 4).alias("avg_component_diversity"),
        F.sum("short_lived_flag").alias("short_lived_blocks"), percent(F.sum("short_lived_flag"), F.count("*")).alias("short_lived_percent"),
    ]


@query
def derived_summary(s):
    return s.derived.agg(*_derived_figures(s.derived))


@query
def derived_by_label(s):
    rows = s.labelled(s.derived)
    return rows.groupBy("label").agg(*_derived_figures(rows), average("active_duration_seconds", 2).alias("avg_duration_seconds")).orderBy("label")


@query
def feature_percentiles(s):
    at = lambda c, p, places: rounded(F.percentile(c, F.lit(p)), places)
    return s.labelled(s.derived).groupBy("label").agg(
        at("events_per_second", 0.25, 4).alias("eps_p25"), at("events_per_second", 0.5, 4).alias("eps_median"), at("events_per_second", 0.75, 4).alias("eps_p75"),
        at("active_duration_seconds", 0.25, 2).alias("duration_p25"), at("active_duration_seconds", 0.5, 2).alias("duration_median"), at("active_duration_seconds", 0.75, 2).alias("duration_p75"),
        at("component_diversity", 0.5, 4).alias("diversity_median"), average("component_diversity", 4).alias("diversity_avg"),
    ).orderBy("label")


def _observed_anomalies(s):
    seen = s.labels.filter(is_anomaly()).join(s.derived.select("block_id"), "block_id", "left_semi")
    return F.broadcast(seen.agg(F.count("*").alias("total_anomalies")))


@query
def duration_sweep(s):
    rows = thresholds(s.labelled(s.derived), "duration_threshold", DURATIONS).filter("active_duration_seconds <= duration_threshold")
    out = rows.groupBy("duration_threshold").agg(F.count("*").alias("flagged_blocks"), _n(is_anomaly()).alias("true_positives"), _n(is_normal()).alias("false_positives")).crossJoin(_observed_anomalies(s))
    return out.withColumn("precision_pct", percent("true_positives", "flagged_blocks")).withColumn("recall_pct", percent("true_positives", "total_anomalies")).drop("total_anomalies").orderBy("duration_threshold")


@query
def duration_eps_grid(s):
    rows = thresholds(thresholds(s.labelled(s.derived), "duration_threshold", GRID_DURATIONS), "eps_threshold", GRID_EPS)
    rows = rows.filter("active_duration_seconds <= duration_threshold and events_per_second >= eps_threshold")
    out = rows.groupBy("duration_threshold", "eps_threshold").agg(F.count("*").alias("flagged_blocks"), _n(is_anomaly()).alias("true_positives"), _n(is_normal()).alias("false_positives")).crossJoin(_observed_anomalies(s))
    p, r = ratio("true_positives", "flagged_blocks"), ratio("true_positives", "total_anomalies")
    out = out.withColumns({"precision_pct": percent("true_positives", "flagged_blocks"), "recall_pct": percent("true_positives", "total_anomalies"), "f1_score": f1(p, r)})
    return out.drop("total_anomalies").orderBy(F.desc_nulls_first("f1_score"), F.desc_nulls_first("precision_pct"))


@query
def anomaly_scores(s):
    return s.scores


def _rates():
    return [F.count("*").alias("blocks"), _n(is_anomaly()).alias("anomalies"), _n(is_normal()).alias("normals"), percent(_n(is_anomaly()), F.count("*")).alias("anomaly_rate_pct")]


@query
def score_distribution(s):
    return s.labelled(s.scores).groupBy("anomaly_score").agg(*_rates()).orderBy("anomaly_score")


@query
def score_patterns(s):
    rows = s.labelled(behavior.bands(s.scores).filter("anomaly_score >= 2"))
    return rows.groupBy("anomaly_score", "duration_band", "eps_band", "diversity_band").agg(*_rates()).orderBy(F.desc("anomaly_rate_pct"), F.desc("blocks"))


@query
def rule_evaluation(s):
    names = {"A_STRICT_PATTERN": "A", "B_BROAD_EPS": "B", "C_SHORT_LOW_DIVERSITY": "C", "D_HYBRID_PATTERN": "D"}
    each = F.array(*[F.struct(F.lit(n).alias("rule_name"), F.coalesce(behavior.rule(r), F.lit(False)).alias("predicted")) for n, r in names.items()])
    rows = s.labelled(s.derived).select("label", F.inline(each))
    return evaluation.confusion(rows, ["rule_name"], F.col("predicted")).orderBy(F.desc_nulls_first("f1_score"), "rule_name")


@query
def incidents_behavioral(s):
    return s.incidents


@query
def incidents_summary(s):
    return s.incidents.agg(
        F.count("*").alias("incident_rows"), F.count_distinct("block_id").alias("unique_blocks"), _n(F.col("severity") == "HIGH").alias("high_severity"), _n(F.col("severity") == "MEDIUM").alias("medium_severity"),
        average("active_duration_seconds", 2).alias("avg_duration_seconds"), average("events_per_second", 4).alias("avg_events_per_second"), average("component_diversity", 4).alias("avg_component_diversity"),
    )


# -- ranks, quartiles, gaps ---------------------------------------------------------------------------


@query
def incident_ranking(s):
    """Ranks come from counts of rates: only different rates, of four decimals, are ordered together."""
    counts = s.incidents.groupBy("severity", "events_per_second").agg(F.count("*").alias("n"))
    down = F.col("events_per_second").desc_nulls_last()
    values = counts.groupBy("events_per_second").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(down).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.select(F.coalesce("events_per_second", F.lit(-1.0)).alias("v"), (before + 1).alias("overall_rank"))
    dense = counts.select("severity", F.coalesce("events_per_second", F.lit(-1.0)).alias("v"), F.dense_rank().over(Window.partitionBy("severity").orderBy(down)).cast("long").alias("rank_within_severity"))
    rows = s.incidents.withColumn("v", F.coalesce("events_per_second", F.lit(-1.0))).join(values, "v").join(dense, ["severity", "v"])
    columns = ["block_id", "severity", "events_per_second", "component_diversity", "active_duration_seconds", "overall_rank", "rank_within_severity"]
    return rows.select(columns).orderBy("overall_rank", "block_id").limit(30)


def _quartiles(s):
    rows = ordered.number_rows(s.derived.select("block_id", "events_per_second"), F.col("events_per_second").asc_nulls_first(), F.col("block_id"))
    return ordered.ntile(rows, 4, "eps_quartile").select("block_id", "events_per_second", "eps_quartile")


@query
def eps_quartiles(s):
    return _quartiles(s).orderBy(F.desc("eps_quartile"), F.desc_nulls_last("events_per_second"))


@query
def incident_rate_by_quartile(s):
    rows = _quartiles(s).join(s.incidents.select("block_id", F.lit(1).alias("hit")), "block_id", "left")
    out = rows.groupBy("eps_quartile").agg(F.count("*").alias("total_blocks"), F.count("hit").alias("flagged_incidents"))
    return out.withColumn("incident_rate_pct", percent("flagged_incidents", "total_blocks")).orderBy("eps_quartile")


@query
def incident_share_by_quartile(s):
    rows = _quartiles(s).select("block_id", "eps_quartile").join(s.incidents.select("block_id", "severity"), "block_id")
    out = rows.groupBy("eps_quartile").agg(F.count("*").alias("incidents"), _n(F.col("severity") == "HIGH").alias("high_severity"), _n(F.col("severity") == "MEDIUM").alias("medium_severity"))
    share = percent("incidents", F.sum("incidents").over(Window.partitionBy()))  # at most four rows
    return out.withColumn("pct_of_all_incidents", share).orderBy("eps_quartile")


@query
def incident_timeline(s):
    rows = ordered.with_neighbour(s.timeline, "first_event_time", "next_incident_start", -1)
    return rows.select("block_id", "severity", "first_event_time", "last_event_time", "prev_incident_start", F.col("gap_seconds").alias("seconds_since_prev_incident"), "next_incident_start").orderBy("first_event_time", "block_id")


@query
def gap_summary(s):
    g = F.col("gap_seconds")
    return s.timeline.agg(
        F.count("*").alias("incidents"), F.min(g).alias("min_gap_seconds"), average("gap_seconds", 2).alias("avg_gap_seconds"), F.median(g).alias("median_gap_seconds"), F.max(g).alias("max_gap_seconds"),
        _n(g <= 60).alias("within_60_sec"), _n(g > 60).alias("over_60_sec"),
    )


@query
def gap_histogram(s):
    rows = s.timeline.filter("gap_seconds is not null").groupBy("gap_seconds").agg(F.count("*").alias("occurrences"))
    total = F.broadcast(rows.agg(F.sum("occurrences").alias("total")))
    return rows.crossJoin(total).select("gap_seconds", "occurrences", percent("occurrences", "total").alias("pct_of_gaps")).orderBy("gap_seconds")


@query
def episode_threshold_sweep(s):
    return s.timeline.agg(*[(_n(F.col("gap_seconds") > g) + 1).alias(f"episodes_at_{g}_sec") for g in EPISODE_GAPS])


@query
def incident_episodes(s):
    return s.episodes


@query
def episode_members(s):
    return s.members.select("episode_id", "block_id", "severity", "events_per_second", "component_diversity", "first_event_time", "last_event_time", "gap_seconds")


@query
def session_episodes(s):
    rows = s.incidents.join(s.features.select("block_id", "first_event_time"), "block_id")
    return episodes.session_episodes(rows)


@query
def episode_purity(s):
    return episodes.episode_purity(s.members, s.labels)


@query
def high_precision(s):
    rows = s.labelled(s.incidents)
    high = F.col("severity") == "HIGH"
    out = rows.agg(_n(high & is_anomaly()).alias("high_true_positives"), _n(high & is_normal()).alias("high_false_positives"), _n(high).alias("high_flagged"))
    return out.withColumn("high_only_precision_pct", percent("high_true_positives", "high_flagged"))


@query
def severity_precision(s):
    out = s.labelled(s.incidents).groupBy("severity").agg(F.count("*").alias("flagged_blocks"), _n(is_anomaly()).alias("true_positives"), _n(is_normal()).alias("false_positives"))
    rank = F.when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
    return out.withColumn("precision_pct", percent("true_positives", "flagged_blocks")).orderBy(rank)


# -- evidence, star schema, evaluation, root cause ----------------------------------------------------


@query
def incident_evidence(s):
    return evidence.incident_evidence(s.static_incidents, s.raw)


@query
def evidence_behavioral(s):
    return s.evidence


@query
def dim_block(s):
    return s.dims[0]


@query
def dim_date(s):
    return s.dims[1]


@query
def dim_component(s):
    return s.dims[2]


@query
def fact_incident_events(s):
    return star.fact_incident_events(s.static_incidents, s.raw, *s.dims).drop("loaded_at")


@query
def detector_evaluation(s):
    return evaluation.detector_evaluation(s.incidents, s.labels, s.raw)


@query
def detector_evaluation_static(s):
    return evaluation.detector_evaluation(s.static_incidents, s.labels, s.raw)


@query
def rca_evidence(s):
    first = F.broadcast(s.incidents.agg(F.min("block_id").alias("block_id")))
    return s.evidence.join(first, "block_id").orderBy("event_time")


@query
def rca_episode_metadata(s):
    return s.episodes.filter(F.col("episode_id") == EPISODE)


@query
def rca_component_breakdown(s):
    return evidence.component_breakdown(s.evidence, s.members, EPISODE)


@query
def rca_sample(s):
    return evidence.episode_sample(s.evidence, s.members, EPISODE)


@query
def rca_episode_purity(s):
    return evidence.labelled_purity(s.members, s.labels, EPISODE)


@query
def labels_csv_load(s):
    path = scratch_path(s.spark, "labels")
    s.labels.select("block_id", "label").write.option("header", True).option("quoteAll", True).csv(path)
    return log_lines.load_labels_csv(s.spark, path)


# -- streaming, run over what is there ----------------------------------------------------------------


def _streamed(s, name, schema):
    out, inbox, checkpoints = (scratch_path(s.spark, x) for x in ("stream", "inbox", "checkpoints"))
    lines = log_lines.synthetic_lines(s.spark.read.parquet(f"{s.sf_dir}/events.parquet")).select("raw_line")
    envelopes(lines).write.text(inbox)
    for q in job.run(job.read_folder(s.spark, inbox), out, checkpoints, once=True):
        q.awaitTermination()
    return job.stored(s.spark, f"{out}/{name}", schema.replace("timestamp_ntz", "timestamp"))


@query
def stream_parse(s):
    return log_lines.at_rest(_streamed(s, "raw_events", log_lines.RAW_SCHEMA)).drop("batch_id")


@query
def stream_windowed(s):
    return log_lines.at_rest(job.latest(_streamed(s, "windowed_metrics", log_lines.WINDOW_SCHEMA)))


@query
def stream_incidents(s):
    return log_lines.at_rest(job.latest(_streamed(s, "incidents", log_lines.INCIDENT_SCHEMA)).drop("detected_at"))
