"""SQL of the registered queries for a single-node engine, on the same tables."""

from __future__ import annotations

_MINUTE = "date_trunc('minute', event_time)"
_SECONDS = "epoch(date_trunc('second', {1}))::BIGINT - epoch(date_trunc('second', {0}))::BIGINT"


def _diff(a: str, b: str) -> str:
    return "(" + _SECONDS.format(a, b) + ")"


def _round(x: str, places: int) -> str:
    return f"round(CAST({x} AS DECIMAL(38,12)), {places})::DOUBLE"


def _pct(n: str, d: str) -> str:
    return _round(f"100.0::DOUBLE * ({n}) / nullif({d}, 0)", 2)


_A, _N = "label = 'Anomaly'", "label = 'Normal'"
_RULE_B = "(active_duration_seconds <= 10 AND events_per_second < 1.25 AND component_diversity < 0.35)"
_RULE_D = f"({_RULE_B} OR (active_duration_seconds BETWEEN 11 AND 15 AND events_per_second >= 1.25 AND component_diversity >= 0.35))"

BASE = f"""
fields AS (
  SELECT event_id, event_type, TIMESTAMP '2008-11-09 20:35:18' + to_seconds(event_id // 8) AS event_time,
         event_id % 900 + 1 AS pid_n,
         CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'WARN' END ELSE 'INFO' END AS level,
         CASE WHEN user_id % 5 = 0
              THEN (event_id // 24 + CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' AND user_id % 15 = 0 THEN 2 ELSE 0 END) % 8
              ELSE (event_id * 7 + user_id) % 8 END AS k,
         CASE WHEN user_id % 10 = 0 THEN -(1000 + event_id // 24) WHEN user_id % 10 = 5 THEN -(900000 + event_id // 112) ELSE user_id END AS b
  FROM events
),
raw AS (
  SELECT strftime(event_time, '%y%m%d %H%M%S') || ' ' || pid_n || ' ' || level || ' dfs.C' || k || ': Event ' || event_type || ' block blk_' || b AS raw_line,
         strftime(event_time, '%y%m%d') AS log_date, strftime(event_time, '%H%M%S') AS log_time, pid_n::VARCHAR AS pid, level,
         'dfs.C' || k AS component, 'Event ' || event_type || ' block blk_' || b AS message, 'blk_' || b AS block_id, event_time
  FROM fields
),
labels AS (
  SELECT 'blk_' || b AS block_id, CASE WHEN abs(b) % 7 IN (0, 3) THEN 'Anomaly' ELSE 'Normal' END AS label
  FROM (SELECT DISTINCT b FROM fields) WHERE abs(b) % 23 <> 0
),
wm AS (
  SELECT {_MINUTE} AS window_start, {_MINUTE} + INTERVAL 1 MINUTE AS window_end, block_id, count(*) AS event_count,
         count_if(level = 'ERROR')::BIGINT AS error_count, count_if(level = 'WARN')::BIGINT AS warn_count
  FROM raw GROUP BY ALL
),
si AS (SELECT *, true AS is_incident FROM wm WHERE error_count > 0 OR warn_count >= 3),
act AS (
  SELECT {_MINUTE} AS window_start, {_MINUTE} + INTERVAL 1 MINUTE AS window_end, component, count(*) AS event_count,
         count_if(level = 'ERROR')::BIGINT AS error_count, count_if(level = 'WARN')::BIGINT AS warn_count
  FROM raw GROUP BY ALL
),
roll AS (
  SELECT *, count(*) OVER w AS history_count, avg(event_count) OVER w AS rolling_mean, stddev_samp(event_count) OVER w AS rolling_stddev
  FROM act WINDOW w AS (PARTITION BY component ORDER BY window_start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
),
zs AS (
  SELECT window_start, window_end, component, event_count, error_count, warn_count, history_count, round(rolling_mean, 2) AS rolling_mean,
         round(rolling_stddev, 2) AS rolling_stddev, round((event_count - rolling_mean) / nullif(rolling_stddev, 0), 3) AS z_score
  FROM roll WHERE history_count >= 5 AND rolling_stddev > 0
),
zb AS (
  SELECT DISTINCT z.window_start, z.window_end, z.component, z.event_count, z.z_score, r.block_id
  FROM zs z JOIN raw r ON r.component = z.component AND r.event_time >= z.window_start AND r.event_time < z.window_end
),
gz AS (
  SELECT wm.*, (event_count - m) / nullif(sd, 0) AS z
  FROM wm, (SELECT avg(event_count) AS m, stddev_samp(event_count) AS sd FROM wm)
),
feat AS (
  SELECT block_id, count(*) AS event_count, count(DISTINCT component) AS component_count, count(DISTINCT level) AS level_count,
         count_if(upper(level) = 'ERROR')::BIGINT AS error_count, count_if(upper(level) IN ('WARN', 'WARNING'))::BIGINT AS warn_count,
         min(event_time) AS first_event_time, max(event_time) AS last_event_time, {_diff("min(event_time)", "max(event_time)")} AS active_duration_seconds
  FROM raw GROUP BY block_id
),
mf AS (
  SELECT block_id, count(*) AS total_events, count(DISTINCT component) AS unique_components, count(DISTINCT message) AS unique_messages,
         {_diff("min(event_time)", "max(event_time)")} AS lifetime_seconds
  FROM raw GROUP BY block_id
),
der AS (
  SELECT block_id, event_count, component_count, active_duration_seconds,
         round(event_count / nullif(active_duration_seconds, 0)::DOUBLE, 4) AS events_per_second,
         round(event_count / nullif(component_count, 0)::DOUBLE, 4) AS events_per_component,
         round(component_count / 8.0::DOUBLE, 4) AS component_diversity, CASE WHEN active_duration_seconds <= 30 THEN 1 ELSE 0 END AS short_lived_flag
  FROM feat
),
sc AS (
  SELECT * EXCLUDE (short_lived_flag),
         CASE WHEN active_duration_seconds <= 10 THEN 3 WHEN active_duration_seconds <= 15 THEN 2 WHEN active_duration_seconds <= 30 THEN 1 ELSE 0 END
         + CASE WHEN events_per_second >= 1.25 THEN 2 WHEN events_per_second >= 0.75 THEN 1 ELSE 0 END
         + CASE WHEN component_diversity < 0.35 THEN 1 ELSE 0 END AS anomaly_score
  FROM der
),
inc AS (
  SELECT block_id, event_count, component_count, active_duration_seconds, events_per_second, component_diversity, true AS is_incident,
         CASE WHEN {_RULE_D} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'SHORT_DURATION_LOW_COMPONENT_DIVERSITY' AS detection_reason
  FROM der WHERE active_duration_seconds <= 15 AND component_diversity < 0.35
),
tl AS (
  SELECT inc.*, first_event_time, last_event_time, lag(first_event_time) OVER w AS prev_incident_start, lead(first_event_time) OVER w AS next_incident_start
  FROM inc JOIN feat USING (block_id) WINDOW w AS (ORDER BY first_event_time, block_id)
),
gp AS (SELECT *, {_diff("prev_incident_start", "first_event_time")} AS gap_seconds FROM tl),
mem AS (
  SELECT *, sum(CASE WHEN gap_seconds IS NULL OR gap_seconds > 2 THEN 1 ELSE 0 END) OVER (ORDER BY first_event_time, block_id ROWS UNBOUNDED PRECEDING)::BIGINT AS episode_id
  FROM gp
),
ep AS (
  SELECT episode_id, min(first_event_time) AS episode_start, max(last_event_time) AS episode_end,
         {_diff("min(first_event_time)", "max(last_event_time)")} AS episode_duration_seconds, count(*) AS n_incidents, count(DISTINCT block_id) AS n_distinct_blocks,
         count_if(severity = 'HIGH')::BIGINT AS n_high_severity, count_if(severity = 'MEDIUM')::BIGINT AS n_medium_severity, sum(event_count)::BIGINT AS total_events,
         round(CAST(avg(events_per_second) AS DECIMAL(38,12)), 4)::DOUBLE AS avg_events_per_second, round(max(events_per_second), 4) AS max_events_per_second, round(CAST(avg(component_diversity) AS DECIMAL(38,12)), 4)::DOUBLE AS avg_component_diversity
  FROM mem GROUP BY episode_id
),
evb AS (
  SELECT i.block_id, i.severity, i.detection_reason, d.event_count, d.component_count, d.active_duration_seconds, d.events_per_second, d.events_per_component,
         d.component_diversity, r.level, r.component, r.message, r.event_time
  FROM inc i JOIN der d USING (block_id) JOIN raw r USING (block_id)
),
db AS (
  SELECT row_number() OVER (ORDER BY block_id) AS block_key, block_id, label AS ground_truth_label, first_event_time AS first_seen_at, last_event_time AS last_seen_at
  FROM labels LEFT JOIN feat USING (block_id)
),
dd AS (
  SELECT strftime(d, '%Y%m%d')::INT AS date_key, d AS full_date, year(d)::INT AS year_number, quarter(d)::INT AS quarter_number, month(d)::INT AS month_number,
         strftime(d, '%b') AS month_name, day(d)::INT AS day_number, strftime(d, '%a') AS day_of_week, isodow(d) IN (6, 7) AS is_weekend
  FROM (SELECT DISTINCT window_start::DATE AS d FROM wm)
),
dc AS (SELECT row_number() OVER (ORDER BY component) AS component_key, component AS component_name FROM (SELECT DISTINCT component FROM raw)),
quart AS (SELECT block_id, events_per_second, ntile(4) OVER (ORDER BY events_per_second NULLS FIRST, block_id)::INT AS eps_quartile FROM der)
"""

_W = "block_id, window_start, window_end, event_count, error_count, warn_count"
_RATES = f"count(*) AS blocks, count_if({_A})::BIGINT AS anomalies, count_if({_N})::BIGINT AS normals, {_pct(f'count_if({_A})', 'count(*)')} AS anomaly_rate_pct"


def _values(name: str, numbers: list) -> str:
    return f"(SELECT unnest({numbers!r}::DOUBLE[]) AS {name})"


def _f1(p: str, r: str) -> str:
    return f"round(CAST(2.0::DOUBLE * ({p}) * ({r}) / nullif(({p}) + ({r}), 0) AS DECIMAL(38,12)), 4)::DOUBLE"


def _share(n: str, d: str) -> str:
    return f"({n})::DOUBLE / nullif({d}, 0)"


def _detector(flagged: str) -> str:
    return f"""
seen AS (SELECT DISTINCT block_id FROM raw), det AS (SELECT DISTINCT block_id FROM {flagged}),
act2 AS (SELECT DISTINCT block_id FROM labels WHERE {_A} AND block_id IN (SELECT block_id FROM seen)),
n AS (SELECT (SELECT count(*) FROM det) AS detected_blocks, (SELECT count(*) FROM act2) AS actual_anomalies,
             (SELECT count(*) FROM det WHERE block_id IN (SELECT block_id FROM act2)) AS true_positives,
             (SELECT count(*) FROM det WHERE block_id NOT IN (SELECT block_id FROM act2)) AS false_positives,
             (SELECT count(*) FROM act2 WHERE block_id NOT IN (SELECT block_id FROM det)) AS false_negatives, (SELECT count(*) FROM seen) AS blocks_seen),
q AS (SELECT *, coalesce(true_positives::DOUBLE / nullif(detected_blocks, 0), 0) AS p, coalesce(true_positives::DOUBLE / nullif(actual_anomalies, 0), 0) AS r FROM n)
SELECT * EXCLUDE (p, r), round(p, 6) AS precision, round(r, 6) AS recall, coalesce(round(CAST(2 * p * r / nullif(p + r, 0) AS DECIMAL(38,12)), 6)::DOUBLE, 0) AS f1_score FROM q"""


def _avg(c: str, places: int) -> str:
    return f"round(CAST(avg({c}) AS DECIMAL(38,12)), {places})::DOUBLE"


_DERIVED = f"""count(*) AS blocks, {_avg("events_per_second", 4)} AS avg_events_per_second, {_avg("events_per_component", 4)} AS avg_events_per_component,
  {_avg("component_diversity", 4)} AS avg_component_diversity, sum(short_lived_flag)::BIGINT AS short_lived_blocks, {_pct("sum(short_lived_flag)", "count(*)")} AS short_lived_percent"""
_P, _R = _share(f"count_if({_A})", "count(*)"), _share(f"count_if({_A})", "max(t)")
_OBSERVED = f"(SELECT count(*) AS t FROM labels WHERE {_A} AND block_id IN (SELECT block_id FROM der)) AS tot"
_MATCH = f"count(*) AS flagged_blocks, count_if({_A})::BIGINT AS true_positives, count_if({_N})::BIGINT AS false_positives"

#: Each is the part after the WITH clauses of BASE.
PARTS = {
    "raw_count": "SELECT count(*) AS raw_rows FROM raw",
    "raw_unique_blocks": "SELECT count(DISTINCT block_id) AS unique_blocks FROM raw",
    "level_distribution": "SELECT level, count(*) AS event_count FROM raw GROUP BY level",
    "severity_text_search": "SELECT level, raw_line FROM raw WHERE upper(raw_line) LIKE '%ERROR%' OR upper(raw_line) LIKE '%WARN%' ORDER BY raw_line LIMIT 30",
    "top_components": "SELECT component, count(*) AS event_count FROM raw GROUP BY component ORDER BY event_count DESC, component LIMIT 20",
    "sample_events": "SELECT raw_line, level, component, message, block_id, event_time FROM raw ORDER BY event_time, raw_line LIMIT 20",
    "event_time_range": "SELECT min(event_time) AS first_event, max(event_time) AS last_event FROM raw",
    "raw_log_events": "SELECT * FROM raw",
    "stream_parse": "SELECT * FROM raw",
    "stream_windowed": "SELECT * FROM wm",
    "stream_incidents": "SELECT * FROM si",
    "windows_count": "SELECT count(*) AS window_rows FROM wm",
    "windowed_metrics": "SELECT * FROM wm",
    "latest_windows": f"SELECT {_W} FROM wm ORDER BY window_start DESC, block_id LIMIT 20",
    "window_severity_summary": "SELECT count(*) AS total_windows, count_if(error_count > 0)::BIGINT AS windows_with_errors, count_if(warn_count > 0)::BIGINT AS windows_with_warnings, max(error_count) AS max_errors_in_window, max(warn_count) AS max_warnings_in_window FROM wm",
    "severity_windows": f"SELECT {_W} FROM wm WHERE error_count > 0 OR warn_count > 0",
    "window_volume_stats": f"SELECT min(event_count) AS min_events, {_avg('event_count', 6)} AS avg_events, median(event_count) AS median_events, max(event_count) AS max_events, round(stddev_samp(event_count), 6) AS stddev_events FROM wm",
    "static_incidents": "SELECT * FROM si",
    "labels_count": "SELECT count(*) AS total_rows FROM labels",
    "label_histogram": 'SELECT label, count(*) AS "count" FROM labels GROUP BY label',
    "label_quality": "SELECT count_if(block_id IS NULL OR trim(block_id) = '')::BIGINT AS blank_block_ids, count_if(label NOT IN ('Normal', 'Anomaly'))::BIGINT AS unexpected_labels FROM labels",
    "label_distribution": "SELECT label, count(*) AS block_count FROM labels GROUP BY label",
    "label_sample": "SELECT * FROM labels ORDER BY block_id LIMIT 20",
    "label_duplicates": "SELECT block_id, count(*) AS label_rows FROM labels GROUP BY block_id HAVING count(*) > 1",
    "stream_by_label": "SELECT label, count(DISTINCT block_id) AS unique_blocks, count(*) AS log_events FROM raw JOIN labels USING (block_id) GROUP BY label",
    "label_coverage": f"SELECT count(DISTINCT r.block_id) AS streamed_blocks, count(DISTINCT CASE WHEN {_N} THEN r.block_id END) AS normal_blocks, count(DISTINCT CASE WHEN {_A} THEN r.block_id END) AS anomaly_blocks, count(DISTINCT CASE WHEN g.block_id IS NULL THEN r.block_id END) AS unmatched_blocks FROM raw r LEFT JOIN labels g ON r.block_id = g.block_id",
    "anomalous_blocks_top": f"SELECT block_id, label, count(*) AS event_count, min(event_time) AS first_event, max(event_time) AS last_event FROM raw JOIN labels USING (block_id) WHERE {_A} GROUP BY ALL ORDER BY event_count DESC, block_id LIMIT 30",
    "anomalous_sequences": f"SELECT block_id, event_time, component, level, message FROM raw JOIN labels USING (block_id) WHERE {_A} ORDER BY ALL LIMIT 200",
    "window_stats_by_label": f"SELECT label, count(*) AS window_count, {_avg('event_count', 2)} AS avg_events_per_window, median(event_count) AS median_events_per_window, max(event_count) AS max_events_per_window, round(stddev_samp(event_count), 2) AS stddev_events FROM wm JOIN labels USING (block_id) GROUP BY label",
    "largest_windows": f"SELECT label, {_W} FROM wm JOIN labels USING (block_id) ORDER BY event_count DESC, block_id, window_start LIMIT 30",
    "global_zscore_top": "SELECT block_id, label, event_count, round(z, 2) AS z_score, window_start, window_end FROM gz LEFT JOIN labels USING (block_id) ORDER BY abs(z) DESC NULLS FIRST, block_id, window_start LIMIT 30",
    "global_zscore_sweep": f"SELECT threshold, count_if(mz >= threshold)::BIGINT AS flagged_blocks, count_if(mz >= threshold AND {_A})::BIGINT AS true_anomalies, count_if(mz >= threshold AND {_N})::BIGINT AS false_positives FROM (SELECT block_id, max(abs(z)) AS mz FROM gz GROUP BY block_id) JOIN labels USING (block_id), {_values('threshold', [1.5, 2.0, 2.5, 3.0])} GROUP BY threshold",
    "block_features_top": "SELECT block_id, label, total_events, unique_components, unique_messages, lifetime_seconds FROM mf JOIN labels USING (block_id) ORDER BY CASE WHEN label = 'Anomaly' THEN 0 ELSE 1 END, total_events DESC, block_id LIMIT 50",
    "feature_comparison": f"SELECT label, count(*) AS blocks, {_avg('total_events', 2)} AS avg_total_events, {_avg('unique_components', 2)} AS avg_unique_components, {_avg('unique_messages', 2)} AS avg_unique_messages, {_avg('lifetime_seconds', 2)} AS avg_lifetime_seconds, median(lifetime_seconds) AS median_lifetime_seconds FROM mf JOIN labels USING (block_id) GROUP BY label",
    "scale_baseline": "SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM wm) AS window_rows, (SELECT count(*) FROM si) AS incident_rows, (SELECT count(DISTINCT block_id) FROM raw) AS unique_blocks",
    "recovery_counts": "SELECT count(*) AS raw_rows, count(DISTINCT block_id) AS unique_blocks FROM raw",
    "component_window_activity": "SELECT * FROM act",
    "component_integrity": "SELECT (SELECT count(*) FROM raw) AS raw_eligible_events, (SELECT sum(event_count)::BIGINT FROM act) AS aggregated_events, (SELECT count(*) FROM raw) - (SELECT sum(event_count)::BIGINT FROM act) AS difference",
    "component_window_extent": "SELECT count(*) AS component_window_rows, count(DISTINCT component) AS unique_components, min(window_start) AS first_window, max(window_end) AS last_window FROM act",
    "component_window_sample": "SELECT * FROM act ORDER BY window_start, component LIMIT 30",
    "component_history": f"SELECT component, count(*) AS n_windows, sum(event_count)::BIGINT AS total_events, {_avg('event_count', 2)} AS avg_events_per_window, median(event_count) AS median_events_per_window, max(event_count) AS max_events_per_window, round(stddev_samp(event_count), 2) AS stddev_events FROM act GROUP BY component",
    "history_buckets": "SELECT CASE WHEN n < 10 THEN '<10' WHEN n < 20 THEN '10-19' WHEN n < 50 THEN '20-49' ELSE '50+' END AS window_history_bucket, count(*) AS components FROM (SELECT component, count(*) AS n FROM act GROUP BY component) GROUP BY 1",
    "component_rolling_stats": "SELECT * REPLACE (round(rolling_mean, 6) AS rolling_mean, round(rolling_stddev, 6) AS rolling_stddev) FROM roll",
    "component_zscores": "SELECT * FROM zs",
    "zscore_scored_counts": "SELECT count(*) AS scored_observations, count(DISTINCT component) AS scored_components, min(window_start) AS first_scored_window, max(window_start) AS last_scored_window FROM zs",
    "zscore_by_component": f"SELECT component, count(*) AS scored_windows, {_avg('z_score', 3)} AS avg_z_score, round(min(z_score), 3) AS min_z_score, round(max(z_score), 3) AS max_z_score, round(max(abs(z_score)), 3) AS max_abs_z_score FROM zs GROUP BY component",
    "zscore_outliers": "SELECT window_start, window_end, component, event_count, history_count, rolling_mean, rolling_stddev, z_score FROM zs ORDER BY abs(z_score) DESC, component, window_start LIMIT 50",
    "zscore_threshold_distribution": f"SELECT threshold, count_if(abs(z_score) >= threshold)::BIGINT AS flagged_component_windows, {_pct('count_if(abs(z_score) >= threshold)', 'count(*)')} AS flagged_percent FROM zs, {_values('threshold', [1.5, 2.0, 2.5, 3.0, 3.5])} GROUP BY threshold",
    "zscore_block_candidates": "SELECT * FROM zb",
    "zscore_block_sweep": f"SELECT threshold, count(DISTINCT CASE WHEN abs(z_score) >= threshold THEN block_id END) AS flagged_blocks, count(DISTINCT CASE WHEN abs(z_score) >= threshold AND {_A} THEN block_id END) AS true_anomaly_blocks, count(DISTINCT CASE WHEN abs(z_score) >= threshold AND {_N} THEN block_id END) AS false_positive_blocks FROM zb JOIN labels USING (block_id), {_values('threshold', [1.5, 2.0, 2.5, 3.0, 3.5])} GROUP BY threshold",
    "zscore_precision_recall": f"SELECT threshold, f AS flagged_blocks, tp AS true_positives, fp AS false_positives, t AS total_anomaly_blocks, {_pct('tp', 'f')} AS precision_pct, {_pct('tp', 't')} AS recall_pct FROM (SELECT threshold, count(DISTINCT CASE WHEN abs(z_score) >= threshold THEN block_id END) AS f, count(DISTINCT CASE WHEN abs(z_score) >= threshold AND {_A} THEN block_id END) AS tp, count(DISTINCT CASE WHEN abs(z_score) >= threshold AND {_N} THEN block_id END) AS fp FROM zb JOIN labels USING (block_id), {_values('threshold', [1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0])} GROUP BY threshold), (SELECT count_if({_A})::BIGINT AS t FROM labels)",
    "zscore_direction": f"SELECT CASE WHEN z_score >= 3 THEN 'POSITIVE_SPIKE' WHEN z_score <= -3 THEN 'NEGATIVE_DROP' ELSE 'NORMAL_RANGE' END AS z_direction, count(*) AS component_block_rows, count(DISTINCT block_id) AS unique_blocks, count(DISTINCT CASE WHEN {_A} THEN block_id END) AS anomaly_blocks, count(DISTINCT CASE WHEN {_N} THEN block_id END) AS normal_blocks, {_pct(f'count(DISTINCT CASE WHEN {_A} THEN block_id END)', 'count(DISTINCT block_id)')} AS anomaly_percent FROM zb JOIN labels USING (block_id) GROUP BY 1",
    "block_population": "SELECT count(*) AS total_events, count(DISTINCT block_id) AS unique_blocks, count(DISTINCT component) AS unique_components, min(event_time) AS first_event, max(event_time) AS last_event FROM raw",
    "block_features": "SELECT * FROM feat",
    "block_features_summary": f"SELECT count(*) AS feature_rows, count(DISTINCT block_id) AS unique_blocks, {_avg('event_count', 2)} AS avg_events_per_block, median(event_count) AS median_events_per_block, max(event_count) AS max_events_per_block, {_avg('component_count', 2)} AS avg_components_per_block, max(component_count) AS max_components_per_block, sum(error_count)::BIGINT AS total_errors, sum(warn_count)::BIGINT AS total_warnings FROM feat",
    "most_active_blocks": "SELECT * EXCLUDE (first_event_time, last_event_time) FROM feat ORDER BY event_count DESC, block_id LIMIT 30",
    "features_by_label": f"SELECT label, count(DISTINCT block_id) AS blocks, {_avg('event_count', 2)} AS avg_event_count, median(event_count) AS median_event_count, {_avg('component_count', 2)} AS avg_component_count, {_avg('error_count', 2)} AS avg_error_count, {_avg('warn_count', 2)} AS avg_warn_count, {_avg('active_duration_seconds', 2)} AS avg_active_duration_seconds FROM feat JOIN labels USING (block_id) GROUP BY label",
    "label_stats": "SELECT label, " + ", ".join(f"{_avg(c, 9)} AS avg_{c}" for c in ("event_count", "component_count", "error_count", "warn_count", "active_duration_seconds")) + " FROM feat JOIN labels USING (block_id) GROUP BY label",
    "block_derived": "SELECT * FROM der",
    "derived_summary": f"SELECT {_DERIVED} FROM der",
    "derived_by_label": f"SELECT label, {_DERIVED}, {_avg('active_duration_seconds', 2)} AS avg_duration_seconds FROM der JOIN labels USING (block_id) GROUP BY label",
    "feature_percentiles": f"SELECT label, round(CAST(quantile_cont(events_per_second, 0.25) AS DECIMAL(38,12)), 4)::DOUBLE AS eps_p25, round(CAST(median(events_per_second) AS DECIMAL(38,12)), 4)::DOUBLE AS eps_median, round(CAST(quantile_cont(events_per_second, 0.75) AS DECIMAL(38,12)), 4)::DOUBLE AS eps_p75, round(CAST(quantile_cont(active_duration_seconds, 0.25) AS DECIMAL(38,12)), 2)::DOUBLE AS duration_p25, round(CAST(median(active_duration_seconds) AS DECIMAL(38,12)), 2)::DOUBLE AS duration_median, round(CAST(quantile_cont(active_duration_seconds, 0.75) AS DECIMAL(38,12)), 2)::DOUBLE AS duration_p75, round(CAST(median(component_diversity) AS DECIMAL(38,12)), 4)::DOUBLE AS diversity_median, {_avg('component_diversity', 4)} AS diversity_avg FROM der JOIN labels USING (block_id) GROUP BY label",
    "duration_sweep": f"SELECT duration_threshold::INT AS duration_threshold, {_MATCH}, {_pct(f'count_if({_A})', 'count(*)')} AS precision_pct, {_pct(f'count_if({_A})', 'max(t)')} AS recall_pct FROM der JOIN labels USING (block_id), {_values('duration_threshold', [15, 30, 45, 60, 90, 120])}, {_OBSERVED} WHERE active_duration_seconds <= duration_threshold GROUP BY duration_threshold",
    "duration_eps_grid": f"SELECT duration_threshold::INT AS duration_threshold, eps_threshold, {_MATCH}, {_pct(f'count_if({_A})', 'count(*)')} AS precision_pct, {_pct(f'count_if({_A})', 'max(t)')} AS recall_pct, {_f1(_P, _R)} AS f1_score FROM der JOIN labels USING (block_id), {_values('duration_threshold', [10, 15, 20, 30])}, {_values('eps_threshold', [0.5, 0.75, 1.0, 1.25])}, {_OBSERVED} WHERE active_duration_seconds <= duration_threshold AND events_per_second >= eps_threshold GROUP BY duration_threshold, eps_threshold",
    "anomaly_scores": "SELECT * FROM sc",
    "score_distribution": f"SELECT anomaly_score, {_RATES} FROM sc JOIN labels USING (block_id) GROUP BY anomaly_score",
    "score_patterns": f"SELECT anomaly_score, CASE WHEN active_duration_seconds <= 10 THEN '<=10s' WHEN active_duration_seconds <= 15 THEN '11-15s' WHEN active_duration_seconds <= 30 THEN '16-30s' ELSE '>30s' END AS duration_band, CASE WHEN events_per_second >= 1.25 THEN '>=1.25' WHEN events_per_second >= 0.75 THEN '0.75-1.25' ELSE '<0.75' END AS eps_band, CASE WHEN component_diversity < 0.35 THEN '<0.35' ELSE '>=0.35' END AS diversity_band, {_RATES} FROM sc JOIN labels USING (block_id) WHERE anomaly_score >= 2 GROUP BY ALL",
    "rule_evaluation": f"""SELECT rule_name, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, tp + fp AS flagged_blocks,
  {_pct("tp", "tp + fp")} AS precision_pct, {_pct("tp", "tp + fn")} AS recall_pct, {_f1(_share("tp", "tp + fp"), _share("tp", "tp + fn"))} AS f1_score
FROM (SELECT rule_name, count_if(p AND {_A})::BIGINT AS tp, count_if(p AND {_N})::BIGINT AS fp, count_if(NOT p AND {_A})::BIGINT AS fn, count_if(NOT p AND {_N})::BIGINT AS tn
      FROM (SELECT label, rule_name, coalesce(CASE rule_name WHEN 'A_STRICT_PATTERN' THEN active_duration_seconds <= 10 AND events_per_second < 0.75 AND component_diversity < 0.35
                   WHEN 'B_BROAD_EPS' THEN {_RULE_B} WHEN 'C_SHORT_LOW_DIVERSITY' THEN active_duration_seconds <= 15 AND component_diversity < 0.35 ELSE {_RULE_D} END, false) AS p
            FROM der JOIN labels USING (block_id), (VALUES ('A_STRICT_PATTERN'), ('B_BROAD_EPS'), ('C_SHORT_LOW_DIVERSITY'), ('D_HYBRID_PATTERN')) AS v(rule_name)) GROUP BY rule_name)""",
    "incidents_behavioral": "SELECT * FROM inc",
    "incidents_summary": f"SELECT count(*) AS incident_rows, count(DISTINCT block_id) AS unique_blocks, count_if(severity = 'HIGH')::BIGINT AS high_severity, count_if(severity = 'MEDIUM')::BIGINT AS medium_severity, {_avg('active_duration_seconds', 2)} AS avg_duration_seconds, {_avg('events_per_second', 4)} AS avg_events_per_second, {_avg('component_diversity', 4)} AS avg_component_diversity FROM inc",
    "incident_ranking": "SELECT block_id, severity, events_per_second, component_diversity, active_duration_seconds, rank() OVER (ORDER BY events_per_second DESC NULLS LAST) AS overall_rank, dense_rank() OVER (PARTITION BY severity ORDER BY events_per_second DESC NULLS LAST) AS rank_within_severity FROM inc ORDER BY overall_rank, block_id LIMIT 30",
    "eps_quartiles": "SELECT * FROM quart",
    "incident_rate_by_quartile": f"SELECT eps_quartile, count(*) AS total_blocks, count(i.block_id) AS flagged_incidents, {_pct('count(i.block_id)', 'count(*)')} AS incident_rate_pct FROM quart q LEFT JOIN inc i USING (block_id) GROUP BY eps_quartile",
    "incident_share_by_quartile": "SELECT eps_quartile, count(*) AS incidents, count_if(severity = 'HIGH')::BIGINT AS high_severity, count_if(severity = 'MEDIUM')::BIGINT AS medium_severity, round(CAST(100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS DECIMAL(38,12)), 2)::DOUBLE AS pct_of_all_incidents FROM quart JOIN inc USING (block_id) GROUP BY eps_quartile",
    "incident_timeline": "SELECT block_id, severity, first_event_time, last_event_time, prev_incident_start, gap_seconds AS seconds_since_prev_incident, next_incident_start FROM gp",
    "labels_csv_load": "SELECT block_id, label FROM labels",
    "gap_summary": "SELECT count(*) AS incidents, min(gap_seconds) AS min_gap_seconds, round(CAST(avg(gap_seconds) AS DECIMAL(38,12)), 2)::DOUBLE AS avg_gap_seconds, median(gap_seconds) AS median_gap_seconds, max(gap_seconds) AS max_gap_seconds, count_if(gap_seconds <= 60)::BIGINT AS within_60_sec, count_if(gap_seconds > 60)::BIGINT AS over_60_sec FROM gp",
    "gap_histogram": "SELECT gap_seconds, count(*) AS occurrences, round(CAST(100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS DECIMAL(38,12)), 2)::DOUBLE AS pct_of_gaps FROM gp WHERE gap_seconds IS NOT NULL GROUP BY gap_seconds",
    "episode_threshold_sweep": "SELECT " + ", ".join(f"count_if(gap_seconds > {g})::BIGINT + 1 AS episodes_at_{g}_sec" for g in (1, 2, 5, 10, 15, 20, 30)) + " FROM gp",
    "incident_episodes": "SELECT * FROM ep",
    "episode_members": "SELECT episode_id, block_id, severity, events_per_second, component_diversity, first_event_time, last_event_time, gap_seconds FROM mem",
    "session_episodes": "SELECT count(*) AS n_incidents, min(first_event_time) AS episode_start, max(first_event_time) AS last_start FROM mem GROUP BY episode_id",
    "episode_purity": f"SELECT episode_id, count(*) AS n_blocks, count_if({_A})::BIGINT AS true_positives, count_if({_N})::BIGINT AS false_positives, {_pct(f'count_if({_A})', 'count(*)')} AS purity_pct FROM mem JOIN labels USING (block_id) GROUP BY episode_id",
    "high_precision": f"SELECT count_if(severity = 'HIGH' AND {_A})::BIGINT AS high_true_positives, count_if(severity = 'HIGH' AND {_N})::BIGINT AS high_false_positives, count_if(severity = 'HIGH')::BIGINT AS high_flagged, {_pct(chr(32).join(['count_if(severity =', chr(39) + 'HIGH' + chr(39), 'AND', _A + ')']), chr(32).join(['count_if(severity =', chr(39) + 'HIGH' + chr(39) + ')']))} AS high_only_precision_pct FROM inc JOIN labels USING (block_id)",
    "severity_precision": f"SELECT severity, {_MATCH}, {_pct(f'count_if({_A})', 'count(*)')} AS precision_pct FROM inc JOIN labels USING (block_id) GROUP BY severity",
    "incident_evidence": "SELECT i.block_id, i.window_start, i.window_end, i.event_count, i.error_count, i.warn_count, r.event_time, r.level, r.component, r.message FROM si i JOIN raw r ON r.block_id = i.block_id AND r.event_time >= i.window_start AND r.event_time < i.window_end",
    "evidence_behavioral": "SELECT * FROM evb",
    "dim_block": "SELECT * FROM db",
    "dim_date": "SELECT * FROM dd",
    "dim_component": "SELECT * FROM dc",
    "fact_incident_events": """SELECT block_key, date_key, component_key, window_start, window_end, count(r.event_time) AS component_event_count, count_if(upper(r.level) = 'ERROR')::BIGINT AS component_error_count,
  count_if(upper(r.level) = 'WARN')::BIGINT AS component_warn_count, i.event_count AS window_event_count, i.error_count AS window_error_count, i.warn_count AS window_warn_count, is_incident,
  coalesce(is_incident AND upper(ground_truth_label) = 'ANOMALY', false) AS is_true_positive
FROM si i JOIN db USING (block_id) JOIN dd ON full_date = window_start::DATE JOIN raw r ON r.block_id = i.block_id AND r.event_time >= i.window_start AND r.event_time < i.window_end
JOIN dc ON component_name = r.component
GROUP BY block_key, date_key, component_key, window_start, window_end, i.event_count, i.error_count, i.warn_count, is_incident, ground_truth_label""",
    "rca_evidence": "SELECT * FROM evb WHERE block_id = (SELECT min(block_id) FROM inc)",
    "rca_episode_metadata": "SELECT * FROM ep WHERE episode_id = 1",
    "rca_component_breakdown": "SELECT component, level, count(*) AS event_count FROM evb JOIN mem USING (block_id) WHERE episode_id = 1 GROUP BY component, level",
    "rca_sample": "SELECT block_id, event_time, component, level, message FROM (SELECT evb.* FROM evb JOIN mem USING (block_id) WHERE episode_id = 1) ORDER BY md5(concat_ws('~', block_id, strftime(event_time, '%Y-%m-%d %H:%M:%S'), component, level, message)) LIMIT 25",
    "rca_episode_purity": f"SELECT count(*) AS labelled_blocks, count_if({_A})::BIGINT AS anomaly_blocks, count_if({_N})::BIGINT AS normal_blocks, {_pct(f'count_if({_A})', 'count(*)')} AS purity_pct FROM mem JOIN labels USING (block_id) WHERE episode_id = 1",
}
TAILS = {"detector_evaluation": _detector("inc"), "detector_evaluation_static": _detector("si")}

ORACLE_SQL = {k: f"WITH {BASE}\n{v}" for k, v in PARTS.items()} | {k: f"WITH {BASE},\n{v}" for k, v in TAILS.items()}
