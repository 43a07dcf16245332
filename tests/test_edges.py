"""Hand-made fixtures for the cases most easily got wrong."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from emberlog.functions import ordered, scalars
from emberlog.operators import behavior, episodes, evaluation, evidence, star, windows
from emberlog.sources.log_lines import LABEL_SCHEMA, RAW_SCHEMA

T0 = datetime(2008, 11, 9, 20, 35, 0)


def raw(spark, *rows):
    """rows: (block, seconds, component, level)"""
    made = [("line", "081109", "203500", "1", level, comp, f"m {block}", block, T0 + timedelta(seconds=at)) for block, at, comp, level in rows]
    return spark.createDataFrame(made, RAW_SCHEMA)


def labels(spark, **by):
    return spark.createDataFrame(list(by.items()), LABEL_SCHEMA)


def incidents(spark, starts):
    rows = [(b, 4, 1, 5, None, 0.125, True, "MEDIUM", "r") for b, _ in starts]
    inc = spark.createDataFrame(rows, "block_id string, event_count long, component_count long, active_duration_seconds long, events_per_second double, component_diversity double, is_incident boolean, severity string, detection_reason string")
    feat = spark.createDataFrame([(b, T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + 1)) for b, s in starts], "block_id string, first_event_time timestamp_ntz, last_event_time timestamp_ntz")
    return inc, feat


def test_single_event_block(spark):
    d = behavior.block_derived(behavior.block_features(raw(spark, ("blk_1", 0, "c", "INFO"))))
    (r,) = d.collect()
    assert r.active_duration_seconds == 0 and r.events_per_second is None
    assert behavior.anomaly_scores(d).first().anomaly_score == 4
    assert behavior.incidents_behavioral(d).first().severity == "MEDIUM"


def test_gaps_split_after_two_seconds(spark):
    line = episodes.timeline(*incidents(spark, [("a", 0), ("b", 0), ("c", 1), ("d", 3), ("e", 6)]))
    rows = {r.block_id: (r.gap_seconds, r.episode_id) for r in episodes.episode_members(line).collect()}
    assert rows == {"a": (None, 1), "b": (0, 1), "c": (1, 1), "d": (2, 1), "e": (3, 2)}
    assert sorted(r.n_incidents for r in episodes.session_episodes(line).collect()) == [1, 4]


def test_empty_incidents(spark):
    inc, feat = incidents(spark, [("a", 0)])
    line = episodes.timeline(inc.limit(0), feat)
    assert line.agg(F.count_if(F.col("gap_seconds") > 2) + 1).first()[0] == 1
    members = episodes.episode_members(line)
    assert members.count() == 0
    r = evidence.labelled_purity(members, labels(spark, a="Anomaly"), 1).first()
    assert (r.labelled_blocks, r.purity_pct) == (0, None)


def test_purity(spark):
    starts = [(f"b{i:02}", 0) for i in range(50)]
    members = episodes.episode_members(episodes.timeline(*incidents(spark, starts)))
    by = {b: "Anomaly" if i < 3 else "Normal" for i, (b, _) in enumerate(starts)}
    assert episodes.episode_purity(members, labels(spark, **by)).first().purity_pct == 6.0


def test_rolling_history(spark):
    rows = [("blk_1", 60 * m, "six", "INFO") for m in range(6) for _ in range(m % 3 + 1)]
    rows += [("blk_1", 60 * m, "five", "INFO") for m in range(5)] + [("blk_1", 60 * m, "flat", "INFO") for m in range(8)]
    z = windows.zscores(windows.rolling_stats(windows.component_activity(raw(spark, *rows))))
    assert [r.component for r in z.collect()] == ["six"]


def test_levels_and_components(spark):
    r = raw(spark, ("blk_1", 0, "c", "WARNING"), ("blk_1", 1, "c", "warn"), ("blk_1", 2, None, "WARN"), ("blk_1", 3, " ", "error"))
    f = behavior.block_features(r).first()
    assert (f.warn_count, f.error_count) == (3, 1)
    w = windows.windowed_metrics(r).first()
    assert (w.warn_count, w.error_count) == (1, 0)
    assert [x.component_name for x in star.dim_component(r).collect()] == ["c"]
    assert windows.component_activity(r).count() == 2


def test_half_open_windows(spark):
    r = raw(spark, ("blk_1", 0, "c", "ERROR"), ("blk_1", 59.9, "c", "INFO"), ("blk_1", 60, "c", "INFO"))
    w = windows.windowed_metrics(r)
    assert sorted(x.event_count for x in w.collect()) == [1, 2]
    assert evidence.incident_evidence(windows.flag_static(w), r).count() == 2


def test_second_boundaries(spark):
    df = spark.createDataFrame([(T0 + timedelta(seconds=0.9), T0 + timedelta(seconds=1.1))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(scalars.seconds_between("a", "b")).first()[0] == 1


def test_star_refresh_is_idempotent(spark):
    r = raw(spark, ("blk_1", 0, "c", "ERROR"), ("blk_1", 1, "d", "INFO"), ("blk_9", 2, "c", "ERROR"))
    lab = labels(spark, blk_1="Anomaly", blk_2="Normal")
    w = windows.windowed_metrics(r)
    inc = windows.flag_static(w)
    b, d, c = star.dim_block(lab, r), star.dim_date(w), star.dim_component(r)
    fact = star.fact_incident_events(inc, r, b, d, c)
    again = star.fact_incident_events(inc.unionByName(inc), r, star.dim_block(lab, r, b), star.dim_date(w, d), star.dim_component(r, c), fact)
    key = lambda df: sorted(map(tuple, df.drop("loaded_at").select(sorted(x for x in df.columns if x != "loaded_at")).collect()))
    assert key(fact) == key(again) and fact.count() == 2  # the unlabelled block has no row
    assert all(x.is_true_positive for x in fact.collect())
    later = star.dim_block(labels(spark, blk_1="Normal", blk_3="Anomaly"), r.limit(0), b)
    rows = {x.block_id: x for x in later.collect()}
    assert rows["blk_1"].ground_truth_label == "Normal" and rows["blk_1"].first_seen_at == T0
    assert {x.block_id: x.block_key for x in later.collect()} == {"blk_1": 1, "blk_2": 2, "blk_3": 3}
    assert d.first().month_name == "Nov" and d.first().day_of_week == "Sun" and d.first().is_weekend


def test_windows_emitted_twice(spark):
    w = windows.windowed_metrics(raw(spark, ("blk_1", 0, "c", "ERROR"), ("blk_1", 1, "c", "ERROR"), ("blk_1", 2, "c", "INFO")))
    inc = windows.flag_static(w.withColumn("event_count", F.lit(2).cast("long")).unionByName(w))
    assert inc.count() == 2
    assert [r.event_count for r in star.latest_windows(inc).collect()] == [3]


def test_detector_counts_unlabelled(spark):
    r = raw(spark, *[(b, 0, "c", "INFO") for b in ("a", "b", "c", "d")])
    det = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "block_id string")
    row = evaluation.detector_evaluation(det, labels(spark, a="Anomaly", b="Normal", d="Anomaly", unseen="Anomaly"), r).first()
    assert (row.detected_blocks, row.actual_anomalies, row.true_positives, row.false_positives, row.false_negatives, row.blocks_seen) == (3, 2, 1, 2, 1, 4)
    none = evaluation.detector_evaluation(det.limit(0), labels(spark, z="Normal"), r).first()
    assert (none.precision, none.recall, none.f1_score) == (0.0, 0.0, 0.0)


def test_order_helpers(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)], "v long, f int").repartition(7)
    rows = ordered.running_total(ordered.with_neighbour(ordered.number_rows(df, F.col("v")), "v", "prev"), "f", "total")
    got = sorted((r.v, r.rn, r.prev, r.total) for r in ordered.ntile(rows, 4, "q").collect())
    total, prev = 0, None
    flags = {i * 37 % 101: i % 3 for i in range(101)}
    for v, rn, p, t in got:
        total += flags[v]
        assert (rn, p, t) == (v + 1, prev, total)
        prev = v
    sizes = ordered.ntile(rows, 4, "q").groupBy("q").count().orderBy("q").collect()
    assert [r["count"] for r in sizes] == [26, 25, 25, 25]


def test_rounding_ties_go_away_from_zero(spark):
    df = spark.createDataFrame([(0.0005,), (-0.0005,), (2.675,), (-2.675,), (1.0049999,)], "x double")
    assert [r[0] for r in df.select(scalars.rounded(F.col("x"), 3)).collect()] == [0.001, -0.001, 2.675, -2.675, 1.005]
    assert [r[0] for r in df.select(scalars.rounded(F.col("x"), 2)).collect()][2:] == [2.68, -2.68, 1.0]
