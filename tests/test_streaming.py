import json
from datetime import datetime, timedelta

from emberlog.plans import evaluate, summary
from emberlog.plans.queries import QUERIES
from emberlog.plans.store import Store
from emberlog.sources.log_lines import INCIDENT_SCHEMA, RAW_SCHEMA, WINDOW_SCHEMA
from emberlog.streaming import job
from emberlog.streaming import main as stream

T0 = datetime(2008, 11, 9, 20, 35, 0)


def put(folder, name, *rows):
    """rows: (block, seconds, level)"""
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"raw": f"{(T0 + timedelta(seconds=s)):%y%m%d %H%M%S} 1 {level} dfs.C: Event on {block}"}) for block, s, level in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def run(spark, tmp):
    for q in job.run(job.read_folder(spark, str(tmp / "in")), str(tmp / "out"), str(tmp / "ck"), once=True):
        q.awaitTermination()
    read = lambda name, schema: job.stored(spark, str(tmp / "out" / name), schema.replace("timestamp_ntz", "timestamp"))
    return read("raw_events", RAW_SCHEMA), read("windowed_metrics", WINDOW_SCHEMA), read("incidents", INCIDENT_SCHEMA)


def test_restart_updates_and_late_rows(spark, tmp_path):
    put(tmp_path / "in", "1.txt", ("blk_1", 0, "INFO"), ("blk_1", 5, "ERROR"), ("blk_2", 300, "INFO"))
    raw, windows, incidents = run(spark, tmp_path)
    assert (raw.count(), windows.count(), incidents.count()) == (3, 2, 1)
    # after a restart: one row updates a live window, one is beyond the watermark, one is late but within
    put(tmp_path / "in", "2.txt", ("blk_2", 301, "INFO"), ("blk_1", 10, "INFO"), ("blk_3", 200, "INFO"))
    raw, windows, _ = run(spark, tmp_path)
    assert raw.count() == 6
    rows = {(r.block_id, r.event_count) for r in job.latest(windows).collect()}
    assert rows == {("blk_1", 2), ("blk_2", 2), ("blk_3", 1)}
    assert windows.filter("block_id = 'blk_2'").count() == 2  # emitted twice


def test_batch_written_twice_stays_once(spark, tmp_path):
    sink = job.batch_sink(str(tmp_path / "t"))
    df = spark.range(3)
    sink(df, 0)
    sink(df, 0)
    sink(df, 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6


def test_summaries(spark):
    s = Store(spark, "/root/testdata/sf0.001")
    block = s.incidents.first().block_id
    text = summary.summarize_block(s, block)
    assert all(x in text for x in summary.SECTIONS) and block in text
    assert "Episode 1 of" in summary.summarize_episode(s, 1)
    for bad in (lambda: summary.block_prompt("x", []), lambda: summary.validated("nothing"), lambda: summary.summarize_episode(s, 10**6)):
        try:
            bad()
            raise AssertionError
        except ValueError:
            pass
    assert summary.file_name("block", "a/b:c") == "incident_a_b_c.txt"
    assert summary.format_metric(None) == "unknown"
    assert summary.SECTIONS == ["Incident summary", "Root-cause hypothesis", "Recommended next action"]


def test_stream_to_tables_to_queries(spark, tmp_path, capsys):
    """Envelopes through the command, stored tables and a label CSV through the analytics, a summary on disk."""
    rows = [(f"blk_{b}", b * 10 + s, "ERROR" if b == 3 else "INFO") for b in range(1, 9) for s in range(0, 6, 2)]
    put(tmp_path / "in", "1.txt", *rows)
    env = {"LOG_INBOX": str(tmp_path / "in"), "LOG_TABLES": str(tmp_path / "t"), "LOG_CHECKPOINTS": str(tmp_path / "ck"), "LOG_ONCE": "1"}
    assert stream.main(env) == 0
    (tmp_path / "t" / "labels.csv").write_text('block_id,label\n"blk_3", Anomaly\nblk_4,Normal\nblk_99,Anomaly\n')
    s = Store.of_folder(spark, str(tmp_path / "t"))
    assert s.raw.count() == len(rows) and s.labels.count() == 3
    found = evaluate.evaluate(s, "incidents")
    assert (found.detected_blocks, found.true_positives, found.actual_anomalies, found.precision) == (1, 1, 1, 1.0)
    assert evaluate.main(["--tables", str(tmp_path / "t"), "--table", "INCIDENTS"]) == 0
    assert "recall: 1.0000" in capsys.readouterr().out
    assert QUERIES["raw_count"].__name__ and s.incidents.count() == 8
    block = s.incidents.first().block_id
    path = summary.save(summary.summarize_block(s, block), str(tmp_path / "new" / "folder"), "block", block)
    assert block in open(path).read()


def test_settings():
    assert stream.configured({})["servers"] == "localhost:9092" and stream.configured({"KAFKA_TOPIC": "x"})["topic"] == "x"
