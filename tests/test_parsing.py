import json
from datetime import datetime

import pytest

from emberlog.sources import log_lines, replay

LINE = "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-1608999687919862906 src: /10.250.19.102:54106 dest: /10.250.19.102:50010"


def parse(spark, *lines):
    return log_lines.parse_lines(spark.createDataFrame([(x,) for x in lines], "raw_line string")).collect()


def test_valid_line(spark):
    (r,) = parse(spark, LINE)
    assert (r.log_date, r.log_time, r.pid, r.level, r.component) == ("081109", "203518", "143", "INFO", "dfs.DataNode$DataXceiver")
    assert r.block_id == "blk_-1608999687919862906"
    assert r.event_time == datetime(2008, 11, 9, 20, 35, 18)
    assert r.message.startswith("Receiving block")


def test_dropped_lines(spark):
    no_block = "081109 203518 143 INFO dfs.DataNode$DataXceiver: DataNode service started"
    bad_time = LINE.replace("203518", "993518")
    assert parse(spark, no_block, bad_time, "this is not a valid log line", "", None) == []


def test_first_of_two_blocks(spark):
    (r,) = parse(spark, "081109 203518 1 INFO dfs.X: from blk_7 to blk_8")
    assert r.block_id == "blk_7"


def test_envelopes(spark):
    values = [json.dumps({"raw": LINE, "ingest_ts": "x"}), "{broken", json.dumps({"other": 1}), None]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert log_lines.parse_messages(df).count() == 1
    assert log_lines.parse_messages(df.selectExpr("cast(value as binary) as value")).count() == 1


def test_label_csv(spark, tmp_path):
    (tmp_path / "good.csv").write_text('BlockId,Label\n"blk_1", Normal \nblk_2,Anomaly\n')
    rows = log_lines.load_labels_csv(spark, str(tmp_path / "good.csv")).collect()
    assert [tuple(r) for r in rows] == [("blk_1", "Normal"), ("blk_2", "Anomaly")]
    (tmp_path / "bad.csv").write_text("BlockId,Label\nblk_1\n")
    with pytest.raises(Exception):
        log_lines.load_labels_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_replay(tmp_path):
    assert replay.line_time(LINE) == datetime(2008, 11, 9, 20, 35, 18)
    assert replay.line_time("x") is None and replay.line_time("a b c") is None
    waits = []
    lines = [LINE, "\n", LINE.replace("203518", "203528"), LINE.replace("203518", "203500"), LINE.replace("203518", "213518")]
    out = list(replay.paced(lines, speed=10, max_sleep=2, sleep=waits.append))
    assert len(out) == 4 and waits == [1.0, 2.0]
    assert json.loads(out[0])["raw"] == LINE
    assert len(list(replay.paced(lines, limit=2, sleep=waits.append))) == 2
    (tmp_path / "log").write_bytes(LINE.encode() + b"\n\xff bad bytes\n")
    assert replay.replay_to_folder(str(tmp_path / "log"), str(tmp_path / "in"), per_file=1, speed=1e9) == 2
