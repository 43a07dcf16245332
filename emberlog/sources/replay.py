"""Replay of a log file as envelopes, paced by the lines' own times."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_time(line: str) -> datetime | None:
    """Time of a line by its first two blank-separated fields; None where they aren't one."""
    parts = line.split(" ")
    try:
        return datetime.strptime(parts[0] + parts[1], "%y%m%d%H%M%S")
    except (IndexError, ValueError):
        return None


def envelopes(lines: DataFrame, raw: str = "raw_line") -> DataFrame:
    """(value): each line in the JSON form that the stream reads."""
    return lines.select(F.to_json(F.struct(F.col(raw).alias("raw"), F.current_timestamp().cast("string").alias("ingest_ts"))).alias("value"))


def paced(lines: Iterable[str], speed: float = 60.0, limit: int | None = None, max_sleep: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Envelopes of the lines that aren't blank; waits as long as the lines' times lie apart, over speed.

    A wait is max_sleep at most; times that run backwards and lines without time don't wait.
    """
    before, sent = None, 0
    for line in lines:
        line = line.rstrip("\n")
        if not line.strip():
            continue
        if limit is not None and sent >= limit:
            return
        at = line_time(line)
        if at and before and at > before:
            sleep(min((at - before).total_seconds() / speed, max_sleep))
        before = at or before
        sent += 1
        yield json.dumps({"raw": line, "ingest_ts": datetime.now(timezone.utc).isoformat()})


def replay_to_folder(file: str, folder: str, per_file: int = 5000, **pace) -> int:
    """Writes envelopes as files that the folder source picks up, in order; returns how many."""
    import os

    os.makedirs(folder, exist_ok=True)
    count, batch = 0, []

    def flush():
        if batch:
            name = os.path.join(folder, f"part-{count:012d}.json")
            with open(name + ".tmp", "w", encoding="utf-8") as f:
                f.write("\n".join(batch) + "\n")
            os.replace(name + ".tmp", name)
            batch.clear()

    with open(file, encoding="utf-8", errors="replace") as lines:
        for message in paced(lines, **pace):
            batch.append(message)
            count += 1
            if len(batch) >= per_file:
                flush()
    flush()
    return count


def main(argv: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(description="Replay a log file into a folder that a stream reads.")
    cli.add_argument("--file", required=True)
    cli.add_argument("--folder", required=True)
    cli.add_argument("--speed", type=float, default=60.0)
    cli.add_argument("--limit", type=int)
    cli.add_argument("--max-sleep", type=float, default=2.0)
    a = cli.parse_args(argv)
    print(replay_to_folder(a.file, a.folder, speed=a.speed, limit=a.limit, max_sleep=a.max_sleep))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
