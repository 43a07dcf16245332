"""Root-cause summaries: deterministic evidence in, validated text out.

The writer is any function from prompt to text; the default one is a fixed template over the evidence. The
writer decides nothing: flags, severities and episodes come from the queries.
"""

from __future__ import annotations

import argparse
import os
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Row

from ..operators import evidence as ev
from ..operators.evidence import block_evidence
from ..sources.session import build_spark
from .store import Store

#: Headings that a summary must have, in any letter case. Fixed values.
SECTIONS = ["Incident summary", "Root-cause hypothesis", "Recommended next action"]


def format_metric(value, fallback: str = "unknown") -> str:
    return fallback if value is None else str(value)


def _facts(rows: list[Row]) -> list[str]:
    times = [r.event_time for r in rows if r.event_time is not None]
    levels = Counter(r.level for r in rows)
    parts = Counter(r.component for r in rows)
    return [
        f"Events: {len(rows)}",
        f"From {format_metric(min(times, default=None))} to {format_metric(max(times, default=None))}",
        "Levels: " + ", ".join(f"{k} {n}" for k, n in sorted(levels.items())),
        "Components: " + ", ".join(f"{k} {n}" for k, n in sorted(parts.items())),
    ]


def block_prompt(block_id: str, rows: list[Row]) -> str:
    """Prompt on one flagged block; raises ValueError without evidence."""
    if not rows:
        raise ValueError(f"no evidence for block {block_id}")
    r = rows[0]
    head = [
        f"Block {block_id} was flagged: {r.detection_reason}, severity {r.severity}.",
        f"Duration {r.active_duration_seconds} s, events a second {format_metric(r.events_per_second)}, component diversity {r.component_diversity}.",
    ]
    log = [f"{format_metric(x.event_time)} {x.level} {x.component}: {x.message}" for x in rows]
    return "\n".join([*head, *_facts(rows), "Log:", *log, "Write these sections: " + "; ".join(SECTIONS) + ". Use only the evidence above."])


def episode_prompt(meta: Row, breakdown: list[Row], sample: list[Row], purity: Row) -> str:
    head = [
        f"Episode {meta.episode_id} of {meta.n_distinct_blocks} blocks, {meta.n_high_severity} HIGH and {meta.n_medium_severity} MEDIUM incidents.",
        f"From {meta.episode_start} to {meta.episode_end}, {meta.episode_duration_seconds} s, {meta.total_events} events.",
        f"Labelled anomalies: {purity.anomaly_blocks} of {purity.labelled_blocks} ({format_metric(purity.purity_pct, 'not defined')} %).",
        "Components: " + ", ".join(f"{r.component}/{r.level} {r.event_count}" for r in breakdown),
    ]
    log = [f"{r.event_time} {r.block_id} {r.level} {r.component}: {r.message}" for r in sample]
    return "\n".join([*head, f"Sample of {len(sample)} events:", *log, "Write these sections: " + "; ".join(SECTIONS) + ". Use only the evidence above."])


def template_writer(prompt: str) -> str:
    facts = prompt.split("\n")
    return "\n\n".join([
        f"{SECTIONS[0]}\n{facts[0]}", f"{SECTIONS[1]}\nNot decided by this template; the evidence is:\n" + "\n".join(f"- {x}" for x in facts[1:5]), f"{SECTIONS[2]}\n- Compare with unflagged blocks of the same minutes."
    ])


def validated(text: str) -> str:
    """The text, if it has every section; else ValueError."""
    missing = [s for s in SECTIONS if s.lower() not in (text or "").lower()]
    if missing:
        raise ValueError("summary lacks: " + ", ".join(missing))
    return text


def file_name(kind: str, key) -> str:
    safe = re.sub(r"[/\\:]", "_", str(key))
    return f"incident_{safe}.txt" if kind == "block" else f"episode_{safe}_rca.txt"


def save(text: str, folder: str, kind: str, key) -> str:
    """Writes a summary into a folder of the driver, made if need be; returns the path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, file_name(kind, key))
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def summarize_block(store: Store, block_id: str, writer: Callable[[str], str] = template_writer) -> str:
    return validated(writer(block_prompt(block_id, block_evidence(store.evidence, block_id).collect())))  # one block's events


def summarize_episode(store: Store, episode_id: int, writer: Callable[[str], str] = template_writer) -> str:
    meta = store.episodes.filter(f"episode_id = {int(episode_id)}").first()
    if meta is None:
        raise ValueError(f"no episode {episode_id}")
    breakdown = ev.component_breakdown(store.evidence, store.members, episode_id).collect()
    sample = ev.episode_sample(store.evidence, store.members, episode_id).collect()
    purity = ev.labelled_purity(store.members, store.labels, episode_id).first()
    return validated(writer(episode_prompt(meta, breakdown, sample, purity)))


def main(argv: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(description="Summary of an incident or an episode.")
    which = cli.add_mutually_exclusive_group(required=True)
    which.add_argument("--block-id")
    which.add_argument("--episode-id", type=int)
    cli.add_argument("--tables", required=True)
    cli.add_argument("--save")
    a = cli.parse_args(argv)
    store = Store.of_folder(build_spark("incident-summary"), a.tables)
    kind, key = ("block", a.block_id) if a.block_id else ("episode", a.episode_id)
    text = summarize_block(store, key) if kind == "block" else summarize_episode(store, key)
    print(text)
    if a.save:
        save(text, a.save, kind, key)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
