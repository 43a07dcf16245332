"""Command: quality of a detector against labels, over stored events or the synthetic log."""

from __future__ import annotations

import argparse

from pyspark.sql import Row

from ..operators.evaluation import detector_evaluation
from ..sources.session import build_spark
from .store import Store

DETECTORS = {"incidents": "static_incidents", "incidents_behavioral": "incidents"}


def evaluate(store: Store, detector: str) -> Row:
    """The one row of detector_evaluation for a detector of DETECTORS."""
    return detector_evaluation(getattr(store, DETECTORS[detector]), store.labels, store.raw).first()


def main(argv: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(description="Quality of a detector on the labelled blocks that were seen.")
    cli.add_argument("--tables", required=True, help="folder with raw_events of the streaming job, or with events.parquet")
    cli.add_argument("--labels", help="label CSV; by default labels.csv in that folder")
    cli.add_argument("--table", choices=list(DETECTORS), default="incidents_behavioral", type=str.lower)
    a = cli.parse_args(argv)
    found = evaluate(Store.of_folder(build_spark("detector-evaluation"), a.tables, a.labels), a.table)
    print(f"detector: {a.table}")
    for name, value in found.asDict().items():
        print(f"{name.replace('_', ' ')}: {value:.4f}" if isinstance(value, float) else f"{name.replace('_', ' ')}: {value}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
