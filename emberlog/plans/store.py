"""The relations that queries read, built on first use from one set of tables.

A store begins with raw events and labels. Store(spark, sf_dir) makes both from the table `events`, of(...) takes
any two relations, and of_folder(...) reads what the streaming job and the label load have stored.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behavior, episodes, evidence, star, windows
from ..sources.log_lines import RAW_SCHEMA, at_rest, ground_truth_labels, load_labels_csv, raw_log_events


class Store:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, raw: DataFrame, labels: DataFrame) -> Store:
        """A store over given relations of RAW_SCHEMA and LABEL_SCHEMA; other columns are not read."""
        store = cls(raw.sparkSession, "")
        columns = [c.split()[0] for c in RAW_SCHEMA.split(", ")]
        store.__dict__ |= {"raw": at_rest(raw.select(*columns)), "labels": labels.select("block_id", "label")}
        return store

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, labels: str | None = None) -> Store:
        """A store over the stream's table raw_events in a folder, and a label CSV, by default labels.csv there.

        A folder with events.parquet gives the synthetic log.
        """
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/raw_events")
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return cls(spark, folder)
        raw = spark.read.schema(RAW_SCHEMA.replace("timestamp_ntz", "timestamp")).parquet(f"{folder}/raw_events")
        return cls.of(raw, load_labels_csv(spark, labels or f"{folder}/labels.csv"))

    @cached_property
    def raw(self) -> DataFrame:
        return raw_log_events(self.spark, self.sf_dir)

    @cached_property
    def labels(self) -> DataFrame:
        return ground_truth_labels(self.raw)

    @cached_property
    def windows(self) -> DataFrame:
        return windows.windowed_metrics(self.raw)

    @cached_property
    def static_incidents(self) -> DataFrame:
        return windows.flag_static(self.windows)

    @cached_property
    def activity(self) -> DataFrame:
        return windows.component_activity(self.raw)

    @cached_property
    def rolling(self) -> DataFrame:
        return windows.rolling_stats(self.activity)

    @cached_property
    def zscores(self) -> DataFrame:
        return windows.zscores(self.rolling)

    @cached_property
    def zblocks(self) -> DataFrame:
        return windows.zscore_blocks(self.zscores, self.raw)

    @cached_property
    def features(self) -> DataFrame:
        return behavior.block_features(self.raw)

    @cached_property
    def derived(self) -> DataFrame:
        return behavior.block_derived(self.features)

    @cached_property
    def scores(self) -> DataFrame:
        return behavior.anomaly_scores(self.derived)

    @cached_property
    def incidents(self) -> DataFrame:
        return behavior.incidents_behavioral(self.derived).drop("detected_at")

    @cached_property
    def timeline(self) -> DataFrame:
        return episodes.timeline(self.incidents, self.features)

    @cached_property
    def members(self) -> DataFrame:
        return episodes.episode_members(self.timeline)

    @cached_property
    def episodes(self) -> DataFrame:
        return episodes.incident_episodes(self.members)

    @cached_property
    def evidence(self) -> DataFrame:
        return evidence.evidence_behavioral(self.incidents, self.derived, self.raw)

    @cached_property
    def dims(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return star.dim_block(self.labels, self.raw), star.dim_date(self.windows), star.dim_component(self.raw)

    def labelled(self, df: DataFrame) -> DataFrame:
        return df.join(self.labels, "block_id")

    @staticmethod
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))
