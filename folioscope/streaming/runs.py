"""Run events as streams: the current state of runs, legal changes, idempotent appends, progress by windows.

Every stream gives, once its input is read, what the batch operator of the same name gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.store import TRANSITIONS


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, status, at, changes): the latest status of each run; for a stream in complete or update mode."""
    return events.groupBy("run_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max("at").alias("at"), F.count("*").alias("changes"))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and status; those that are later than the watermark are dropped."""
    return events.withWatermark("at", late).groupBy(F.window("at", size).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """Spells of activity of a run that are apart by more than a gap."""
    return events.withWatermark("at", late).groupBy("run_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def checked_transitions(events: DataFrame) -> DataFrame:
    """(run_id, event_id, prior, status, legal) with the status before each event held as state; a run's events of one micro-batch are taken in order of event_id."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        prior = state.get[0] if state.exists else None
        rows = []
        for event in pd.concat(list(parts)).sort_values("event_id").itertuples():
            rows.append((key[0], event.event_id, prior, event.status, prior is None or event.status in TRANSITIONS.get(prior, [])))
            prior = event.status
        state.update((prior,))
        yield pd.DataFrame(rows, columns=["run_id", "event_id", "prior", "status", "legal"])

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id long, event_id long, prior string, status string, legal boolean", "status string", "append", "NoTimeout")


def batch_writer(path: str):
    """For foreachBatch: a micro-batch replaces the part of its own number, so that a retry changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key of an append-only table: the last one."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return table.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
