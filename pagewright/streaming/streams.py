"""Structured Streaming: leads deduplicated within a watermark, job states, event-time counts, completion by idleness.

Event-time windows are an extension of ours; states and time-to-live follow the stored operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import TERMINAL


def leads_once(leads: DataFrame, seen_at: str = "seen_at", keep: str = "24 hours") -> DataFrame:
    """The first of each lead key within a time to live; state older than that is dropped."""
    return leads.withWatermark(seen_at, keep).dropDuplicatesWithinWatermark(["lead_key"])


def counts(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, at: str = "ts", gap: str = "9 seconds", late: str = "1 minute") -> DataFrame:
    """Bursts of progress of a job: one that is followed by an idle gap is complete."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), "job_id").agg(F.count("*").alias("n"))


def job_states(events: DataFrame) -> DataFrame:
    """events (job_id, at_ms, status) -> a row for each change of a job's state; terminal states stay."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, at = state.get if state.exists else ("", -1)
        rows = pd.concat(list(batches)).sort_values("at_ms", kind="stable")
        out = []
        for t, s in zip(rows["at_ms"], rows["status"]):
            if t >= at and s != status and status not in TERMINAL:
                out.append((key[0], status or None, s, int(t)))
                status, at = s, int(t)
        state.update((status, at))
        yield pd.DataFrame(out, columns=["job_id", "before", "status", "at_ms"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, before string, status string, at_ms long", "status string, at_ms long", "append", GroupStateTimeout.NoTimeout)


def drift_batches(report, fields: list[str], ratio: float = 0.95):
    """A foreachBatch callback: reports the share of missing values of each batch, and whether it warns."""

    def run(df: DataFrame, epoch: int) -> None:
        missing = [F.avg((F.coalesce(F.col(f).cast("string"), F.lit("")) == "").cast("double")).alias(f) for f in fields]
        row = df.agg(F.count("*").alias("n"), *missing).first()
        report(epoch, row["n"], {f: row[f] for f in fields}, any((row[f] or 0) > ratio for f in fields))

    return run
