"""Streams of events: windows and sessions with late data, and the job queue as a keyed state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake.operators.jobs import ATTEMPTS


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in windows of event time; what comes later than ``late`` is left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


STATE = "status string, attempts int, available_at double, refused int"
OUT = "active_key string, status string, attempts int, available_at double, refused int"


def advance(state: tuple | None, kind: str, at: float) -> tuple:
    """State of one active key after an event: enqueue, claim, done, fail (may pass) or fatal.

    Enqueueing an active job is refused and counted; a claim needs a queued job that is due; a failed attempt waits
    2**attempts seconds and is given up after ATTEMPTS. Events that don't fit the state change nothing.
    """
    status, attempts, due, refused = state or ("none", 0, 0.0, 0)
    if kind == "enqueue":
        return (status, attempts, due, refused + 1) if status in ("queued", "running") else ("queued", 0, at, refused)
    if kind == "claim" and status == "queued" and at >= due:
        return ("running", attempts + 1, due, refused)
    if kind == "done" and status == "running":
        return ("ready", attempts, due, refused)
    if kind in ("fail", "fatal") and status == "running":
        return ("queued" if kind == "fail" and attempts < ATTEMPTS else "failed", attempts, at + 2**attempts, refused)
    return (status, attempts, due, refused)


def job_states(events: DataFrame) -> DataFrame:
    """The state of each active key after each batch, from a stream ``(active_key, event, at)``.

    Events of a batch are taken in order of ``at``; a key's state is four numbers, kept until it is dropped by the
    caller's retention.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "event"], kind="stable")
        for kind, at in zip(rows["event"], rows["at"]):
            now = advance(now, kind, float(at))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["active_key", "status", "attempts", "available_at", "refused"])

    return events.groupBy("active_key").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
