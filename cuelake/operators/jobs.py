"""Outcomes of a job queue from its ordered log of events.

A DataFrame computes what a log amounts to. It takes no locks: who claims a job first is decided by the log's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attempts after which a failing job is given up.
ATTEMPTS = 3
#: Active jobs beyond which a queue refuses others.
MAX_PENDING = 20
STAGES = {"acquire": "fetching", "ingest": "preparing_video", "speech": "transcribing", "visual": "indexing"}
#: Seconds that a job of each kind may run.
DEADLINES = {"acquire": 3600, "ingest": 1800, "speech": 7200, "visual": 3600}


def retried(status: Column, error: Column, retryable: Column, attempts: Column) -> Column:
    """Status after an attempt: ready, queued again after a failure that may pass, or failed."""
    again = error.isNotNull() & F.coalesce(retryable, F.lit(True)) & (attempts < ATTEMPTS)
    return F.when(error.isNull(), "ready").when(again, "queued").otherwise("failed")


def backoff(now: Column, attempts: Column) -> Column:
    return now + F.pow(F.lit(2.0), attempts)


def enqueued(requests: DataFrame, queue: list[str], key: list[str], at: str, until: str, ident: str, most: int = MAX_PENDING) -> DataFrame:
    """Adds ``verdict``: ``full`` if ``most`` jobs of the queue are active (from ``at`` to ``until``), ``active`` if one of
    the same key is, else ``accepted``.

    What happens to a request depends on all before it, so a queue is folded by one task in the order of ``at`` and
    ``ident``, row by row from a sorted partition; what is kept are the active jobs, ``most`` at the most. Queues run side
    by side. A null or not finite time, or an end before the start, makes a job that is never active.
    """
    columns = requests.columns
    by = [*queue, at, ident]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, active = None, {}
        for b in batches:
            cols = b.to_pydict()
            verdicts = []
            for q, k, t, u in zip(zip(*(cols[c] for c in queue)), zip(*(cols[c] for c in key)), cols[at], cols[until]):
                if q != now:
                    now, active = q, {}
                if t is not None:
                    active = {x: e for x, e in active.items() if e > t}
                if len(active) >= most:
                    verdicts.append("full")
                elif k in active:
                    verdicts.append("active")
                else:
                    verdicts.append("accepted")
                    if t is not None and u is not None and t < u < float("inf"):
                        active[k] = u
            yield b.append_column("verdict", pa.array(verdicts, pa.string()))

    schema = T.StructType([*requests.schema.fields, T.StructField("verdict", T.StringType())])
    return requests.select(*columns).repartition(*queue).sortWithinPartitions(*by).mapInArrow(run, schema)


def recovered(jobs: DataFrame) -> DataFrame:
    """``(job_id, status)`` after their worker went away: jobs marked as running end with an error and are queued again
    or, after the last attempt or if they can't be retried, failed. Others aren't touched."""
    running = jobs.where(F.col("status") == "running")
    return running.select("job_id", retried(F.col("status"), F.lit("Worker interrupted"), F.col("retryable"), F.col("attempts")).alias("status"))


def claimable(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The n queued jobs that are due and have waited longest."""
    return jobs.where((F.col("status") == "queued") & (F.col("available_at") <= now)).orderBy("available_at", "job_id").limit(n)


def latest(jobs: DataFrame, keys: list[str], at: str, ident: str) -> DataFrame:
    """The last job of each key: one pass, no sort."""
    last = F.max_by(F.struct(*[c for c in jobs.columns if c not in keys]), F.struct(at, ident))
    return jobs.groupBy(*keys).agg(last.alias("j")).select(*keys, "j.*")


def stage(kind: Column, status: Column) -> tuple[Column, Column]:
    """What to show of a job: processing or failed (null when ready), and its stage by kind."""
    m = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))
    return F.when(status.isin("queued", "running"), "processing").when(status == "failed", "failed"), F.coalesce(F.try_element_at(m, kind), kind)


def retry_verdict(status: Column, retryable: Column) -> Column:
    return F.when(status.isNull(), "not_found").when(status != "failed", "not_failed").when(~F.coalesce(retryable, F.lit(True)), "not_retryable").otherwise("queued")


def overdue(kind: Column, started: Column, now: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in DEADLINES.items() for x in kv))
    return now - started > F.try_element_at(m, kind)


def running(df: DataFrame, keys: list[str], order: list, amount: str, out: str) -> DataFrame:
    """Adds the running sum of ``amount``."""
    return df.withColumn(out, F.sum(amount).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
