"""Jobs: the life cycle folded from an event log, counts by status, and which job is next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cases

STATUSES = ("pending", "processing", "completed", "failed")
ATTEMPTS = 3


def job_states(events: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(job, status, attempts, created_ts, updated_ts) from (job, seq, kind, ts): the last event decides."""
    last = events.groupBy("job").agg(F.max_by("kind", "seq").alias("kind"), F.count_if(F.col("kind") == "started").alias("attempts"), F.min("ts").alias("created_ts"), F.max("ts").alias("updated_ts"))
    k = F.col("kind")
    status = cases([(k == "completed", "completed"), (k == "cancelled", "failed"), (k == "started", "processing"), ((k == "failed") & (F.col("attempts") >= attempts), "failed")], "pending")
    return last.select("job", status.alias("status"), "attempts", "created_ts", "updated_ts")


def status_counts(states: DataFrame) -> DataFrame:
    """(status, jobs) of all statuses, with zeros."""
    domain = states.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return domain.join(states.groupBy("status").agg(F.count("*").alias("jobs")), "status", "left").fillna(0, ["jobs"])


def next_jobs(states: DataFrame, priorities: DataFrame | None = None, slots: int = 3, now: int | None = None) -> DataFrame:
    """The pending jobs to start in the slots that processing jobs leave free, by priority, then age.

    Where states have ``retry_after``, a job waits until ``now`` is past it. The jobs returned are at most ``slots``.
    """
    rows = states.filter("status = 'pending'")
    if now is not None and "retry_after" in states.columns:
        rows = rows.filter(F.col("retry_after").isNull() | (F.col("retry_after") <= now))
    rows = rows.join(priorities, "job", "left").fillna(0, ["priority"]) if priorities is not None else rows.withColumn("priority", F.lit(0))
    busy = states.filter("status = 'processing'").limit(slots).count()
    return rows.orderBy(F.desc("priority"), "created_ts", "job").limit(max(0, slots - busy))


def retained(states: DataFrame, ref_ts: int, days: int = 7) -> DataFrame:
    """States without finished jobs that are older than ``days``."""
    done = F.col("status").isin("completed", "failed")
    return states.filter(~done | (F.col("updated_ts") >= ref_ts - days * 86_400_000))


def newest(rows: DataFrame, n: int, ts: str, key: str | None = None) -> DataFrame:
    """The n newest rows, or of each key."""
    if key is None:
        return rows.orderBy(F.desc(ts)).limit(n)
    at = Window.partitionBy(key).orderBy(F.desc(ts))
    return rows.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= n).drop("_n")
