"""Streams of events: sessions, sliding activity, duplicates in flight, thinning with state.

Each function takes a streaming (or static) DataFrame with an event time and returns another; sinks are the
caller's. ``settled`` runs one over all data that is there and gives the result as a table, for jobs and tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LATE = "20 minutes"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream, with ``ts`` as a timestamp (its files have no zone; the session's is UTC)."""
    static = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "20 minutes", late: str = LATE) -> DataFrame:
    """(key, start, last, events): a pause of more than ``gap`` opens a session."""
    w = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("events"), F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts")).drop("w")


def activity(events: DataFrame, width: str = "24 hours", slide: str = "1 hour", kind: str = "event_type", late: str = LATE) -> DataFrame:
    """(start, end, kind, events, value) over sliding windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), kind)
    return w.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), kind, "events", "value")


def distinct_requests(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Events without repeats of the same keys that come while the first may be in flight."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class Thinner(StatefulProcessor):
    """Keeps a key's last kept event until the watermark is past it by ``idle_ms``: keys that never return leave no state."""

    def __init__(self, key: str, same: str, ms: int, idle_ms: int):
        self.key, self.same, self.ms, self.idle_ms = key, same, ms, idle_ms

    def init(self, handle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "us long, kind string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        us, kind, timer = self.kept.get() if self.kept.exists() else (None, None, None)
        for r in sorted(rows, key=lambda r: (r._us, r[self.same] is not None, r[self.same])):
            if us is None or r[self.same] != kind or r._us - us >= self.ms * 1000:
                yield Row(**{self.key: key[0], "ts": r.ts, self.same: r[self.same]})
                us, kind = r._us, r[self.same]
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(us // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        self.handle.registerTimer(timer)
        self.kept.update((us, kind, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def thinned(events: DataFrame, key: str = "user_id", seconds: float = 20.0, same: str = "event_type", idle_ms: int = 3_600_000, late: str = LATE) -> DataFrame:
    """Events without those within ``seconds`` of the last kept one of the same kind. The last kept one is the state, dropped when the watermark is past it by ``idle_ms``."""
    rows = events.select(key, "ts", same, F.unix_micros("ts").alias("_us")).withWatermark("ts", late)
    schema = rows.select(key, "ts", same).schema
    return rows.groupBy(key).transformWithState(Thinner(key, same, int(seconds * 1000), idle_ms), schema, "Append", "EventTime")


class Memory(StatefulProcessor):
    """Answers that live for a time from when they were stored; the store drops them, and a timer too where time is that of events."""

    def __init__(self, ttl_ms: int, wall: bool):
        self.ttl_ms, self.wall = ttl_ms, wall

    def init(self, handle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", "ts long, value string", self.ttl_ms if self.wall else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # the store is asked once and told once, whatever the number of rows: each call goes to another process
        held = self.answer.get()
        ts, value = held if held is not None else (None, None)
        made = None
        for r in sorted(rows, key=lambda r: (r.ts_ms, r.request)):
            live = ts is not None and (self.wall or r.ts_ms - ts < self.ttl_ms)
            yield Row(key=key[0], request=r.request, ts_ms=r.ts_ms, outcome="hit" if live else "miss" if ts is None else "expired", value=value if live else r.value)
            if not live and r.value is not None:
                made = ts, value = r.ts_ms, r.value
            elif not live:
                # an answer that was not made stores nothing
                ts, value = None, None
        if made is not None:
            self.answer.update(made)
            if not self.wall:
                if held is not None:
                    self.handle.deleteTimer(held[0] + self.ttl_ms)
                self.handle.registerTimer(made[0] + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.answer.clear()
        return iter(())

    def close(self) -> None:
        pass


def remembered(requests: DataFrame, ttl_ms: int, wall: bool = False, late: str = LATE) -> DataFrame:
    """(key, request, ts_ms, outcome, value) of requests (key, request, ts, value): hit, miss or expired, and the value that answers.

    An answer lives ``ttl_ms`` from when it was stored, by the time of events; hits do not prolong it. With ``wall`` it lives by the
    clock of the machines, as the state store's own time to live counts. Either way keys that never return leave no state.
    """
    schema = "key string, request string, ts_ms long, outcome string, value string"
    rows = requests.select("key", "request", F.unix_millis("ts").alias("ts_ms"), "value", *([] if wall else ["ts"]))
    if not wall:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("key").transformWithState(Memory(ttl_ms, wall), schema, "Append", "ProcessingTime" if wall else "EventTime")


#: What keeps states with timers, maps and times to live; others keep a value a key only.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def settled(stream: DataFrame, mode: str = "complete", transform: Callable[[DataFrame], DataFrame] | None = None, at: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns the result as a table of the session.

    Each batch is written to the shared folder; in complete mode the last one is the result. With ``at``, a folder of
    an earlier run, it goes on from there.
    """
    from .sinks import shared_folder

    spark = stream.sparkSession
    out = at or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={n}")

    # states of rows that are added are those with timers; aggregates keep the session's store
    with rocks(spark) if mode == "append" else nullcontext():
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.drop("batch") if mode != "complete" else rows
