"""Structured Streaming: watched files, debounced sessions, tasks with a time to live, replay buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphmill.operators.storage import TableStore, upsert

#: Time to live of a task and its bounds in milliseconds, idle time of a session, bounds of its replay buffer.
TASK_TTL, TASK_TTL_LEAST, TASK_TTL_MOST = 300_000, 10_000, 3_600_000
SESSION_IDLE, REPLAY_EVENTS, REPLAY_BYTES, EVENT_BYTES = "30 minutes", 256, 1 << 20, 256 << 10


def watch(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """A stream of the rows of files that appear in a folder."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def sessions(events: DataFrame, key: str, at: str, gap: str = SESSION_IDLE, late: str | None = None) -> DataFrame:
    """(key, start, end, events): bursts of activity that a quiet gap ends; works on batches and on streams.

    On a stream, pass `late`, the watermark after which a session is final.
    """
    src = events.withWatermark(at, late) if late else events
    out = src.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def maintain(stream: DataFrame, store: TableStore, name: str, keys: list[str], checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Upsert every micro-batch into a stored table, once each: table and batch number are one commit.

    A batch that was already applied is skipped when the query restarts.
    """

    def apply(batch: DataFrame, number: int) -> None:
        done = store.metadata(f"batch:{name}")
        if done is not None and number <= done:
            return
        store.write(name, upsert(store.read(name), batch, keys) if store.has(name) else batch, {f"batch:{name}": number})
        if after is not None:
            after(batch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TASK = "task_id string, status string, updated_ms long"


def _step(status: str | None, event: str) -> str | None:
    """Next status of a task; cancelled, and a task that ended, stay as they are."""
    if status in ("cancelled", "completed", "failed"):
        return status
    return {"create": "working", "complete": "completed", "fail": "failed", "cancel": "cancelled"}.get(event, status)


def task_states(events: DataFrame, ttl_ms: int = TASK_TTL, watermark: str = "1 minute") -> DataFrame:
    """(task_id, status, updated_ms) after each micro-batch of events (task_id, event, at); a task without news expires as cancelled.

    State is one small row per task and is dropped when the task ends or expires.
    """
    ttl = max(TASK_TTL_LEAST, min(TASK_TTL_MOST, ttl_ms))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, at = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "cancelled", at + ttl)], columns=["task_id", "status", "updated_ms"])
            return
        status, at = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        for event, t in zip(rows["event"], rows["at"]):
            ms = int(pd.Timestamp(t).value // 1_000_000)
            if status == "working" and ms > at + ttl:
                status = "cancelled"
            new = _step(status, event)
            if new != status:
                status, at = new, ms
        if status is None:
            return
        if status == "working":
            state.update((status, at))
            state.setTimeoutTimestamp(at + ttl)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], status, at)], columns=["task_id", "status", "updated_ms"])

    grouped = events.withWatermark("at", watermark).groupBy("task_id")
    return grouped.applyInPandasWithState(run, TASK, "status string, at long", "update", GroupStateTimeout.EventTimeTimeout)


def task_outcomes(events: DataFrame, ttl_ms: int = TASK_TTL) -> DataFrame:
    """(task_id, status) of a finished log of events: the batch form of `task_states`, for all tasks created."""
    ttl = max(TASK_TTL_LEAST, min(TASK_TTL_MOST, ttl_ms))
    ms = F.unix_millis(F.col("at").cast("timestamp"))
    born = events.filter("event = 'create'").groupBy("task_id").agg(F.min(ms).alias("born"))
    ends = events.filter(F.col("event").isin("complete", "fail", "cancel")).select("task_id", "event", ms.alias("ms")).join(born, "task_id")
    first = ends.filter(F.col("ms").between(F.col("born"), F.col("born") + ttl)).groupBy("task_id").agg(F.min(F.struct("ms", "event")).alias("e"))
    status = F.when(F.col("e.event") == "complete", "completed").when(F.col("e.event") == "fail", "failed").otherwise("cancelled")
    return born.join(first, "task_id", "left").select("task_id", status.alias("status"))


def replay_after(events: DataFrame, session: str, order: list, size: str, after: int) -> DataFrame:
    """(session, seq): buffered events with a number above `after`: per session the newest REPLAY_EVENTS within REPLAY_BYTES."""
    from pyspark.sql import Window as W

    kept = events.filter(F.col(size) <= EVENT_BYTES)
    seq = F.row_number().over(W.partitionBy(session).orderBy(*order)).cast("long")
    numbered = kept.withColumn("seq", seq)
    back = W.partitionBy(session).orderBy(F.desc("seq"))
    numbered = numbered.withColumn("n", F.row_number().over(back)).withColumn("b", F.sum(size).over(back.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.filter((F.col("n") <= REPLAY_EVENTS) & (F.col("b") <= REPLAY_BYTES) & (F.col("seq") > after)).drop("n", "b")


class Cancellable:
    """Runs an action under a tag, so that another thread can cancel all of its Spark jobs."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag

    def __enter__(self) -> Cancellable:
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
