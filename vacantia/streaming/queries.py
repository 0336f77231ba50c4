"""Streaming forms of ingest, dedupe, windows, stuck runs, task states, reminders.

Every function starts a query that drains what has landed (``availableNow``)
and returns it; callers wait on it and read the result folder. State lives in
Spark's state store or in a :class:`ChangeLog`, both under the shared folder.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.functions import dates
from vacantia.operators import filters, task_state, transitions
from vacantia.sources.duplicate_keys import KeyTable
from vacantia.streaming.changelog import ChangeLog

STUCK_MINUTES = 60


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_stream(landed: DataFrame, store: ChangeLog, as_of: str, checkpoint: str, keys: KeyTable | None = None) -> StreamingQuery:
    """Landed postings into the stored ones, batch by batch.

    With ``keys`` duplicates are found in the kept key table, which follows the
    changes of each batch; only postings that are refreshed are then read.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = store.current(batch_id)
        known = keys.rows(batch_id + 1) if keys else None  # the start is batch 0 of the table
        changes = transitions.ingest_changes(stored, batch, as_of, keys=known)
        start = (batch_id + 1) << 40
        store.write(transitions.with_ids(changes, start, [F.col("company_id"), F.col("external_id")]), batch_id)
        if keys:
            written = store.rows().filter(F.col("batch") == batch_id)
            keys.change(stored.join(written.select("id"), "id", "left_semi"), written, batch_id + 1)

    return drain(landed, handle, checkpoint)


def dedupe_stream(postings: DataFrame, horizon: str = "7 days") -> DataFrame:
    """First posting per external id within the horizon."""
    return postings.withWatermark("discovered_at", horizon).dropDuplicatesWithinWatermark(["external_id"])


def window_counts(rows: DataFrame, at: str, keys: list[str], length: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Rows per sliding window and key; the same call serves streams and batches."""
    counted = rows.groupBy(F.window(at, length, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def window_stream(rows: DataFrame, at: str, keys: list[str], log: ChangeLog, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Changed windows of each batch into a change log."""
    counts = window_counts(rows.withWatermark(at, late), at, keys)
    return drain(counts, log.write, checkpoint, mode="update")


def stuck_runs(starts: DataFrame, finishes: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Runs without a finish within an hour of their start.

    An outer stream-stream join: a start leaves the state unmatched once the
    watermark has passed its hour. The state is keyed by a hash of the run, which it
    holds twice a row and once more when the row leaves; the run itself is compared then.
    """
    s = starts.withWatermark("started_at", late)
    f = finishes.withWatermark("finished_at", late).select(*[F.col(k).alias(f"_{k}") for k in keys], "finished_at")
    same = F.xxhash64(*keys) == F.xxhash64(*[f"_{k}" for k in keys])
    for k in keys:
        same = same & F.col(k).between(F.col(f"_{k}"), F.col(f"_{k}"))  # an equality would become part of the key
    limit = F.col("started_at") + F.expr(f"INTERVAL {STUCK_MINUTES} MINUTES")
    in_time = (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= limit)
    joined = s.join(f, same & in_time, "left_outer")
    return joined.filter(F.col("finished_at").isNull()).drop("finished_at", *[f"_{k}" for k in keys])


def clock_of(starts: DataFrame, finishes: DataFrame, late: str = "1 hour") -> int | None:
    """The watermark (microseconds) of ``stuck_runs`` after these rows; none if a side has no times."""
    ends = starts.agg(F.max("started_at").alias("a")).crossJoin(finishes.agg(F.max("finished_at").alias("b")))
    slower = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least("a", "b") - F.expr(f"INTERVAL {late}"))
    return ends.select(F.unix_micros(slower)).first()[0]


def stuck_as_of(found: DataFrame, starts: DataFrame, finishes: DataFrame, keys: list[str], as_of: str, clock: int | None = None) -> DataFrame:
    """Runs the stream has reported, and those its watermark has not reached, as of a moment.

    ``clock``: a watermark (microseconds) that a batch of the stream has read rows
    with. It has decided all runs whose hour was over by then, so only later ones are
    looked at, and those without a key, which no join finds again.
    """
    late = dates.plus(dates.ts(as_of), -STUCK_MINUTES, "minute")
    if clock is not None:
        # a minute more than the hour, for the rounding of the watermark
        reached = F.timestamp_micros(F.lit(clock - (STUCK_MINUTES + 1) * 60_000_000))
        keyless = reduce(operator.or_, [F.col(k).isNull() for k in keys])
        starts = starts.filter((F.col("started_at") >= reached) | keyless)
        # a run that started later ends later
        finishes = finishes.filter(F.col("finished_at") >= reached)
    ended = finishes.select(*keys, "finished_at").withColumnRenamed("finished_at", "_end")
    rest = starts.join(found.select(*keys, "started_at"), [*keys, "started_at"], "left_anti")
    open_ones = rest.join(ended, keys, "left").groupBy(*starts.columns).agg(
        F.max((F.col("_end") >= F.col("started_at")) & (F.col("_end") <= F.col("started_at") + F.expr(f"INTERVAL {STUCK_MINUTES} MINUTES"))).alias("_done")
    )
    both = found.unionByName(open_ones.filter(~F.coalesce("_done", F.lit(False))).drop("_done"))
    return both.filter(F.col("started_at") < late)


STATE = "task_id bigint, status string, rejected bigint, completed_at timestamp, commands bigint, snooze_count bigint, snooze_until timestamp"


def task_stream(commands: DataFrame, log: ChangeLog, checkpoint: str, wake: bool = False) -> StreamingQuery:
    """Task states from a stream of commands, in batch order.

    With ``wake`` each batch ends with a look at the clock of its events: tasks
    whose snooze has run out become pending.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        before = log.current(batch_id)
        new = task_state.replay_commands(batch, before.select("task_id", "status"))
        old = before.select("task_id", *[F.col(c).alias(f"_{c}") for c in ("rejected", "completed_at", "commands", "snooze_count", "snooze_until")])
        merged = new.join(old, "task_id", "left").select(
            "task_id", "status",
            (F.col("rejected") + F.coalesce("_rejected", F.lit(0))).alias("rejected"),
            F.coalesce("_completed_at", "completed_at").alias("completed_at"),
            (F.col("commands") + F.coalesce("_commands", F.lit(0))).alias("commands"),
            (F.col("snooze_count") + F.coalesce("_snooze_count", F.lit(0))).alias("snooze_count"),
            F.coalesce("snooze_until", "_snooze_until").alias("snooze_until"),
        )
        if wake:
            clock = batch.agg(F.max("ts").alias("c")).scalar()
            others = before.join(merged.select("task_id"), "task_id", "left_anti").filter("status = 'snoozed'").filter(F.col("snooze_until") <= clock)
            merged = merged.unionByName(others)
            over = (F.col("status") == "snoozed") & (F.col("snooze_until") <= clock)
            merged = merged.withColumn("status", F.when(over, "pending").otherwise(F.col("status")))
        log.write(merged, batch_id)

    return drain(commands, handle, checkpoint)


def reminder_stream(ticks: DataFrame, tasks: DataFrame, sent: ChangeLog, checkpoint: str, within_hours: int = 1) -> StreamingQuery:
    """Due tasks at each tick, each sent once. ``ticks``: rows with ``as_of``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        clock = batch.agg(F.max("as_of").alias("c")).scalar()
        by = dates.plus(clock, within_hours, "hour")
        due = tasks.filter((F.col("due_date") <= by) & F.col("status").isin(*filters.OPEN_TASK))
        # what was sent is folded now and then, so a tick reads a bounded number of earlier ones
        fresh = due.join(sent.current(batch_id).select("id"), "id", "left_anti")
        sent.write(fresh.select("id", "job_id", "due_date").withColumn("sent_at", clock), batch_id)

    return drain(ticks, handle, checkpoint)


def activity_stream(activities: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Activity rows into a table split by day."""
    return (
        activities.withColumn("day", F.to_date("created_at"))
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .trigger(availableNow=True)
        .start()
    )
