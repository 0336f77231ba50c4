"""Task states with timers: a snooze ends when its time comes.

Every task is keyed state in Spark's state store: its status, the end of its
snooze and how many commands it has had. Snoozing sets a timer; when the clock of
the events (the watermark) has passed it, the task becomes pending, whether or
not a command for it ever comes. A command that comes later than a snooze's end
finds the task pending already.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vacantia.operators.scale import keep_first
from vacantia.operators.task_state import STATES, outcome, snoozed_until
from vacantia.streaming.changelog import ChangeLog
from vacantia.streaming.queries import drain

TASKS = "task_id bigint, status string, snooze_until timestamp, commands bigint, woken bigint"
HELD = "status string, until bigint, commands bigint, woken bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Snoozes(StatefulProcessor):
    """State of one task; times are microseconds since 1970."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, until, commands, woken = self.task.get() if self.task.exists() else ("pending", None, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["at", "id"])
        for at, command, ends in zip(batch["at"], batch["new_status"], batch["until"]):
            if status == "snoozed" and until <= at:
                status, woken = "pending", woken + 1
            status, _ = outcome(status, command)
            commands += 1
            if command == "snoozed":
                until = int(ends)
                if status == "snoozed":
                    self.handle.registerTimer(until // 1000 + 1)
        self.task.update((status, until, commands, woken))
        yield self.shown(key, status, until, commands, woken)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, until, commands, woken = self.task.get()
        # a timer of a snooze that was ended or set anew changes nothing
        if status == "snoozed" and until < expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.task.update(("pending", until, commands, woken + 1))
            yield self.shown(key, "pending", until, commands, woken + 1)

    def close(self) -> None:
        pass

    def shown(self, key, status, until, commands, woken) -> pd.DataFrame:
        end = pd.NaT if until is None else pd.Timestamp(until, unit="us")
        return pd.DataFrame({"task_id": [key[0]], "status": [status], "snooze_until": [end], "commands": [commands], "woken": [woken]})


def timer_stream(commands: DataFrame, log: ChangeLog, checkpoint: str, late: str = "0 seconds") -> StreamingQuery:
    """Task states of a stream of commands (``id, task_id, ts, new_status``, optionally ``snooze_for``) into a change log."""
    spark = commands.sparkSession
    option = F.col("snooze_for") if "snooze_for" in commands.columns else F.lit(None).cast("string")
    known = commands.filter(F.col("new_status").isin(*STATES)).withWatermark("ts", late)
    rows = known.select("id", "task_id", "ts", F.unix_micros("ts").alias("at"), "new_status", F.unix_micros(snoozed_until(F.col("ts"), option)).alias("until"))
    states = rows.groupBy("task_id").transformWithStateInPandas(Snoozes(), TASKS, "Update", "EventTime")

    def handle(batch: DataFrame, batch_id: int) -> None:
        # a task may show up for its commands and again for its timer
        log.write(keep_first(batch, ["task_id"], [F.col("commands").desc(), F.col("woken").desc()]), batch_id)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # timers need it; a query keeps the settings it starts with
    try:
        return drain(states, handle, checkpoint, mode="update")
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
