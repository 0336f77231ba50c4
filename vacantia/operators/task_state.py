"""Replaying status commands of tasks.

A run of commands is a function from the state before to the state after, and
such functions compose. Commands are range-partitioned on (task, time), each
task of a partition is reduced to one function over the five states, and the
few functions of a task are applied in order. A task with a third of all
commands is therefore spread over as many tasks as any other data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states and the allowed moves.
STATES = ("pending", "in_progress", "completed", "snoozed", "cancelled")
MOVES = {
    "pending": ("in_progress", "completed", "snoozed", "cancelled"),
    "in_progress": ("completed", "snoozed", "cancelled"),
    "snoozed": ("pending", "in_progress", "cancelled"),
    "completed": (),
    "cancelled": (),
}
SNOOZE_HOURS = {"1h": 1, "1d": 24, "3d": 72, "1w": 168}
DEFAULT_SNOOZE = "1d"
BULK_STATUS = {"complete": "completed", "cancel": "cancelled", "snooze": "snoozed"}
NEVER = np.iinfo(np.int64).min
SUMMARY = "task_id long, first_ts timestamp, first_id long, ends array<int>, rejected array<long>, completed_us array<long>"


def outcome(state: str, command: str) -> tuple[str, bool]:
    """State after a command and whether it counts as success.

    Repeating the present state succeeds. Snoozing always succeeds, but a final
    task keeps its state.
    """
    if command == state or command in MOVES[state]:
        return command, True
    return state, command == "snoozed"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    n = len(STATES)
    after, failed = np.zeros((n, n), dtype=np.int64), np.zeros((n, n), dtype=np.int64)
    for c, command in enumerate(STATES):
        for s, state in enumerate(STATES):
            end, good = outcome(state, command)
            after[c, s], failed[c, s] = STATES.index(end), int(not good)
    return after, failed


def _reduce(task: np.ndarray, ends: np.ndarray, rejected: np.ndarray, done: np.ndarray):
    """Compose neighbouring rows of the same task until each task has one row."""
    first = np.arange(len(task))
    while len(task) > 1 and (task[1:] == task[:-1]).any():
        starts = np.r_[0, np.flatnonzero(task[1:] != task[:-1]) + 1]
        place = np.arange(len(task)) - np.repeat(starts, np.diff(np.r_[starts, len(task)]))
        left = np.flatnonzero((place % 2 == 0) & np.r_[task[1:] == task[:-1], False])
        right = left + 1
        via = ends[left]
        ends[left], rejected[left] = (
            np.take_along_axis(ends[right], via, 1),
            rejected[left] + np.take_along_axis(rejected[right], via, 1),
        )
        done[left] = np.where(done[left] != NEVER, done[left], np.take_along_axis(done[right], via, 1))
        keep = np.ones(len(task), dtype=bool)
        keep[right] = False
        task, ends, rejected, done, first = task[keep], ends[keep], rejected[keep], done[keep], first[keep]
    return task, ends, rejected, done, first


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One function per task of a sorted partition; batches may cut a task."""
    after, failed = _tables()
    code = {s: i for i, s in enumerate(STATES)}
    held = None
    for batch in batches:
        if batch.empty:
            continue
        command = batch["new_status"].map(code).to_numpy()
        stamp = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        ends = after[command].copy()
        moves = (ends == code["completed"]) & (np.arange(len(STATES)) != code["completed"])
        parts = (
            batch["task_id"].to_numpy(), ends, failed[command].copy(), np.where(moves, stamp[:, None], NEVER),
            stamp, batch["id"].to_numpy(),
        )
        if held is not None:
            parts = tuple(np.concatenate([h, p]) for h, p in zip(held, parts))
        task, ends, rejected, done, first = _reduce(*parts[:4])
        stamp, ident = parts[4][first], parts[5][first]
        held = (task[-1:], ends[-1:], rejected[-1:], done[-1:], stamp[-1:], ident[-1:])
        if len(task) > 1:
            yield _frame(task[:-1], ends[:-1], rejected[:-1], done[:-1], stamp[:-1], ident[:-1])
    if held is not None:
        yield _frame(*held)


def _frame(task, ends, rejected, done, stamp, ident) -> pd.DataFrame:
    return pd.DataFrame({
        "task_id": task, "first_ts": pd.to_datetime(stamp, unit="us"), "first_id": ident,
        "ends": list(ends.astype("int32")), "rejected": list(rejected), "completed_us": list(done),
    })


def _moment(us: Column) -> Column:
    return F.when(us != NEVER, F.timestamp_micros(us))


def snoozed_until(ts: Column, option: Column) -> Column:
    """End of a snooze of one of the offered lengths."""
    hours = F.lit(SNOOZE_HOURS[DEFAULT_SNOOZE])
    for name, length in SNOOZE_HOURS.items():
        hours = F.when(option == name, length).otherwise(hours)
    return ts + F.make_dt_interval(F.lit(0), hours)


def state_code(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), status).cast("int") - 1


def replay_commands(commands: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Final state per task.

    ``commands``: ``id, task_id, ts, new_status`` in the order (ts, id), and
    optionally ``snooze_for``, one of SNOOZE_HOURS; a day where it is missing.
    ``initial``: ``task_id, status``; tasks without one start as pending.
    """
    option = F.col("snooze_for") if "snooze_for" in commands.columns else F.lit(None).cast("string")
    known = commands.filter(F.col("new_status").isin(*STATES)).select("id", "task_id", "ts", "new_status", snoozed_until(F.col("ts"), option).alias("until"))
    order = ["task_id", "ts", "id"]
    cut = known.drop("until").repartitionByRange(*order).sortWithinPartitions(*order)
    runs = cut.mapInPandas(_summaries, SUMMARY)
    run = F.struct("first_ts", "first_id", "ends", "rejected", "completed_us")
    per_task = runs.groupBy("task_id").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    start = F.lit(0)
    if initial is not None:
        per_task = per_task.join(initial.select("task_id", F.col("status").alias("_from")), "task_id", "left")
        start = F.coalesce(state_code(F.col("_from")), F.lit(0))
    zero = F.struct(
        start.cast("int").alias("s"), F.lit(0).cast("long").alias("rejected"), F.lit(None).cast("timestamp").alias("completed_at")
    )
    folded = F.aggregate(
        "runs",
        zero,
        lambda acc, r: F.struct(
            F.get(r["ends"], acc["s"]).alias("s"),
            (acc["rejected"] + F.get(r["rejected"], acc["s"])).alias("rejected"),
            F.coalesce(acc["completed_at"], _moment(F.get(r["completed_us"], acc["s"]))).alias("completed_at"),
        ),
    )
    names = F.array(*[F.lit(s) for s in STATES])
    final = per_task.select("task_id", folded.alias("f")).select(
        "task_id", F.get(names, F.col("f.s")).alias("status"), F.col("f.rejected").alias("rejected"), F.col("f.completed_at").alias("completed_at")
    )
    snoozed = F.col("new_status") == "snoozed"
    counts = known.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("commands"),
        F.count_if(snoozed).alias("snooze_count"),
        F.max(F.when(snoozed, F.struct("ts", "id", "until")))["until"].alias("snooze_until"),
    )
    return final.join(counts, "task_id")


def bulk_action(tasks: DataFrame, task_ids: DataFrame, action: str) -> DataFrame:
    """How many tasks of a list the action succeeds or fails on.

    An id that names no task counts as success.
    """
    command = BULK_STATUS[action]
    good = [s for s in STATES if outcome(s, command)[1]]
    named = task_ids.select(F.col("id")).join(tasks.select("id", "status"), "id", "left")
    success = F.col("status").isNull() | F.col("status").isin(*good)
    return named.agg(F.count_if(success).alias("success"), F.count_if(~success).alias("failed"))
