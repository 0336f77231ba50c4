"""History of the circuit breaker of every host.

A breaker opens at the last of FAILURES failures without a success between. While
it is open, crawls are refused and change nothing. The first crawl RESET_SECONDS
or more after the opening finds it half-open: the count of failures starts again
at nothing, and the crawl counts as any other.

Crawls are range-partitioned on (host, time), so that a host with a third of all
crawls lies in many chunks. A chunk is a function of the state it begins with:
closed with 0 to 4 failures, or open since some moment; as the breaker can't stay
open for more than RESET_SECONDS after the chunk's first crawl, only the crawls
within that time matter for the last case. The few functions of a host are applied
in order, then every chunk is read again from its true first state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, urls
from vacantia.operators.aggregates import BREAKER_FAILURES, BREAKER_RESET_SECONDS
from vacantia.operators.scale import parts_of
from vacantia.session import settled

#: Crawls of a chunk, which a Python worker holds at a time.
CHUNK_ROWS = 200_000
RESET_US = BREAKER_RESET_SECONDS * 1_000_000
#: How a chunk leaves a host: closed with ``failures``, or open since ``opened`` (microseconds).
STATE = "failures int, opened bigint"
SUMMARY = f"host string, _chunk int, closed array<struct<{STATE}>>, until array<bigint>, after array<struct<{STATE}>>"
PIECES = "host string, opened bigint, closed bigint, failures int, refused bigint"


class Run:
    """Crawls of one host in order: their times and whether they failed."""

    def __init__(self, at: np.ndarray, failed: np.ndarray) -> None:
        self.at, self.failed = at, failed
        places = np.arange(len(at))
        good = np.where(failed, -1, places)
        self.streak = places - np.maximum.accumulate(good) if len(at) else places
        self.full = np.flatnonzero(self.streak >= BREAKER_FAILURES)

    def opening(self, start: int, failures: int) -> int | None:
        """Place of the crawl that opens a breaker which has ``failures`` before ``start``."""
        need = BREAKER_FAILURES - failures - 1
        early = start + need
        if failures and early < len(self.at) and self.failed[start : early + 1].all():
            return early
        k = np.searchsorted(self.full, start + BREAKER_FAILURES - 1)
        return int(self.full[k]) if k < len(self.full) else None

    def half_open(self, opened: int) -> int:
        """Place of the first crawl that an opening at this moment lets through."""
        return int(np.searchsorted(self.at, opened + RESET_US))

    def closed_with(self, start: int, failures: int) -> int:
        """Failures at the end if nothing opens from ``start`` on."""
        streak = int(self.streak[-1])
        return min(streak, len(self.at) - start) + (failures if streak >= len(self.at) - start else 0)

    def walk(self, failures: int, opened: int | None) -> tuple[list[tuple[int, int | None, int]], tuple[int, int | None]]:
        """Openings as (opened, closed or None, refused), and the state at the end."""
        pieces = []
        start, n = 0, len(self.at)
        while True:
            if opened is not None:
                end = self.half_open(opened)
                pieces.append((opened, int(self.at[end]) if end < n else None, end - start))
                if end == n:
                    return pieces, (BREAKER_FAILURES, opened)
                start, failures = end, 0
            if start >= n:
                return pieces, (failures, None)
            at = self.opening(start, failures)
            if at is None:
                return pieces, (self.closed_with(start, failures), None)
            opened, start = int(self.at[at]), at + 1


def _runs(chunk: pd.DataFrame) -> Iterator[tuple[str, Run]]:
    for host, rows in chunk.groupby("host", sort=False):
        yield host, Run(rows["at"].to_numpy(), rows["failed"].to_numpy())


def _as_state(state: tuple[int, int | None]) -> dict:
    return {"failures": state[0], "opened": state[1]}


def _summaries(chunk: pd.DataFrame) -> pd.DataFrame:
    """One function per host of a chunk."""
    order = [c for c in chunk.columns if c.startswith("_o")]
    number = int(chunk["_chunk"].iloc[0])
    out = []
    for host, run in _runs(chunk.sort_values(["host", *order], kind="stable")):
        closed = [_as_state(run.walk(f, None)[1]) for f in range(BREAKER_FAILURES)]
        # open before the chunk: by the crawl that finds it half-open
        last = int(np.searchsorted(run.at, run.at[0] + RESET_US, "right"))
        moments = np.unique(run.at[: last + 1])
        after = [_as_state(run.walk(0, int(m) - RESET_US)[1]) for m in moments]
        out.append((host, number, closed, moments.tolist(), after))
    return pd.DataFrame(out, columns=["host", "_chunk", "closed", "until", "after"])


def _entries(chunks: pd.DataFrame) -> pd.DataFrame:
    """The state each chunk of one host begins with."""
    failures, opened = 0, None
    out = []
    ordered = chunks.sort_values("_chunk")
    for host, chunk, closed, until, after in zip(*[ordered[c] for c in ("host", "_chunk", "closed", "until", "after")]):
        out.append((host, chunk, failures, opened))
        if opened is None:
            state = closed[failures]
        else:
            k = int(np.searchsorted(until, opened + RESET_US))
            state = after[k] if k < len(until) else {"failures": failures, "opened": opened}
        failures, opened = state["failures"], state["opened"]
        opened = None if opened is None or pd.isna(opened) else int(opened)
    made = pd.DataFrame(out, columns=["host", "_chunk", "failures", "opened"])
    return made.astype({"opened": "Int64"})


def _pieces(chunk: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Openings of a chunk, from the states its hosts begin with."""
    order = [c for c in chunk.columns if c.startswith("_o")]
    known = {r.host: (r.failures, None if pd.isna(r.opened) else int(r.opened)) for r in entries.itertuples(index=False)}
    out = []
    if len(chunk):
        for host, run in _runs(chunk.sort_values(["host", *order], kind="stable")):
            found, _ = run.walk(*known.get(host, (0, None)))
            out += [(host, opened, closed, BREAKER_FAILURES, refused) for opened, closed, refused in found]
    made = pd.DataFrame(out, columns=["host", "opened", "closed", "failures", "refused"])
    return made.astype({"opened": "Int64", "closed": "Int64"})


def breaker_episodes(logs: DataFrame, companies: DataFrame, as_of: str, order: list[str]) -> DataFrame:
    """(domain, opened_at, closed_at, failures, refused) of every opening; closed_at is NULL while it is open.

    Crawls of hosts that are unknown, or not yet finished, do not count.
    """
    hosts = companies.select(F.col("id").alias("company_id"), urls.url_host(F.col("career_page_url")).alias("host")).filter("host IS NOT NULL")
    past = logs.filter((F.col("started_at") < dates.ts(as_of)) & F.col("status").isin("completed", "failed"))
    keys: list[Column] = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    rows = past.join(hosts, "company_id").select(
        "host", F.unix_micros("started_at").alias("at"), (F.col("status") == "failed").alias("failed"), *keys
    )
    names = ["host", *[f"_o{i}" for i in range(len(order))]]
    parts = parts_of(past, CHUNK_ROWS)
    cut = settled(rows.repartitionByRange(parts, *names).withColumn("_chunk", F.spark_partition_id()), "breaker")
    functions = settled(cut.groupBy("_chunk").applyInPandas(_summaries, SUMMARY), "breaker-runs")
    entries = functions.groupBy("host").applyInPandas(_entries, f"host string, _chunk int, {STATE}")
    found = cut.groupBy("_chunk").cogroup(entries.groupBy("_chunk")).applyInPandas(_pieces, PIECES)
    merged = found.groupBy("host", "opened", "failures").agg(F.max("closed").alias("closed"), F.sum("refused").alias("refused"))
    return merged.select(
        F.col("host").alias("domain"), F.timestamp_micros("opened").alias("opened_at"), F.timestamp_micros("closed").alias("closed_at"), "failures", "refused"
    )
