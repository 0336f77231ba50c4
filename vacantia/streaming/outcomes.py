"""Crawl outcomes per class and period as they come in.

Each landing is reduced to one row per (day, class) and kept as a partial. Late
crawls are further partials of their day, so nothing is ever too late, and no
state is held. Periods of any length are sums of days, made when they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.functions import dates, urls
from vacantia.streaming.changelog import PartialLog
from vacantia.streaming.queries import drain

KEYS = ["day", "crawler_class"]
SUMS = ["crawls", "completed", "failed", "new_jobs", "seconds", "timed"]
PARTIALS = "day date, crawler_class string, crawls bigint, completed bigint, failed bigint, new_jobs bigint, seconds double, timed bigint"


def outcome_partials(logs: DataFrame, companies: DataFrame) -> DataFrame:
    """Sums per day and class; crawls of unknown companies have no class."""
    kinds = companies.select(F.col("id").alias("company_id"), urls.crawler_class(F.col("crawler_type")).alias("crawler_class"))
    done = F.col("status") == "completed"
    seconds = F.when(done, dates.seconds_between(F.col("started_at"), F.col("completed_at")))
    named = logs.join(kinds, "company_id", "left").withColumn("day", F.to_date("started_at"))
    return named.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("crawls"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(done, F.col("new_jobs"))), F.lit(0)).cast("bigint").alias("new_jobs"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"), F.count(seconds).alias("timed"),
    )


def outcome_stream(logs: DataFrame, companies: DataFrame, log: PartialLog, checkpoint: str) -> StreamingQuery:
    """Landed crawls into daily partials; a landing that is tried again replaces its own."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        log.current(batch_id)  # folds what many small landings have left
        log.write(outcome_partials(batch, companies), batch_id)

    return drain(logs, handle, checkpoint)


def outcome_periods(partials: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Outcomes of the periods of each length (in days) that begin on any day, per class.

    A day's sums go to every period that holds it; there are as many rows as days
    and classes, however many crawls.
    """
    days = F.explode(F.array(*[F.lit(n) for n in lengths]))
    spread = partials.withColumn("days", days).withColumn("_back", F.explode(F.sequence(F.lit(0), F.col("days") - 1)))
    placed = spread.withColumn("period_start", F.date_sub("day", F.col("_back")))
    sums = placed.groupBy("days", "period_start", "crawler_class").agg(*[F.sum(c).alias(c) for c in SUMS])
    rate = F.when(F.col("crawls") > 0, F.col("completed") / F.col("crawls"))
    mean = F.when(F.col("timed") > 0, F.col("seconds") / F.col("timed"))
    return sums.select("days", "period_start", "crawler_class", "crawls", "completed", "failed", "new_jobs", rate.alias("success_rate"), mean.alias("avg_duration"))
