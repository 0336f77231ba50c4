"""Daily partials of the crawl log, kept beside it and merged when a figure is read.

``company`` holds one row per (day, company, method): counts, sums of durations in
microseconds and the latest times. ``sketches`` holds one row per (day, class):
a HyperLogLog sketch of the companies and a KLL sketch of the durations. Both lie in
a folder per version and month. Sums, counts and extremes merge exactly; distinct companies and
quantiles are estimates (KLL with k = K_SIZE: ranks within about RANK_ERROR;
HyperLogLog with 2^LG_SIZE registers: about COUNT_ERROR of the count, one standard error).

A figure reads the whole days of its span from the partials. The parts of a day at
its ends, where a span doesn't begin or end at midnight, are made from the crawls of
those two days alone. Late crawls change their own days only: ``refresh`` makes these
days anew from the log and adds them as a version; of the versions of a day the last
counts. A version that was cut off is not read and its number is used again. There
is one writer at a time.

Crawls without a start have no day and belong to no span; they are kept under a null
day for figures over all time. A class is that of the company when the day was made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import dates, scores, urls
from vacantia.operators.aggregates import NOT_A_FALLBACK
from vacantia.session import folders

COMPANY = (
    "day date, company_id bigint, method_used string, crawls bigint, completed bigint, failed bigint, micros bigint, timed bigint, "
    "done_micros bigint, done_timed bigint, last_started timestamp, last_completed timestamp"
)
SKETCHES = "day date, crawler_class string, companies binary, durations binary"
SUMS = ["crawls", "completed", "failed", "micros", "timed", "done_micros", "done_timed"]
K_SIZE, RANK_ERROR = 200, 0.0133
LG_SIZE, COUNT_ERROR = 12, 0.017


def company_partials(logs: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    micros = F.unix_micros("completed_at") - F.unix_micros("started_at")
    return logs.groupBy(F.to_date("started_at").alias("day"), F.col("company_id").cast("bigint").alias("company_id"), "method_used").agg(
        F.count(F.lit(1)).alias("crawls"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(micros), F.lit(0)).cast("bigint").alias("micros"), F.count(micros).alias("timed"),
        F.coalesce(F.sum(F.when(done, micros)), F.lit(0)).cast("bigint").alias("done_micros"), F.count(F.when(done, micros)).alias("done_timed"),
        F.max("started_at").alias("last_started"), F.max(F.when(done, F.col("completed_at"))).alias("last_completed"),
    )


def classes(companies: DataFrame) -> DataFrame:
    return companies.select(F.col("id").cast("bigint").alias("company_id"), urls.crawler_class(F.col("crawler_type")).alias("crawler_class"))


def sketch_partials(logs: DataFrame, companies: DataFrame) -> DataFrame:
    """Sketches of the crawls of known companies."""
    named = logs.withColumn("company_id", F.col("company_id").cast("bigint")).join(classes(companies), "company_id")
    seconds = dates.seconds_between(F.col("started_at"), F.col("completed_at"))
    return named.groupBy(F.to_date("started_at").alias("day"), "crawler_class").agg(
        F.hll_sketch_agg("company_id", F.lit(LG_SIZE)).alias("companies"), F.kll_sketch_agg_double(seconds, F.lit(K_SIZE)).alias("durations"),
    )


class CrawlPartials:
    """The partials at ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        """Numbers of the versions of which both tables are whole."""
        done = [{f for f in folders(self.spark, f"{self.root}/{name}") if f.startswith("version=")} for name in ("company", "sketches")]
        return sorted(int(f.split("=")[1]) for f in done[0] & done[1])

    def _write(self, rows: DataFrame, name: str, version: int) -> None:
        dealt = rows.withColumn("month", F.trunc("day", "month")).hint("rebalance", "month").sortWithinPartitions("month", "day")
        dealt.write.mode("overwrite").partitionBy("month").parquet(f"{self.root}/{name}/version={version}")

    def start(self, logs: DataFrame, companies: DataFrame) -> CrawlPartials:
        """Partials of all days of the log."""
        version = max(self.versions(), default=-1) + 1
        self._write(company_partials(logs), "company", version)
        self._write(sketch_partials(logs, companies), "sketches", version)
        return self

    def refresh(self, logs: DataFrame, companies: DataFrame, landed: DataFrame) -> list:
        """Make the days of the ``landed`` crawls anew from the log, which holds them already; other days stay as they are.

        The days go through the driver: there is a row for each day of the calendar
        at most, however many crawls.
        """
        days = [r.day for r in landed.select(F.to_date("started_at").alias("day")).distinct().collect()]
        dated = [d for d in days if d is not None]
        day = F.col("started_at_day") if "started_at_day" in logs.columns else F.to_date("started_at")
        late = logs.filter(day.isin(dated) | day.isNull() if len(dated) < len(days) else day.isin(dated))
        if days:
            self.start(late, companies)
        return sorted(dated)

    def _read(self, name: str, schema: str, since: Column | None = None, before: Column | None = None) -> DataFrame:
        """Rows of the last version of each day; with bounds only of the days that lie whole inside them."""
        versions = self.versions()
        every = self.spark.read.schema(f"{schema}, version int, month date").parquet(f"{self.root}/{name}").filter(F.col("version").isin(versions))
        kept = whole_days(every, since, before)
        columns = [c for c in every.columns if c not in ("version", "month")]
        if len(versions) == 1:
            return kept.select(columns)
        last = kept.groupBy(F.col("day").alias("_day")).agg(F.max("version").alias("_version"))  # a row per day
        return kept.join(last, F.col("day").eqNullSafe(F.col("_day")) & (F.col("version") == F.col("_version"))).select(columns)

    def company(self, logs: DataFrame | None = None, since: Column | None = None, before: Column | None = None) -> DataFrame:
        """(company_id, method_used) partials of the crawls with ``since <= started_at < before``, or of all of them."""
        kept = self._read("company", COMPANY, since, before)
        if since is None and before is None:
            return kept
        return kept.unionByName(company_partials(ends(logs, since, before)))

    def sketches(self, logs: DataFrame, companies: DataFrame, since: Column, before: Column) -> DataFrame:
        kept = self._read("sketches", SKETCHES, since, before)
        return kept.unionByName(sketch_partials(ends(logs, since, before), companies))


def whole_days(kept: DataFrame, since: Column | None, before: Column | None) -> DataFrame:
    """Partials of the days that lie inside the span from their first to their last moment."""
    if since is not None:
        first = F.date_add(F.to_date(since), F.when(F.date_trunc("day", since) == since, 0).otherwise(1))
        kept = kept.filter((F.col("day") >= first) & (F.col("month") >= F.trunc(first, "month")))
    if before is not None:
        kept = kept.filter((F.col("day") < F.to_date(before)) & (F.col("month") <= F.trunc(F.to_date(before), "month")))
    return kept


def ends(logs: DataFrame, since: Column | None, before: Column | None) -> DataFrame:
    """The crawls of a span that lie on a day of which the span holds only a part."""
    inside = dates.in_range(logs, "started_at", since=since, before=before)
    day = F.col("started_at_day") if "started_at_day" in logs.columns else F.to_date("started_at")
    tests = []
    if since is not None:
        tests.append((F.date_trunc("day", since) != since) & (day == F.to_date(since)))
    if before is not None:
        tests.append((F.date_trunc("day", before) != before) & (day == F.to_date(before)))
    return inside.filter(tests[0] if len(tests) == 1 else tests[0] | tests[1])


def _mean(micros: str, timed: str) -> Column:
    return F.when(F.col(timed) > 0, F.col(micros) / F.lit(1e6) / F.col(timed))


def _span(as_of: str, days: int) -> tuple[Column, Column]:
    now = dates.ts(as_of)
    return dates.plus(now, -days, "day"), now


def crawler_health(kept: CrawlPartials, logs: DataFrame, companies: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """``aggregates.crawler_health`` over all crawls of the last days, from partials."""
    by_company = kept.company(logs, *_span(as_of, days)).groupBy("company_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    sums = by_company.join(classes(companies), "company_id").groupBy("crawler_class").agg(*[F.sum(c).alias(c) for c in SUMS])
    return sums.select(
        "crawler_class", F.col("crawls").alias("total_runs"), F.col("completed").alias("success_count"), F.col("failed").alias("error_count"),
        F.bround(F.coalesce(_mean("micros", "timed"), F.lit(0.0)), 1).alias("avg_duration_seconds"),
        F.bround(scores.percentage(F.col("completed"), F.col("crawls")), 1).alias("success_rate"),
    )


def crawl_totals(kept: CrawlPartials, logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """``joins.crawl_totals`` from partials: two spans of the same days, before and since the border."""
    since, now = _span(as_of, days)
    recent = kept.company(logs, since, now).select("company_id", "crawls", "completed", "last_started")
    older = kept.company(logs, None, since).select("company_id", F.lit(0).alias("crawls"), F.lit(0).alias("completed"), "last_started")
    return recent.unionByName(older).groupBy("company_id").agg(
        F.max("last_started").alias("last_crawl_at"), F.sum("crawls").alias("total_crawls_30d"), F.sum("completed").alias("successful_crawls_30d"),
    )


def combined_metrics(kept: CrawlPartials, logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """``aggregates.combined_metrics`` from partials."""
    sums = kept.company(logs, *_span(as_of, days)).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in SUMS])
    return sums.select(
        F.col("crawls").alias("total_crawls_30d"), F.col("completed").alias("successful_crawls_30d"),
        F.bround(scores.percentage(F.col("completed"), F.col("crawls")), 1).alias("crawl_success_rate_30d"),
        F.bround(F.nullif(_mean("done_micros", "done_timed"), F.lit(0.0)), 1).alias("average_crawl_duration_seconds"),
    )


def fallback_successes(kept: CrawlPartials) -> DataFrame:
    """``aggregates.fallback_successes`` from partials."""
    good = kept.company().filter((F.col("completed") > 0) & ~F.col("method_used").isin(*NOT_A_FALLBACK))
    return good.groupBy("company_id", "method_used").agg(F.sum("completed").alias("success_count"), F.max("last_completed").alias("last_success_at"))


def duration_profile(kept: CrawlPartials, logs: DataFrame, companies: DataFrame, as_of: str, days: int = 30, ranks=(0.5, 0.9, 0.99)) -> DataFrame:
    """Per class: estimated distinct companies crawled and quantiles of the duration, merged from the sketches of the days."""
    merged = kept.sketches(logs, companies, *_span(as_of, days)).groupBy("crawler_class").agg(
        F.hll_sketch_estimate(F.hll_union_agg("companies")).alias("companies"), F.kll_merge_agg_double("durations").alias("_durations"),
    )
    timed = F.kll_sketch_get_n_double("_durations")
    return merged.select(
        "crawler_class", "companies", timed.alias("timed"),
        *[F.when(timed > 0, F.kll_sketch_get_quantile_double("_durations", F.lit(float(q)))).alias(f"p{round(q * 100)}_seconds") for q in ranks],
    )
