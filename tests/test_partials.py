"""Daily partials of the crawl log against figures of the whole log."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from vacantia.operators import aggregates, joins
from vacantia.session import work_path
from vacantia.sources import crawl_partials as cp

LOG = "company_id bigint, started_at timestamp, completed_at timestamp, status string, method_used string"
NOON, MIDNIGHT = "2001-08-02 12:30:00", "2001-08-02 00:00:00"


def crawls(count, seed, first=dt.datetime(2001, 6, 20)):
    random.seed(seed)
    out = []
    for _ in range(count):
        start = first + dt.timedelta(minutes=random.randrange(60 * 24 * 50))
        status = random.choice(["completed", "completed", "failed", "running", None])
        end = None if status in ("running", None) else start + dt.timedelta(seconds=random.randrange(1, 600))
        out.append((random.choice([1, 2, 3, 4, 99, None]), random.choice([start] * 20 + [None]), end, status, random.choice(["indeed", "linkedin", "career_page", None])))
    return out


@pytest.fixture(scope="module")
def companies(spark):
    rows = [(1, "a", "indeed"), (2, "b", "greenhouse"), (3, "c", "generic"), (4, "d", "indeed")]
    return spark.createDataFrame(rows, "id bigint, name string, crawler_type string").cache()


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.select(sorted(df.columns)).collect())))


def agree(kept, logs, companies):
    for as_of in (NOON, MIDNIGHT):
        assert rows(cp.crawler_health(kept, logs, companies, as_of)) == rows(aggregates.crawler_health(logs, companies, as_of, ()))
        assert rows(cp.crawl_totals(kept, logs, as_of)) == rows(joins.crawl_totals(logs, as_of))
        assert rows(cp.combined_metrics(kept, logs, as_of)) == rows(aggregates.combined_metrics(logs, as_of))
    assert rows(cp.fallback_successes(kept)) == rows(aggregates.fallback_successes(logs))


def test_figures_of_partials_are_those_of_the_log(spark, companies):
    logs = spark.createDataFrame(crawls(900, 1), LOG).cache()
    agree(cp.CrawlPartials(spark, work_path(spark, "partials")).start(logs, companies), logs, companies)


def test_late_crawls_change_their_days_only(spark, companies):
    early = spark.createDataFrame(crawls(600, 2), LOG).cache()
    late = spark.createDataFrame([(1, dt.datetime(2001, 7, 9, 5), dt.datetime(2001, 7, 9, 6), "completed", "indeed"), (2, dt.datetime(2001, 9, 1), None, "running", None)], LOG)
    kept = cp.CrawlPartials(spark, work_path(spark, "partials")).start(early, companies)
    every = early.unionByName(late).cache()
    days = [dt.date(2001, 7, 9), dt.date(2001, 9, 1)]
    for again in (1, 2):  # a second run leaves the same
        assert kept.refresh(every, companies, late) == days
        agree(kept, every, companies)
        added = spark.read.parquet(f"{kept.root}/company/version={again}").select("day").distinct()
        assert sorted(r.day for r in added.collect()) == days
    spark.range(1).selectExpr("DATE '2001-07-09' AS day", "1L AS crawls", "DATE '2001-07-01' AS month").write.partitionBy("month").parquet(f"{kept.root}/company/version=3")
    agree(kept, every, companies)  # a version without its sketches is not read


def test_crawls_without_start_are_refreshed_too(spark, companies):
    early = spark.createDataFrame(crawls(50, 3), LOG)
    late = spark.createDataFrame([(2, None, dt.datetime(2001, 7, 9, 6), "completed", "indeed")], LOG)
    kept = cp.CrawlPartials(spark, work_path(spark, "partials")).start(early, companies)
    assert kept.refresh(early.unionByName(late), companies, late) == []
    agree(kept, early.unionByName(late), companies)


def test_empty_log(spark, companies):
    logs = spark.createDataFrame([], LOG)
    kept = cp.CrawlPartials(spark, work_path(spark, "partials")).start(logs, companies)
    agree(kept, logs, companies)
    assert cp.duration_profile(kept, logs, companies, NOON).count() == 0


def test_sketches_stay_within_their_errors(spark):
    many = spark.range(60_000).select(
        (F.col("id") % 5000).alias("company_id"), (F.timestamp_seconds(F.lit(994_000_000) + F.col("id") * 37)).alias("started_at"),
        F.lit("completed").alias("status"), F.lit("indeed").alias("method_used"), F.col("id"),
    )
    logs = many.withColumn("completed_at", F.expr("started_at + make_interval(0, 0, 0, 0, 0, 0, CAST((id * 7919) % 60000 AS INT))")).drop("id")
    companies = spark.range(5000).select("id", F.lit("n").alias("name"), F.lit("indeed").alias("crawler_type"))
    kept = cp.CrawlPartials(spark, work_path(spark, "partials")).start(logs, companies)
    [row] = cp.duration_profile(kept, logs, companies, NOON, days=60).collect()
    assert row.timed == 60_000 and abs(row.companies / 5000 - 1) < 4 * cp.COUNT_ERROR
    for got, rank in ((row.p50_seconds, 0.5), (row.p90_seconds, 0.9), (row.p99_seconds, 0.99)):
        assert abs(got / 60_000 - rank) < 2 * cp.RANK_ERROR


def test_plan_reads_days_of_the_span_only(spark, companies):
    logs = spark.createDataFrame(crawls(200, 4), LOG)
    kept = cp.CrawlPartials(spark, work_path(spark, "partials")).start(logs, companies)
    plan = kept.company(logs, cp.dates.ts("2001-07-03 00:00:00"), cp.dates.ts(NOON))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month", plan), plan
