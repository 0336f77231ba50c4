"""Counts, health figures and groupings.

Every figure over one table comes from one conditional aggregate, so a report
is one scan with map-side partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, scores, urls
from vacantia.operators.filters import desc
from vacantia.operators.joins import logs_with_company
from vacantia.operators.ranking import rows_since_last
from vacantia.operators.scale import top_rows

# Methods that are no fallback, and the breaker of a domain.
NOT_A_FALLBACK = ("career_page", "no_results")
BREAKER_FAILURES = 5
BREAKER_RESET_SECONDS = 300
TARGET_COMPANIES = 4000


def one_row(*parts: DataFrame) -> DataFrame:
    """Put single-row frames side by side without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def dashboard_totals(jobs: DataFrame, searches: DataFrame, as_of: str) -> DataFrame:
    since = dates.plus(dates.ts(as_of), -1, "day")
    return one_row(
        jobs.agg(F.count(F.lit(1)).alias("total_jobs"), F.count_if(F.col("discovered_at") >= since).alias("new_jobs_24h")),
        searches.agg(F.count_if("is_active").alias("active_searches")),
    )


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.coalesce("status", F.lit("new")).alias("status")).agg(F.count(F.lit(1)).alias("jobs"))


def company_summary(companies: DataFrame) -> DataFrame:
    active = F.col("is_active")
    mean = F.avg(F.when(active, F.col("viability_score")))
    return companies.agg(
        F.count(F.lit(1)).alias("total_companies"),
        F.count_if(active).alias("active_companies"),
        F.count_if(~active).alias("inactive_companies"),
        F.count_if(active & (F.col("consecutive_empty_crawls") >= 2)).alias("needs_attention"),
        F.count_if(active & F.col("viability_last_checked").isNull()).alias("unchecked_viability"),
        F.bround(F.nullif(mean, F.lit(0.0)), 2).alias("average_viability_score"),
    )


def latest_logs(logs: DataFrame, as_of: str, limit: int, ties: tuple[str, ...], days: int | None = None) -> DataFrame:
    """The latest ``limit`` logs, looked for in the last ``days`` only if they are given."""
    since = None if days is None else dates.plus(dates.ts(as_of), -days, "day")
    past = dates.in_range(logs, "started_at", since=since, before=dates.ts(as_of))
    return top_rows(past, [desc("started_at"), *[F.col(c) for c in ties]], limit)


def crawler_health(logs: DataFrame, companies: DataFrame, as_of: str, ties: tuple[str, ...], days: int = 30, limit: int | None = None) -> DataFrame:
    """Success and duration per crawler class over the logs of the last ``days``, or the latest ``limit`` of them."""
    now = dates.ts(as_of)
    recent = dates.in_range(logs, "started_at", since=dates.plus(now, -days, "day"), before=now)
    last = logs_with_company(recent if limit is None else latest_logs(recent, as_of, limit, ties), companies)
    seconds = dates.seconds_between(F.col("started_at"), F.col("completed_at"))
    return (
        last.filter(F.col("crawler_class").isNotNull())
        .groupBy("crawler_class")
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if(F.col("status") == "completed").alias("success_count"),
            F.count_if(F.col("status") == "failed").alias("error_count"),
            F.bround(F.coalesce(F.avg(seconds), F.lit(0.0)), 1).alias("avg_duration_seconds"),
        )
        .withColumn("success_rate", F.bround(scores.percentage(F.col("success_count"), F.col("total_runs")), 1))
    )


def combined_metrics(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    now = dates.ts(as_of)
    recent = dates.in_range(logs, "started_at", since=dates.plus(now, -days, "day"), before=now)
    done = F.col("status") == "completed"
    seconds = dates.seconds_between(F.col("started_at"), F.col("completed_at"))
    totals = recent.agg(
        F.count(F.lit(1)).alias("total_crawls_30d"),
        F.count_if(done).alias("successful_crawls_30d"),
        F.avg(F.when(done, seconds)).alias("_mean"),
    )
    rate = scores.percentage(F.col("successful_crawls_30d"), F.col("total_crawls_30d"))
    return totals.select(
        "total_crawls_30d", "successful_crawls_30d",
        F.bround(rate, 1).alias("crawl_success_rate_30d"),
        F.bround(F.nullif(F.col("_mean"), F.lit(0.0)), 1).alias("average_crawl_duration_seconds"),
    )


def feedback_counts(feedback: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    since = dates.plus(dates.ts(as_of), -days, "day")
    kept = dates.in_range(feedback, "created_at", since=since)
    return kept.groupBy("feedback_type", "feedback_value").agg(F.count(F.lit(1)).alias("count"))


def context_summary(
    jobs: DataFrame, applications: DataFrame, tasks: DataFrame, companies: DataFrame, as_of: str, days: int = 30
) -> DataFrame:
    since = dates.plus(dates.ts(as_of), -days, "day")
    return one_row(
        jobs.agg(
            F.count(F.lit(1)).alias("total_jobs"),
            F.count_if(F.col("discovered_at") >= since).alias("recent_jobs"),
            F.count_if("ai_recommended").alias("recommended_jobs"),
        ),
        applications.agg(F.count(F.lit(1)).alias("total_applications")),
        tasks.agg(F.count_if(F.col("status") == "pending").alias("pending_tasks")),
        companies.agg(F.count_if("is_active").alias("active_companies")),
    )


def archived_count(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("archived_at").isNotNull()).alias("archived_jobs"))


def discovery_status(companies: DataFrame, pending: DataFrame, target: int = TARGET_COMPANIES) -> DataFrame:
    counts = one_row(
        companies.agg(F.count(F.lit(1)).alias("total_companies"), F.count_if("is_active").alias("active_companies")),
        pending.agg(F.count_if(F.col("status") == "pending").alias("pending_count")),
    )
    share = F.col("active_companies") / F.lit(target) * 100
    return counts.withColumn("progress", F.least(F.lit(100.0), share))


def load_statistics(parsed: DataFrame) -> DataFrame:
    """Rows per reject reason of a company list; ``loaded`` for accepted rows."""
    reason = F.coalesce("reason", F.lit("loaded"))
    return parsed.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def load_diagnosis(parsed: DataFrame, companies: DataFrame) -> DataFrame:
    """Severity rows on the state of the company table and its list."""
    facts = one_row(
        companies.agg(F.count_if("is_active").alias("active")),
        parsed.agg(
            F.count_if(F.col("reason").isNull()).alias("found"),
            F.count_if(F.col("reason") == "blank_url").alias("no_url"),
        ),
    )
    rules = F.array(
        F.when(F.col("active") == 0, F.struct(F.lit("critical").alias("severity"), F.lit("No active companies found").alias("message")))
        .when(
            F.col("active") < 10,
            F.struct(F.lit("warning").alias("severity"), F.format_string("Only %d active companies", F.col("active")).alias("message")),
        ),
        F.when(F.col("found") == 0, F.struct(F.lit("warning").alias("severity"), F.lit("No companies were parsed").alias("message"))),
        F.when(
            F.col("no_url") > 0,
            F.struct(F.lit("info").alias("severity"), F.format_string("%d companies have no extractable URLs", F.col("no_url")).alias("message")),
        ),
    )
    return facts.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("r.severity", "r.message")


def fallback_successes(logs: DataFrame) -> DataFrame:
    good = logs.filter((F.col("status") == "completed") & ~F.col("method_used").isin(*NOT_A_FALLBACK))
    return good.groupBy("company_id", "method_used").agg(
        F.count(F.lit(1)).alias("success_count"), F.max("completed_at").alias("last_success_at")
    )


def stage_counts(jobs: DataFrame) -> DataFrame:
    """Postings per board column; all six columns are present."""
    stage = scores.board_stage(F.col("pipeline_stage"))
    row = jobs.agg(*[F.count_if(stage == s).alias(s) for s in scores.STAGES])
    pairs = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("jobs")) for s in scores.STAGES])
    return row.select(F.explode(pairs).alias("p")).select("p.stage", "p.jobs")


def recommendations_by_type(recommendations: DataFrame) -> DataFrame:
    return recommendations.groupBy("type").agg(F.count(F.lit(1)).alias("recommendations"))


def new_job_digest(jobs: DataFrame, order: list[Column], shown: int = 5) -> DataFrame:
    """One message: how many postings, the first five, how many more."""
    score = F.col("ai_match_score")
    tail = F.when(F.coalesce(score, F.lit(0.0)) != 0, F.format_string(" (%s%% match)", F.bround(score, 0).cast("int").cast("string"))).otherwise("")
    line = F.concat(F.lit("\n• "), F.col("title"), F.lit(" at "), F.col("company"), tail)
    first = jobs.orderBy(*order).limit(shown).select(F.struct(*order, line.alias("_line")).alias("s"))
    lines = first.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["_line"]).alias("lines"))
    both = one_row(jobs.agg(F.count(F.lit(1)).alias("new_jobs")), lines.select(F.array_join("lines", "\n").alias("body")))
    more = F.col("new_jobs") - shown
    return both.filter(F.col("new_jobs") > 0).select(
        "new_jobs",
        F.concat(
            F.format_string("Found %d new job(s):\n", F.col("new_jobs")),
            F.col("body"),
            F.when(more > 0, F.format_string("\n\n...and %d more", more)).otherwise(""),
        ).alias("message"),
    )


def running_crawls(logs: DataFrame) -> DataFrame:
    running = F.count_if(F.col("status") == "running")
    return logs.agg(running.alias("running_count"), (running > 0).alias("is_running"))


def jobs_without_external_id(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("external_id").isNull()).alias("jobs_without_external_id"))


def discovery_decisions(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count(F.lit(1)).alias("records"))


def domain_failures(logs: DataFrame, companies: DataFrame, as_of: str, order: list[str]) -> DataFrame:
    """Failures since the last success per career-page host, with the breaker state."""
    hosts = companies.select(F.col("id").alias("company_id"), urls.url_host(F.col("career_page_url")).alias("domain"))
    past = logs.filter((F.col("started_at") < dates.ts(as_of)) & F.col("status").isin("completed", "failed"))
    slim = past.select("company_id", "status", *[c for c in order if c != "company_id"])
    named = slim.join(hosts, "company_id")
    after = rows_since_last(named, ["domain"], F.col("status") == "completed", order)
    failed = after.groupBy("domain").agg(
        F.count_if(F.col("status") == "failed").alias("failures"), F.max(F.when(F.col("status") == "failed", F.col("started_at"))).alias("_last")
    )
    every = hosts.select("domain").distinct().join(failed, "domain", "left")
    failures = F.coalesce("failures", F.lit(0))
    is_open = failures >= BREAKER_FAILURES
    age = dates.seconds_between(F.col("_last"), dates.ts(as_of))
    return every.select(
        "domain",
        failures.alias("failures"),
        is_open.alias("open"),
        F.when(is_open, age).otherwise(0.0).alias("opened_seconds_ago"),
        (~is_open | (age >= BREAKER_RESET_SECONDS)).alias("allows"),
    )
