"""Registered aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import aggregates, breaker, dedupe, joins, recommendations
from vacantia.operators.filters import LOG_TIES
from vacantia.plans.joined import AUTOMATION
from vacantia.plans.registry import query
from vacantia.plans.views import AS_OF, TODAY
from vacantia.sources import crawl_partials

ORDER = ["started_at", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "company_id"]
HOST = r"lower(regexp_extract(career_page_url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1))"
STAGE = "CASE WHEN pipeline_stage IN ('discover','review','prepare','apply','follow_up','archive') THEN pipeline_stage ELSE 'discover' END"
#: A time of day, so that the span of a figure begins and ends inside a day.
MIDDAY = "1998-07-01 12:00:00"
HEALTH = f"""
SELECT crawler_class, count(*) AS total_runs, count(*) FILTER (status = 'completed') AS success_count, count(*) FILTER (status = 'failed') AS error_count,
 round_even(coalesce(avg((epoch_us(completed_at) - epoch_us(started_at)) / 1e6), 0), 1) AS avg_duration_seconds,
 round_even(count(*) FILTER (status = 'completed') / count(*) * 100, 1) AS success_rate FROM (
 SELECT l.*, CASE WHEN c.crawler_type IN ('indeed','linkedin') THEN 'selenium' WHEN c.crawler_type IN ('greenhouse','lever') THEN 'api'
  WHEN c.crawler_type IN ('generic','workday') THEN 'ai' ELSE 'unknown' END AS crawler_class
 FROM (SELECT * FROM {{crawl_logs}} WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY AND started_at < TIMESTAMP '{AS_OF}') l JOIN {{companies}} c ON c.id = l.company_id)
GROUP BY 1"""
TOTALS = f"""
SELECT company_id, max(started_at) AS last_crawl_at, count(*) FILTER (started_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY) AS total_crawls_30d,
 count(*) FILTER (started_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY AND status = 'completed') AS successful_crawls_30d
FROM {{crawl_logs}} WHERE started_at < TIMESTAMP '{AS_OF}' GROUP BY 1"""
METRICS = f"""
SELECT count(*) AS total_crawls_30d, count(*) FILTER (status = 'completed') AS successful_crawls_30d,
 round_even(count(*) FILTER (status = 'completed') / count(*) * 100, 1) AS crawl_success_rate_30d,
 round_even(nullif(avg((epoch_us(completed_at) - epoch_us(started_at)) / 1e6) FILTER (status = 'completed'), 0), 1) AS average_crawl_duration_seconds
FROM {{crawl_logs}} WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY AND started_at < TIMESTAMP '{AS_OF}'"""
FALLBACKS = """
SELECT company_id, method_used, count(*) AS success_count, max(completed_at) AS last_success_at FROM {crawl_logs}
WHERE status = 'completed' AND method_used NOT IN ('career_page', 'no_results') GROUP BY 1, 2"""


@query("d1_dashboard_totals", f"""
SELECT count(*) AS total_jobs, count(*) FILTER (discovered_at >= TIMESTAMP '{TODAY}' - INTERVAL '1' DAY) AS new_jobs_24h,
 (SELECT count(*) FROM {{search_criteria}} WHERE is_active) AS active_searches FROM {{jobs}}""")
def _(t):
    return aggregates.dashboard_totals(t("jobs"), t("search_criteria"), TODAY)


@query("d1_jobs_by_status", "SELECT coalesce(status, 'new') AS status, count(*) AS jobs FROM {jobs} GROUP BY 1")
def _(t):
    return aggregates.jobs_by_status(t("jobs"))


@query("d2_company_summary", """
SELECT count(*) AS total_companies, count(*) FILTER (is_active) AS active_companies, count(*) FILTER (NOT is_active) AS inactive_companies,
 count(*) FILTER (is_active AND consecutive_empty_crawls >= 2) AS needs_attention,
 count(*) FILTER (is_active AND viability_last_checked IS NULL) AS unchecked_viability,
 round_even(nullif(avg(viability_score) FILTER (is_active), 0), 2) AS average_viability_score FROM {companies}""")
def _(t):
    return aggregates.company_summary(t("companies"))


@query("d3_crawler_health", HEALTH)
def _(t):
    return aggregates.crawler_health(t("crawl_logs"), t("companies"), AS_OF, LOG_TIES)


@query("d4_company_crawl_totals", TOTALS)
def _(t):
    return joins.crawl_totals(t("crawl_logs"), AS_OF)


@query("d5_combined_metrics", METRICS)
def _(t):
    return aggregates.combined_metrics(t("crawl_logs"), AS_OF)


@query("d6_feedback_counts", f"""
SELECT feedback_type, feedback_value, count(*) AS count FROM {{job_feedback}}
WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY GROUP BY 1, 2""")
def _(t):
    return aggregates.feedback_counts(t("job_feedback"), AS_OF)


@query("d7_duplicate_groups", """
WITH c AS (SELECT external_id, count(*) AS group_count FROM {jobs} WHERE external_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT c.external_id, group_count, CAST(0 AS BIGINT) AS page,
 string_agg(CAST(j.id AS VARCHAR), ',' ORDER BY j.id) AS job_ids, string_agg(CAST(j.company_id AS VARCHAR), ',' ORDER BY j.id) AS company_ids
FROM {jobs} j JOIN c ON c.external_id = j.external_id GROUP BY 1, 2, 3""")
def _(t):
    out = dedupe.duplicate_groups(t("jobs"))
    for name in ("job_ids", "company_ids"):
        out = out.withColumn(name, F.array_join(F.col(name).cast("array<string>"), ","))
    return out


@query("d8_duplicate_pairs", """
SELECT external_id, company_id, count(*) AS count FROM {jobs} GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return dedupe.duplicate_pairs(t("jobs"))


@query("d9_context_summary", f"""
SELECT count(*) AS total_jobs, count(*) FILTER (discovered_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY) AS recent_jobs,
 count(*) FILTER (ai_recommended) AS recommended_jobs, (SELECT count(*) FROM {{applications}}) AS total_applications,
 (SELECT count(*) FROM {{tasks}} WHERE status = 'pending') AS pending_tasks, (SELECT count(*) FROM {{companies}} WHERE is_active) AS active_companies
FROM {{jobs}}""")
def _(t):
    return aggregates.context_summary(t("jobs"), t("applications"), t("tasks"), t("companies"), AS_OF)


@query("d10_archived_jobs", "SELECT count(archived_at) AS archived_jobs FROM {jobs}")
def _(t):
    return aggregates.archived_count(t("jobs"))


@query("d11_discovery_status", """
SELECT count(*) AS total_companies, count(*) FILTER (is_active) AS active_companies,
 (SELECT count(*) FROM {pending_companies} WHERE status = 'pending') AS pending_count,
 least(100, count(*) FILTER (is_active) / 4000 * 100) AS progress FROM {companies}""")
def _(t):
    return aggregates.discovery_status(t("companies"), t("pending_companies"))


@query("d13_fallback_successes", FALLBACKS)
def _(t):
    return aggregates.fallback_successes(t("crawl_logs"))


@query("d14_stage_counts", f"""
SELECT s.stage, count(j.id) AS jobs FROM (SELECT unnest(['discover','review','prepare','apply','follow_up','archive']) AS stage) s
LEFT JOIN {{jobs}} j ON {STAGE} = s.stage GROUP BY 1""")
def _(t):
    return aggregates.stage_counts(t("jobs"))


@query("d15_recommendations_by_type", f"""
SELECT type, count(*) AS recommendations FROM (
 SELECT 'follow_up' AS type FROM {{jobs}} j WHERE status = 'applied' AND NOT is_new
  AND NOT EXISTS (SELECT 1 FROM {{follow_ups}} f WHERE f.job_id = j.id AND NOT f.completed)
 UNION ALL SELECT 'upcoming_followup' FROM {{follow_ups}} f JOIN {{jobs}} j ON j.id = f.job_id
  WHERE NOT f.completed AND follow_up_date BETWEEN TIMESTAMP '{TODAY}' AND TIMESTAMP '{TODAY}' + INTERVAL '24' HOUR
 UNION ALL (SELECT 'apply_now' FROM {{jobs}} WHERE ai_match_score >= 75 AND status = 'new' LIMIT 10)) GROUP BY 1""")
def _(t):
    return aggregates.recommendations_by_type(recommendations.follow_up_board(t("jobs"), t("follow_ups"), TODAY))


@query("d16_new_job_digest", """
WITH n AS (SELECT * FROM {jobs} WHERE is_new), f AS (SELECT * FROM n ORDER BY id LIMIT 5)
SELECT (SELECT count(*) FROM n) AS new_jobs, 'Found ' || (SELECT count(*) FROM n) || ' new job(s):' || chr(10)
 || string_agg(chr(10) || '• ' || title || ' at ' || company || CASE WHEN coalesce(ai_match_score, 0) <> 0
  THEN ' (' || CAST(CAST(ai_match_score AS INT) AS VARCHAR) || '% match)' ELSE '' END, chr(10) ORDER BY id)
 || chr(10) || chr(10) || '...and ' || ((SELECT count(*) FROM n) - 5) || ' more' AS message FROM f""")
def _(t):
    return aggregates.new_job_digest(t("jobs").filter("is_new"), [F.col("id")])


@query("d17_running_crawls", """
SELECT count(*) FILTER (status = 'running') AS running_count, count(*) FILTER (status = 'running') > 0 AS is_running FROM {crawl_logs}""")
def _(t):
    return aggregates.running_crawls(t("crawl_logs"))


@query("d18_jobs_without_external_id", """
SELECT count(*) FILTER (external_id IS NULL) AS jobs_without_external_id FROM {jobs}""")
def _(t):
    return aggregates.jobs_without_external_id(t("jobs"))


@query("d20_domain_failures", f"""
WITH h AS (SELECT id, {HOST} AS domain FROM {{companies}}),
 l AS (SELECT h.domain, l.*, row_number() OVER (PARTITION BY h.domain ORDER BY started_at, l_orderkey, l_linenumber, l_partkey, l_extendedprice, company_id) AS n
  FROM {{crawl_logs}} l JOIN h ON h.id = l.company_id WHERE started_at < TIMESTAMP '{AS_OF}' AND status IN ('completed', 'failed')),
 s AS (SELECT domain, max(n) FILTER (status = 'completed') AS good FROM l GROUP BY 1),
 f AS (SELECT l.domain, count(*) AS failures, max(started_at) AS last_failure FROM l JOIN s ON s.domain = l.domain
  WHERE l.status = 'failed' AND n > coalesce(good, 0) GROUP BY 1)
SELECT d.domain, coalesce(failures, 0) AS failures, coalesce(failures, 0) >= 5 AS open,
 CASE WHEN coalesce(failures, 0) >= 5 THEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_failure)) / 1e6 ELSE 0 END AS opened_seconds_ago,
 coalesce(failures, 0) < 5 OR (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_failure)) / 1e6 >= 300 AS allows
FROM (SELECT DISTINCT domain FROM h) d LEFT JOIN f ON f.domain = d.domain""")
def _(t):
    return aggregates.domain_failures(t("crawl_logs"), t("companies"), AS_OF, ORDER)


#: From every crawl that finds a breaker closed and its count at nothing, the crawl that opens it next and the one that finds it half-open.
@query("d20_breaker_episodes", f"""
WITH RECURSIVE h AS (SELECT id, {HOST} AS domain FROM {{companies}}),
 base AS (SELECT h.domain, started_at, status = 'failed' AS failed,
   row_number() OVER (PARTITION BY h.domain ORDER BY started_at, l_orderkey, l_linenumber, l_partkey, l_extendedprice, company_id) AS n
  FROM {{crawl_logs}} l JOIN h ON h.id = l.company_id WHERE started_at < TIMESTAMP '{AS_OF}' AND status IN ('completed', 'failed')),
 l AS MATERIALIZED (SELECT *, n - coalesce(max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY domain ORDER BY n), 0) AS streak FROM base),
 ahead AS (SELECT domain, n, min(CASE WHEN streak >= 5 THEN n END) OVER (PARTITION BY domain ORDER BY n ROWS BETWEEN 4 FOLLOWING AND UNBOUNDED FOLLOWING) AS opens FROM l),
 jump AS MATERIALIZED (SELECT a.domain, a.n, a.opens, o.started_at AS opened_at, c.n AS half, c.started_at AS closed_at
  FROM ahead a JOIN l o ON o.domain = a.domain AND o.n = a.opens
  ASOF LEFT JOIN (SELECT domain, started_at, min(n) AS n FROM l GROUP BY 1, 2) c ON c.domain = o.domain AND c.started_at >= o.started_at + INTERVAL '300' SECOND),
 last AS (SELECT domain, max(n) AS n FROM l GROUP BY 1),
 walk AS (SELECT * FROM jump WHERE n = 1 UNION ALL SELECT j.* FROM walk w JOIN jump j ON j.domain = w.domain AND j.n = w.half)
SELECT w.domain, opened_at, closed_at, 5 AS failures, CAST(coalesce(half - 1, last.n) - opens AS BIGINT) AS refused FROM walk w JOIN last ON last.domain = w.domain""")
def _(t):
    return breaker.breaker_episodes(t("crawl_logs"), t("companies"), AS_OF, ORDER)


@query("g26_company_health_classes", f"""
SELECT health_status, needs_attention, count(*) AS companies FROM ({AUTOMATION.strip()}) GROUP BY 1, 2""")
def _(t):
    out = joins.companies_with_automation(t("companies"), t("crawl_logs"), AS_OF)
    return out.groupBy("health_status", "needs_attention").agg(F.count(F.lit(1)).alias("companies"))


@query("d3_crawler_health_kept", HEALTH)
def _(t):
    return crawl_partials.crawler_health(t.crawl_partials(), t("crawl_logs"), t("companies"), AS_OF)


@query("d4_company_crawl_totals_kept", TOTALS.replace(AS_OF, MIDDAY))
def _(t):
    return crawl_partials.crawl_totals(t.crawl_partials(), t("crawl_logs"), MIDDAY)


@query("d5_combined_metrics_kept", METRICS.replace(AS_OF, MIDDAY))
def _(t):
    return crawl_partials.combined_metrics(t.crawl_partials(), t("crawl_logs"), MIDDAY)


@query("d13_fallback_successes_kept", FALLBACKS)
def _(t):
    return crawl_partials.fallback_successes(t.crawl_partials())


@query("d3_duration_profile")
def _(t):
    """Estimates from merged sketches; tested against the exact figures."""
    return crawl_partials.duration_profile(t.crawl_partials(), t("crawl_logs"), t("companies"), MIDDAY, 365)
