"""Registered uses of the extension points: own heuristics, sources and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import filters, scoring
from vacantia.plans.functions import responses
from vacantia.plans.registry import query
from vacantia.plans.views import TODAY
from vacantia.session import work_path
from vacantia.sources import companies, company_source, pages
from vacantia.streaming import queries as streams

SCORE = """least(100.0, 50.0 + len(list_filter(['python', 'engineer'], lambda k: contains(lower(title), k) OR contains(lower(coalesce(description, '')), k))) / 2 * 30
 + CASE WHEN contains(lower(coalesce(location, '')), 'new york') THEN 10 ELSE 0 END)"""


@query("i1_custom_heuristic", "SELECT seq, name FROM {company_records} WHERE has_crawl_results OR contains(name, '4')")
def _(t):
    return filters.verified_records(t("company_records"), lambda df: df["name"].contains("4")).select("seq", "name")


@query("i2_callable_sources", """
SELECT name, 0 AS source_no FROM {company_records} UNION ALL SELECT name, 1 FROM {pending_companies} WHERE status = 'pending'""")
def _(t):
    sources = [lambda spark: t("company_records").select("name"), lambda spark: t("pending_companies").filter("status = 'pending'").select("name")]
    return companies.collect_records([fetch(t.spark) for fetch in sources]).select("name", "source_no")


LANDED = """
SELECT trim(name) AS name, career_page_url, source, priority, coalesce(has_crawl_results, false) AS has_crawl_results FROM {company_records}"""


def land_payloads(records, root: str) -> str:
    """Company records as payload files, a list each, in a folder per source."""
    lists = records.withColumn("_list", F.pmod(F.xxhash64("seq"), F.lit(4))).groupBy("source", "_list").agg(
        F.to_json(F.collect_list(F.struct("name", "career_page_url", "priority", "has_crawl_results"))).alias("value")
    )
    lists.select("source", "value").write.option("maxRecordsPerFile", 1).partitionBy("source").text(root)
    return root


@query("i2_company_source", LANDED + " WHERE source IN ('linkedin', 'indeed')")
def _(t):
    """The landed payloads of two sources; files of the others are not opened."""
    company_source.register(t.spark)
    rows = t.spark.read.format("company_payloads").option("path", land_payloads(t("company_records"), work_path(t.spark, "payloads"))).load()
    return rows.filter(F.col("source").isin("linkedin", "indeed")).drop("file")


@query("i2_company_stream", LANDED)
def _(t):
    """Payloads that land in three parts, each read once."""
    company_source.register(t.spark)
    root, out, checkpoint = (work_path(t.spark, n) for n in ("payloads", "companies", "ckpt"))
    for n in range(3):
        land_payloads(t("company_records").filter(F.col("seq") % 3 == n), f"{root}/{n:04}")
        stream = t.spark.readStream.format("company_payloads").option("path", root).load()
        streams.append_to(stream, out, checkpoint).awaitTermination()
    return t.spark.read.schema(company_source.SCHEMA).parquet(out).drop("file")


@query("i3_scored_jobs", f"SELECT id, {SCORE} AS ai_match_score, {SCORE} >= 70 AS ai_recommended FROM {{jobs}}")
def _(t):
    out = scoring.scored(t("jobs"), scoring.criteria_scorer("Python engineer", "New York"))
    return out.select("id", "ai_match_score", "ai_recommended")


@query("i3_scored_from_responses", """
SELECT id, CASE WHEN id % 10 = 9 OR id % 8 IN (3, 4, 7) THEN 50.0 ELSE s END::DOUBLE AS ai_match_score,
 CASE WHEN id % 10 = 9 OR id % 8 IN (3, 4, 7) THEN false WHEN id % 3 = 0 THEN id % 2 = 0 ELSE s >= 70 END AS ai_recommended
FROM (SELECT *, CASE id % 8 WHEN 5 THEN 100 WHEN 6 THEN 0 ELSE id % 101 END AS s FROM {jobs})""")
def _(t):
    return scoring.scored(t("jobs"), scoring.response_scorer(responses(t, silent=F.col("id") % 10 == 9))).select("id", "ai_match_score", "ai_recommended")


@query("i3_daily_selection", f"""
WITH newest AS (SELECT * FROM {{jobs}} WHERE description IS NOT NULL AND discovered_at <= TIMESTAMP '{TODAY}'),
s AS (SELECT id, title, discovered_at, {SCORE} AS ai_match_score FROM newest WHERE discovered_at >= TIMESTAMP '{TODAY[:10]} 00:00:00')
SELECT id, title, ai_match_score, CAST(row_number() OVER (ORDER BY ai_match_score DESC, discovered_at DESC, id) AS INT) AS ai_rank FROM s
QUALIFY ai_rank <= 5""")
def _(t):
    out = scoring.daily_selection(t("jobs"), scoring.criteria_scorer("Python engineer", "New York"), TODAY)
    return out.select("id", "title", "ai_match_score", "ai_rank")


@query("g21_json_endpoints", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/jobs/api/' || page_id || '.json|/api/jobs/list|https://x.com/api/v1/jobs.json|/api/a/jobs.json|/api/b/jobs.json|/api/c/positions.json|/jobs/api/d.json' ELSE '' END AS endpoints FROM {pages}""")
def _(t):
    p = F.col("page_id").cast("string")
    script = F.concat(
        F.lit("<script>var a='/jobs/api/"), p, F.lit(".json'; fetch(\"/api/jobs/list\"); load(\"https://x.com/api/v1/jobs.json\"); "),
        F.lit("more('/api/a/jobs.json', '/api/b/jobs.json', '/api/a/jobs.json', '/api/c/positions.json', '/jobs/api/d.json')</script>"),
    )
    html = F.concat("html", F.when(F.col("page_id") % 2 == 0, script).otherwise(""))
    return t("pages").select("page_id", F.array_join(pages.json_endpoints(html), "|").alias("endpoints"))
