"""Registered rankings and recommendation lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import aggregates, dedupe, joins, ranking, recommendations
from vacantia.operators.filters import LOG_TIES, desc
from vacantia.plans.figures import ORDER
from vacantia.plans.registry import query
from vacantia.plans.views import AS_OF, TODAY


@query("e1_daily_top", f"""
WITH best AS (SELECT * FROM {{jobs}} WHERE discovered_at >= TIMESTAMP '1998-07-01 00:00:00' AND discovered_at <= TIMESTAMP '{TODAY}' AND ai_match_score IS NOT NULL
 ORDER BY ai_match_score DESC, discovered_at DESC, id LIMIT 5)
SELECT id, title, ai_match_score, CAST(row_number() OVER (ORDER BY ai_match_score DESC, discovered_at DESC, id) AS INT) AS ai_rank,
 TIMESTAMP '{TODAY}' AS ai_selected_date, true AS ai_recommended FROM best""")
def _(t):
    return ranking.daily_top(t("jobs"), TODAY).select("id", "title", "ai_match_score", "ai_rank", "ai_selected_date", "ai_recommended")


@query("e2_rank_latest", """
SELECT id, title, ai_match_score, discovered_at FROM {jobs} WHERE description IS NOT NULL""")
def _(t):
    return ranking.rank_latest(t("jobs")).select("id", "title", "ai_match_score", "discovered_at")


@query("e3_latest_per_company", """
SELECT company_id, id, title, discovered_at FROM {jobs}
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY discovered_at DESC NULLS FIRST, id) <= 10""")
def _(t):
    return ranking.latest_per_company(t("jobs")).select("company_id", "id", "title", "discovered_at")


@query("e4_numbered_versions", """
SELECT id, job_id, document_type, CAST(CASE WHEN coalesce(version, 0) = 0 THEN row_number() OVER w ELSE version END AS INT) AS version,
 row_number() OVER w = count(*) OVER (PARTITION BY job_id, document_type) AS is_current FROM {generated_documents}
WINDOW w AS (PARTITION BY job_id, document_type ORDER BY generated_at NULLS FIRST, id)""")
def _(t):
    return ranking.numbered_versions(t("generated_documents")).select("id", "job_id", "document_type", "version", "is_current")


@query("e5_new_versions", f"""
WITH d AS (SELECT * FROM {{generated_documents}}), r AS (
  SELECT job_id, document_type, content, CASE WHEN job_id % 2 = 0 THEN id END AS parent_version_id FROM d
  QUALIFY row_number() OVER (PARTITION BY job_id, document_type ORDER BY id) = 1)
SELECT d.id, d.job_id, d.document_type, length(d.content) AS chars, d.generated_at, d.version, d.parent_version_id,
 d.is_current AND r.job_id IS NULL AS is_current, d.review_status, d.edited_content, d.review_notes, d.reviewed_at FROM d LEFT JOIN r ON r.job_id = d.job_id AND r.document_type = d.document_type AND r.job_id % 5 <> 0
UNION ALL SELECT NULL, r.job_id, r.document_type, length(r.content), TIMESTAMP '{AS_OF}',
 CAST(CASE WHEN r.parent_version_id IS NOT NULL THEN coalesce(p.version + 1, 1) ELSE coalesce((SELECT max(version) FROM d x WHERE x.job_id = r.job_id AND x.document_type = r.document_type) + 1, 1) END AS INT),
 r.parent_version_id, true, NULL, NULL, NULL, NULL FROM r LEFT JOIN d p ON p.id = r.parent_version_id WHERE r.job_id % 5 <> 0""")
def _(t):
    documents = t("generated_documents")
    first = dedupe.dedupe_by_id(documents, "id", ("job_id", "document_type")).filter("job_id % 5 <> 0")
    parent = F.when(F.col("job_id") % 2 == 0, F.col("id")).alias("parent_version_id")
    requests = first.select("job_id", "document_type", "content", parent)
    out = ranking.new_versions(documents, requests, AS_OF)
    return out.withColumn("chars", F.length("content").cast("bigint")).drop("content")


@query("e6_current_documents", """
SELECT id, job_id, document_type, generated_at FROM {generated_documents} WHERE is_current""")
def _(t):
    return ranking.current_documents(t("generated_documents")).select("id", "job_id", "document_type", "generated_at")


@query("e6_document_versions", """
SELECT id, job_id, document_type, version, generated_at FROM {generated_documents} WHERE document_type = 'resume'""")
def _(t):
    return ranking.document_versions(t("generated_documents"), document_type="resume").select("id", "job_id", "document_type", "version", "generated_at")


@query("e7_dedupe_postings", """
SELECT seq, url, title FROM {incoming} WHERE trim(lower(coalesce(url, ''))) <> '' AND trim(lower(coalesce(title, ''))) <> ''
QUALIFY row_number() OVER (PARTITION BY trim(lower(url)), trim(lower(title)) ORDER BY seq) = 1""")
def _(t):
    return dedupe.dedupe_postings(t("incoming"), "seq", drop_empty=True).select("seq", "url", "title")


@query("e7_dedupe_titles_of_one_page", """
SELECT id, title FROM (SELECT id, title, '' AS url FROM {jobs})
QUALIFY row_number() OVER (PARTITION BY url, trim(lower(title)) ORDER BY id) = 1""")
def _(t):
    page = t("jobs").select("id", "title", F.lit(None).cast("string").alias("url"))
    return dedupe.dedupe_postings(page, "id").select("id", "title")


@query("e8_dedupe_by_external_id", """
SELECT seq, external_id FROM {incoming} QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY seq) = 1""")
def _(t):
    return dedupe.dedupe_by_id(t("incoming"), "seq").select("seq", "external_id")


@query("e9_dedupe_companies", """
SELECT seq, name, priority FROM {company_records} WHERE length(trim(lower(name))) >= 2
QUALIFY row_number() OVER (PARTITION BY trim(lower(name)) ORDER BY priority DESC, seq) = 1""")
def _(t):
    return dedupe.dedupe_companies(t("company_records")).select("seq", "name", "priority")


@query("e10_discovery_order", """
SELECT seq, name, source, priority FROM {company_records} ORDER BY priority DESC, source = 'linkedin' DESC, source = 'indeed' DESC, seq LIMIT 50""")
def _(t):
    return ranking.discovery_order(t("company_records"), 50).select("seq", "name", "source", "priority")


@query("e11_empty_crawl_streaks", f"""
WITH l AS (SELECT *, status = 'completed' AND new_jobs > 0 AS found,
  row_number() OVER (PARTITION BY company_id ORDER BY started_at, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n
 FROM {{crawl_logs}} WHERE started_at < TIMESTAMP '{AS_OF}' AND status <> 'running')
SELECT company_id, max(started_at) AS last_crawled_at, max(completed_at) FILTER (found) AS last_successful_crawl,
 CAST(coalesce(sum(new_jobs) FILTER (found), 0) AS BIGINT) AS jobs_found_total,
 count(*) - coalesce(max(n) FILTER (found), 0) AS consecutive_empty_crawls FROM l GROUP BY 1""")
def _(t):
    return ranking.empty_crawl_streaks(t("crawl_logs"), AS_OF, ORDER)


@query("e12_crawl_eta", f"""
WITH d AS (SELECT (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 AS s FROM {{crawl_logs}} WHERE started_at < TIMESTAMP '{AS_OF}' AND completed_at IS NOT NULL
 ORDER BY completed_at DESC, started_at, l_orderkey, l_linenumber, l_partkey, l_extendedprice, company_id LIMIT 10)
SELECT avg(s) AS avg_duration, (SELECT count(*) FROM {{companies}} WHERE is_active) AS remaining,
 CAST(floor(avg(s) * (SELECT count(*) FROM {{companies}} WHERE is_active)) AS BIGINT) AS eta_seconds FROM d""")
def _(t):
    return ranking.crawl_eta(t("crawl_logs"), t("companies"), AS_OF, ORDER)


@query("e12_moving_average", f"""
WITH d AS (SELECT *, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 AS duration FROM {{crawl_logs}} WHERE started_at < TIMESTAMP '{AS_OF}' AND completed_at IS NOT NULL)
SELECT company_id, l_orderkey, l_linenumber, completed_at, duration,
 avg(duration) OVER (ORDER BY completed_at, started_at DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, company_id DESC ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS avg_duration FROM d""")
def _(t):
    out = ranking.moving_durations(t("crawl_logs"), AS_OF, ORDER)
    return out.select("company_id", "l_orderkey", "l_linenumber", "completed_at", "duration", "avg_duration")


@query("e13_last_seen_ids", """
SELECT company_id, string_agg(external_id, ',' ORDER BY discovered_at DESC, id) AS last_seen_ids FROM (
 SELECT * FROM {jobs} WHERE coalesce(external_id, '') <> '' QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY discovered_at DESC, id) <= 500)
GROUP BY 1""")
def _(t):
    return ranking.last_seen_ids(t("jobs"), cap=500).withColumn("last_seen_ids", F.array_join("last_seen_ids", ","))


@query("e14_capped_records", """
SELECT seq, name FROM {company_records} ORDER BY has_crawl_results DESC, priority DESC, lower(name) DESC, seq LIMIT 60""")
def _(t):
    return ranking.capped_records(t("company_records"), 60).select("seq", "name")


@query("e15_top_list", """
SELECT id, title, ai_match_score FROM {jobs} WHERE ai_match_score >= 70 ORDER BY ai_match_score DESC, id LIMIT 10""")
def _(t):
    return ranking.top_list(t("jobs")).select("id", "title", "ai_match_score")


@query("e15_newest_list", "SELECT id, title, discovered_at FROM {jobs} WHERE is_new ORDER BY discovered_at DESC, id LIMIT 10")
def _(t):
    return ranking.newest_list(t("jobs"), new_only=True).select("id", "title", "discovered_at")


@query("e16_lacking_documents", """
SELECT * FROM (SELECT id, ai_match_score, NOT EXISTS (SELECT 1 FROM {generated_documents} d WHERE d.job_id = j.id AND document_type = 'resume') AS needs_resume,
 NOT EXISTS (SELECT 1 FROM {generated_documents} d WHERE d.job_id = j.id AND document_type = 'cover_letter') AS needs_cover_letter
FROM {jobs} j WHERE ai_match_score IS NOT NULL) WHERE needs_resume OR needs_cover_letter ORDER BY ai_match_score DESC, id LIMIT 10""")
def _(t):
    return ranking.lacking_documents(t("jobs"), t("generated_documents")).select("id", "ai_match_score", "needs_resume", "needs_cover_letter")


@query("e17_recent_crawls", f"""
SELECT company_id, status, started_at, jobs_found, new_jobs FROM {{crawl_logs}} WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL '60' DAY AND started_at < TIMESTAMP '{AS_OF}'
ORDER BY started_at DESC, company_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 20""")
def _(t):
    out = aggregates.latest_logs(t("crawl_logs"), AS_OF, 20, LOG_TIES, days=60)
    return out.select("company_id", "status", "started_at", "jobs_found", "new_jobs")


@query("e17_recent_pending", """
SELECT id, name, discovery_source, confidence_score, created_at FROM {pending_companies} WHERE status = 'pending'
ORDER BY created_at DESC, id LIMIT 5""")
def _(t):
    return ranking.recent_pending(t("pending_companies")).select("id", "name", "discovery_source", "confidence_score", "created_at")


@query("e18_automation_order", "SELECT id, name, priority_score FROM {companies}")
def _(t):
    return ranking.automation_order(t("companies")).select("id", "name", "priority_score")


@query("f1_follow_up_board", f"""
SELECT 'follow_up' AS type, 'high' AS priority, j.id AS job_id, CAST(NULL AS BIGINT) AS followup_id, title AS job_title, company, location,
 ai_match_score AS score, '' AS date_key, 'Schedule follow-up email or call' AS suggested_action FROM {{jobs}} j
WHERE status = 'applied' AND NOT is_new AND NOT EXISTS (SELECT 1 FROM {{follow_ups}} f WHERE f.job_id = j.id AND NOT f.completed)
UNION ALL SELECT 'upcoming_followup', CASE WHEN epoch_us(follow_up_date) - epoch_us(TIMESTAMP '{TODAY}') < 3600000000 THEN 'high' ELSE 'medium' END,
 j.id, f.id, title, company, location, NULL, strftime(follow_up_date, '%Y-%m-%dT%H:%M:%S'), 'Follow up: ' || action_type
FROM {{follow_ups}} f JOIN {{jobs}} j ON j.id = f.job_id
WHERE NOT completed AND follow_up_date BETWEEN TIMESTAMP '{TODAY}' AND TIMESTAMP '{TODAY}' + INTERVAL '24' HOUR
UNION ALL (SELECT 'apply_now', 'medium', id, NULL, title, company, location, ai_match_score, strftime(discovered_at, '%Y-%m-%dT%H:%M:%S'), 'Apply now - high match score'
FROM {{jobs}} WHERE ai_match_score >= 75 AND status = 'new' ORDER BY ai_match_score DESC, id LIMIT 10)""")
def _(t):
    return recommendations.follow_up_board(t("jobs"), t("follow_ups"), TODAY)


@query("f2_task_board", """
WITH best AS (SELECT * FROM {jobs} WHERE ai_match_score >= 50 AND status = 'new'),
 act AS (SELECT 0 AS branch, -ai_match_score AS place, * FROM best b WHERE NOT EXISTS (SELECT 1 FROM {tasks} t WHERE t.job_id = b.id) ORDER BY ai_match_score DESC, id LIMIT 20),
 later AS (SELECT 1 AS branch, -epoch_us(updated_at) AS place, * FROM {jobs} a WHERE status = 'applied'
  AND NOT EXISTS (SELECT 1 FROM {tasks} t WHERE t.job_id = a.id AND t.task_type = 'follow_up') ORDER BY updated_at DESC, id LIMIT 20)
SELECT id AS job_id, title AS job_title, company, ai_match_score AS match_score,
 CASE WHEN branch = 1 THEN 'follow_up' WHEN ai_match_score >= 75 THEN 'apply' ELSE 'research' END AS recommended_action,
 CASE WHEN branch = 1 OR ai_match_score >= 75 THEN 'high' ELSE 'medium' END AS priority,
 CASE WHEN branch = 1 THEN 'Application submitted - follow-up recommended' WHEN ai_match_score >= 75 THEN 'High match score - immediate action recommended'
  ELSE 'Medium match - research recommended before applying' END AS reason
FROM (SELECT * FROM act UNION ALL SELECT * FROM later) ORDER BY branch, place, id LIMIT 20""")
def _(t):
    return recommendations.task_board(t("jobs"), t("tasks"), limit=20)


@query("f3_known_names", """
SELECT lower(name) AS known_name FROM {companies} UNION SELECT lower(name) FROM {pending_companies} WHERE status = 'pending'""")
def _(t):
    return joins.known_names(t("companies"), t("pending_companies"))


@query("f4_id_difference", """
SELECT DISTINCT target_3 AS id FROM {search_criteria} WHERE target_3 IS NOT NULL EXCEPT SELECT id FROM {companies}""")
def _(t):
    wanted = t("search_criteria").select(F.col("target_3").alias("id")).filter("id IS NOT NULL")
    return recommendations.id_difference(wanted, t("companies"))
