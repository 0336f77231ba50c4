"""Registered lists and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import filters
from vacantia.plans.registry import query
from vacantia.plans.views import AS_OF
from vacantia.session import settled, work_path
from vacantia.sources.text_index import TextIndex

JOB = "id, title, company, location, url, status, ai_match_score, is_new, discovered_at, posted_date"
JOB_COLS = JOB.split(", ")


@query("b1_job_list_high_match", f"""
SELECT {JOB} FROM {{jobs}} WHERE ai_match_score >= 75 ORDER BY ai_match_score DESC NULLS FIRST, id LIMIT 100""")
def _(t):
    return filters.job_list(t("jobs"), match="high", sort="ai_match_score").select(*JOB_COLS)


@query("b1_job_list_not_ready", f"""
SELECT {JOB} FROM {{jobs}} WHERE (ai_match_score < 70 OR ai_match_score IS NULL) AND is_new AND status = 'new'
ORDER BY posted_date DESC NULLS FIRST, id LIMIT 100""")
def _(t):
    return filters.job_list(t("jobs"), status="new", new_only=True, ready_to_apply=False, sort="posted_date").select(*JOB_COLS)


@query("b2_pipeline_needs_action", """
SELECT id, title, pipeline_stage, status, discovered_at,
 CASE WHEN pipeline_stage IN ('discover','review','prepare','apply','follow_up','archive') THEN pipeline_stage ELSE 'discover' END AS board_stage
FROM {jobs} WHERE pipeline_stage IN ('prepare','apply','follow_up') OR status = 'applied'""")
def _(t):
    out = filters.pipeline_list(t("jobs"), filter_type="needs_action")
    return out.select("id", "title", "pipeline_stage", "status", "discovered_at", "board_stage")


@query("b3_criteria_filter", """
SELECT id, title, location FROM {jobs}
WHERE (contains(lower(title) || ' ' || lower(coalesce(description,'')), 'python')
    OR contains(lower(title) || ' ' || lower(coalesce(description,'')), 'data,'))
 AND (contains(lower(coalesce(location,'')), 'remote') OR contains(lower(coalesce(location,'')), 'anywhere')
   OR contains(lower(coalesce(location,'')), 'work from home'))
 AND contains(lower(coalesce(job_type,'')), 'full-time')""")
def _(t):
    return filters.criteria_filter(t("jobs"), "Python data,", True, "Full-time").select("id", "title", "location")


@query("b4_text_search", """
SELECT id, title, company, discovered_at FROM {jobs}
WHERE title ILIKE '%python%' OR description ILIKE '%python%' OR company ILIKE '%python%'
ORDER BY discovered_at DESC NULLS FIRST, id LIMIT 10""")
def _(t):
    return filters.text_search(t("jobs"), "python").select("id", "title", "company", "discovered_at")


def indexed(t):
    """Postings with the names of their descriptions, and the index of all their texts."""
    jobs = settled(t.by_name("jobs").select("id", "title", "company", "location", "description", "discovered_at"), "postings")
    return jobs, TextIndex(t.spark, work_path(t.spark, "text-index"), t.texts()).add(jobs)


@query("b4_indexed_search", """
SELECT id, title, company, discovered_at FROM {jobs}
WHERE title ILIKE '%backend_eng%remote%' OR description ILIKE '%backend_eng%remote%' OR company ILIKE '%backend_eng%remote%'""")
def _(t):
    jobs, index = indexed(t)
    return filters.text_search(jobs, "Backend_eng%remote", limit=None, index=index).select("id", "title", "company", "discovered_at")


@query("b5_indexed_screen_search", """
SELECT id, title, company, location FROM {jobs}
WHERE contains(lower(title), 'new york') OR contains(lower(company), 'new york') OR contains(lower(coalesce(location,'')), 'new york')""")
def _(t):
    jobs, index = indexed(t)
    return filters.screen_search(jobs, "New York", index=index).select("id", "title", "company", "location")


@query("b5_screen_search", """
SELECT id, title, company, location FROM {jobs}
WHERE contains(lower(title), 'york') OR contains(lower(company), 'york') OR contains(lower(coalesce(location,'')), 'york')""")
def _(t):
    return filters.screen_search(t("jobs"), "York").select("id", "title", "company", "location")


@query("b6_task_list", f"""
SELECT id, job_id, task_type, priority, status, due_date, snooze_until FROM {{tasks}}
WHERE priority = 'high' AND due_date <= TIMESTAMP '{AS_OF}' AND due_date >= TIMESTAMP '1998-01-01 00:00:00'
 AND (status <> 'snoozed' OR snooze_until <= TIMESTAMP '{AS_OF}') ORDER BY due_date NULLS LAST, id LIMIT 100""")
def _(t):
    return filters.task_list(
        t("tasks"), AS_OF, priority="high", due_before=AS_OF, due_after="1998-01-01 00:00:00", include_snoozed=False
    ).select("id", "job_id", "task_type", "priority", "status", "due_date", "snooze_until")


@query("b7_tasks_due", """
SELECT id, job_id, status, due_date FROM {tasks}
WHERE due_date <= TIMESTAMP '1998-07-01 13:00:00' AND status IN ('pending','in_progress')""")
def _(t):
    return filters.tasks_due(t("tasks"), "1998-07-01 12:00:00").select("id", "job_id", "status", "due_date")


@query("b8_overdue_tasks", f"""
SELECT id, job_id, due_date FROM {{tasks}} WHERE due_date < TIMESTAMP '{AS_OF}' AND status = 'pending'""")
def _(t):
    return filters.overdue_tasks(t("tasks"), AS_OF).select("id", "job_id", "due_date")


@query("b9_upcoming_follow_ups", """
SELECT id, job_id, follow_up_date, action_type FROM {follow_ups}
WHERE NOT completed AND follow_up_date >= TIMESTAMP '1998-07-01 00:00:00'""")
def _(t):
    return filters.upcoming_follow_ups(t("follow_ups"), "1998-07-01 00:00:00").select("id", "job_id", "follow_up_date", "action_type")


@query("b10_application_list", """
SELECT id, job_id, status, application_date, created_at FROM {applications} WHERE status = 'interviewing'
ORDER BY created_at DESC NULLS FIRST, id LIMIT 100""")
def _(t):
    return filters.application_list(t("applications"), status="interviewing").select("id", "job_id", "status", "application_date", "created_at")


@query("b11_crawl_log_list", f"""
SELECT * FROM (
 SELECT l.company_id, c.name AS company_name, c.crawler_type,
  CASE WHEN c.name IS NULL THEN NULL WHEN c.crawler_type IN ('indeed','linkedin') THEN 'selenium'
   WHEN c.crawler_type IN ('greenhouse','lever') THEN 'api' WHEN c.crawler_type IN ('generic','workday') THEN 'ai' ELSE 'unknown' END AS crawler_class,
  l.status, l.started_at, (epoch_us(l.completed_at) - epoch_us(l.started_at)) / 1e6 AS duration_seconds, l.jobs_found, l.new_jobs
 FROM (SELECT * FROM {{crawl_logs}} WHERE started_at >= TIMESTAMP '2001-07-03 00:00:00' AND started_at < TIMESTAMP '{AS_OF}' AND status <> '') l
 LEFT JOIN {{companies}} c ON c.id = l.company_id WHERE c.crawler_type IN ('greenhouse', 'lever')
 ORDER BY started_at DESC NULLS FIRST, company_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 200)""")
def _(t):
    return filters.crawl_log_list(
        t("crawl_logs"), t("companies"), AS_OF, crawler_class="api", limit=200, hours=24 * 30
    ).select("company_id", "company_name", "crawler_type", "crawler_class", "status", "started_at", "duration_seconds", "jobs_found", "new_jobs")


@query("b12_archivable_jobs", f"""
SELECT id, status, discovered_at FROM {{jobs}}
WHERE discovered_at < TIMESTAMP '{AS_OF}' - INTERVAL '90' DAY AND archived_at IS NULL
 AND status NOT IN ('applied','interviewing','accepted')""")
def _(t):
    return filters.archivable(t("jobs"), AS_OF).select("id", "status", "discovered_at")


@query("b13_valid_postings", """
SELECT seq, external_id, title FROM {incoming} WHERE coalesce(external_id,'') <> '' AND coalesce(title,'') <> ''""")
def _(t):
    return filters.valid_postings(t("incoming")).select("seq", "external_id", "title")


@query("b14_unseen_postings", """
SELECT seq, external_id, company_id FROM {incoming} i
WHERE NOT EXISTS (SELECT 1 FROM {stored_jobs} s WHERE s.company_id = i.company_id AND s.external_id = i.external_id)""")
def _(t):
    return filters.unseen_postings(t("incoming"), t("stored_jobs")).select("seq", "external_id", "company_id")


@query("b15_company_name_sanity", r"""
SELECT doc_id, company_name FROM (
 SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS company_name FROM {documents})
WHERE length(company_name) >= 2 AND NOT regexp_matches(lower(company_name), 'remote|view job|easy apply|apply now|urgent|hiring')""")
def _(t):
    return filters.named_companies(t("documents"), "indeed", "text").select("doc_id", "company_name")


@query("b16_career_urls", r"""
SELECT seq, career_page_url FROM {company_records}
WHERE regexp_matches(lower(career_page_url), '/careers|/jobs|/job|/work-with-us|/career')""")
def _(t):
    return filters.career_pages(t("company_records")).select("seq", "career_page_url")


@query("b17_search_list", "SELECT id, name, keywords, is_active, created_at FROM {search_criteria}")
def _(t):
    return filters.search_list(t("search_criteria")).select("id", "name", "keywords", "is_active", "created_at")


@query("b17_active_companies", "SELECT id, name, crawler_type FROM {companies} WHERE is_active")
def _(t):
    return filters.company_list(t("companies"), active_only=True).select("id", "name", "crawler_type")


@query("b17_pending_companies", """
SELECT id, name, confidence_score FROM {pending_companies} WHERE status = 'pending'
ORDER BY confidence_score DESC NULLS FIRST, id LIMIT 100""")
def _(t):
    return filters.pending_list(t("pending_companies")).select("id", "name", "confidence_score")


@query("b17_user_documents", "SELECT id, filename, created_at FROM {user_documents}")
def _(t):
    return filters.document_list(t("user_documents")).select("id", "filename", "created_at")


@query("b17_pending_reviews", """
SELECT id, job_id, generated_at FROM {generated_documents} WHERE review_status = 'pending'
ORDER BY generated_at DESC NULLS FIRST, id LIMIT 10""")
def _(t):
    return filters.pending_reviews(t("generated_documents")).select("id", "job_id", "generated_at")


@query("b18_keep_or_discard", """
SELECT seq, name, priority FROM {company_records}
WHERE has_crawl_results OR priority >= 40 OR regexp_matches(lower(coalesce(industry,'')), 'software|technology|ai')""")
def _(t):
    return filters.verified_records(t("company_records")).select("seq", "name", "priority")


@query("b19_repaired_slugs", r"""
SELECT id, slug, repaired FROM (
 SELECT id, coalesce(slug,'') = '' AS repaired, coalesce(nullif(slug,''),
  nullif(regexp_extract(lower(career_page_url), 'boards\.greenhouse\.io/([^/]+)', 1), ''),
  nullif(regexp_extract(lower(career_page_url), 'jobs\.lever\.co/([^/]+)', 1), ''),
  regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')) AS slug
 FROM {companies} WHERE crawler_type IN ('greenhouse','lever'))""")
def _(t):
    return filters.repaired_slugs(t("companies")).select("id", "slug", F.col("repaired"))
