"""Registered joins and the duplicate cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import dedupe, joins
from vacantia.operators.filters import desc
from vacantia.plans.registry import query
from vacantia.plans.views import AS_OF, TODAY


def searches(t):
    """Saved searches with their targets as an array."""
    return t("search_criteria").withColumn("target_companies", F.array_compact(F.array("target_1", "target_2", "target_3")))


@query("c1_score_discrepancy", f"""
SELECT nullif(avg(j.ai_match_score - f.ai_match_score_actual), 0) AS avg_discrepancy
FROM {{jobs}} j JOIN {{job_feedback}} f ON j.id = f.job_id
WHERE f.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY AND f.ai_match_score_actual IS NOT NULL AND j.ai_match_score IS NOT NULL""")
def _(t):
    return joins.score_discrepancy(t("jobs"), t("job_feedback"), AS_OF)


@query("c2_jobs_to_review", """
SELECT f.id AS feedback_id, j.id AS id, j.title AS title, f.created_at AS feedback_at
FROM {jobs} j JOIN {job_feedback} f ON j.id = f.job_id WHERE f.feedback_value IN ('negative','low')
ORDER BY f.created_at DESC, f.id LIMIT 10""")
def _(t):
    return joins.jobs_to_review(t("jobs"), t("job_feedback")).select("feedback_id", "id", "title", "feedback_at")


@query("c3_jobs_per_company", """
SELECT c.id, c.name, count(j.id) AS job_count FROM {companies} c LEFT JOIN {jobs} j ON c.id = j.company_id
GROUP BY c.id, c.name ORDER BY job_count DESC, c.id LIMIT 10""")
def _(t):
    return joins.jobs_per_company(t("companies"), t("jobs"))


@query("c4_logs_with_company", """
SELECT l.company_id, c.name AS company_name, c.crawler_type, l.started_at, l.status, l.l_orderkey, l.l_linenumber,
 CASE WHEN c.name IS NULL THEN NULL WHEN c.crawler_type IN ('indeed','linkedin') THEN 'selenium' WHEN c.crawler_type IN ('greenhouse','lever') THEN 'api'
  WHEN c.crawler_type IN ('generic','workday') THEN 'ai' ELSE 'unknown' END AS crawler_class
FROM {crawl_logs} l LEFT JOIN {companies} c ON c.id = l.company_id""")
def _(t):
    return joins.logs_with_company(t("crawl_logs"), t("companies")).select(
        "company_id", "company_name", "crawler_type", "started_at", "status", "l_orderkey", "l_linenumber", "crawler_class"
    )


@query("c5_applied_without_follow_up", """
SELECT id, title, company, updated_at FROM {jobs} j WHERE status = 'applied' AND NOT is_new
 AND NOT EXISTS (SELECT 1 FROM {follow_ups} f WHERE f.job_id = j.id AND NOT f.completed)""")
def _(t):
    jobs = t("jobs")
    return joins.applied_without_follow_up(jobs, t("follow_ups")).select("id", "title", "company", "updated_at")


@query("c6_action_recommendations", """
WITH best AS (SELECT * FROM {jobs} WHERE ai_match_score >= 50 AND status = 'new')
SELECT id AS job_id, title AS job_title, company, ai_match_score AS match_score,
 CASE WHEN ai_match_score >= 75 THEN 'apply' ELSE 'research' END AS recommended_action,
 CASE WHEN ai_match_score >= 75 THEN 'high' ELSE 'medium' END AS priority,
 CASE WHEN ai_match_score >= 75 THEN 'High match score - immediate action recommended' ELSE 'Medium match - research recommended before applying' END AS reason
FROM best b WHERE NOT EXISTS (SELECT 1 FROM {tasks} t WHERE t.job_id = b.id) ORDER BY match_score DESC, job_id LIMIT 100""")
def _(t):
    return joins.action_recommendations(t("jobs"), t("tasks"), limit=100)


@query("c7_applied_without_follow_up_task", """
SELECT id AS job_id, title AS job_title, company, ai_match_score AS match_score, updated_at FROM {jobs} j WHERE status = 'applied'
 AND NOT EXISTS (SELECT 1 FROM {tasks} t WHERE t.job_id = j.id AND t.task_type = 'follow_up')""")
def _(t):
    out = joins.follow_up_recommendations(t("jobs"), t("tasks"), limit=None)
    return out.select("job_id", "job_title", "company", "match_score", "updated_at")


@query("c8_unknown_companies", """
SELECT seq, name FROM {company_records} r WHERE NOT EXISTS (SELECT 1 FROM {companies} c WHERE lower(c.name) = lower(trim(r.name)))
 AND NOT EXISTS (SELECT 1 FROM {pending_companies} p WHERE p.status = 'pending' AND lower(p.name) = lower(trim(r.name)))""")
def _(t):
    return joins.unknown_companies(t("company_records"), t("companies"), t("pending_companies")).select("seq", "name")


@query("c9_search_targets", """
SELECT s.id AS search_id, c.id AS company_id FROM {search_criteria} s JOIN {companies} c
 ON c.is_active AND c.id IN (s.target_1, s.target_2, s.target_3) WHERE s.is_active
UNION ALL SELECT id, NULL FROM {search_criteria} WHERE is_active AND target_1 IS NULL""")
def _(t):
    return joins.search_targets(searches(t), t("companies"))


@query("c10_missing_targets", """
SELECT search_id, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS missing_ids FROM (
 SELECT id AS search_id, unnest([target_1, target_2, target_3]) AS target FROM {search_criteria}) x
WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {companies} c WHERE c.id = x.target) GROUP BY search_id""")
def _(t):
    out = joins.missing_targets(searches(t), t("companies"))
    return out.withColumn("missing_ids", F.array_join(F.col("missing_ids").cast("array<string>"), ","))


@query("c11_job_context", """
SELECT x.job_id, x.section, x.item_id, x.at, x.label, j.title AS job_title, j.status AS job_status FROM (
 SELECT job_id, 'application' AS section, id AS item_id, created_at AS at, status AS label FROM {applications}
 UNION ALL SELECT job_id, 'task', id, due_date, task_type FROM {tasks}
 UNION ALL SELECT job_id, 'follow_up', id, follow_up_date, action_type FROM {follow_ups}
 UNION ALL SELECT job_id, 'document', id, generated_at, document_type FROM {generated_documents}
 UNION ALL SELECT job_id, 'activity', id, created_at, activity_type FROM {job_activities}) x JOIN {jobs} j ON j.id = x.job_id""")
def _(t):
    def part(name, at, label):
        return t(name).select("job_id", F.col("id").alias("item_id"), F.col(at).alias("at"), F.col(label).alias("label"))

    return joins.job_context(t("jobs"), {
        "application": part("applications", "created_at", "status"),
        "task": part("tasks", "due_date", "task_type"),
        "follow_up": part("follow_ups", "follow_up_date", "action_type"),
        "document": part("generated_documents", "generated_at", "document_type"),
        "activity": part("job_activities", "created_at", "activity_type"),
    })


@query("c12_companies_with_job_counts", """
SELECT c.id, c.name, (SELECT count(*) FROM {jobs} j WHERE j.company_id = c.id) AS jobs_count FROM {companies} c WHERE c.is_active""")
def _(t):
    return joins.with_counts(t("companies").filter("is_active").select("id", "name"), "id", jobs_count=(t("jobs"), "company_id"))


@query("c12_jobs_with_child_counts", """
SELECT j.id, j.status, coalesce(a.n, 0) AS applications_count, coalesce(d.n, 0) AS documents_count FROM {jobs} j
LEFT JOIN (SELECT job_id, count(*) AS n FROM {applications} GROUP BY 1) a ON a.job_id = j.id
LEFT JOIN (SELECT job_id, count(*) AS n FROM {generated_documents} GROUP BY 1) d ON d.job_id = j.id""")
def _(t):
    return joins.with_counts(
        t("jobs").select("id", "status"), "id",
        applications_count=(t("applications"), "job_id"), documents_count=(t("generated_documents"), "job_id"),
    )


@query("c13_follow_ups_soon", f"""
SELECT f.id AS followup_id, f.job_id, f.follow_up_date, j.title AS job_title,
 CASE WHEN epoch_us(f.follow_up_date) - epoch_us(TIMESTAMP '{TODAY}') < 3600000000 THEN 'high' ELSE 'medium' END AS priority
FROM {{follow_ups}} f JOIN {{jobs}} j ON j.id = f.job_id
WHERE NOT f.completed AND f.follow_up_date BETWEEN TIMESTAMP '{TODAY}' AND TIMESTAMP '{TODAY}' + INTERVAL '24' HOUR""")
def _(t):
    return joins.follow_ups_soon(t("follow_ups"), t("jobs"), TODAY).select(
        F.col("id").alias("followup_id"), "job_id", "follow_up_date", "job_title", "priority"
    )


MATCHES = r"""
WITH body AS (SELECT id, company_id, lower(title) || ' ' || lower(coalesce(description, '')) AS text, lower(coalesce(location, '')) AS place,
  lower(coalesce(job_type, '')) AS type FROM {jobs} j WHERE EXISTS (SELECT 1 FROM {companies} c WHERE c.is_active AND c.id = j.company_id)),
 words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(keywords), '\s+')) AS word FROM {search_criteria} WHERE keywords IS NOT NULL),
 hits AS (SELECT w.word, b.id FROM body b JOIN words w ON w.word <> '' AND contains(b.text, w.word)),
 needs AS (SELECT s.*, unnest(regexp_split_to_array(lower(keywords), '\s+')) AS word FROM {search_criteria} s WHERE keywords IS NOT NULL),
 found AS (SELECT DISTINCT n.id AS search_id, h.id AS job_id FROM needs n JOIN hits h ON h.word = n.word
  UNION ALL SELECT s.id, b.id FROM {search_criteria} s JOIN body b ON s.keywords IS NULL AND (s.target_1 IS NULL OR b.company_id IN (s.target_1, s.target_2, s.target_3)))
SELECT f.search_id, count(*) AS matches, CAST(sum(f.job_id) AS BIGINT) AS id_sum FROM found f
JOIN {search_criteria} s ON s.id = f.search_id JOIN body b ON b.id = f.job_id
WHERE s.is_active AND (s.target_1 IS NULL OR b.company_id IN (s.target_1, s.target_2, s.target_3))
 AND (NOT s.remote_only OR regexp_matches(b.place, 'remote|anywhere|work from home'))
 AND (s.job_type IS NULL OR contains(b.type, lower(s.job_type))) GROUP BY 1"""


@query("c14_search_matches_per_search", MATCHES)
def _(t):
    index = joins.standing(searches(t), t("companies"))
    sums = joins.matched_totals(index, *joins.matched_cells(index, t("jobs")))
    return sums.unionByName(joins.open_search_totals(index, t("jobs")))


@query("c14_open_searches", """
SELECT id AS search_id, remote_only, coalesce(lower(job_type), '') AS wanted_type FROM {search_criteria} WHERE is_active AND keywords IS NULL AND target_1 IS NULL""")
def _(t):
    return joins.open_searches(joins.standing(searches(t), t("companies")))


LINK = "lower(rtrim(split_part(split_part(coalesce({0}, ''), '?', 1), '#', 1), '/'))"
TITLE = r"replace(replace(trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g')), '-', ' '), '_', ' ')"
CASCADE = f"""
want AS (SELECT seq, external_id AS ext, company_id AS comp, {LINK.format("coalesce(nullif(url, ''), source_url)")} AS link, {TITLE.format("title")} AS ttl FROM {{incoming}}),
have AS (SELECT id, external_id AS ext, company_id AS comp, {TITLE.format("title")} AS ttl, discovered_at FROM {{stored_jobs}}),
links AS (SELECT id, company_id AS comp, {LINK.format("url")} AS link FROM {{stored_jobs}} UNION SELECT id, company_id, {LINK.format("source_url")} FROM {{stored_jobs}}),
latest AS (SELECT ext, id, discovered_at FROM have QUALIFY row_number() OVER (PARTITION BY ext ORDER BY discovered_at DESC, id) = 1),
hits AS (SELECT w.seq, 1 AS tier, h.id FROM want w JOIN have h ON h.ext = w.ext AND h.comp = w.comp WHERE w.ext <> ''
 UNION ALL SELECT w.seq, 2, l.id FROM want w JOIN links l ON l.link = w.link AND l.comp = w.comp WHERE w.link <> ''
 UNION ALL SELECT w.seq, 3, h.id FROM want w JOIN have h ON h.ttl = w.ttl AND h.comp = w.comp WHERE w.ttl <> ''
 UNION ALL SELECT w.seq, 4, l.id FROM want w JOIN latest l ON l.ext = w.ext WHERE w.ext <> '' AND l.discovered_at >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY),
cascade AS (SELECT w.seq, h.tier, h.id AS match_id FROM want w LEFT JOIN (
 SELECT seq, tier, min(id) AS id FROM hits GROUP BY seq, tier QUALIFY row_number() OVER (PARTITION BY seq ORDER BY tier) = 1) h ON h.seq = w.seq)
"""


@query("c15_duplicate_cascade", "WITH " + CASCADE + " SELECT seq, tier, match_id FROM cascade")
def _(t):
    return dedupe.find_duplicates(t("incoming"), None, AS_OF, keys=t.stored_keys().first_rows())


@query("c15_stored_keys", f"""
WITH k AS (SELECT company_id, nullif(external_id, '') AS ext, nullif({TITLE.format('title')}, '') AS title, nullif({LINK.format('url')}, '') AS u, nullif({LINK.format('source_url')}, '') AS v FROM {{stored_jobs}})
SELECT * FROM (SELECT 1 AS tier, count(*) FILTER (company_id IS NOT NULL AND ext IS NOT NULL) AS keys, count(DISTINCT ext) FILTER (company_id IS NOT NULL) AS texts FROM k
 UNION ALL SELECT 2, count(*) FILTER (company_id IS NOT NULL) + count(*), count(DISTINCT u) FROM (SELECT company_id, u FROM k WHERE u IS NOT NULL UNION ALL SELECT company_id, v FROM k WHERE v IS NOT NULL)
 UNION ALL SELECT 3, count(*) FILTER (company_id IS NOT NULL AND title IS NOT NULL), count(DISTINCT title) FILTER (company_id IS NOT NULL) FROM k
 UNION ALL SELECT 4, count(ext), count(DISTINCT ext) FROM k)""")
def _(t):
    """What a kept table of keys holds."""
    rows = t.stored_keys().first_rows()
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("k").alias("texts"))


@query("c15_duplicates_by_scan", "WITH " + CASCADE + " SELECT seq, tier, match_id FROM cascade")
def _(t):
    """The same without a kept table of keys."""
    return dedupe.find_duplicates(t("incoming"), t("stored_jobs"), AS_OF)


AUTOMATION = f"""
SELECT c.id, c.name, c.is_active, l.last_crawl_at, coalesce(l.total, 0) AS total_crawls_30d, coalesce(l.good, 0) AS successful_crawls_30d,
 round_even(CASE WHEN l.total > 0 THEN l.good / l.total * 100 END, 1) AS success_rate,
 CASE WHEN NOT c.is_active THEN 'inactive' WHEN c.consecutive_empty_crawls >= 3 THEN 'critical' WHEN c.consecutive_empty_crawls >= 2 THEN 'warning'
  WHEN l.total > 0 AND l.good / l.total * 100 < 50 THEN 'warning' WHEN c.viability_score < 50 THEN 'warning'
  WHEN coalesce(l.total, 0) = 0 THEN 'unknown' ELSE 'healthy' END AS health_status,
 c.consecutive_empty_crawls >= 2 OR coalesce(l.total > 0 AND l.good / l.total * 100 < 70, false) OR coalesce(c.viability_score < 50, false) AS needs_attention
FROM {{companies}} c LEFT JOIN (
 SELECT company_id, max(started_at) AS last_crawl_at, count(*) FILTER (started_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY) AS total,
  count(*) FILTER (started_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY AND status = 'completed') AS good
 FROM {{crawl_logs}} WHERE started_at < TIMESTAMP '{AS_OF}' GROUP BY 1) l ON l.company_id = c.id"""


@query("c16_companies_with_automation", AUTOMATION)
def _(t):
    return joins.companies_with_automation(t("companies"), t("crawl_logs"), AS_OF).select(
        "id", "name", "is_active", "last_crawl_at", "total_crawls_30d", "successful_crawls_30d", "success_rate",
        "health_status", "needs_attention",
    )


@query("c17_tasks_with_job", """
SELECT t.id, t.job_id, t.status, j.title AS job_title, j.company AS job_company FROM {tasks} t LEFT JOIN {jobs} j ON j.id = t.job_id""")
def _(t):
    return joins.with_job(t("tasks"), t("jobs"), "title", "company").select("id", "job_id", "status", "job_title", "job_company")


@query("c17_applications_with_job", """
SELECT a.id, a.job_id, a.status, j.title AS job_title, j.url AS job_url FROM {applications} a LEFT JOIN {jobs} j ON j.id = a.job_id""")
def _(t):
    return joins.with_job(t("applications"), t("jobs"), "title", "url").select("id", "job_id", "status", "job_title", "job_url")


@query("c18_recent_applications", """
SELECT a.id, a.job_id, j.title AS job_title, a.status, a.created_at FROM (SELECT * FROM {applications} ORDER BY created_at DESC, id LIMIT 50) a
LEFT JOIN {jobs} j ON j.id = a.job_id""")
def _(t):
    out = joins.recent_with_job(t("applications"), t("jobs"), [desc("created_at"), F.col("id")])
    return out.select("id", "job_id", "job_title", "status", "created_at")


@query("c18_open_tasks", """
SELECT a.id, a.job_id, j.title AS job_title, a.due_date FROM (SELECT * FROM {tasks} WHERE status <> 'completed' ORDER BY due_date, id LIMIT 50) a
LEFT JOIN {jobs} j ON j.id = a.job_id""")
def _(t):
    open_tasks = t("tasks").filter("status <> 'completed'")
    out = joins.recent_with_job(open_tasks, t("jobs"), [F.col("due_date"), F.col("id")])
    return out.select("id", "job_id", "job_title", "due_date")


@query("c18_future_follow_ups", f"""
SELECT a.id, a.job_id, j.title AS job_title, a.follow_up_date FROM (
 SELECT * FROM {{follow_ups}} WHERE follow_up_date >= TIMESTAMP '{TODAY}' ORDER BY follow_up_date, id LIMIT 50) a
LEFT JOIN {{jobs}} j ON j.id = a.job_id""")
def _(t):
    ahead = t("follow_ups").filter(F.col("follow_up_date") >= F.lit(TODAY).cast("timestamp"))
    out = joins.recent_with_job(ahead, t("jobs"), [F.col("follow_up_date"), F.col("id")])
    return out.select("id", "job_id", "job_title", "follow_up_date")


@query("c18_recent_documents", """
SELECT a.id, a.job_id, j.title AS job_title, a.document_type, a.generated_at FROM (
 SELECT * FROM {generated_documents} ORDER BY generated_at DESC, id LIMIT 50) a LEFT JOIN {jobs} j ON j.id = a.job_id""")
def _(t):
    out = joins.recent_with_job(t("generated_documents"), t("jobs"), [desc("generated_at"), F.col("id")])
    return out.select("id", "job_id", "job_title", "document_type", "generated_at")
