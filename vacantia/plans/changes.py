"""Registered state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import aggregates, task_state, transitions
from vacantia.plans.figures import ORDER
from vacantia.plans.joined import CASCADE
from vacantia.plans.landing import PARSED, raw_companies
from vacantia.plans.registry import query
from vacantia.plans.views import AS_OF, TODAY

LATER = "2024-06-01 00:00:00"


def ts(value):
    return F.lit(value).cast("timestamp")


BATCH = """
batch AS (SELECT * FROM {incoming} WHERE coalesce(external_id, '') <> '' AND coalesce(title, '') <> ''
 QUALIFY row_number() OVER (PARTITION BY external_id, company_id ORDER BY seq) = 1)
"""
INGEST = "WITH " + CASCADE + "," + BATCH + f""",
hit AS (SELECT b.*, c.match_id, s.discovered_at FROM batch b JOIN cascade c ON c.seq = b.seq JOIN {{stored_jobs}} s ON s.id = c.match_id WHERE b.posted_date > s.discovered_at
 QUALIFY row_number() OVER (PARTITION BY c.match_id ORDER BY b.seq DESC) = 1),
after AS (SELECT s.id, s.company_id, s.external_id, s.title, coalesce(h.url, s.url) AS url, coalesce(h.source_url, s.source_url) AS source_url,
 md5(coalesce(h.description, s.description)) AS description_md5, coalesce(h.posted_date, s.posted_date) AS posted_date, s.discovered_at, s.status,
 CASE WHEN h.seq IS NULL THEN 'kept' ELSE 'refreshed' END AS change FROM {{stored_jobs}} s LEFT JOIN hit h ON h.match_id = s.id
 UNION ALL SELECT NULL, b.company_id, b.external_id, b.title, b.url, coalesce(b.source_url, b.url), md5(b.description), b.posted_date, TIMESTAMP '{AS_OF}', 'new', 'new'
 FROM batch b JOIN cascade c ON c.seq = b.seq WHERE c.match_id IS NULL)
"""


def ingested(t):
    """Postings after a batch, with (text, name) for descriptions: the texts of stored postings are brought to the result, not carried through."""
    return transitions.ingest(t.stored_by_name(), t.incoming_in_hand(), AS_OF, keys=t.stored_keys().first_rows())


@query("j1_ingest", INGEST + " SELECT * FROM after")
def _(t):
    return t.with_descriptions(ingested(t)).withColumn("description_md5", F.md5("description")).drop("description")


@query("j1_new_postings_with_ids", INGEST + """ SELECT CAST(1000000000 + row_number() OVER (ORDER BY company_id, external_id) AS BIGINT) AS id, company_id, external_id, title
FROM after WHERE change = 'new'""")
def _(t):
    fresh = ingested(t).filter("change = 'new'").select("id", "company_id", "external_id", "title")
    return transitions.with_ids(fresh, 1_000_000_000, [F.col("company_id"), F.col("external_id")])


@query("j2_simple_ingest", """
SELECT seq, external_id, title FROM {incoming} i WHERE NOT EXISTS (SELECT 1 FROM {stored_jobs} s WHERE s.external_id = i.external_id)
QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY seq) = 1""")
def _(t):
    return transitions.simple_ingest(t("stored_jobs"), t("incoming")).select("seq", "external_id", "title")


@query("j3_company_stats", f"""
WITH l AS (SELECT *, status = 'completed' AND new_jobs > 0 AS found,
  row_number() OVER (PARTITION BY company_id ORDER BY started_at, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n
 FROM {{crawl_logs}} WHERE started_at < TIMESTAMP '{AS_OF}' AND status <> 'running'),
s AS (SELECT company_id, max(started_at) AS last_crawled_at, max(completed_at) FILTER (found) AS good, coalesce(sum(new_jobs) FILTER (found), 0) AS total,
 count(*) - coalesce(max(n) FILTER (found), 0) AS empty FROM l GROUP BY 1),
i AS (SELECT company_id, string_agg(external_id, ',' ORDER BY discovered_at DESC, id) AS ids FROM (
 SELECT * FROM {{jobs}} QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY discovered_at DESC, id) <= 500) GROUP BY 1)
SELECT c.id, s.last_crawled_at, s.good AS last_successful_crawl, CAST(c.jobs_found_total + coalesce(s.total, 0) AS BIGINT) AS jobs_found_total,
 CAST(CASE WHEN s.good IS NULL THEN c.consecutive_empty_crawls ELSE 0 END + coalesce(s.empty, 0) AS INT) AS consecutive_empty_crawls, i.ids AS last_seen_ids
FROM {{companies}} c LEFT JOIN s ON s.company_id = c.id LEFT JOIN i ON i.company_id = c.id""")
def _(t):
    out = transitions.update_company_stats(t("companies"), t("crawl_logs"), t("jobs"), AS_OF, ORDER, seen_cap=500)
    return out.select(
        "id", "last_crawled_at", "last_successful_crawl", "jobs_found_total", "consecutive_empty_crawls",
        F.array_join("last_seen_ids", ",").alias("last_seen_ids"),
    )


OLD = f"discovered_at < TIMESTAMP '{AS_OF}' - INTERVAL '90' DAY AND archived_at IS NULL AND status NOT IN ('applied', 'interviewing', 'accepted')"


@query("j4_archive", f"""
SELECT id, CASE WHEN {OLD} THEN 'archived' ELSE status END AS status, CASE WHEN {OLD} THEN TIMESTAMP '{AS_OF}' ELSE archived_at END AS archived_at FROM {{jobs}}""")
def _(t):
    return transitions.archive_jobs(t("jobs"), AS_OF).select("id", "status", "archived_at")


@query("j4_unarchive", """
SELECT id, CASE WHEN id % 2 = 0 AND archived_at IS NOT NULL AND status = 'archived' THEN 'new' ELSE status END AS status,
 CASE WHEN id % 2 = 0 THEN NULL ELSE archived_at END AS archived_at FROM {jobs}""")
def _(t):
    return transitions.unarchive_jobs(t("jobs"), t("jobs").filter("id % 2 = 0").select("id")).select("id", "status", "archived_at")


MERGES = """
g AS (SELECT external_id, min(id) AS first_id FROM {jobs} GROUP BY 1 HAVING count(*) > 1),
req AS (SELECT g.external_id AS request_id, CASE WHEN g.first_id % 20 = 8 THEN -1 ELSE g.first_id END AS keep_id, j.id AS job_id FROM {jobs} j JOIN g ON g.external_id = j.external_id
 UNION ALL SELECT external_id, first_id, -5 FROM g WHERE first_id % 30 = 28),
bad AS (SELECT request_id FROM req r LEFT JOIN {jobs} j ON j.id = r.job_id GROUP BY 1 HAVING NOT bool_or(r.job_id = r.keep_id) OR count(*) <> count(j.id)),
gone AS (SELECT job_id, keep_id FROM req WHERE job_id <> keep_id AND request_id NOT IN (SELECT request_id FROM bad))
"""


def merge_requests(t):
    """Every group of equal external ids; some requests are faulty on purpose."""
    jobs = t("jobs").select("id", "external_id")
    first = jobs.groupBy("external_id").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    keep = F.when(F.col("first_id") % 20 == 8, F.lit(-1)).otherwise(F.col("first_id"))
    rows = jobs.join(first, "external_id").select(F.col("external_id").alias("request_id"), keep.alias("keep_id"), F.col("id").alias("job_id"))
    lost = first.filter("first_id % 30 = 28").select("external_id", "first_id", F.lit(-5).cast("bigint"))
    return rows.union(lost)


@query("j5_merge_duplicates", "WITH " + MERGES + " SELECT id, external_id FROM {jobs} WHERE id NOT IN (SELECT job_id FROM gone)")
def _(t):
    return transitions.merge_duplicates(t("jobs"), merge_requests(t)).select("id", "external_id")


@query("j5_repointed_tasks", "WITH " + MERGES + " SELECT t.id, coalesce(g.keep_id, t.job_id) AS job_id FROM {tasks} t LEFT JOIN gone g ON g.job_id = t.job_id")
def _(t):
    return transitions.repoint_children(t("tasks"), t("jobs"), merge_requests(t)).select("id", "job_id")


@query("j6_stuck_logs", f"""
SELECT company_id, l_orderkey, l_linenumber, started_at, CASE WHEN stuck THEN 'failed' ELSE status END AS status, CASE WHEN stuck THEN TIMESTAMP '{AS_OF}' ELSE completed_at END AS completed_at,
 CASE WHEN stuck THEN 'Automatically marked as failed - stuck in ''running'' status for ' || printf('%.1f', (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(started_at)) / 6e7) || ' minutes (threshold: 60 minutes)' END AS error_message
FROM (SELECT *, status = 'running' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL '60' MINUTE AS stuck FROM {{crawl_logs}})""")
def _(t):
    out = transitions.fail_stuck_logs(t("crawl_logs"), AS_OF)
    return out.select("company_id", "l_orderkey", "l_linenumber", "started_at", "status", "completed_at", "error_message")


@query("j6_cancelled_logs", f"""
SELECT status, completed_at, error_message, count(*) AS logs FROM (SELECT CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status,
 CASE WHEN status = 'running' THEN TIMESTAMP '{AS_OF}' ELSE completed_at END AS completed_at, CASE WHEN status = 'running' THEN chr(10) || 'Cancelled by user' END AS error_message
 FROM {{crawl_logs}}) GROUP BY ALL""")
def _(t):
    out = transitions.cancel_running_logs(t("crawl_logs"), AS_OF)
    return out.groupBy("status", "completed_at", "error_message").agg(F.count(F.lit(1)).alias("logs"))


@query("j7_generated_tasks", """
WITH f AS (SELECT *, coalesce(ai_match_score, 0) AS s FROM {jobs} j WHERE coalesce(ai_match_score, 0) >= 50 AND NOT EXISTS (SELECT 1 FROM {tasks} t WHERE t.job_id = j.id AND t.status = 'pending'))
SELECT id AS job_id, 'apply' AS task_type, 'Apply to ' || title || ' at ' || company AS title, CASE WHEN s >= 75 THEN 'high' ELSE 'medium' END AS priority, 'AI' AS recommended_by,
 discovered_at + INTERVAL '1' DAY * CAST(CASE WHEN s >= 75 THEN 1 WHEN posted_date IS NOT NULL AND epoch_us(discovered_at) - epoch_us(posted_date) < 86400000000 THEN 2 ELSE 3 END AS INT) AS due_date FROM f WHERE status = 'new'
UNION ALL SELECT id, 'research', 'Research ' || company || ' for ' || title || ' position', 'medium', 'AI', discovered_at + INTERVAL '2' DAY FROM f WHERE status = 'new' AND s < 75
UNION ALL SELECT id, 'follow_up', 'Follow up on application to ' || title || ' at ' || company, 'high', 'system', updated_at + INTERVAL '7' DAY FROM f WHERE status = 'applied'""")
def _(t):
    out = transitions.generated_tasks(t("jobs"), t("tasks"), AS_OF)
    return out.select("job_id", "task_type", "title", "priority", "recommended_by", "due_date")


UNTIL = "ts + CASE snooze_for WHEN '1h' THEN INTERVAL '1' HOUR WHEN '3d' THEN INTERVAL '3' DAY WHEN '1w' THEN INTERVAL '7' DAY ELSE INTERVAL '1' DAY END"
REPLAY = f"""
WITH RECURSIVE c AS (SELECT id, task_id, ts, new_status, {UNTIL} AS until, row_number() OVER (PARTITION BY task_id ORDER BY ts, id) AS n FROM {{task_commands}}),
walk AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(NULL AS TIMESTAMP) AS completed_at, CAST(0 AS BIGINT) AS rejected FROM c
 UNION ALL SELECT w.task_id, c.n, CASE WHEN ok THEN c.new_status ELSE w.status END, CASE WHEN ok AND c.new_status = 'completed' AND w.status <> 'completed' THEN c.ts ELSE w.completed_at END,
  w.rejected + CASE WHEN ok OR c.new_status = 'snoozed' THEN 0 ELSE 1 END
 FROM walk w JOIN c ON c.task_id = w.task_id AND c.n = w.n + 1, LATERAL (SELECT c.new_status = w.status
  OR (w.status = 'pending' AND c.new_status IN ('in_progress', 'completed', 'snoozed', 'cancelled')) OR (w.status = 'in_progress' AND c.new_status IN ('completed', 'snoozed', 'cancelled'))
  OR (w.status = 'snoozed' AND c.new_status IN ('pending', 'in_progress', 'cancelled')) AS ok) x),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC) = 1)
SELECT l.task_id, l.status, l.completed_at, l.rejected, a.commands, a.snooze_count, a.snooze_until FROM last l JOIN (
 SELECT task_id, count(*) AS commands, count(*) FILTER (new_status = 'snoozed') AS snooze_count, arg_max(until, (ts, id)) FILTER (new_status = 'snoozed') AS snooze_until FROM c GROUP BY 1) a ON a.task_id = l.task_id"""


@query("j8_replayed_tasks", REPLAY)
def _(t):
    return task_state.replay_commands(t("task_commands"))


@query("j8_bulk_complete", """
SELECT count(*) FILTER (status IS NULL OR status IN ('pending', 'in_progress', 'completed')) AS success, count(*) FILTER (status IN ('snoozed', 'cancelled')) AS failed
FROM (SELECT o_orderkey AS id FROM {orders}) o LEFT JOIN {tasks} t ON t.id = o.id""")
def _(t):
    return task_state.bulk_action(t("tasks"), t("orders").select(F.col("o_orderkey").alias("id")), "complete")


def submissions(t):
    return t("applications").filter("status IN ('queued', 'drafting')").select(F.col("id").alias("application_id"))


SENT = "sent AS (SELECT DISTINCT job_id FROM {applications} WHERE status IN ('queued', 'drafting'))"


@query("j9_submitted_jobs", f"""
WITH {SENT} SELECT j.id, CASE WHEN s.job_id IS NULL THEN status ELSE 'applied' END AS status,
 CASE WHEN s.job_id IS NOT NULL AND coalesce(status, '') <> 'applied' THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at FROM {{jobs}} j LEFT JOIN sent s ON s.job_id = j.id""")
def _(t):
    return transitions.submitted_jobs(t("jobs"), t("applications"), submissions(t), AS_OF).select("id", "status", "updated_at")


@query("j9_submission_tasks", f"""
WITH {SENT} SELECT j.id AS job_id, 'follow_up' AS task_type, 'Follow up on application to ' || title || ' at ' || company AS title, 'high' AS priority,
 CASE WHEN coalesce(status, '') <> 'applied' THEN TIMESTAMP '{AS_OF}' ELSE updated_at END + INTERVAL '7' DAY AS due_date FROM {{jobs}} j JOIN sent s ON s.job_id = j.id
WHERE NOT EXISTS (SELECT 1 FROM {{tasks}} t WHERE t.job_id = j.id AND t.task_type = 'follow_up' AND t.status = 'pending')""")
def _(t):
    out = transitions.submission_tasks(t("jobs"), t("applications"), submissions(t), t("tasks"), AS_OF)
    return out.select("job_id", "task_type", "title", "priority", "due_date")


@query("j9_queued_applications", """
SELECT DISTINCT job_id, 'queued' AS status FROM {tasks} t WHERE EXISTS (SELECT 1 FROM {jobs} j WHERE j.id = t.job_id) AND NOT EXISTS (SELECT 1 FROM {applications} a WHERE a.job_id = t.job_id)""")
def _(t):
    return transitions.queued_applications(t("jobs"), t("applications"), t("tasks").select("job_id"))


VALID = "v AS (SELECT * FROM {stage_change_log} WHERE stage <> 'nowhere')"


@query("j10_stage_changes", f"""
WITH {VALID}, l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, change_id DESC) = 1)
SELECT j.id, coalesce(l.stage, j.pipeline_stage) AS pipeline_stage, coalesce(l.ts, j.updated_at) AS updated_at FROM {{jobs}} j LEFT JOIN l ON l.job_id = j.id""")
def _(t):
    return transitions.stage_changes(t("jobs"), t("stage_change_log")).select("id", "pipeline_stage", "updated_at")


@query("j10_stage_activities", f"""
WITH {VALID} SELECT job_id, old_stage, stage AS new_stage, 'Job moved from ' || coalesce(old_stage, 'None') || ' to ' || stage AS activity_description, ts AS created_at FROM (
 SELECT v.*, CASE WHEN row_number() OVER w = 1 THEN j.pipeline_stage ELSE lag(v.stage) OVER w END AS old_stage FROM v JOIN {{jobs}} j ON j.id = v.job_id
 WINDOW w AS (PARTITION BY v.job_id ORDER BY v.ts, v.change_id))""")
def _(t):
    out = transitions.stage_activities(t("jobs"), t("stage_change_log"))
    return out.select("job_id", "old_stage", "new_stage", "activity_description", "created_at")


def decisions(t):
    i = F.col("id")
    verdict = F.when(i % 3 == 0, "approve").when(i % 3 == 1, "reject").otherwise("wait")
    return t("pending_companies").select("id", verdict.alias("decision"))


@query("j11_reviewed_pending", f"""
SELECT id, name, CASE WHEN status = 'pending' AND id % 3 = 0 THEN 'approved' WHEN status = 'pending' AND id % 3 = 1 THEN 'rejected' ELSE status END AS status,
 CASE WHEN status = 'pending' AND id % 3 < 2 THEN TIMESTAMP '{AS_OF}' ELSE reviewed_at END AS reviewed_at FROM {{pending_companies}}""")
def _(t):
    return transitions.reviewed_pending(t("pending_companies"), decisions(t), AS_OF).select("id", "name", "status", "reviewed_at")


@query("j11_approved_companies", """
SELECT name, career_page_url, true AS is_active, discovery_source, confidence_score / 100 AS priority_score FROM {pending_companies} p WHERE status = 'pending' AND id % 3 = 0
 AND NOT EXISTS (SELECT 1 FROM {companies} c WHERE c.name = p.name)""")
def _(t):
    return transitions.approved_companies(t("pending_companies"), decisions(t), t("companies"))


DECIDED = """
d AS (SELECT *, least(100, CASE WHEN seq % 3 <> 0 THEN 75 ELSE 45 END + CASE source WHEN 'linkedin' THEN 5 WHEN 'indeed' THEN 3 WHEN 'web_search' THEN 2 ELSE 0 END
  + CASE WHEN priority >= 50 THEN 5 WHEN priority >= 30 THEN 2 ELSE 0 END + CASE WHEN contains(lower(career_page_url), '/careers') OR contains(lower(career_page_url), '/jobs') THEN 3 ELSE 0 END)::DOUBLE AS confidence_score,
  row_number() OVER (PARTITION BY lower(name) ORDER BY seq) AS n FROM {company_records}
 WHERE has_crawl_results OR priority >= 40 OR regexp_matches(lower(coalesce(industry, '')), 'software|technology|ai')),
e AS (SELECT d.*, CASE WHEN n > 1 OR EXISTS (SELECT 1 FROM {companies} c WHERE lower(c.name) = lower(d.name)) OR EXISTS (SELECT 1 FROM {pending_companies} p WHERE p.status = 'pending' AND lower(p.name) = lower(d.name))
  THEN 'skipped_existing' WHEN confidence_score >= 70 THEN 'auto_approved' ELSE 'pending_added' END AS decision FROM d)
"""


def decided(t):
    return transitions.discovery_decisions(t("company_records"), t("companies"), t("pending_companies"), F.col("seq") % 3 != 0)


@query("j12_discovery_decisions", "WITH " + DECIDED + " SELECT seq, name, confidence_score, decision FROM e")
def _(t):
    return decided(t).select("seq", "name", "confidence_score", "decision")


@query("d19_discovery_run", "WITH " + DECIDED + " SELECT decision, count(*) AS records FROM e GROUP BY 1")
def _(t):
    return aggregates.discovery_decisions(decided(t))


@query("j13_company_refresh", """
WITH all_records AS (SELECT name, career_page_url, source, priority, has_crawl_results, industry, seq, 0 AS source_no FROM {company_records}
 UNION ALL SELECT name, career_page_url, discovery_source, CAST(floor(confidence_score) AS INT), false, NULL, id + 1000000, 1 FROM {pending_companies}),
capped AS (SELECT * FROM all_records WHERE has_crawl_results OR priority >= 40 OR regexp_matches(lower(coalesce(industry, '')), 'software|technology|ai')
 ORDER BY has_crawl_results DESC, priority DESC, lower(name) DESC, seq LIMIT 150)
SELECT name AS "Company Name", career_page_url AS "Career Page URL", source AS "Source", priority AS "Priority", '' AS "Notes" FROM capped""")
def _(t):
    from vacantia.operators.filters import rule_heuristic
    from vacantia.sources.companies import csv_rows, refresh_records

    shared = ("name", "career_page_url", "source", "priority", "has_crawl_results", "industry", "seq")
    pending = t("pending_companies").select(
        "name", "career_page_url", F.col("discovery_source").alias("source"), F.floor("confidence_score").cast("int").alias("priority"),
        F.lit(False).alias("has_crawl_results"), (F.col("id") + 1000000).alias("seq"),
    )
    kept = refresh_records([t("company_records").select(*shared), pending], rule_heuristic, cap=150)
    return csv_rows(kept, F.lit(None).cast("string"))


@query("j14_loaded_companies", "WITH " + PARSED + """
SELECT name, url AS career_page_url, true AS is_active, 'companies_csv' AS discovery_source FROM p WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM {companies} c WHERE c.name = p.name)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) = 1""")
def _(t):
    out = transitions.loaded_companies(raw_companies(t), t("companies"), "seq", min_companies=10_000_000)
    return out.select("name", "career_page_url", "is_active", "discovery_source")


@query("j14_refused_load", "WITH " + PARSED + """,
fresh AS (SELECT DISTINCT p.name FROM p WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM {companies} c WHERE c.name = p.name))
SELECT 'enough' AS load, name FROM fresh WHERE (SELECT count(*) FILTER (is_active) FROM {companies}) < 2
UNION ALL SELECT 'forced', name FROM fresh""")
def _(t):
    parsed, companies = raw_companies(t), t("companies")
    refused = transitions.loaded_companies(parsed, companies, "seq", min_companies=2)
    forced = transitions.loaded_companies(parsed, companies, "seq", min_companies=2, force=True)
    return refused.select(F.lit("enough").alias("load"), "name").unionByName(forced.select(F.lit("forced").alias("load"), "name"))


@query("j15_retirable_companies", """
SELECT id, name FROM {companies} WHERE is_active AND (consecutive_empty_crawls >= 3 OR coalesce(viability_score < 30, false))""")
def _(t):
    return transitions.retirable(t("companies")).select("id", "name")


@query("j16_reviewed_documents", """
WITH v AS (SELECT * FROM {document_reviews} WHERE action <> 'glanced'),
s AS (SELECT document_id, arg_max(action, (ts, review_id)) AS action, max(ts) AS ts FROM v GROUP BY 1),
e AS (SELECT document_id, arg_max(edited_content, (ts, review_id)) AS x FROM v WHERE action = 'edited' GROUP BY 1),
n AS (SELECT document_id, arg_max(notes, (ts, review_id)) AS x FROM v WHERE coalesce(notes, '') <> '' GROUP BY 1)
SELECT d.id, coalesce(s.action, d.review_status) AS review_status, coalesce(s.ts, d.reviewed_at) AS reviewed_at,
 coalesce(e.x, d.edited_content) AS edited_content, coalesce(n.x, d.review_notes) AS review_notes FROM {generated_documents} d
LEFT JOIN s ON s.document_id = d.id LEFT JOIN e ON e.document_id = d.id LEFT JOIN n ON n.document_id = d.id""")
def _(t):
    out = transitions.reviewed_documents(t("generated_documents"), t("document_reviews"))
    return out.select("id", "review_status", "reviewed_at", "edited_content", "review_notes")


@query("j17_read_marks", """
SELECT id, is_new AND NOT EXISTS (SELECT 1 FROM {job_activities} a WHERE a.job_id = j.id AND a.activity_type = 'view') AS is_new FROM {jobs} j""")
def _(t):
    views = t("job_activities").filter("activity_type = 'view'")
    return transitions.read_marks(t("jobs"), views).select("id", "is_new")


@query("j18_patched_searches", """
SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE keywords END AS keywords, CASE WHEN id % 4 < 2 THEN concat('new ', id) ELSE name END AS name, remote_only FROM {search_criteria}""")
def _(t):
    i = F.col("id")
    fields = F.when(i % 4 == 0, F.array(F.lit("keywords"), F.lit("name"))).otherwise(F.array(F.lit("name")))
    patches = t("search_criteria").filter("id % 4 < 2").select(
        "id", fields.alias("set_fields"), F.lit(None).cast("string").alias("keywords"), F.concat(F.lit("new "), i.cast("string")).alias("name"),
        F.lit(True).alias("remote_only"),
    )
    return transitions.patched(t("search_criteria"), patches, ["keywords", "name", "remote_only"]).select("id", "keywords", "name", "remote_only")


@query("j18_patched_profiles", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'sql' ELSE c_mktsegment END AS skills, c_name AS base_resume FROM {customer}""")
def _(t):
    state = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("skills"), F.col("c_name").alias("base_resume"))
    patches = state.filter("id % 2 = 0").select("id", F.lit("sql").alias("skills"), F.lit(None).cast("string").alias("base_resume"))
    return transitions.patched_profile(state, patches, ["skills", "base_resume"])


@query("g29_migrated_stages", """
SELECT j.id, CASE WHEN coalesce(pipeline_stage, '') <> '' THEN pipeline_stage WHEN EXISTS (SELECT 1 FROM {applications} a WHERE a.job_id = j.id) THEN 'apply'
 WHEN EXISTS (SELECT 1 FROM {tasks} t WHERE t.job_id = j.id AND task_type = 'apply') THEN 'prepare' WHEN EXISTS (SELECT 1 FROM {tasks} t WHERE t.job_id = j.id) THEN 'review'
 WHEN EXISTS (SELECT 1 FROM {follow_ups} f WHERE f.job_id = j.id) THEN 'follow_up'
 ELSE CASE status WHEN 'new' THEN 'discover' WHEN 'viewed' THEN 'review' WHEN 'applied' THEN 'apply' WHEN 'rejected' THEN 'archive' WHEN 'saved' THEN 'review' WHEN 'archived' THEN 'archive' ELSE 'discover' END END AS pipeline_stage
FROM {jobs} j""")
def _(t):
    return transitions.migrated_stages(t("jobs"), t("applications"), t("tasks"), t("follow_ups")).select("id", "pipeline_stage")
