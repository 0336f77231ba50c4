"""Fixed schemas (as DDL) of the domain tables and of the posting in flight."""

from __future__ import annotations

POSTING = (
    "external_id string, title string, company string, location string, url string, source_url string, "
    "description string, job_type string, posted_date timestamp, platform string, departments array<string>, team string"
)
COMPANY_CSV = ("`Company Name` string, `Career Page URL` string, `Source` string, `Priority` string, `Notes` string")
COMPANY_RECORD = (
    "name string, career_page_url string, source string, priority int, has_crawl_results boolean, metadata map<string,string>"
)
COMPANIES = (
    "id bigint, name string, career_page_url string, is_active boolean, crawler_type string, "
    "crawler_config struct<slug:string,source:string,last_seen_ids:array<string>>, last_crawled_at timestamp, "
    "jobs_found_total bigint, consecutive_empty_crawls int, viability_score double, viability_last_checked timestamp, "
    "discovery_source string, last_successful_crawl timestamp, priority_score double, created_at timestamp, updated_at timestamp"
)
PENDING_COMPANIES = (
    "id bigint, name string, career_page_url string, discovery_source string, confidence_score double, crawler_type string, "
    "crawler_config struct<slug:string,source:string>, discovery_metadata map<string,string>, status string, "
    "created_at timestamp, reviewed_at timestamp"
)
SEARCH_CRITERIA = (
    "id bigint, name string, keywords string, location string, remote_only boolean, job_type string, experience_level string, "
    "salary_min int, salary_max int, target_companies array<bigint>, is_active boolean, notify_on_new boolean, created_at timestamp"
)
JOBS = (
    "id bigint, search_criteria_id bigint, company_id bigint, platform string, external_id string, title string, company string, "
    "location string, job_type string, url string, source_url string, description string, posted_date timestamp, "
    "ai_match_score double, ai_summary string, ai_pros array<string>, ai_cons array<string>, ai_keywords_matched array<string>, "
    "ai_rank int, ai_recommended boolean, ai_selected_date timestamp, ai_content map<string,string>, status string, is_new boolean, "
    "archived_at timestamp, pipeline_stage string, notes string, discovered_at timestamp, updated_at timestamp"
)
FOLLOW_UPS = ("id bigint, job_id bigint, follow_up_date timestamp, action_type string, notes string, completed boolean")
CRAWL_LOGS = (
    "id bigint, search_criteria_id bigint, company_id bigint, platform string, started_at timestamp, completed_at timestamp, "
    "status string, jobs_found int, new_jobs int, error_message string"
)
USER_PROFILES = (
    "id bigint, skills array<string>, experience array<struct<title:string,company:string,location:string,start_date:string,"
    "end_date:string,description:string>>, education array<struct<degree:string,institution:string,year:string>>, "
    "preferences map<string,string>, base_resume string"
)
USER_DOCUMENTS = ("id bigint, filename string, content_type string, content string, raw_file binary, metadata map<string,string>, created_at timestamp")
GENERATED_DOCUMENTS = (
    "id bigint, job_id bigint, document_type string, content string, generated_at timestamp, review_status string, review_notes string, "
    "edited_content string, reviewed_at timestamp, version int, parent_version_id bigint, is_current boolean"
)
CRAWL_FALLBACKS = ("company_id bigint, method_used string, success_count bigint, last_success_at timestamp")
TASKS = (
    "id bigint, job_id bigint, task_type string, priority string, status string, due_date timestamp, snooze_until timestamp, "
    "snooze_count int, title string, notes string, recommended_by string, completed_at timestamp"
)
APPLICATIONS = (
    "id bigint, job_id bigint, status string, application_date timestamp, resume_version_id bigint, cover_letter_id bigint, created_at timestamp"
)
JOB_FEEDBACK = ("id bigint, job_id bigint, feedback_type string, feedback_value string, ai_match_score_actual double, created_at timestamp")
JOB_ACTIVITIES = (
    "id bigint, job_id bigint, activity_type string, activity_description string, activity_metadata map<string,string>, "
    "created_at timestamp, created_by string"
)

TABLES = {
    "companies": COMPANIES,
    "pending_companies": PENDING_COMPANIES,
    "search_criteria": SEARCH_CRITERIA,
    "jobs": JOBS,
    "follow_ups": FOLLOW_UPS,
    "crawl_logs": CRAWL_LOGS,
    "user_profiles": USER_PROFILES,
    "user_documents": USER_DOCUMENTS,
    "generated_documents": GENERATED_DOCUMENTS,
    "crawl_fallbacks": CRAWL_FALLBACKS,
    "tasks": TASKS,
    "applications": APPLICATIONS,
    "job_feedback": JOB_FEEDBACK,
    "job_activities": JOB_ACTIVITIES,
}
