"""State changes as new state: ``state x changes -> state`` frames.

Nothing is updated in place. A caller writes the result as a new version of the
table (``sources.tables.write_version``) and points readers at it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, scores, urls
from vacantia.operators import dedupe, filters, joins, ranking
from vacantia.operators.scale import keep_first, ordinals
from vacantia.session import settled

AUTO_APPROVE = 70.0
REFRESHED = ("description", "posted_date", "url", "source_url")


def new_postings(incoming: DataFrame, key: str = "seq") -> DataFrame:
    """Valid postings, the first per (external id, company) of the batch."""
    return dedupe.dedupe_by_id(filters.valid_postings(incoming), key, ("external_id", "company_id"))


def _decided(stored: DataFrame, incoming: DataFrame, as_of: str, seen: DataFrame | None, key: str, keys: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """New rows of a batch, and the one refresh per stored posting."""
    batch = new_postings(incoming, key)
    if seen is not None:
        batch = filters.unseen_postings(batch, seen)
    batch = settled(batch, "batch")
    # the texts of a batch are written once; only the keys of the hits are kept beside them
    decided = batch.join(settled(dedupe.find_duplicates(batch, stored, as_of, key, settle=False, keys=keys), "hits"), key)
    known = stored.select(F.col("id").alias("match_id"), F.col("discovered_at").alias("_found_at"))
    later = decided.filter(F.col("match_id").isNotNull()).join(known, "match_id").filter(F.col("posted_date") > F.col("_found_at"))
    last = keep_first(later, ["match_id"], [F.col(key).desc()]).select(
        F.col("match_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in REFRESHED], F.lit(True).alias("_hit")
    )
    fresh = decided.filter(F.col("match_id").isNull()).select(
        F.lit(None).cast("bigint").alias("id"), "company_id", "external_id", "title", "url",
        F.coalesce("source_url", "url").alias("source_url"), "description", "posted_date",
        dates.ts(as_of).alias("discovered_at"), F.lit("new").alias("status"), F.lit("new").alias("change"),
    )
    return fresh, last


def _refresh(stored: DataFrame, last: DataFrame, how: str) -> DataFrame:
    old = stored.join(last, "id", how)
    for c in REFRESHED:
        old = old.withColumn(c, F.when(F.col("_hit"), F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)))
    change = F.when(F.col("_hit"), "refreshed").otherwise("kept")
    return old.withColumn("change", change).drop("_hit", *[f"_{c}" for c in REFRESHED])


def ingest(
    stored: DataFrame, incoming: DataFrame, as_of: str, seen: DataFrame | None = None, key: str = "seq", keys: DataFrame | None = None
) -> DataFrame:
    """Stored postings after a batch, with ``change`` = kept, refreshed or new.

    A duplicate refreshes the stored posting when it was posted after that one
    was discovered; of several the last in the batch wins. A NULL in the batch
    counts as absent. New rows have no id yet (see :func:`with_ids`). ``keys``: the
    stored rows' duplicate keys, where a table of them is kept.
    """
    fresh, last = _decided(stored, incoming, as_of, seen, key, keys)
    # read once and not at all by who wants the new postings alone, so it is not written
    return _refresh(stored, last, "left").unionByName(fresh, allowMissingColumns=True)


def ingest_changes(
    stored: DataFrame, incoming: DataFrame, as_of: str, seen: DataFrame | None = None, key: str = "seq", keys: DataFrame | None = None
) -> DataFrame:
    """Only the refreshed and new rows of :func:`ingest`."""
    fresh, last = _decided(stored, incoming, as_of, seen, key, keys)
    return _refresh(stored, settled(last, "refreshes"), "inner").unionByName(fresh, allowMissingColumns=True)


def simple_ingest(stored: DataFrame, incoming: DataFrame, key: str = "seq") -> DataFrame:
    """New postings by external id alone, the first of each id."""
    fresh = incoming.join(stored.select("external_id"), "external_id", "left_anti")
    return dedupe.dedupe_by_id(fresh, key)


def with_ids(rows: DataFrame, start: int, order: Sequence[Column]) -> DataFrame:
    """Give rows without id the next numbers after ``start`` in the given order."""
    blank = rows.filter(F.col("id").isNull()).withColumn("_all", F.lit(0))
    numbered = ordinals(blank, ["_all"], list(order), name="_n")
    numbered = numbered.withColumn("id", F.lit(start) + F.col("_n")).drop("_n", "_all")
    return rows.filter(F.col("id").isNotNull()).unionByName(numbered)


def update_company_stats(companies: DataFrame, logs: DataFrame, jobs: DataFrame, as_of: str, order: list[str], seen_cap: int) -> DataFrame:
    """Companies after a batch of crawls: streak, totals, times and the newest ``seen_cap`` ids."""
    streaks = ranking.empty_crawl_streaks(logs, as_of, order).select(
        F.col("company_id").alias("id"), F.col("last_crawled_at").alias("_crawled"), F.col("last_successful_crawl").alias("_good"),
        F.col("jobs_found_total").alias("_found"), F.col("consecutive_empty_crawls").alias("_empty"),
    )
    ids = ranking.last_seen_ids(jobs, seen_cap).withColumnRenamed("company_id", "id")
    out = companies.drop("last_seen_ids").join(streaks, "id", "left").join(ids, "id", "left")
    base = F.when(F.col("_good").isNull(), F.col("consecutive_empty_crawls")).otherwise(0)
    for name, value in (("last_crawled_at", "_crawled"), ("last_successful_crawl", "_good")):
        out = out.withColumn(name, F.coalesce(value, name) if name in companies.columns else F.col(value))
    return (
        out.withColumn("consecutive_empty_crawls", (base + F.coalesce("_empty", F.lit(0))).cast("int"))
        .withColumn("jobs_found_total", (F.col("jobs_found_total") + F.coalesce("_found", F.lit(0))).cast("bigint"))
        .drop("_crawled", "_good", "_found", "_empty")
    )


def archive_jobs(jobs: DataFrame, as_of: str, days_old: int = 90) -> DataFrame:
    """Old postings become archived; the dry run is ``filters.archivable().count()``."""
    now = dates.ts(as_of)
    cutoff = dates.plus(now, -days_old, "day")
    due = (
        (F.col("discovered_at") < cutoff)
        & F.col("archived_at").isNull()
        & ~F.col("status").isin(*filters.ACTIVE_APPLICATION)
    )
    marked = jobs.withColumn("_due", F.coalesce(due, F.lit(False)))
    return (
        marked.withColumn("archived_at", F.when(F.col("_due"), now).otherwise(F.col("archived_at")))
        .withColumn("status", F.when(F.col("_due"), "archived").otherwise(F.col("status")))
        .drop("_due")
    )


def unarchive_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed archived postings come back; an archived status becomes new."""
    listed = jobs.join(ids.select("id").distinct().withColumn("_back", F.lit(True)), "id", "left")
    back = F.coalesce("_back", F.lit(False)) & F.col("archived_at").isNotNull()
    return (
        listed.withColumn("status", F.when(back & (F.col("status") == "archived"), "new").otherwise(F.col("status")))
        .withColumn("archived_at", F.when(back, F.lit(None)).otherwise(F.col("archived_at")))
        .drop("_back")
    )


def checked_merges(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, keep_id, job_id`` rows with ``error`` (NULL = may be merged)."""
    found = requests.join(jobs.select(F.col("id").alias("job_id"), F.lit(1).alias("_there")), "job_id", "left")
    totals = found.groupBy("request_id").agg(
        F.max(F.col("job_id") == F.col("keep_id")).alias("_has_keep"), F.count_if(F.col("_there").isNull()).alias("_missing")
    )
    error = F.when(~F.col("_has_keep"), "keep id is not in the list").when(F.col("_missing") > 0, "not all ids were found")
    return found.drop("_there").join(totals, "request_id").withColumn("error", error).drop("_has_keep", "_missing")


def merge_duplicates(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Postings without the merged-away ones."""
    gone = checked_merges(jobs, requests).filter(F.col("error").isNull() & (F.col("job_id") != F.col("keep_id")))
    return jobs.join(gone.select(F.col("job_id").alias("id")), "id", "left_anti")


def repoint_children(children: DataFrame, jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Children of merged-away postings move to the kept one."""
    gone = checked_merges(jobs, requests).filter(F.col("error").isNull() & (F.col("job_id") != F.col("keep_id")))
    target = gone.groupBy("job_id").agg(F.min("keep_id").alias("_keep"))
    return children.join(target, "job_id", "left").withColumn("job_id", F.coalesce("_keep", "job_id")).drop("_keep")


def fail_stuck_logs(logs: DataFrame, as_of: str, threshold_minutes: int = 60) -> DataFrame:
    """Running logs older than the threshold become failed with a message."""
    now = dates.ts(as_of)
    stuck = (F.col("status") == "running") & (F.col("started_at") < dates.plus(now, -threshold_minutes, "minute"))
    minutes = F.format_string("%.1f", F.bround(dates.seconds_between(F.col("started_at"), now) / 60, 1))
    message = F.concat(
        F.lit("Automatically marked as failed - stuck in 'running' status for "), minutes,
        F.lit(f" minutes (threshold: {threshold_minutes} minutes)"),
    )
    before = F.col("error_message") if "error_message" in logs.columns else F.lit(None).cast("string")
    marked = logs.withColumn("_stuck", F.coalesce(stuck, F.lit(False)))
    return (
        marked.withColumn("error_message", F.when(F.col("_stuck"), message).otherwise(before))
        .withColumn("completed_at", F.when(F.col("_stuck"), now).otherwise(F.col("completed_at")))
        .withColumn("status", F.when(F.col("_stuck"), "failed").otherwise(F.col("status")))
        .drop("_stuck")
    )


def cancel_running_logs(logs: DataFrame, as_of: str) -> DataFrame:
    running = F.col("status") == "running"
    before = F.col("error_message") if "error_message" in logs.columns else F.lit(None).cast("string")
    note = F.concat(F.coalesce(before, F.lit("")), F.lit("\nCancelled by user"))
    return (
        logs.withColumn("error_message", F.when(running, note).otherwise(before))
        .withColumn("completed_at", F.when(running, dates.ts(as_of)).otherwise(F.col("completed_at")))
        .withColumn("status", F.when(running, "failed").otherwise(F.col("status")))
    )


def _task(kind: str, title: Column, priority: Column, by: str, notes: Column, application_date: Column, as_of: str) -> Column:
    due = dates.due_date(
        F.lit(kind), F.col("ai_match_score"), F.col("discovered_at"), F.col("posted_date"), application_date, dates.ts(as_of)
    )
    return F.struct(
        F.lit(kind).alias("task_type"), title.alias("title"), due.alias("due_date"), priority.alias("priority"),
        F.lit("pending").alias("status"), F.lit(by).alias("recommended_by"), notes.alias("notes"),
    )


def _follow_up_task(as_of: str, application_date: Column) -> Column:
    title = F.concat(F.lit("Follow up on application to "), "title", F.lit(" at "), "company")
    note = F.lit("Automatically created after application")
    return _task("follow_up", title, F.lit("high"), "system", note, application_date, as_of)


def generated_tasks(jobs: DataFrame, tasks: DataFrame, as_of: str, threshold: float = joins.TASK_SCORE) -> DataFrame:
    """Tasks for scored postings that have no pending task."""
    waiting = tasks.filter(F.col("status") == "pending").select(F.col("job_id").alias("id"))
    score = F.coalesce("ai_match_score", F.lit(0.0))
    free = jobs.filter((score >= threshold) & F.col("status").isin("new", "applied")).join(waiting, "id", "left_anti")
    none = F.lit(None).cast("string")
    no_date = F.lit(None).cast("timestamp")
    priority = scores.priority_from_score(score)
    apply_title = F.concat(F.lit("Apply to "), "title", F.lit(" at "), "company")
    research_title = F.concat(F.lit("Research "), "company", F.lit(" for "), "title", F.lit(" position"))
    apply = _task("apply", apply_title, priority, "AI", none, no_date, as_of)
    research = _task("research", research_title, priority, "AI", none, no_date, as_of)
    is_new = F.col("status") == "new"
    made = F.array(
        F.when(is_new & (score >= 50), apply),
        F.when(is_new & (score < 75), research),
        F.when(F.col("status") == "applied", _follow_up_task(as_of, F.col("updated_at"))),
    )
    rows = free.select(F.col("id").alias("job_id"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("t"))
    return rows.select("job_id", "t.*")


def submitted_jobs(jobs: DataFrame, applications: DataFrame, submissions: DataFrame, as_of: str) -> DataFrame:
    """Postings after applications were submitted: their status becomes applied.

    ``submissions``: ``application_id``. Applications already submitted change nothing.
    """
    sent = _just_submitted(applications, submissions)
    marked = jobs.join(sent.withColumn("_sent", F.lit(True)), jobs["id"] == sent["_job"], "left").drop("_job")
    change = F.coalesce("_sent", F.lit(False)) & ~F.col("status").eqNullSafe("applied")
    return (
        marked.withColumn("updated_at", F.when(change, dates.ts(as_of)).otherwise(F.col("updated_at")))
        .withColumn("status", F.when(change, "applied").otherwise(F.col("status")))
        .drop("_sent")
    )


def _just_submitted(applications: DataFrame, submissions: DataFrame) -> DataFrame:
    wanted = submissions.select(F.col("application_id").alias("id"))
    sent = applications.filter(~F.col("status").eqNullSafe("submitted")).join(wanted, "id", "left_semi")
    return sent.select(F.col("job_id").alias("_job")).distinct()


def submission_tasks(jobs: DataFrame, applications: DataFrame, submissions: DataFrame, tasks: DataFrame, as_of: str) -> DataFrame:
    """One follow-up task per submitted posting without a pending one."""
    after = submitted_jobs(jobs, applications, submissions, as_of)
    sent = _just_submitted(applications, submissions).select(F.col("_job").alias("id"))
    waiting = tasks.filter((F.col("task_type") == "follow_up") & (F.col("status") == "pending")).select(F.col("job_id").alias("id"))
    due = after.join(sent, "id", "left_semi").join(waiting, "id", "left_anti")
    task = _follow_up_task(as_of, F.col("updated_at"))
    return due.select(F.col("id").alias("job_id"), task.alias("t")).select("job_id", "t.*")


def queued_applications(jobs: DataFrame, applications: DataFrame, requests: DataFrame) -> DataFrame:
    """New queued applications for requested postings that have none."""
    wanted = requests.select("job_id").distinct().join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return wanted.join(applications.select("job_id"), "job_id", "left_anti").withColumn("status", F.lit("queued"))


def stage_changes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Postings moved to the stage of their last valid change."""
    valid = changes.filter(F.col("stage").isin(*scores.STAGES))
    last = valid.groupBy(F.col("job_id").alias("id")).agg(F.max(F.struct("ts", "change_id", "stage")).alias("_last"))
    out = jobs.join(last, "id", "left")
    return (
        out.withColumn("pipeline_stage", F.coalesce("_last.stage", "pipeline_stage"))
        .withColumn("updated_at", F.coalesce("_last.ts", "updated_at"))
        .drop("_last")
    )


def stage_activities(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """One activity row per valid change, with the stage before it.

    The stage before is the neighbour in the numbered changes of the posting,
    found by an equi-join on (posting, number) instead of a window.
    """
    valid = changes.filter(F.col("stage").isin(*scores.STAGES)).select("change_id", "job_id", "ts", "stage")
    there = valid.join(jobs.select(F.col("id").alias("job_id"), F.col("pipeline_stage").alias("_start")), "job_id")
    placed = ordinals(there, ["job_id"], [F.col("ts"), F.col("change_id")], name="_n")
    before = placed.select("job_id", (F.col("_n") + 1).alias("_n"), F.col("stage").alias("_before"))
    out = placed.join(before, ["job_id", "_n"], "left")
    old = F.when(F.col("_n") == 1, F.col("_start")).otherwise(F.col("_before"))
    said = F.concat(F.lit("Job moved from "), F.coalesce(old, F.lit("None")), F.lit(" to "), F.col("stage"))
    return out.select(
        "job_id", F.lit("pipeline_stage_changed").alias("activity_type"), said.alias("activity_description"),
        old.alias("old_stage"), F.col("stage").alias("new_stage"), F.col("ts").alias("created_at"), F.lit("user").alias("created_by"),
    )


def migrated_stages(jobs: DataFrame, applications: DataFrame, tasks: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """Fill empty stages from the records of a posting, else from its status."""
    apps = applications.groupBy("job_id").agg(F.lit(True).alias("_app"))
    work = tasks.groupBy("job_id").agg(F.lit(True).alias("_task"), F.max(F.col("task_type") == "apply").alias("_apply"))
    later = follow_ups.groupBy("job_id").agg(F.lit(True).alias("_later"))
    out = jobs
    for frame in (apps, work, later):
        out = out.join(frame.withColumnRenamed("job_id", "id"), "id", "left")
    flags = [F.coalesce(c, F.lit(False)) for c in ("_app", "_task", "_apply", "_later")]
    stage = scores.stage_from_status(F.col("status"), *flags)
    empty = F.coalesce("pipeline_stage", F.lit("")) == ""
    return out.withColumn("pipeline_stage", F.when(empty, stage).otherwise(F.col("pipeline_stage"))).drop("_app", "_task", "_apply", "_later")


def _stored(rows: DataFrame, name: str, kind: str) -> Column:
    """The column a row has already, NULL where the table has none."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def reviewed_pending(pending: DataFrame, decisions: DataFrame, as_of: str) -> DataFrame:
    """Pending companies after review. ``decisions``: ``id, decision`` (approve/reject).

    Of several decisions for one id approval counts. Rows without a decision keep
    what they have.
    """
    verdict = decisions.filter(F.col("decision").isin("approve", "reject")).groupBy("id").agg(F.min("decision").alias("_d"))
    out = pending.join(verdict, "id", "left")
    waiting = (F.col("status") == "pending") & F.col("_d").isin("approve", "reject")
    hit = F.coalesce(waiting, F.lit(False))
    return (
        out.withColumn("reviewed_at", F.when(hit, dates.ts(as_of)).otherwise(_stored(pending, "reviewed_at", "timestamp")))
        .withColumn("status", F.when(hit & (F.col("_d") == "approve"), "approved").when(hit, "rejected").otherwise(F.col("status")))
        .drop("_d")
    )


def approved_companies(pending: DataFrame, decisions: DataFrame, companies: DataFrame) -> DataFrame:
    """New companies of approved rows whose exact name is not taken yet."""
    yes = decisions.filter(F.col("decision") == "approve").select("id")
    rows = pending.filter(F.col("status") == "pending").join(yes, "id", "left_semi")
    fresh = rows.join(companies.select("name"), "name", "left_anti")
    return keep_first(fresh, ["name"], [F.col("id")]).select(
        "name", "career_page_url", F.lit(True).alias("is_active"), "discovery_source",
        (F.col("confidence_score") / 100.0).alias("priority_score"),
    )


def discovery_decisions(
    records: DataFrame, companies: DataFrame, pending: DataFrame, approved: Column,
    heuristic: Callable[[DataFrame], Column] = filters.rule_heuristic, order: str = "seq",
) -> DataFrame:
    """Verified records with ``decision``: auto_approved, pending_added or skipped_existing.

    ``approved`` is the opinion that enters the confidence score. Of several
    records with one lower-case name the first counts, the others are skipped.
    """
    verified = filters.verified_records(records, heuristic).withColumn("_name", F.lower("name"))
    known = joins.known_names(companies, pending).withColumnRenamed("known_name", "_name").withColumn("_known", F.lit(True))
    first = verified.groupBy("_name").agg(F.min(order).alias("_first"))
    out = verified.join(known, "_name", "left").join(first, "_name")
    kind = urls.detect_crawler_type(F.col("career_page_url"))
    out = out.withColumn("crawler_type", kind).withColumn(
        "crawler_config", urls.crawler_config(F.col("name"), F.col("career_page_url"), F.col("crawler_type"))
    )
    score = scores.confidence_score(approved, F.col("source"), F.col("priority"), F.col("career_page_url"))
    out = out.withColumn("confidence_score", score)
    skipped = F.col("_known").isNotNull() | (F.col(order) != F.col("_first"))
    decision = F.when(skipped, "skipped_existing").when(F.col("confidence_score") >= AUTO_APPROVE, "auto_approved").otherwise("pending_added")
    return out.withColumn("decision", decision).drop("_name", "_known", "_first")


def loaded_companies(parsed: DataFrame, companies: DataFrame, order: str, min_companies: int = 10, force: bool = False) -> DataFrame:
    """Accepted list rows to insert: exact names not present, none when enough are active."""
    accepted = parsed.filter(F.col("reason").isNull())
    fresh = keep_first(accepted.join(companies.select("name"), "name", "left_anti"), ["name"], [F.col(order)])
    if not force:
        active = companies.agg(F.count_if("is_active").alias("n")).scalar()
        fresh = fresh.filter(active < min_companies)
    return fresh.select(
        "name", "career_page_url", "crawler_type", "crawler_config", F.lit(True).alias("is_active"), F.lit("companies_csv").alias("discovery_source")
    )


def retirable(companies: DataFrame, empty_crawls: int = 3, viability: float = 30.0) -> DataFrame:
    worn = (F.col("consecutive_empty_crawls") >= empty_crawls) | F.coalesce(F.col("viability_score") < viability, F.lit(False))
    return companies.filter(F.col("is_active") & worn)


def reviewed_documents(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Documents after review. ``reviews``: ``review_id, document_id, action, edited_content, notes, ts``.

    The last review sets the status; edits, notes and dates stay until a later
    review brings new ones.
    """
    valid = reviews.filter(F.col("action").isin("approved", "rejected", "edited"))
    at = lambda value, when: F.max(F.when(when, F.struct("ts", "review_id", F.col(value).alias("v"))))
    last = valid.groupBy(F.col("document_id").alias("id")).agg(
        F.max(F.struct("ts", "review_id", F.col("action").alias("v"))).alias("_status"),
        at("edited_content", F.col("action") == "edited").alias("_edit"),
        at("notes", F.coalesce("notes", F.lit("")) != "").alias("_notes"),
    )
    out = documents.join(last, "id", "left")
    return (
        out.withColumn("review_status", F.coalesce("_status.v", "review_status"))
        .withColumn("reviewed_at", F.coalesce("_status.ts", _stored(documents, "reviewed_at", "timestamp")))
        .withColumn("edited_content", F.coalesce("_edit.v", _stored(documents, "edited_content", "string")))
        .withColumn("review_notes", F.coalesce("_notes.v", _stored(documents, "review_notes", "string")))
        .drop("_status", "_edit", "_notes")
    )


def read_marks(jobs: DataFrame, views: DataFrame) -> DataFrame:
    seen = views.select(F.col("job_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
    return jobs.join(seen, "id", "left").withColumn("is_new", F.col("is_new") & F.col("_seen").isNull()).drop("_seen")


def patched(state: DataFrame, patches: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Set only the columns named in ``set_fields``; an explicit NULL is set too.

    ``patches`` has one row per key: ``key, set_fields array<string>`` and values.
    """
    new = patches.select(key, "set_fields", *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = state.join(new, key, "left")
    for c in columns:
        given = F.coalesce(F.array_contains("set_fields", c), F.lit(False))
        out = out.withColumn(c, F.when(given, F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.drop("set_fields", *[f"_new_{c}" for c in columns])


def patched_profile(state: DataFrame, patches: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Profile patch: NULLs in the patch are ignored."""
    new = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = state.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    return out.drop(*[f"_new_{c}" for c in columns])
