"""Lists and predicates over the domain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, scores, text, urls
from vacantia.operators.scale import parts_of, top_rows
from vacantia.sources.text_index import TextIndex

# Statuses with their own rule.
ACTIVE_APPLICATION = ("applied", "interviewing", "accepted")
OPEN_TASK = ("pending", "in_progress")


def desc(name: str) -> Column:
    """Descending with NULLs first, as the relational store orders."""
    return F.col(name).desc_nulls_first()


def job_list(
    jobs: DataFrame,
    status: str | None = None,
    search_id: int | None = None,
    new_only: bool = False,
    match: str | None = None,
    ready_to_apply: bool | None = None,
    sort: str = "discovered_at",
    limit: int = 100,
) -> DataFrame:
    score = F.col("ai_match_score")
    bands = {"high": score >= 75, "medium": (score >= 50) & (score < 75), "low": score < 50}
    if status:
        jobs = jobs.filter(F.col("status") == status)
    if search_id:
        jobs = jobs.filter(F.col("search_criteria_id") == search_id)
    if new_only:
        jobs = jobs.filter("is_new")
    if match in bands:
        jobs = jobs.filter(bands[match])
    if ready_to_apply is not None:
        jobs = jobs.filter(score >= 70 if ready_to_apply else (score < 70) | score.isNull())
    key = sort if sort in ("ai_match_score", "posted_date") else "discovered_at"
    return top_rows(jobs, [desc(key), F.col("id")], limit)


def pipeline_list(jobs: DataFrame, stage: str | None = None, filter_type: str | None = None) -> DataFrame:
    """Postings of the pipeline with their board column, newest first."""
    if stage:
        jobs = jobs.filter(F.col("pipeline_stage") == stage)
    rules = {
        "high_match": F.col("ai_match_score") >= 75,
        "recently_found": F.col("is_new"),
        "needs_action": F.col("pipeline_stage").isin("prepare", "apply", "follow_up") | (F.col("status") == "applied"),
    }
    if filter_type in rules:
        jobs = jobs.filter(rules[filter_type])
    return jobs.withColumn("board_stage", scores.board_stage(F.col("pipeline_stage")))


def meets_criteria(
    title: Column,
    description: Column,
    location: Column,
    job_type: Column,
    keywords: Column,
    remote_only: Column,
    wanted_type: Column,
    split_on: str = text.PY_SPACE,
) -> Column:
    """Whether a posting meets a saved search; an empty keyword list accepts all."""
    tokens = text.keyword_tokens(keywords, split_on)
    body = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(description, F.lit(""))))
    wanted = F.lower(F.coalesce(wanted_type, F.lit("")))
    return (
        ((F.size(tokens) == 0) | text.has_any_keyword(body, tokens))
        & (~F.coalesce(remote_only, F.lit(False)) | text.is_remote_location(location))
        & ((wanted == "") | F.contains(F.lower(F.coalesce(job_type, F.lit(""))), wanted))
    )


def criteria_filter(
    jobs: DataFrame, keywords: str, remote_only: bool = False, job_type: str | None = None, split_on: str = text.PY_SPACE
) -> DataFrame:
    return jobs.filter(
        meets_criteria(
            F.col("title"), F.col("description"), F.col("location"), F.col("job_type"),
            F.lit(keywords), F.lit(remote_only), F.lit(job_type).cast("string"), split_on,
        )
    )


def text_search(jobs: DataFrame, phrase: str, limit: int | None = 10, index: TextIndex | None = None) -> DataFrame:
    """Newest matches in title, description or company; ``%`` and ``_`` are wildcards.

    ``index`` finds the postings and days to look at; the rows are the same. Where it
    knows texts by name, postings come and go with the names of their descriptions.
    """
    like = lambda text: text.ilike(f"%{phrase.lower()}%")
    columns, said = jobs.columns, like(F.col("description"))
    if index:
        jobs = index.narrowed(jobs, phrase, ["title", "description", "company"], wildcards="%_\\")
        jobs, said = index.told(jobs, like, phrase, wildcards="%_\\")
    found = jobs.filter(like(F.col("title")) | said | like(F.col("company"))).select(*columns)
    return top_rows(found, [desc("discovered_at"), F.col("id")], limit)


def screen_search(jobs: DataFrame, term: str, index: TextIndex | None = None) -> DataFrame:
    """Literal search in title, company and location, through an index where there is one."""
    if index:
        jobs = index.narrowed(jobs, term, ["title", "company", "location"])
    low = F.lit(term.lower())
    fields = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), low) for c in ("title", "company", "location")]
    return jobs.filter(fields[0] | fields[1] | fields[2])


def task_list(
    tasks: DataFrame,
    as_of: str,
    status: str | None = None,
    priority: str | None = None,
    task_type: str | None = None,
    job_id: int | None = None,
    due_before: str | None = None,
    due_after: str | None = None,
    include_snoozed: bool = True,
    limit: int = 100,
) -> DataFrame:
    for name, value in (("status", status), ("priority", priority), ("task_type", task_type), ("job_id", job_id)):
        if value:
            tasks = tasks.filter(F.col(name) == value)
    if due_before:
        tasks = tasks.filter(F.col("due_date") <= dates.ts(due_before))
    if due_after:
        tasks = tasks.filter(F.col("due_date") >= dates.ts(due_after))
    if not include_snoozed:
        tasks = tasks.filter((F.col("status") != "snoozed") | (F.col("snooze_until") <= dates.ts(as_of)))
    return top_rows(tasks, [F.col("due_date").asc_nulls_last(), F.col("id")], limit)


def tasks_due(tasks: DataFrame, as_of: str, within_hours: int = 1) -> DataFrame:
    by = dates.plus(dates.ts(as_of), within_hours, "hour")
    return tasks.filter((F.col("due_date") <= by) & F.col("status").isin(*OPEN_TASK))


def overdue_tasks(tasks: DataFrame, as_of: str) -> DataFrame:
    return tasks.filter((F.col("due_date") < dates.ts(as_of)) & (F.col("status") == "pending"))


def upcoming_follow_ups(follow_ups: DataFrame, as_of: str) -> DataFrame:
    return follow_ups.filter(~F.col("completed") & (F.col("follow_up_date") >= dates.ts(as_of)))


def application_list(applications: DataFrame, status: str | None = None, job_id: int | None = None, limit: int = 100) -> DataFrame:
    if status:
        applications = applications.filter(F.col("status") == status)
    if job_id:
        applications = applications.filter(F.col("job_id") == job_id)
    return top_rows(applications, [desc("created_at"), F.col("id")], limit)


#: A total order over crawl logs; further columns may be appended by callers.
LOG_TIES = ("company_id", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def crawl_log_list(
    logs: DataFrame,
    companies: DataFrame,
    as_of: str,
    crawler_class: str | None = None,
    status: str | None = None,
    limit: int = 100,
    hours: int = 24,
    ties: tuple[str, ...] = LOG_TIES,
) -> DataFrame:
    """Latest logs with company and class, of one class if it is given."""
    since = dates.plus(dates.ts(as_of), -hours, "hour")
    logs = dates.in_range(logs, "started_at", since=since, before=dates.ts(as_of))
    if status:
        logs = logs.filter(F.col("status") == status)
    named = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), "crawler_type")
    out = logs.join(named, "company_id", "left").withColumn(
        "crawler_class",
        F.when(F.col("company_name").isNotNull(), urls.crawler_class(F.col("crawler_type"))),
    )
    if crawler_class:
        out = out.filter(F.col("crawler_class") == crawler_class)
    latest = top_rows(out, [desc("started_at"), *[F.col(c) for c in ties]], limit)
    return latest.withColumn("duration_seconds", dates.seconds_between(F.col("started_at"), F.col("completed_at")))


def robots_disallowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages (``url``) with ``disallowed``: whether a rule ``host, prefix`` of their host begins their path.

    Rules meet distinct addresses by an equi-join on the host, so neither side is
    copied and a page asked for often is tested once.
    """
    asked = pages.select("url").distinct().withColumn("host", urls.url_host(F.col("url")))
    known = rules.filter(F.coalesce("prefix", F.lit("")) != "").distinct()
    hit = asked.join(known, "host").filter(F.startswith(urls.url_path(F.col("url")), F.col("prefix")))
    flagged = hit.select(F.col("url").alias("_url")).distinct()
    out = pages.join(flagged, pages["url"] == flagged["_url"], "left")
    return out.withColumn("disallowed", F.col("_url").isNotNull()).drop("_url")


def archivable(jobs: DataFrame, as_of: str, days_old: int = 90) -> DataFrame:
    """Old, not archived and not in an active application; a NULL status is kept out."""
    cutoff = dates.plus(dates.ts(as_of), -days_old, "day")
    return jobs.filter(
        (F.col("discovered_at") < cutoff) & F.col("archived_at").isNull() & ~F.col("status").isin(*ACTIVE_APPLICATION)
    )


def valid_postings(postings: DataFrame) -> DataFrame:
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("external_id", "title")]
    return postings.filter(filled[0] & filled[1])


#: Seen postings that one task compares.
PART_ROWS = 100_000


def unseen_postings(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop postings whose (company, external_id) was seen before.

    ``seen`` has one row per company and id: the exploded ``last_seen_ids``.
    """
    on = ["company_id", "external_id"]
    known = seen.select(*on)
    # dealt by their number, so that no task's rows grow with the table; equal ones meet after that
    parts = parts_of(known, PART_ROWS)
    return postings.repartition(parts, *on).join(known.repartition(parts, *on).distinct(), on, "left_anti")


def named_companies(cards: DataFrame, site: str, name: str = "name") -> DataFrame:
    clean = text.clean_company_name(F.col(name), site)
    return cards.withColumn("company_name", clean).filter(F.col("company_name").isNotNull())


def career_pages(records: DataFrame, url: str = "career_page_url") -> DataFrame:
    return records.filter(urls.is_career_url(F.col(url)))


def search_list(searches: DataFrame) -> DataFrame:
    return searches.orderBy(desc("created_at"), "id")


def company_list(companies: DataFrame, active_only: bool = False) -> DataFrame:
    if active_only:
        companies = companies.filter("is_active")
    return companies.orderBy("name", "id")


def pending_list(pending: DataFrame, limit: int = 100) -> DataFrame:
    waiting = pending.filter(F.col("status") == "pending")
    return top_rows(waiting, [desc("confidence_score"), F.col("id")], limit)


def document_list(documents: DataFrame) -> DataFrame:
    return documents.orderBy(desc("created_at"), "id")


def pending_reviews(documents: DataFrame, limit: int = 10) -> DataFrame:
    waiting = documents.filter(F.col("review_status") == "pending")
    return top_rows(waiting, [desc("generated_at"), F.col("id")], limit)


def rule_heuristic(records: DataFrame) -> Column:
    return scores.keep_by_rules(F.col("priority"), F.col("industry"), F.lit(False))


def verified_records(records: DataFrame, heuristic: Callable[[DataFrame], Column] = rule_heuristic) -> DataFrame:
    """Records with crawl results, or approved by the (replaceable) heuristic."""
    return records.filter(F.coalesce(F.col("has_crawl_results"), F.lit(False)) | heuristic(records))


def repaired_slugs(companies: DataFrame) -> DataFrame:
    """Fill missing slugs of companies on hosted boards."""
    boards = companies.filter(F.col("crawler_type").isin("greenhouse", "lever"))
    slug = F.coalesce(
        F.nullif(F.col("slug"), F.lit("")), urls.repaired_slug(F.col("name"), F.col("career_page_url"))
    )
    return boards.withColumn("repaired", F.coalesce(F.col("slug"), F.lit("")) == "").withColumn("slug", slug)
