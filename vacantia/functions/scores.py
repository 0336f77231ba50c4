"""Scores, priorities and health classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.text import keyword_tokens

# Stages, statuses and their mapping.
STAGES = ("discover", "review", "prepare", "apply", "follow_up", "archive")
STATUS_STAGE = (
    ("new", "discover"),
    ("viewed", "review"),
    ("applied", "apply"),
    ("rejected", "archive"),
    ("saved", "review"),
    ("archived", "archive"),
)


def priority_from_score(score: Column) -> Column:
    return F.when(score.isNull(), "medium").when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def percentage(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL when whole is 0."""
    return F.when(whole > 0, part / whole * 100)


def company_health(
    is_active: Column, empty_crawls: Column, success_rate: Column, viability: Column, total_crawls: Column
) -> Column:
    return (
        F.when(~is_active, "inactive")
        .when(empty_crawls >= 3, "critical")
        .when(empty_crawls >= 2, "warning")
        .when(success_rate < 50, "warning")
        .when(viability < 50, "warning")
        .when(total_crawls == 0, "unknown")
        .otherwise("healthy")
    )


def needs_attention(empty_crawls: Column, success_rate: Column, viability: Column) -> Column:
    return (
        (empty_crawls >= 2)
        | F.coalesce(success_rate < 70, F.lit(False))
        | F.coalesce(viability < 50, F.lit(False))
    )


def match_score(
    title: Column,
    description: Column,
    location: Column,
    keywords: Column,
    wanted_location: Column,
    remote_only: Column,
) -> Column:
    """50 + 30 x share of keywords found + 10 for location + 10 for remote, at most 100."""
    low_title = F.lower(F.coalesce(title, F.lit("")))
    low_text = F.lower(F.coalesce(description, F.lit("")))
    tokens = keyword_tokens(keywords)
    body = F.array(F.struct(low_title.alias("title"), low_text.alias("text")))
    found = F.transform(body, lambda b: F.filter(tokens, lambda k: F.contains(b["title"], k) | F.contains(b["text"], k)))
    hits = F.size(F.flatten(found))
    share = F.when(F.size(tokens) > 0, hits / F.size(tokens) * 30).otherwise(0.0)
    place = F.when(
        (F.coalesce(wanted_location, F.lit("")) != "")
        & F.contains(F.lower(F.coalesce(location, F.lit(""))), F.lower(wanted_location)),
        10.0,
    ).otherwise(0.0)
    remote = F.when(remote_only & (low_title.contains("remote") | low_text.contains("remote")), 10.0).otherwise(0.0)
    return F.least(F.lit(50.0) + share + place + remote, F.lit(100.0))


def confidence_score(approved: Column, source: Column, priority: Column, url: Column) -> Column:
    low = F.lower(url)
    total = (
        F.when(approved, 75.0).otherwise(45.0)
        + F.when(source == "linkedin", 5.0).when(source == "indeed", 3.0).when(source == "web_search", 2.0).otherwise(0.0)
        + F.when(priority >= 50, 5.0).when(priority >= 30, 2.0).otherwise(0.0)
        + F.when(low.contains("/careers") | low.contains("/jobs"), 3.0).otherwise(0.0)
    )
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def stage_from_status(status: Column, has_application: Column, has_task: Column, has_apply_task: Column, has_follow_up: Column) -> Column:
    """Stage of a posting that has none: its records first, then its status."""
    by_status = F.lit("discover")
    for value, stage in reversed(STATUS_STAGE):
        by_status = F.when(status == value, stage).otherwise(by_status)
    return (
        F.when(has_application, "apply")
        .when(has_task & has_apply_task, "prepare")
        .when(has_task, "review")
        .when(has_follow_up, "follow_up")
        .otherwise(by_status)
    )


def board_stage(stage: Column) -> Column:
    """Board column of a posting: unknown, empty or NULL stages go to discover."""
    return F.when(stage.isin(*STAGES), stage).otherwise("discover")


def http_error_class(code: Column) -> Column:
    """Error class of an HTTP status; NULL when it is none."""
    return (
        F.when(code == 429, "throttled").when(code == 403, "forbidden").when(code.between(500, 599), "retryable")
    )


def keep_by_rules(priority: Column, industry: Column, has_results: Column) -> Column:
    """Keep/discard rule for a company record without an outside opinion."""
    low = F.lower(F.coalesce(industry, F.lit("")))
    return (
        F.coalesce(has_results, F.lit(False))
        | F.coalesce(priority >= 40, F.lit(False))
        | low.rlike("software|technology|ai")
    )
