"""Recommendation lists made of several branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates
from vacantia.operators import joins
from vacantia.operators.scale import top_rows

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def follow_up_board(jobs: DataFrame, follow_ups: DataFrame, as_of: str, apply_limit: int = 10) -> DataFrame:
    """Applied without follow-up, follow-ups of the next day, and high matches.

    Ordered by priority, then by the date text; rows without a date come first.
    """
    waiting = joins.applied_without_follow_up(jobs, follow_ups).select(
        F.lit("follow_up").alias("type"), F.lit("high").alias("priority"), F.col("id").alias("job_id"),
        F.lit(None).cast("bigint").alias("followup_id"), F.col("title").alias("job_title"), "company", "location",
        F.col("ai_match_score").alias("score"), F.lit("").alias("date_key"),
        F.lit("Schedule follow-up email or call").alias("suggested_action"),
    )
    soon = joins.follow_ups_soon(follow_ups, jobs, as_of).select(
        F.lit("upcoming_followup").alias("type"), "priority", "job_id", F.col("id").alias("followup_id"), "job_title",
        "company", "location", F.lit(None).cast("double").alias("score"),
        F.date_format("follow_up_date", ISO).alias("date_key"),
        F.concat(F.lit("Follow up: "), F.col("action_type")).alias("suggested_action"),
    )
    fit = jobs.filter((F.col("ai_match_score") >= 75) & (F.col("status") == "new"))
    best = top_rows(fit, [F.col("ai_match_score").desc(), F.col("id")], apply_limit).select(
        F.lit("apply_now").alias("type"), F.lit("medium").alias("priority"), F.col("id").alias("job_id"),
        F.lit(None).cast("bigint").alias("followup_id"), F.col("title").alias("job_title"), "company", "location",
        F.col("ai_match_score").alias("score"), F.date_format("discovered_at", ISO).alias("date_key"),
        F.lit("Apply now - high match score").alias("suggested_action"),
    )
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return waiting.unionByName(soon).unionByName(best).orderBy(rank, "date_key", "type", "job_id", "followup_id")


def task_board(jobs: DataFrame, tasks: DataFrame, limit: int = 10) -> DataFrame:
    """Recommended actions first, then missing follow-up tasks, cut to the limit."""
    actions = joins.action_recommendations(jobs, tasks, limit).select(
        "*", F.lit(0).alias("branch"), (-F.col("match_score")).alias("place")
    )
    later = joins.follow_up_recommendations(jobs, tasks, limit).select(
        "*", F.lit(1).alias("branch"), (-F.unix_micros("updated_at")).cast("double").alias("place")
    ).drop("updated_at")
    both = actions.unionByName(later)
    return top_rows(both, [F.col("branch"), F.col("place"), F.col("job_id")], limit).drop("branch", "place")


def next_steps(jobs: DataFrame, as_of: str) -> DataFrame:
    """Suggested next steps per posting: six fixed ones and one for a skill gap.

    ``jobs`` has ``id, title, company, must_haves, nice_to_haves,
    what_they_want, simplified_requirements``.
    """
    title, company = F.coalesce(F.nullif("title", F.lit("")), F.lit("Role")), F.coalesce(F.nullif("company", F.lit("")), F.lit("Company"))
    empty = F.array().cast("array<string>")
    must, nice = F.coalesce("must_haves", empty), F.coalesce("nice_to_haves", empty)
    simple, want = F.coalesce("simplified_requirements", empty), F.coalesce("what_they_want", F.lit(""))
    focus = F.when(F.size(must) > 0, F.slice(must, 1, 2)).otherwise(F.slice(simple, 1, 2))
    now = dates.ts(as_of)

    def step(key, label, kind, text, notes, days):
        return F.struct(
            F.lit(key).alias("suggestion_id"), F.lit(label).alias("label"), F.lit(kind).alias("task_type"),
            text.alias("title"), notes.alias("notes"), dates.plus(now, days, "day").alias("suggested_due_date"),
        )

    # Keys, labels and texts of the suggestions.
    steps = F.array(
        step("apply_now", "Apply now", "apply", F.concat(F.lit("Apply to "), title, F.lit(" at "), company),
             F.when(F.size(must) > 0, F.concat(F.lit("Highlight matches to must-haves: "), F.array_join(F.slice(must, 1, 3), ", ")))
             .otherwise("Review description and tailor resume."), 1),
        step("research_company", "Research company", "research", F.concat(F.lit("Research "), company, F.lit(" and team for "), title),
             F.coalesce(F.nullif(want, F.lit("")), F.lit("Identify product, customers, and success metrics.")), 2),
        step("tailor_resume", "Tailor resume", "prepare_interview", F.concat(F.lit("Tailor resume for "), title, F.lit(" at "), company),
             F.when(F.size(focus) > 0, F.concat(F.lit("Emphasize: "), F.array_join(focus, ", ")))
             .otherwise("Emphasize top relevant accomplishments."), 2),
        step("draft_cover_letter", "Draft cover letter", "prepare_interview", F.concat(F.lit("Draft cover letter for "), company),
             F.lit("Address how you meet must-haves and why this role."), 3),
        step("network_outreach", "Network outreach", "network", F.concat(F.lit("Identify 1-2 contacts at "), company),
             F.lit("Find team members on LinkedIn; request a short chat."), 3),
        step("schedule_follow_up", "Schedule follow-up", "follow_up", F.concat(F.lit("Schedule follow-up for "), title, F.lit(" at "), company),
             F.lit("If no response after applying, send polite follow-up."), 7),
        F.when(F.size(nice) > 0, step(
            "close_skill_gap", "Close skill gap", "research", F.concat(F.lit("Study 1 nice-to-have for "), title),
            F.concat(F.lit("Review: "), F.try_element_at(nice, F.lit(1))), 5)),
    )
    made = jobs.select(F.col("id").alias("job_id"), F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    return made.select("job_id", "s.*")


def id_difference(wanted: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")
