"""Replaceable scorers and the daily run that uses them.

A scorer is any callable from postings to ``id, ai_match_score, ai_recommended``
rows. It may come from the rules here, from a table of model responses, or from
the caller (a pandas UDF inside is fine).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, payloads, scores
from vacantia.operators import ranking

Scorer = Callable[[DataFrame], DataFrame]
RECOMMEND_FROM = 70


def criteria_scorer(keywords: str, location: str | None = None, remote_only: bool = False) -> Scorer:
    """Score by the wishes of one search or profile."""

    def score(jobs: DataFrame) -> DataFrame:
        value = scores.match_score(
            F.col("title"), F.col("description"), F.col("location"), F.lit(keywords), F.lit(location).cast("string"), F.lit(remote_only)
        )
        return jobs.select("id", value.alias("ai_match_score")).withColumn("ai_recommended", F.col("ai_match_score") >= RECOMMEND_FROM)

    return score


def response_scorer(responses: DataFrame) -> Scorer:
    """Score from stored model responses (``id, response``); none means neutral."""
    parsed = responses.select("id", payloads.match_response(F.col("response")).alias("r"))
    known = parsed.select("id", F.col("r.match_score").cast("double").alias("ai_match_score"), F.col("r.recommended").alias("ai_recommended"))

    def score(jobs: DataFrame) -> DataFrame:
        out = jobs.select("id").join(known, "id", "left")
        return out.select("id", F.coalesce("ai_match_score", F.lit(50.0)).alias("ai_match_score"), F.coalesce("ai_recommended", F.lit(False)).alias("ai_recommended"))

    return score


def scored(jobs: DataFrame, scorer: Scorer) -> DataFrame:
    """Postings with the scorer's result in place of their AI fields."""
    bare = jobs.drop("ai_match_score", "ai_recommended")
    return bare.join(scorer(jobs), "id", "left")


def daily_selection(jobs: DataFrame, scorer: Scorer, as_of: str, count: int = 5) -> DataFrame:
    """All described postings of the day, scored, and the top of them picked."""
    now = dates.ts(as_of)
    today = dates.in_range(jobs.filter(F.col("description").isNotNull()), "discovered_at", since=F.date_trunc("day", now), through=now)
    return ranking.daily_top(scored(today, scorer), as_of, count)
