"""Date functions. ``as_of`` is always a timestamp column or literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ts(value: str) -> Column:
    """A timestamp literal for ``as_of`` parameters."""
    return F.lit(value).cast("timestamp")


def plus(when: Column, amount: Column | int, unit: str) -> Column:
    """``when + amount unit`` for unit in day/hour/minute/second."""
    amount = F.lit(amount) if isinstance(amount, int) else amount
    slot = {"day": "days", "hour": "hours", "minute": "mins", "second": "secs"}[unit]
    return when + F.make_interval(**{slot: amount})


def in_range(rows: DataFrame, column: str, since: Column | None = None, before: Column | None = None, through: Column | None = None) -> DataFrame:
    """Rows with ``since <= column``, ``column < before``, ``column <= through``.

    A table split by day has ``<column>_day``; the same bounds on it let the scan
    skip the folders of other days.
    """
    day = F.col(f"{column}_day") if f"{column}_day" in rows.columns else None
    for bound, test, on_day in (
        (since, lambda c, b: c >= b, lambda d, b: d >= b),
        (before, lambda c, b: c < b, lambda d, b: d <= b),
        (through, lambda c, b: c <= b, lambda d, b: d <= b),
    ):
        if bound is None:
            continue
        rows = rows.filter(test(F.col(column), bound))
        if day is not None:
            rows = rows.filter(on_day(day, F.to_date(bound)))
    return rows


def relative_date(text: Column, as_of: Column) -> Column:
    """``3 days ago``, ``Just posted``, ``30+ days ago`` … relative to as_of."""
    low = F.lower(F.coalesce(text, F.lit("")))

    amount = F.regexp_extract(low, r"(\d+)\s*(day|hour|minute)", 1).try_cast("int")
    unit = F.regexp_extract(low, r"(\d+)\s*(day|hour|minute)", 2)
    return (
        F.when(low.contains("today") | low.contains("just posted"), as_of)
        .when(low.contains("30+"), plus(as_of, -30, "day"))
        .when(unit == "day", plus(as_of, -amount, "day"))
        .when(unit == "hour", plus(as_of, -amount, "hour"))
        .when(unit == "minute", plus(as_of, -amount, "minute"))
    )


def iso_to_utc(text: Column) -> Column:
    """ISO 8601 text with Z, an offset or none (then UTC); NULL when malformed."""
    return text.try_cast("timestamp")


def epoch_to_utc(value: Column, unit: str) -> Column:
    return F.timestamp_millis(value) if unit == "ms" else F.timestamp_seconds(value)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def due_date(
    task_type: Column,
    score: Column,
    discovered_at: Column,
    posted_date: Column,
    application_date: Column,
    as_of: Column,
) -> Column:
    """Due date of a task from its type and the posting it belongs to."""
    base = F.coalesce(discovered_at, as_of)
    known = F.coalesce(score, F.lit(50.0))
    apply_days = F.when(known >= 75, 1).when(known >= 50, 3).otherwise(5)
    fresh = F.coalesce(seconds_between(posted_date, base) / 3600 < 24, F.lit(False))
    apply_days = F.when(fresh, F.greatest(F.lit(1), apply_days - 1)).otherwise(apply_days)
    research_days = F.when(score.isNull() | (score >= 75), 1).otherwise(2)
    days = (
        F.when(task_type == "apply", apply_days)
        .when(task_type == "follow_up", F.lit(7))
        .when(task_type == "research", research_days)
        .when(task_type == "network", F.lit(5))
        .when(task_type == "prepare_interview", F.lit(1))
        .otherwise(F.lit(3))
    )
    start = F.when(task_type == "follow_up", F.coalesce(application_date, base)).otherwise(base)
    return plus(start, days, "day")


def snooze_interval_hours(option: Column) -> Column:
    """Hours of a snooze option, NULL for an unknown one."""
    return F.when(option == "1h", 1).when(option == "1d", 24).when(option == "3d", 72).when(option == "1w", 168)
