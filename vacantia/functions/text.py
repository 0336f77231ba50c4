"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PY_SPACE = r"\s+"
# Words looked for in descriptions, chips and company cards.
TECHNOLOGIES = ("python", "javascript", "react", "node", "sql", "aws", "docker", "kubernetes", "git", "linux")
CHIP_TYPES = {
    "indeed": "full-time|part-time|contract|internship|temporary",
    "linkedin": "full-time|part-time|contract|intern|temporary",
}
YEARS_PATTERN = r"(?i)(\d+)\+?\s*(years?|yrs?)\s*(of\s*)?(experience|exp)"
REMOTE_WORDS = ("remote", "anywhere", "work from home")
NOT_A_COMPANY = {
    "linkedin": ("remote", "view job", "easy apply", "apply now", "save job"),
    "indeed": ("remote", "view job", "easy apply", "apply now", "urgent", "hiring"),
}


def py_strip(value: Column) -> Column:
    """Strip all leading and trailing whitespace, not only spaces."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def squeeze(value: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), PY_SPACE, " "))


def normalize_title(title: Column) -> Column:
    """Lower, squeeze, then ``-`` and ``_`` become spaces (runs are kept)."""
    return F.translate(squeeze(F.lower(title)), "-_", "  ")


def clean_text(value: Column, limit: int) -> Column:
    return F.substring(squeeze(value), 1, limit)


def long_lines(value: Column, min_chars: int = 50, max_lines: int = 50) -> Column:
    """The first ``max_lines`` lines longer than ``min_chars`` characters."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(value, F.lit("")), "\n"), lambda x: F.trim(x)),
        lambda x: F.length(x) > min_chars,
    )
    return F.slice(lines, 1, max_lines)


def technologies(description: Column) -> Column:
    words = F.array(*[F.lit(t) for t in TECHNOLOGIES])
    # the lambda variable holds the lower-case text, so it is made once per row
    low = F.array(F.lower(F.coalesce(description, F.lit(""))))
    return F.flatten(F.transform(low, lambda x: F.filter(words, lambda t: F.contains(x, t))))


def any_technologies(*found: Column) -> Column:
    """Technologies of a text whose parts are joined by spaces, from those of its parts: no word holds a space."""
    words = F.array(*[F.lit(t) for t in TECHNOLOGIES])
    none = F.array().cast("array<string>")
    return F.array_intersect(words, F.concat(*[F.coalesce(f, none) for f in found]))


def years_of_experience(description: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(description, F.lit("")), YEARS_PATTERN, 1), F.lit(""))


def employment_type(chips: Column, site: str = "indeed") -> Column:
    """First chip that names an employment type."""
    return F.try_element_at(F.filter(chips, lambda c: F.lower(c).rlike(CHIP_TYPES[site])), F.lit(1))


def clean_company_name(name: Column, site: str) -> Column:
    """Squeezed name, or NULL when it is too short or a button label."""
    clean = squeeze(name)
    bad = F.lower(clean).rlike("|".join(NOT_A_COMPANY[site]))
    return F.when((F.length(clean) >= 2) & ~bad, clean)


def keyword_tokens(keywords: Column, split_on: str = PY_SPACE) -> Column:
    """Lower-case tokens of a keyword string; empty array for none."""
    parts = F.split(F.lower(F.coalesce(keywords, F.lit(""))), split_on)
    return F.filter(parts, lambda k: k != "")


def has_any_keyword(text: Column, tokens: Column) -> Column:
    return F.exists(F.array(text), lambda x: F.exists(tokens, lambda k: F.contains(x, k)))


def is_remote_location(location: Column) -> Column:
    return F.lower(F.coalesce(location, F.lit(""))).rlike("|".join(REMOTE_WORDS))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), PY_SPACE), lambda w: w != ""))
