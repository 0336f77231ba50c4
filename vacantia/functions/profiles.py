"""Text of user profiles, posting summaries and document blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.payloads import blank_to_null
from vacantia.functions.text import py_strip
from vacantia.operators.scale import ordinals

SUMMARY_CHARS = 600
#: Documents per part of a summary text; whole documents can be long.
DOCUMENTS_PER_PART = 100


def _s(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def skills_text(skills: Column) -> Column:
    return _s(F.array_join(skills, ", "))


def experience_text(experience: Column) -> Column:
    """Sections of ``array<struct<title, company, location, start_date, end_date, description>>``."""

    def section(e: Column) -> Column:
        return F.concat(
            F.lit("### "), _s(e["title"]), F.lit("\n"), _s(e["company"]), F.lit(" - "), _s(e["location"]), F.lit("\n"),
            _s(e["start_date"]), F.lit(" - "), F.coalesce(e["end_date"], F.lit("Present")), F.lit("\n\n"), _s(e["description"]), F.lit("\n"),
        )

    return _s(F.array_join(F.transform(experience, section), "\n\n"))


def education_text(education: Column) -> Column:
    def section(e: Column) -> Column:
        return F.concat(F.lit("### "), _s(e["degree"]), F.lit("\n"), _s(e["institution"]), F.lit("\n"), _s(e["year"]), F.lit("\n"))

    return _s(F.array_join(F.transform(education, section), "\n\n"))


def highlights(experience: Column, count: int = 3) -> Column:
    """``title at company`` of the first experiences that name both."""
    first = F.filter(F.slice(experience, 1, count), lambda e: (_s(e["title"]) != "") & (_s(e["company"]) != ""))
    return F.transform(first, lambda e: F.concat(e["title"], F.lit(" at "), e["company"]))


def achievements(experience: Column, count: int = 3, chars: int = 200) -> Column:
    """Starts of the descriptions of the first experiences."""
    first = F.filter(F.slice(experience, 1, count), lambda e: _s(e["description"]) != "")
    return F.transform(first, lambda e: F.substring(e["description"], 1, chars))


def job_summary(role_summary: Column, company_profile: Column, title: Column, company: Column) -> Column:
    told = F.coalesce(blank_to_null(role_summary), blank_to_null(company_profile))
    return F.substring(F.coalesce(told, F.concat(title, F.lit(" at "), company, F.lit("."))), 1, SUMMARY_CHARS)


def document_block(summary: Column, title: Column, filename: Column, content: Column) -> Column:
    heading = F.coalesce(F.nullif(summary, F.lit("")), F.nullif(title, F.lit("")), filename)
    return F.concat(F.lit("### "), heading, F.lit("\n"), py_strip(_s(content)), F.lit("\n"))


def document_summaries(documents: DataFrame, owner: str, order: str = "id") -> DataFrame:
    """Blocks of each owner's documents as one text, in parts of 100 documents.

    ``order`` is a unique key: only it is sorted and numbered. ``part`` counts
    from 0; almost every owner has one part, and an owner with
    very many documents gets several that follow each other.
    """
    numbers = ordinals(documents.select(owner, order), [owner], [F.col(order)], name="_n")
    placed = documents.join(numbers.select(order, "_n"), order)
    block = document_block(F.col("summary"), F.col("title"), F.col("filename"), F.col("content"))
    parts = placed.select(owner, F.floor((F.col("_n") - 1) / DOCUMENTS_PER_PART).alias("part"), "_n", block.alias("block"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "block"))), lambda b: b["block"]), "\n")
    return parts.groupBy(owner, "part").agg(joined.alias("text"))


def ai_content(row: dict[str, Column], stored: Column) -> Column:
    """Map of the AI fields overlaid by the stored map (stored keys win)."""
    base = F.create_map(*[x for key, value in row.items() for x in (F.lit(key), value.cast("string"))])
    over = F.coalesce(stored, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)


def with_ai_defaults(postings: DataFrame) -> DataFrame:
    """Neutral AI fields where they are absent."""
    empty = F.array().cast("array<string>")
    defaults = {
        "ai_match_score": F.lit(50.0), "ai_recommended": F.lit(False), "ai_summary": F.lit(""),
        "ai_pros": empty, "ai_cons": empty, "ai_keywords_matched": empty,
    }
    return postings.withColumns(
        {name: F.coalesce(F.col(name), value) if name in postings.columns else value for name, value in defaults.items()}
    )
