"""Reading model responses and vendor JSON held in string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.text import py_strip

FENCE = "```"


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL.

    The parser stops after the first value. Inside a list and inside an object
    leftovers cannot both pass, so only a text without leftovers is read.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def fenced_body(text: Column) -> Column:
    """Inside of the first Markdown fence (``json`` fence first), else the text."""
    text = F.coalesce(text, F.lit(""))
    after_json = F.split_part(F.split_part(text, F.lit(FENCE + "json"), F.lit(2)), F.lit(FENCE), F.lit(1))
    after_any = F.split_part(text, F.lit(FENCE), F.lit(2))
    body = F.when(text.contains(FENCE + "json"), after_json).when(text.contains(FENCE), after_any).otherwise(text)
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def braced_body(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL when there is no such span."""
    start = F.locate("{", text)
    end = F.length(text) - F.locate("}", F.reverse(text)) + 1
    has = (start > 0) & (F.locate("}", text) > 0) & (end >= start)
    return F.when(has, F.substring(text, start, end - start + 1))


def without_fence_lines(text: Column) -> Column:
    """Drop the first line and the closing fence of a fenced response."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    body = F.regexp_replace(trimmed, r"^```[^\n]*\n", "")
    return F.when(trimmed.startswith(FENCE), F.regexp_replace(body, r"\n?```[^\n]*$", "")).otherwise(trimmed)


def text_list(value: Column, path: str) -> Column:
    """A JSON array of strings inside a VARIANT, empty when absent."""
    return F.coalesce(F.try_variant_get(value, path, "array<string>"), F.array().cast("array<string>"))


def match_response(text: Column) -> Column:
    """``struct`` of the scored match; malformed JSON gives the neutral result."""
    data = strict_json(fenced_body(text))
    is_object = F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))
    raw_score = F.try_variant_get(data, "$.match_score", "double")
    has_score = F.try_variant_get(data, "$.match_score", "string").isNotNull()
    usable = is_object & (raw_score.isNotNull() | ~has_score)
    number = F.when(raw_score >= 0, F.floor(raw_score)).otherwise(F.ceil(raw_score))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(number, F.lit(50)))).cast("int")
    told = F.try_variant_get(data, "$.recommended", "boolean")
    empty = F.array().cast("array<string>")
    return F.struct(
        F.when(usable, score).otherwise(50).alias("match_score"),
        F.when(usable, F.coalesce(told, score >= 70)).otherwise(False).alias("recommended"),
        F.when(usable, F.coalesce(F.try_variant_get(data, "$.summary", "string"), F.lit(""))).otherwise("").alias("summary"),
        F.when(usable, text_list(data, "$.pros")).otherwise(empty).alias("pros"),
        F.when(usable, text_list(data, "$.cons")).otherwise(empty).alias("cons"),
        F.when(usable, text_list(data, "$.keywords_matched")).otherwise(empty).alias("keywords_matched"),
    )


def analysis_response(text: Column, fallback_chars: int = 200, empty_summary: str = "No analysis available") -> Column:
    """``struct`` of a free-form analysis; the fallback summary is the text's start."""
    text = F.coalesce(text, F.lit(""))
    data = strict_json(braced_body(text))
    ok = data.isNotNull()
    empty = F.array().cast("array<string>")
    fallback = F.substring(text, 1, fallback_chars)
    return F.struct(
        ok.alias("parsed"),
        F.when(ok, F.try_variant_get(data, "$.summary", "string"))
        .otherwise(F.when(text == "", F.lit(empty_summary)).otherwise(fallback))
        .alias("summary"),
        F.when(ok, F.try_variant_get(data, "$.pros", "array<string>")).otherwise(empty).alias("pros"),
        F.when(ok, F.try_variant_get(data, "$.cons", "array<string>")).otherwise(empty).alias("cons"),
        F.when(ok, F.try_variant_get(data, "$.overall_fit", "string"))
        .otherwise("Unable to parse analysis")
        .alias("overall_fit"),
    )


def named_value(items: Column, name: str) -> Column:
    """``value`` of the first ``{name, value}`` entry called ``name``."""
    found = F.filter(items, lambda m: m["name"] == name)
    return F.try_element_at(found, F.lit(1))["value"]


def names_of(items: Column) -> Column:
    """``name`` of every entry; '' where it is missing, [] for no list."""
    names = F.transform(items, lambda d: F.coalesce(d["name"], F.lit("")))
    return F.coalesce(names, F.array().cast("array<string>"))


def blank_to_null(value: Column) -> Column:
    return F.nullif(py_strip(value), F.lit(""))
