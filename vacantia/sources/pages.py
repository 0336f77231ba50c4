"""Signals in stored career pages that tell how a page can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import urls
from vacantia.functions.payloads import strict_json
from vacantia.sources.markup import bare_markup, visible_text
from vacantia.sources.postings import json_nodes, jsonld_blocks

# Markers of script-built pages, of job content and of job elements.
SPA_ROOTS = (r"<div[^>]*id=[\"']root[\"']", r"<div[^>]*id=[\"']app[\"']", r"<div[^>]*id=[\"']__next[\"']")
SPA_MARKERS = ("react", "vue", "angular", "__next_data__", "__react_query_state__", r"window\.__initial_state__", "ng-app")
JOB_WORDS = ("job", "position", "career", "opening", "role")
JOB_ELEMENTS = (
    r"(class|id)=[\"'][^\"']*job", r"class=[\"'][^\"']*(position|opening)", r"<article\b", r"class=[\"']([^\"']* )?listing[ \"']",
)
NO_SLUG = ("jobs", "careers", "openings", "boards-api")
ENDPOINTS = (
    r"[\"']([^\"']*api[^\"']*jobs[^\"']*\.json)[\"']",
    r"[\"']([^\"']*jobs[^\"']*api[^\"']*\.json)[\"']",
    r"[\"']([^\"']*api[^\"']*positions[^\"']*\.json)[\"']",
    r"fetch\([\"']([^\"']*api[^\"']*jobs[^\"']*)[\"']",
)


def _slug(value: Column, excluded: tuple[str, ...]) -> Column:
    return F.when(~value.isin("", *excluded), value)


def has_jobposting(html: Column) -> Column:
    """Whether any JSON-LD script holds a JobPosting at any depth."""

    def holds(block: Column) -> Column:
        typed = F.transform(json_nodes(block), lambda v: F.try_variant_get(v, "$['@type']", "string"))
        return strict_json(block).isNotNull() & F.array_contains(F.filter(typed, lambda t: t.isNotNull()), "JobPosting")

    blocks = F.filter(jsonld_blocks(html), lambda b: b.rlike(r"[{\[]") & F.contains(b, F.lit("JobPosting")))
    return F.exists(blocks, holds)


def json_endpoints(html: Column) -> Column:
    """All distinct candidate JSON addresses, in text order.

    The patterns are tried at every place of the text in their order; the
    address is what stands between the quotes of a match.
    """
    matches = F.regexp_extract_all(html, F.lit("(?i)" + "|".join(ENDPOINTS)), F.lit(0))
    return F.array_distinct(F.transform(matches, lambda m: F.regexp_extract(m, r"[\"']([^\"']*)[\"']", 1)))


def page_methods(pages: DataFrame) -> DataFrame:
    """``pages``: url, html. Adds the reading method with its evidence."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    host = urls.url_host(url)
    first = F.coalesce(F.try_element_at(urls.path_parts(url), F.lit(1)), F.lit(""))
    by_url = _slug(first, ("jobs", "careers"))
    in_greenhouse = _slug(F.regexp_extract(html, r"greenhouse\.io/([^/\"']+)", 1), NO_SLUG)
    in_lever = F.coalesce(
        F.nullif(F.regexp_extract(html, r"lever\.co/v0/postings/([^/\"']+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(html, r"jobs\.lever\.co/([^/\"']+)", 1), F.lit("")),
    )
    out = (
        pages.withColumn("endpoints", json_endpoints(html))
        .withColumn("_low", F.lower(html))
        .withColumn("_tags", F.lower(bare_markup(html)))
        .withColumn("_text", visible_text(html))
        .withColumn("external_scripts", F.regexp_count("_tags", F.lit(r"<script[^>]+src=")))
        .withColumn("is_spa", F.col("_low").rlike("|".join(SPA_MARKERS)) | F.col("_tags").rlike("|".join(SPA_ROOTS)))
        .withColumn("text_chars", F.length("_text"))
        .withColumn("_words", F.lower("_text"))
    )
    thin = (F.col("text_chars") < 500) & F.col("_words").rlike("job|career")
    browser = F.col("is_spa") | thin | (F.col("external_scripts") > 5)
    static = F.col("_words").rlike("|".join(JOB_WORDS)) & F.col("_tags").rlike("|".join(JOB_ELEMENTS))
    api_type = (
        F.when(host.contains("greenhouse.io") & by_url.isNotNull(), "greenhouse")
        .when(host.contains("lever.co") & by_url.isNotNull(), "lever")
        .when(F.contains(html, F.lit("greenhouse.io")) & in_greenhouse.isNotNull(), "greenhouse")
        .when(F.contains(html, F.lit("api.lever.co")) & in_lever.isNotNull(), "lever")
        .when(F.contains(html, F.lit("workday.com")) | F.contains(html, F.lit("myworkdayjobs.com")), "workday")
        .when(F.contains(html, F.lit("application/ld+json")) & has_jobposting(html), "jsonld")
        .when(F.size("endpoints") > 0, "custom_json")
    )
    slug = F.when(host.contains("greenhouse.io") | host.contains("lever.co"), by_url)
    return (
        out.withColumn("api_type", api_type)
        .withColumn(
            "slug",
            F.coalesce(slug, F.when(F.col("api_type") == "greenhouse", in_greenhouse).when(F.col("api_type") == "lever", in_lever)),
        )
        .withColumn(
            "method",
            F.when(F.col("api_type").isNotNull(), "api").when(browser, "browser").when(static, "html").otherwise("generic"),
        )
        .drop("_low", "_tags", "_text", "_words")
    )
