"""Raw vendor payloads to postings.

Payloads sit in a string column next to the company they belong to. Known
shapes use ``from_json``; open shapes use VARIANT. A broken payload yields no
rows and never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, text, urls
from vacantia.functions.payloads import named_value, names_of, strict_json, without_fence_lines
from vacantia.sources.markup import script_bodies

GREENHOUSE = (
    "struct<jobs:array<struct<id:string,title:string,location:string,absolute_url:string,updated_at:string,content:string,"
    "description:string,metadata:array<struct<name:string,value:string>>,departments:array<struct<name:string>>>>>"
)
GREENHOUSE_DETAIL = "struct<content:string,departments:array<struct<name:string>>>"
LEVER = (
    "array<struct<id:string,text:string,categories:struct<location:string,commitment:string,team:string,department:string>,"
    "hostedUrl:string,applyUrl:string,createdAt:bigint,description:string,descriptionPlain:string>>"
)
# Wrapper keys in the order they are tried, and search site addresses.
WRAPPER_KEYS = ("jobs", "positions", "openings", "results", "data")
SITES = {
    "indeed": {"base": "https://www.indeed.com", "view": "https://www.indeed.com/viewjob?jk="},
    "linkedin": {"base": "https://www.linkedin.com", "view": "https://www.linkedin.com/jobs/view/"},
}
POSTING_COLUMNS = (
    "external_id", "title", "company", "location", "url", "source_url", "description", "job_type", "posted_date", "platform",
)


def _filled(*values: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def greenhouse_postings(
    landed: DataFrame, details: DataFrame | None = None, kept: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``landed``: company, slug, payload. ``details``: slug, job_id, payload.

    ``kept``: what the caller wants of the description where that is less than the
    text, such as its digest; it is made before postings are dealt to their details.
    """
    kept = kept or (lambda c: c)
    jobs = landed.select("company", "slug", F.explode(F.from_json("payload", GREENHOUSE)["jobs"]).alias("j"))
    jobs = jobs.filter(F.coalesce(F.col("j.id"), F.lit("")) != "")
    own = kept(F.coalesce(_filled(F.col("j.content"), F.col("j.description")), F.lit("")))
    jobs = jobs.select(
        "company", "slug", *[F.col(f"j.{c}") for c in ("id", "title", "location", "absolute_url", "updated_at", "metadata", "departments")],
        own.alias("description"),
    )
    if details is None:
        jobs = jobs.withColumn("d", F.lit(None).cast(GREENHOUSE_DETAIL))
    else:
        found = details.select(
            F.col("slug").alias("_slug"), F.col("job_id").alias("_id"), F.from_json("payload", GREENHOUSE_DETAIL).alias("d")
        )
        jobs = jobs.join(found, (jobs["slug"] == found["_slug"]) & (jobs["id"] == found["_id"]), "left")
    place = F.col("location")
    location = F.when(place.startswith("{"), F.get_json_object(place, "$.name")).otherwise(place)
    url = F.coalesce(
        _filled(F.col("absolute_url")),
        F.concat(F.lit("https://boards.greenhouse.io/"), F.col("slug"), F.lit("/jobs/"), F.col("id")),
    )
    more = F.when(F.size("d.departments") > 0, F.col("d.departments")).otherwise(F.col("departments"))
    detail = _filled(F.col("d.content"))
    return jobs.select(
        F.concat(F.lit("greenhouse_"), F.col("slug"), F.lit("_"), F.col("id")).alias("external_id"),
        text.py_strip(F.coalesce("title", F.lit(""))).alias("title"),
        "company",
        F.coalesce(location, F.lit("")).alias("location"),
        url.alias("url"),
        url.alias("source_url"),
        F.when(detail.isNotNull(), kept(detail)).otherwise(F.col("description")).alias("description"),
        named_value(F.col("metadata"), "Employment Type").alias("job_type"),
        dates.iso_to_utc(F.col("updated_at")).alias("posted_date"),
        F.lit("greenhouse").alias("platform"),
        names_of(more).alias("departments"),
    )


def lever_postings(landed: DataFrame) -> DataFrame:
    """``landed``: company, slug, payload (a JSON list)."""
    lists = landed.filter(F.ltrim("payload").startswith("["))
    jobs = lists.select("company", "slug", F.explode(F.from_json("payload", LEVER)).alias("j"))
    jobs = jobs.filter(F.coalesce(F.col("j.id"), F.lit("")) != "")
    url = F.coalesce(_filled(F.col("j.hostedUrl"), F.col("j.applyUrl")), F.lit(""))
    department = _filled(F.col("j.categories.department"))
    return jobs.select(
        F.concat(F.lit("lever_"), F.col("slug"), F.lit("_"), F.col("j.id")).alias("external_id"),
        text.py_strip(F.coalesce("j.text", F.lit(""))).alias("title"),
        "company",
        F.coalesce("j.categories.location", F.lit("")).alias("location"),
        url.alias("url"),
        url.alias("source_url"),
        F.coalesce(_filled(F.col("j.description"), F.col("j.descriptionPlain")), F.lit("")).alias("description"),
        F.coalesce("j.categories.commitment", F.lit("")).alias("job_type"),
        dates.epoch_to_utc(F.nullif("j.createdAt", F.lit(0)), "ms").alias("posted_date"),
        F.lit("lever").alias("platform"),
        F.array_compact(F.array(department)).alias("departments"),
        F.coalesce("j.categories.team", F.lit("")).alias("team"),
    )


def _text(v: Column, *names: str) -> Column:
    return _filled(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])


def _listed(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _date_of(raw: Column) -> Column:
    """ISO text, or a number of epoch seconds."""
    number = raw.try_cast("double")
    return F.when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(dates.iso_to_utc(raw))


def _open_postings(
    items: DataFrame, prefix: str, title: Column, url: Column, location: Column, job_type: Column, posted: Column,
    page_in_id: bool = False,
) -> DataFrame:
    """Shared tail of the open shapes: absolute URL, generated id, page as fallback.

    The id ends in the URL path, or in the title when there is no URL. With
    ``page_in_id`` the career page stands in for a missing URL first.
    """
    page = F.col("career_url")
    rows = items.withColumn("_raw", title).withColumn("_title", text.py_strip(F.col("_raw")))
    rows = rows.filter(F.coalesce(F.col("_raw"), F.lit("")) != "")
    rows = rows.withColumn("_link", F.when(url.isNotNull(), urls.absolute_url(url, page)))
    link = F.coalesce("_link", page)
    if page_in_id:
        rows = rows.filter(F.col("_title") != "")
        path = F.replace(urls.url_path(link), F.lit("/"), F.lit("_"))
        tail = F.coalesce(_filled(path), F.lower(F.replace("_title", F.lit(" "), F.lit("_"))))
    else:
        tail = urls.url_part(F.col("_link"), F.col("_raw"))
    owner = F.lower(F.replace("company", F.lit(" "), F.lit("_")))
    return rows.select(
        F.concat_ws("_", F.lit(prefix), owner, tail).alias("external_id"),
        F.col("_title").alias("title"),
        "company",
        location.alias("location"),
        link.alias("url"),
        link.alias("source_url"),
        _text(F.col("v"), "description", "summary").alias("description"),
        job_type.alias("job_type"),
        posted.alias("posted_date"),
        F.lit(prefix).alias("platform"),
    )


def custom_json_postings(landed: DataFrame) -> DataFrame:
    """``landed``: company, career_url, payload in any of the usual wrappers."""
    root = landed.withColumn("_root", strict_json(F.col("payload"))).filter(F.col("_root").isNotNull())
    v = F.col("_root")
    wrapped = F.coalesce(*[_listed(v, f"$.{k}") for k in WRAPPER_KEYS])
    whole = F.when(_text(v, "title").isNotNull(), F.array(v))
    found = F.when(F.size(wrapped) > 0, wrapped).otherwise(whole)
    items = root.select("company", "career_url", F.explode(F.coalesce(_listed(v, "$"), found)).alias("v"))
    v = F.col("v")
    return _open_postings(
        items, "api_custom", _text(v, "title", "name", "position"), _text(v, "url", "link", "href"),
        _text(v, "location", "city"), _text(v, "job_type", "type", "employmentType"),
        _date_of(_text(v, "posted_date", "datePosted", "created_at")),
    )


def json_nodes(payload: Column, root: Column | None = None) -> Column:
    """Every object and value of a JSON text at any depth, as an array of VARIANT; ``root`` is the text as read before.

    Levels are opened one by one inside the row; brackets in the text bound the
    number of levels, so there is no fixed depth.
    """
    nothing = F.array().cast("array<variant>")

    def inside(v: Column) -> Column:
        return F.coalesce(
            F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>"), nothing
        )

    start = F.struct(nothing.alias("done"), F.array(strict_json(payload) if root is None else root).alias("level"))
    return F.aggregate(
        F.sequence(F.lit(1), F.regexp_count(payload, F.lit(r"[{\[]"))),
        start,
        lambda acc, _: F.when(F.size(acc["level"]) == 0, acc).otherwise(
            F.struct(
                F.concat(acc["done"], acc["level"]).alias("done"),
                F.flatten(F.transform(acc["level"], inside)).alias("level"),
            )
        ),
        lambda acc: F.concat(acc["done"], acc["level"]),
    )


def jsonld_blocks(html: Column) -> Column:
    """Bodies of the JSON-LD scripts of a page."""
    return script_bodies(html, "application/ld+json")


def jsonld_postings(landed: DataFrame, prefix: str = "api_jsonld") -> DataFrame:
    """``landed``: company, career_url, payload. Every JobPosting at any depth."""
    # a text is made and read once, however often it is used after that
    made = landed.select("company", "career_url", F.explode(F.array("payload")).alias("payload")).filter(F.col("payload").rlike(r"[{\[]"))
    read = made.select("*", F.explode(F.array(strict_json(F.col("payload")))).alias("_root"))
    good = read.filter(F.col("_root").isNotNull())
    typed = F.filter(json_nodes(F.col("payload"), F.col("_root")), lambda n: F.try_variant_get(n, "$['@type']", "string") == "JobPosting")
    items = good.select("company", "career_url", F.explode(typed).alias("v"))
    v = F.col("v")
    url = F.coalesce(_text(v, "url"), _text(v, "hiringOrganization.sameAs"))
    return _open_postings(
        items, prefix, _text(v, "title"), url, F.try_variant_get(v, "$.jobLocation.address.addressLocality", "string"),
        F.try_variant_get(v, "$.employmentType", "string"), _date_of(_text(v, "datePosted")),
    )


def browser_postings(landed: DataFrame, prefix: str = "browser") -> DataFrame:
    """``landed``: company, career_url, payload: a list of extracted objects."""
    root = landed.withColumn("_root", strict_json(F.col("payload")))
    items = root.select("company", "career_url", F.explode(_listed(F.col("_root"), "$")).alias("v"))
    v = F.col("v")

    def place(name: str) -> Column:
        inner = _text(v, f"{name}.name", f"{name}.addressLocality")
        # an empty object counts as absent
        return F.coalesce(inner, F.nullif(_text(v, name), F.lit("{}")))

    location = text.py_strip(F.coalesce(place("location"), place("city"), place("address")))
    return _open_postings(
        items, prefix, _text(v, "title", "name", "position"), _text(v, "url", "href", "link"), location,
        _text(v, "job_type", "employmentType", "type"), F.lit(None).cast("timestamp"), page_in_id=True,
    )


def _xml_text(value: Column) -> Column:
    """Inner text of a tag: no CDATA marks, no tags, entities read."""
    bare = F.regexp_replace(F.regexp_replace(value, r"<!\[CDATA\[|\]\]>", ""), r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return text.py_strip(bare)


def feed_postings(landed: DataFrame) -> DataFrame:
    """RSS items and Atom entries: title and link (``href`` or text)."""
    entries = F.regexp_extract_all(F.coalesce("payload", F.lit("")), F.lit(r"(?s)<(item|entry)\b[^>]*>(.*?)</\1>"), F.lit(2))
    rows = landed.select("company", "career_url", F.explode(entries).alias("x"))
    href = F.regexp_extract("x", r'(?s)<link\b[^>]*\bhref=["\']([^"\']*)["\']', 1)
    inner = F.regexp_extract("x", r"(?s)<link\b[^>]*>(.*?)</link>", 1)
    title = _xml_text(F.regexp_extract("x", r"(?s)<title\b[^>]*>(.*?)</title>", 1))
    return rows.select("company", "career_url", title.alias("title"), _xml_text(F.coalesce(_filled(href), inner)).alias("url"))


def sitemap_urls(landed: DataFrame) -> DataFrame:
    """``loc`` of every ``url`` of a sitemap."""
    entries = F.regexp_extract_all(F.coalesce("payload", F.lit("")), F.lit(r"(?s)<url\b[^>]*>(.*?)</url>"), F.lit(1))
    rows = landed.select("company", F.explode(entries).alias("x"))
    loc = _xml_text(F.regexp_extract("x", r"(?s)<loc\b[^>]*>(.*?)</loc>", 1))
    return rows.select("company", loc.alias("url")).filter(F.col("url") != "")


def card_postings(cards: DataFrame, site: str, as_of: str) -> DataFrame:
    """Search cards already cut into fields: key, title, href, company, location,
    snippet, date_text, chips; ``crawl_company`` stands in for a missing company."""
    base, view = SITES[site]["base"], SITES[site]["view"]
    href = F.coalesce("href", F.lit(""))
    url = F.when(href == "", F.concat(F.lit(view), F.col("key"))).otherwise(urls.absolute_url(href, F.lit(base + "/")))
    rows = cards.filter(F.coalesce("key", F.lit("")) != "")
    if site == "linkedin":
        rows = rows.filter(F.coalesce("title", F.lit("")) != "")
        posted = dates.iso_to_utc(F.col("date_text"))
    else:
        posted = dates.relative_date(F.col("date_text"), dates.ts(as_of))
    return rows.select(
        F.concat(F.lit(f"{site}_"), F.col("key")).alias("external_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("company", "crawl_company").alias("company"),
        "location",
        url.alias("url"),
        url.alias("source_url"),
        F.col("snippet").alias("description"),
        text.employment_type(F.col("chips"), site).alias("job_type"),
        posted.alias("posted_date"),
        F.lit(site).alias("platform"),
    )


def response_postings(landed: DataFrame) -> DataFrame:
    """Model responses that list postings: company, career_url, payload text."""
    bare = landed.withColumn("_root", strict_json(without_fence_lines(F.col("payload"))))
    items = bare.select("company", "career_url", F.explode(_listed(F.col("_root"), "$")).alias("v"))
    v = F.col("v")
    return _open_postings(
        items, "generic", F.try_variant_get(v, "$.title", "string"), _text(v, "url"),
        F.try_variant_get(v, "$.location", "string"), F.try_variant_get(v, "$.job_type", "string"),
        F.lit(None).cast("timestamp"), page_in_id=True,
    )
