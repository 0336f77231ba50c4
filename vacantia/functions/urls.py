"""URL and slug functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.text import py_strip

# URL patterns, legal suffixes and host fragments that decide results.
URL_IN_TEXT = r'https?://[^\s<>"{}|\\^`\[\]]+[^\s<>"{}|\\^`\[\].,;:]'
DOMAIN_IN_TEXT = r'([a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.(?:[a-zA-Z]{2,})(?:/[^\s<>"{}|\\^`\[\]]+)?)'
CAREER_PATHS = ("/careers", "/jobs", "/job", "/work-with-us", "/career")
BOARD_PATH_WORDS = ("embed", "job_board", "jobs")
NAME_DROPS = (" Inc.", " Inc", " LLC", " Ltd.", ",", ".", " ")
LEGAL_SUFFIX = r"\s+(inc|llc|ltd|corp|corporation|company|co)\s*$"
KNOWN_CAREER_URLS = {
    "Adobe Inc.": "https://careers.adobe.com",
    "Airbnb": "https://careers.airbnb.com",
    "Amazon": "https://www.amazon.jobs",
    "Apple Inc.": "https://www.apple.com/careers/us/",
    "Atlassian": "https://www.atlassian.com/company/careers",
    "Autodesk": "https://www.autodesk.com/careers",
    "Automattic (WordPress.com)": "https://automattic.com/work-with-us/",
    "Microsoft": "https://careers.microsoft.com",
    "Meta": "https://www.metacareers.com/jobs",
    "Google": "https://careers.google.com/jobs",
    "Netflix": "https://jobs.netflix.com",
    "Figma": "https://www.figma.com/careers",
    "Canva": "https://www.canva.com/careers",
    "Notion": "https://www.notion.so/careers",
    "Linear": "https://linear.app/careers",
    "Vercel": "https://vercel.com/careers",
    "Stripe": "https://stripe.com/jobs",
    "Coinbase": "https://www.coinbase.com/careers",
    "DoorDash": "https://careers.doordash.com",
    "GitLab": "https://about.gitlab.com/jobs",
    "Plaid": "https://plaid.com/careers",
    "Ramp": "https://ramp.com/careers",
    "Databricks": "https://www.databricks.com/company/careers",
}
KNOWN_SLUGS = {
    "GitLab": "gitlab",
    "Plaid": "plaid",
    "Ramp": "ramp",
    "Databricks": "databricks",
    "Netflix": "netflix",
    "Stripe": "stripe",
    "Airbnb": "airbnb",
    "Coinbase": "coinbase",
    "DoorDash": "doordash",
}


def _map_lookup(table: dict[str, str], key: Column) -> Column:
    """Look up a small fixed table kept as a map literal (NULL if absent)."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, key)


def normalize_url(url: Column) -> Column:
    """Comparison form: no query, no fragment, no trailing slashes, lower case."""
    bare = F.split_part(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return F.lower(F.rtrim(bare, F.lit("/")))


def url_host(url: Column) -> Column:
    """``host[:port]`` of an absolute URL, lower case; '' when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """Path part of a URL; relative URLs are all path."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda p: p != "")


def detect_crawler_type(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(low.contains("greenhouse.io"), "greenhouse")
        .when(low.contains("lever.co"), "lever")
        .when(low.contains("myworkdayjobs.com") | low.contains("workday.com"), "workday")
        .otherwise("generic")
    )


def crawler_class(crawler_type: Column) -> Column:
    return (
        F.when(crawler_type.isin("indeed", "linkedin"), "selenium")
        .when(crawler_type.isin("greenhouse", "lever"), "api")
        .when(crawler_type.isin("generic", "workday"), "ai")
        .otherwise("unknown")
    )


def slugify(name: Column) -> Column:
    base = py_strip(F.split_part(name, F.lit("("), F.lit(1)))
    return F.lower(F.trim(F.regexp_replace(base, r"[^a-zA-Z0-9]+", "-"), F.lit("-")))


def greenhouse_slug(url: Column, name: Column) -> Column:
    """``for`` query value, else the last meaningful path part, else the name."""
    queried = F.nullif(
        F.lower(F.trim(F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&]for(?:\[\])?=([^&#]*)", 1))), F.lit("")
    )
    parts = F.filter(
        F.transform(path_parts(url), lambda p: F.lower(p)), lambda p: ~p.isin(*BOARD_PATH_WORDS)
    )
    return F.coalesce(queried, F.try_element_at(parts, F.lit(-1)), slugify(name))


def lever_slug(url: Column, name: Column) -> Column:
    return F.coalesce(F.lower(F.try_element_at(path_parts(url), F.lit(1))), slugify(name))


def crawler_config(name: Column, url: Column, crawler_type: Column) -> Column:
    """``struct<slug, source>``; the unused field is NULL."""
    slug = F.when(crawler_type == "greenhouse", greenhouse_slug(url, name)).when(
        crawler_type == "lever", lever_slug(url, name)
    )
    return F.struct(
        F.nullif(slug, F.lit("")).alias("slug"),
        F.when(crawler_type == "workday", F.lit("workday")).alias("source"),
    )


def career_url_from_name(name: Column, known: bool = False) -> Column:
    """``https://www.<name>.com/careers``; ``known`` consults the fixed table first."""
    clean = py_strip(F.split_part(name, F.lit("("), F.lit(1)))
    for piece in NAME_DROPS:
        clean = F.replace(clean, F.lit(piece), F.lit(""))
    built = F.concat(F.lit("https://www."), F.lower(clean), F.lit(".com/careers"))
    return F.coalesce(_map_lookup(KNOWN_CAREER_URLS, name), built) if known else built


def career_url_guess(name: Column) -> Column:
    """Discovery variant: legal suffix and joiners dropped; NULL if under 3 chars."""
    clean = F.lower(F.regexp_replace(name, r"[^\w\s-]", ""))
    clean = F.translate(F.regexp_replace(clean, LEGAL_SUFFIX, ""), " -_", "")
    return F.when(F.length(clean) > 2, F.concat(F.lit("https://www."), clean, F.lit(".com/careers")))


def career_url_from_link(href: Column, name: Column) -> Column:
    """Career URL from a profile or company link, else from the name."""
    href = F.coalesce(href, F.lit(""))
    slug = F.regexp_extract(href, r"linkedin\.com/company/([^/?]*)", 1)
    domain = F.split_part(F.replace(url_host(href), F.lit("www."), F.lit("")), F.lit(":"), F.lit(1))
    return (
        F.when(
            href.contains("linkedin.com/company/"),
            F.concat(F.lit("https://www."), F.lower(F.replace(slug, F.lit("-"), F.lit(""))), F.lit(".com/careers")),
        )
        .when(
            ~href.contains("linkedin.com") & href.contains("http") & (domain != ""),
            F.concat(F.lit("https://www."), domain, F.lit("/careers")),
        )
        .otherwise(career_url_guess(name))
    )


def title_case(value: Column) -> Column:
    """Capital at the start of every letter run, also after digits and quotes."""
    runs = F.regexp_extract_all(value, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def company_name_from_host(url: Column, title: Column) -> Column:
    """First host label in title case, else the page title minus its suffix."""
    label = F.split_part(F.replace(url_host(url), F.lit("www."), F.lit("")), F.lit("."), F.lit(1))
    cut = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)\s+(Careers?|Jobs?|Hiring|Career Page).*$", "")
    from_title = F.when(F.coalesce(title, F.lit("")) != "", F.substring(F.trim(cut), 1, 100))
    return F.when(url_host(url) != "", title_case(F.translate(label, "-_", "  "))).otherwise(from_title)


def extract_url(text: Column) -> Column:
    """First http(s) URL of a text, else a bare career domain with https://."""
    text = F.coalesce(text, F.lit(""))
    full = F.rtrim(F.regexp_extract(text, f"({URL_IN_TEXT})", 1), F.lit(".,;:"))
    full = F.when(url_host(full) != "", full)
    domains = F.filter(
        F.regexp_extract_all(text, F.lit(DOMAIN_IN_TEXT), F.lit(1)),
        lambda d: F.lower(d).contains("/career") | F.lower(d).contains("/jobs"),
    )
    return F.coalesce(full, F.concat(F.lit("https://"), F.try_element_at(domains, F.lit(1))))


def valid_url(url: Column) -> Column:
    return F.coalesce(
        (url.startswith("http://") | url.startswith("https://")) & url_host(url).contains("."), F.lit(False)
    )


def is_career_url(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("|".join(CAREER_PATHS)), F.lit(False))


def url_part(url: Column, title: Column) -> Column:
    """The tail of a generated posting id: path with ``_``, else the title."""
    return F.when(F.coalesce(url, F.lit("")) != "", F.replace(url_path(url), F.lit("/"), F.lit("_"))).otherwise(
        F.lower(F.replace(title, F.lit(" "), F.lit("_")))
    )


def generated_external_id(prefix: str, company: Column, url: Column, title: Column) -> Column:
    owner = F.lower(F.replace(company, F.lit(" "), F.lit("_")))
    return F.concat_ws("_", F.lit(prefix), owner, url_part(url, title))


def absolute_url(url: Column, page: Column) -> Column:
    """Keep http URLs, join root- and sibling-relative ones, else the page itself.

    ``..`` segments are left as they are.
    """
    origin = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.concat(url_path(page), F.lit("")), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", page)
        .when(url.startswith("http"), url)
        .when(url.startswith("/"), F.concat(origin, url))
        .otherwise(F.concat(origin, folder, url))
    )


def repaired_slug(name: Column, url: Column) -> Column:
    """Known table, then the board host in the URL, then letters of the name."""
    low = F.lower(url)
    board = F.nullif(F.regexp_extract(low, r"boards\.greenhouse\.io/([^/]+)", 1), F.lit(""))
    lever = F.nullif(F.regexp_extract(low, r"jobs\.lever\.co/([^/]+)", 1), F.lit(""))
    return F.coalesce(
        _map_lookup(KNOWN_SLUGS, name), board, lever, F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "")
    )

