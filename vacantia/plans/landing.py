"""Registered sources: payloads are built from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import dates
from vacantia.plans.registry import Tables, query
from vacantia.plans.views import TODAY
from vacantia.session import settled
from vacantia.sources import companies, documents, pages, postings

CAREER = "https://www.example.com/careers/list"
ISO = "yyyy-MM-dd'T'HH:mm:ss"
BRIEF = ("external_id", "title", "company", "location", "url", "job_type", "posted_date")


def brief(df, *more):
    """Posting columns for comparison; the text is compared by its digest."""
    return df.select(*BRIEF, F.md5("description").alias("description_md5"), *more)


#: Payloads whose texts are brought to them together.
TEXT_GROUP = 100


def listed(t: Tables, item, shape=None, texts: bool = True):
    """Payload texts of up to 20 items each, with their company.

    Items with ``texts`` are listed with the names of their descriptions, and these are
    filled into the finished lists, so no text is dealt or sorted once per posting.
    """
    rows = (t.by_name("jobs") if texts else t("jobs")).withColumn("item", item).withColumn("bucket", F.floor(F.col("id") / 20))
    keys = ["company", "company_id", "bucket"]
    if texts:
        made = rows.groupBy(*keys).agg(F.collect_list(F.struct("item", F.col("description").alias("name"))).alias("made"))
        grouped = with_texts(made, keys, t.texts())
    else:
        grouped = rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    return grouped.withColumn("payload", F.concat(F.lit("["), F.col("items"), F.lit("]")) if shape is None else shape)


def with_texts(lists, keys, texts):
    """``items`` from ``made`` (item, name): the names in the items become the texts, as JSON; then the items are joined in order.

    Lists are sorted by their first document and cut into groups of TEXT_GROUP; a group
    gets each of its texts once, whichever lists share them.
    """
    number = F.transform("made", lambda m: F.split_part(m["name"], F.lit(":"), F.lit(2)).cast("long"))
    placed = lists.withColumn("first", F.array_min(number))
    size = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(size, "first", *keys).sortWithinPartitions("first", *keys)
    cut = settled(dealt.withColumn("group", F.floor(F.monotonically_increasing_id() / TEXT_GROUP)).drop("first"), "lists")
    asked = cut.select("group", F.explode("made.name").alias("name")).filter("name IS NOT NULL").distinct()
    whole = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.substr(whole, F.lit(6), F.length(whole) - 6)  # the value of {"t":"..."}
    found = asked.join(texts.select("name", quoted.alias("quoted")), "name")
    maps = found.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("name", "quoted"))).alias("texts"))

    def fill(m):
        return F.when(m["name"].isNull(), m["item"]).otherwise(
            F.replace(m["item"], F.concat(F.lit('"'), m["name"], F.lit('"')), F.element_at("texts", m["name"]))
        )

    items = F.array_join(F.sort_array(F.transform("made", fill)), ",")
    # exploded, so that what reads the items more than once doesn't fill them more than once
    return cut.join(maps, "group", "left").select(*keys, F.explode(F.array(items)).alias("items"))


def iso_with_offset():
    """Half of the dates in UTC with Z, half two hours ahead with an offset."""
    ahead = dates.plus(F.col("posted_date"), 2, "hour")
    return F.when(F.col("id") % 2 == 0, F.concat(F.date_format("posted_date", ISO), F.lit("Z"))).otherwise(
        F.concat(F.date_format(ahead, ISO), F.lit("+02:00"))
    )


RAW_NAME = """CASE seq % 9 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN concat('Big ', name, ' Inc.') WHEN 3 THEN concat(name, ' (Holding), LLC') ELSE name END"""
RAW_URL = """CASE seq % 8 WHEN 0 THEN '' WHEN 1 THEN concat('see https://www.f', CAST(seq AS STRING), '.com/careers, thanks.')
 WHEN 2 THEN concat('f', CAST(seq AS STRING), '.com/jobs') WHEN 3 THEN 'http://localhost/jobs' WHEN 4 THEN 'ask us'
 WHEN 5 THEN concat('https://jobs.lever.co/Team', CAST(seq AS STRING), '/x?y=1') ELSE career_page_url END"""
PARSED = f"""
r AS (SELECT seq, {RAW_NAME} AS raw_name, {RAW_URL} AS raw_url FROM {{company_records}}),
n AS (SELECT *, regexp_replace(raw_name, '^\\s+|\\s+$', '', 'g') AS name, regexp_replace(raw_url, '^\\s+|\\s+$', '', 'g') AS link FROM r),
u AS (SELECT *, nullif(rtrim(regexp_extract(link, 'https?://[^\\s<>"{{}}|\\\\^`\\[\\]]+[^\\s<>"{{}}|\\\\^`\\[\\].,;:]'), '.,;:'), '') AS full_url,
 list_filter(regexp_extract_all(link, '([a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\\.(?:[a-zA-Z]{{2,}})(?:/[^\\s<>"{{}}|\\\\^`\\[\\]]+)?)', 1),
  lambda x: contains(lower(x), '/career') OR contains(lower(x), '/jobs'))[1] AS dom,
 'https://www.' || lower(replace(replace(replace(replace(replace(replace(replace(trim(split_part(name, '(', 1)), ' Inc.', ''), ' Inc', ''), ' LLC', ''), ' Ltd.', ''), ',', ''), '.', ''), ' ', '')) || '.com/careers' AS built FROM n),
v AS (SELECT *, coalesce(full_url, 'https://' || dom, built) AS url FROM u),
p AS (SELECT seq, name, url, CASE WHEN raw_name = '' THEN 'empty_name' WHEN raw_url = '' THEN 'blank_url' WHEN name = '' THEN 'empty_name'
  WHEN NOT contains(regexp_extract(url, '^https?://([^/?#]*)', 1), '.') THEN 'invalid_url' END AS reason FROM v)
"""


def raw_companies(t: Tables):
    """Company CSV lines of the record table."""
    rows = t("company_records").select(
        "seq", F.expr(RAW_NAME).alias("a"), F.expr(RAW_URL).alias("b"), F.col("source").alias("c"),
        F.col("priority").cast("string").alias("d"), F.coalesce("notes", F.lit("")).alias("e"),
    )
    lines = rows.select("seq", F.to_csv(F.struct("a", "b", "c", "d", "e"), {"escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("line"))
    return companies.parse_companies(companies.company_rows_from_lines(lines))


@query("a1_company_csv", "WITH " + PARSED + r"""
SELECT seq, CASE WHEN reason IS NULL THEN name END AS name, CASE WHEN reason IS NULL THEN url END AS career_page_url, reason,
 CASE WHEN reason IS NOT NULL THEN NULL WHEN contains(lower(url), 'greenhouse.io') THEN 'greenhouse' WHEN contains(lower(url), 'lever.co') THEN 'lever'
  WHEN contains(lower(url), 'myworkdayjobs.com') OR contains(lower(url), 'workday.com') THEN 'workday' ELSE 'generic' END AS crawler_type,
 CASE WHEN reason IS NOT NULL THEN NULL WHEN contains(lower(url), 'greenhouse.io') THEN lower(split_part(split_part(url, '://', 2), '/', 2))
  WHEN contains(lower(url), 'lever.co') THEN lower(split_part(split_part(url, '://', 2), '/', 2)) END AS slug FROM p""")
def _(t):
    out = raw_companies(t)
    ok = F.col("reason").isNull()
    return out.select(
        "seq", F.when(ok, F.col("name")).alias("name"), F.when(ok, F.col("career_page_url")).alias("career_page_url"),
        "reason", "crawler_type", F.col("crawler_config.slug").alias("slug"),
    )


@query("d12_load_statistics", "WITH " + PARSED + " SELECT coalesce(reason, 'loaded') AS reason, count(*) AS rows FROM p GROUP BY 1")
def _(t):
    from vacantia.operators.aggregates import load_statistics

    return load_statistics(raw_companies(t))


@query("d12_load_diagnosis", "WITH " + PARSED + """
SELECT 'warning' AS severity, 'Only ' || count(*) || ' active companies' AS message FROM {companies} WHERE is_active HAVING count(*) BETWEEN 1 AND 9
UNION ALL SELECT 'critical', 'No active companies found' FROM {companies} WHERE is_active HAVING count(*) = 0
UNION ALL SELECT 'info', count(*) || ' companies have no extractable URLs' FROM p WHERE reason = 'blank_url' HAVING count(*) > 0""")
def _(t):
    from vacantia.operators.aggregates import load_diagnosis

    return load_diagnosis(raw_companies(t), t("companies"))


@query("a2_company_csv_rows", """
SELECT name AS "Company Name", career_page_url AS "Career Page URL", source AS "Source", priority AS "Priority", coalesce(notes, '') AS "Notes"
FROM {company_records}""")
def _(t):
    return companies.csv_rows(t("company_records"), F.col("notes"))


@query("a3_seed_json", """
SELECT trim(name) AS name, career_page_url, CASE WHEN seq % 4 = 3 THEN 'seed_file' ELSE source END AS source, priority,
 has_crawl_results, industry, notes FROM {company_records} WHERE seq % 7 <> 3""")
def _(t):
    from pyspark.sql.functions import struct, to_json

    rows = t("company_records")
    name = F.when(F.col("seq") % 7 != 3, F.col("name"))
    source = F.when(F.col("seq") % 4 != 3, F.col("source"))
    item = to_json(struct(name.alias("name"), "career_page_url", source.alias("source"), "priority", "has_crawl_results", "industry", "notes"))
    files = rows.withColumn("item", item).groupBy(F.floor(F.col("seq") / 25).alias("file")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("payload")
    )
    out = companies.seed_records(files)
    meta = {k: F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("industry", "notes")}
    return out.select("name", "career_page_url", "source", "priority", "has_crawl_results", meta["industry"], meta["notes"])


@query("a4_source_override", "SELECT seq, name, 'memory' AS source FROM {company_records}")
def _(t):
    return companies.with_source(t("company_records"), "memory").select("seq", "name", "source")


@query("a5_collected_sources", """
SELECT name, source, priority, 0 AS source_no FROM {company_records} UNION ALL SELECT name, discovery_source, NULL, 1 FROM {pending_companies}""")
def _(t):
    pending = t("pending_companies").select("name", F.col("discovery_source").alias("source"))
    out = companies.collect_records([t("company_records").select("name", "source", "priority"), pending])
    return out.select("name", "source", "priority", "source_no")


@query("a6_table_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} WHERE o_totalprice > 100000")
def _(t):
    from vacantia.sources.tables import scan

    return scan(t.spark, f"{t.sf_dir}/orders.parquet").filter("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("a7_greenhouse_postings", """
SELECT concat('greenhouse_co', company_id, '_', id) AS external_id, trim(title) AS title, company, coalesce(location, '') AS location,
 CASE WHEN id % 5 = 0 THEN concat('https://boards.greenhouse.io/co', company_id, '/jobs/', id) ELSE url END AS url, job_type, posted_date,
 md5(CASE WHEN id % 6 = 0 THEN concat('full text of ', id) ELSE coalesce(description, '') END) AS description_md5,
 CASE WHEN id % 6 = 0 THEN 'Detail' ELSE 'Engineering|' END AS departments FROM {jobs}""")
def _(t):
    item = F.to_json(F.struct(
        "id", "title", F.struct(F.col("location").alias("name")).alias("location"),
        F.when(F.col("id") % 5 != 0, F.col("url")).alias("absolute_url"), iso_with_offset().alias("updated_at"),
        F.col("description").alias("content"),
        F.array(
            F.struct(F.lit("Level").alias("name"), F.lit("x").alias("value")),
            F.struct(F.lit("Employment Type").alias("name"), F.col("job_type").alias("value")),
        ).alias("metadata"),
        F.array(F.struct(F.lit("Engineering").alias("name")), F.struct(F.lit(None).cast("string").alias("name"))).alias("departments"),
    ))
    landed = listed(t, item, F.concat(F.lit('{"jobs":['), F.col("items"), F.lit("]}"))).withColumn(
        "slug", F.concat(F.lit("co"), F.col("company_id").cast("string"))
    )
    details = t("jobs").filter("id % 6 = 0").select(
        F.concat(F.lit("co"), F.col("company_id").cast("string")).alias("slug"), F.col("id").cast("string").alias("job_id"),
        F.to_json(F.struct(
            F.concat(F.lit("full text of "), F.col("id").cast("string")).alias("content"),
            F.array(F.struct(F.lit("Detail").alias("name"))).alias("departments"),
        )).alias("payload"),
    )
    out = postings.greenhouse_postings(landed, details, kept=F.md5)
    return out.select(*BRIEF, F.col("description").alias("description_md5"), F.array_join("departments", "|").alias("departments"))


@query("a8_lever_postings", """
SELECT concat('lever_co', company_id, '_', id) AS external_id, trim(title) AS title, company, coalesce(location, '') AS location, url,
 coalesce(job_type, '') AS job_type, posted_date, md5(coalesce(description, concat('plain ', id))) AS description_md5,
 CASE WHEN id % 3 = 0 THEN '' ELSE 'Dept' END AS departments, concat('team', id % 4) AS team FROM {jobs}""")
def _(t):
    hosted = F.col("id") % 4 != 0
    item = F.to_json(F.struct(
        F.col("id").cast("string").alias("id"), F.col("title").alias("text"),
        F.struct(
            "location", F.col("job_type").alias("commitment"), F.concat(F.lit("team"), (F.col("id") % 4).cast("string")).alias("team"),
            F.when(F.col("id") % 3 != 0, "Dept").otherwise("").alias("department"),
        ).alias("categories"),
        F.when(hosted, F.col("url")).alias("hostedUrl"), F.when(~hosted, F.col("url")).alias("applyUrl"),
        F.unix_millis("posted_date").alias("createdAt"), "description",
        F.concat(F.lit("plain "), F.col("id").cast("string")).alias("descriptionPlain"),
    ))
    landed = listed(t, item).withColumn("slug", F.concat(F.lit("co"), F.col("company_id").cast("string")))
    return brief(postings.lever_postings(landed), F.array_join("departments", "|").alias("departments"), "team")


OWNER = "lower(replace(company, ' ', '_'))"
PATH = "replace(regexp_extract(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^([^?#]*)', 1), '/', '_')"


@query("a9_custom_json_postings", f"""
SELECT concat('api_custom_', {OWNER}, '_', CASE WHEN id % 4 = 1 THEN lower(replace(title, ' ', '_')) ELSE {PATH} END) AS external_id,
 trim(title) AS title, company, location, CASE WHEN id % 4 = 1 THEN '{CAREER}' WHEN id % 4 = 2 THEN concat('https://www.example.com/p/', id) ELSE url END AS url,
 job_type, posted_date, md5(nullif(description, '')) AS description_md5
FROM (SELECT *, floor(id / 20) % 7 AS shape FROM (SELECT * REPLACE (CASE WHEN id % 4 = 2 THEN concat('https://www.example.com/p/', id) ELSE url END AS url) FROM {{jobs}}))
WHERE shape < 6 OR (shape = 6 AND id % 3 = 0)""")
def _(t):
    i = F.col("id")
    link = F.when(i % 4 == 2, F.concat(F.lit("/p/"), i.cast("string"))).when(i % 4 != 1, F.col("url"))
    item = F.to_json(F.struct(
        F.when(i % 3 == 0, F.col("title")).alias("title"), F.when(i % 3 == 1, F.col("title")).alias("name"),
        F.when(i % 3 == 2, F.col("title")).alias("position"),
        F.when(i % 5 < 3, link).alias("url"), F.when(i % 5 == 3, link).alias("link"), F.when(i % 5 == 4, link).alias("href"),
        F.when(i % 2 == 0, F.col("location")).alias("location"), F.when(i % 2 == 1, F.col("location")).alias("city"),
        F.when(i % 2 == 0, F.col("description")).alias("description"), F.when(i % 2 == 1, F.col("description")).alias("summary"),
        F.col("job_type").alias("employmentType"),
        F.when(i % 2 == 0, F.date_format("posted_date", ISO)).alias("datePosted"),
        F.when(i % 2 == 1, F.unix_seconds("posted_date")).alias("created_at"),
    ))
    shape = F.col("bucket") % 7
    wrap = F.lit(None).cast("string")
    for n, key in enumerate(postings.WRAPPER_KEYS):
        wrap = F.when(shape == n, F.concat(F.lit(f'{{"meta":1,"{key}":['), F.col("items"), F.lit("]}"))).otherwise(wrap)
    many = listed(t, item, F.when(shape == 5, F.concat(F.lit("["), F.col("items"), F.lit("]"))).otherwise(wrap)).filter(shape < 6)
    single = t("jobs").filter(F.floor(i / 20) % 7 == 6).select("company", item.alias("payload"))
    landed = many.select("company", "payload").unionByName(single).withColumn("career_url", F.lit(CAREER))
    return brief(postings.custom_json_postings(landed))


@query("a10_jsonld_postings", f"""
SELECT concat('api_jsonld_', {OWNER}, '_', {PATH}) AS external_id, trim(title) AS title, company, location, url,
 job_type, posted_date, md5(description) AS description_md5 FROM {{jobs}}
UNION ALL SELECT concat('api_jsonld_', {OWNER}, '_inner_', id), concat('Inner ', id), company, NULL, '{CAREER}', NULL, NULL, NULL FROM {{jobs}} WHERE id % 4 = 3""")
def _(t):
    i = F.col("id")
    inner = F.when(i % 4 == 3, F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("Inner "), i.cast("string")).alias("title")))
    item = F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), "title", "description",
        F.when(i % 2 == 0, F.col("url")).alias("url"),
        F.when(i % 2 == 1, F.struct(F.col("url").alias("sameAs"))).alias("hiringOrganization"),
        F.struct(F.struct(F.col("location").alias("addressLocality")).alias("address")).alias("jobLocation"),
        F.col("job_type").alias("employmentType"), F.date_format("posted_date", ISO).alias("datePosted"),
        F.struct(inner.alias("deep")).alias("hasPart"),
    ))
    payload = (
        F.when(i % 4 == 1, F.concat(F.lit("["), item, F.lit("]")))
        .when(i % 4 == 2, F.concat(F.lit('{"@graph":[{"@type":"Organization"},'), item, F.lit("]}")))
        .otherwise(item)
    )
    landed = t("jobs").select("company", payload.alias("payload"), F.lit(CAREER).alias("career_url"))
    return brief(postings.jsonld_postings(landed))


SCRIPTS = r"""
SELECT page_id, len(regexp_extract_all(html, '(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)) AS blocks FROM {career_pages}"""


@query("a10_jsonld_scripts_of_odd_pages", SCRIPTS)
def _(t):
    """Scripts inside comments and other scripts are none: the pages have those they had before these were planted."""
    return t("odd_pages").select("page_id", F.size(postings.jsonld_blocks(F.col("html"))).cast("bigint").alias("blocks"))


@query("a10_jsonld_scripts_of_pages", SCRIPTS)
def _(t):
    return t("career_pages").select("page_id", F.size(postings.jsonld_blocks(F.col("html"))).cast("bigint").alias("blocks"))


@query("a11_feed_postings", """
SELECT company, trim(concat(title, ' & more')) AS title, url FROM {jobs}""")
def _(t):
    i = F.col("id")
    name = F.concat("title", F.lit(" &amp; more"))
    rss = F.concat(F.lit("<item><title><![CDATA["), F.col("title"), F.lit(" & more]]></title><link>"), F.col("url"), F.lit("</link></item>"))
    atom = F.concat(F.lit('<entry><link rel="alternate" href="'), F.col("url"), F.lit('"/><title type="text">'), name, F.lit("</title></entry>"))
    feed = F.concat(F.lit("<?xml version='1.0'?><rss><title>All</title>"), F.when(i % 2 == 0, rss).otherwise(atom), F.lit("</rss>"))
    landed = t("jobs").select("company", feed.alias("payload"), F.lit(CAREER).alias("career_url"))
    return postings.feed_postings(landed).select("company", "title", "url")


@query("a12_sitemap_urls", "SELECT company, url FROM {jobs}")
def _(t):
    entry = F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc><lastmod>x</lastmod></url>"))
    landed = listed(t, entry, F.concat(F.lit("<urlset>"), F.replace("items", F.lit(","), F.lit("\n")), F.lit("</urlset>")), texts=False)
    return postings.sitemap_urls(landed)


CARD_DATES = ["Just posted", "Today", "3 days ago", "30+ days ago", "5 hours ago", ""]


@query("a13_indeed_cards", f"""
SELECT concat('indeed_', id) AS external_id, title, CASE WHEN id % 10 = 0 THEN 'Crawled Co' ELSE company END AS company, location,
 CASE id % 3 WHEN 0 THEN concat('https://www.indeed.com/viewjob?jk=', id) WHEN 1 THEN concat('https://www.indeed.com/rc/', id) ELSE url END AS url,
 CASE id % 3 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Contract work' END AS job_type,
 CASE id % 6 WHEN 0 THEN TIMESTAMP '{TODAY}' WHEN 1 THEN TIMESTAMP '{TODAY}' WHEN 2 THEN TIMESTAMP '{TODAY}' - INTERVAL '3' DAY
  WHEN 3 THEN TIMESTAMP '{TODAY}' - INTERVAL '30' DAY WHEN 4 THEN TIMESTAMP '{TODAY}' - INTERVAL '5' HOUR END AS posted_date,
 md5(description) AS description_md5 FROM {{jobs}}""")
def _(t):
    return brief(postings.card_postings(cards(t), "indeed", TODAY))


def cards(t: Tables):
    i = F.col("id")
    when = F.array(*[F.lit(x) for x in CARD_DATES])
    chips = F.when(i % 3 == 0, F.array(F.lit("$100"), F.lit("Full-time"))).when(i % 3 == 1, F.array(F.lit("Contract work"), F.lit("Part-time")))
    return t("jobs").select(
        i.cast("string").alias("key"), "title",
        F.when(i % 3 == 1, F.concat(F.lit("/rc/"), i.cast("string"))).when(i % 3 == 2, F.col("url")).alias("href"),
        F.when(i % 10 != 0, F.col("company")).alias("company"), F.lit("Crawled Co").alias("crawl_company"), "location",
        F.col("description").alias("snippet"), F.element_at(when, (i % 6 + 1).cast("int")).alias("date_text"),
        F.coalesce(chips, F.array(F.lit("Remote"))).alias("chips"), "posted_date",
    )


@query("a13_linkedin_cards", """
SELECT concat('linkedin_', id) AS external_id, title, CASE WHEN id % 10 = 0 THEN 'Crawled Co' ELSE company END AS company, location,
 CASE id % 3 WHEN 0 THEN concat('https://www.linkedin.com/jobs/view/', id) WHEN 1 THEN concat('https://www.linkedin.com/rc/', id) ELSE url END AS url,
 CASE id % 3 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Contract work' END AS job_type, posted_date, md5(description) AS description_md5 FROM {jobs}""")
def _(t):
    dated = cards(t).withColumn("date_text", F.date_format("posted_date", ISO))
    return brief(postings.card_postings(dated, "linkedin", TODAY))


@query("a14_browser_postings", f"""
SELECT concat('browser_', {OWNER}, '_', CASE WHEN id % 4 = 1 THEN '_careers_list' ELSE {PATH} END) AS external_id, trim(title) AS title, company,
 location, CASE WHEN id % 4 = 1 THEN '{CAREER}' ELSE url END AS url, job_type, CAST(NULL AS TIMESTAMP) AS posted_date, md5(nullif(description, '')) AS description_md5 FROM {{jobs}}""")
def _(t):
    i = F.col("id")
    place = F.to_json(F.struct(F.when(i % 3 == 0, F.col("location")).alias("name"), F.when(i % 3 == 1, F.col("location")).alias("addressLocality")))
    whole = F.to_json(F.struct(
        F.when(i % 2 == 0, F.col("title")).alias("title"), F.when(i % 2 == 1, F.col("title")).alias("name"),
        F.when(i % 4 != 1, F.col("url")).alias("href"), F.when(i % 3 == 2, F.col("location")).alias("location"),
        F.col("description").alias("summary"), F.col("job_type").alias("type"),
    ))
    boxed = F.concat(F.lit('{"location":'), place, F.lit(","), F.substr(whole, F.lit(2)))
    landed = listed(t, F.when(i % 3 == 2, whole).otherwise(boxed)).withColumn("career_url", F.lit(CAREER))
    return brief(postings.browser_postings(landed))


@query("a15_search_recipes", """
SELECT name, keywords, location, remote_only, job_type FROM {search_criteria}""")
def _(t):
    item = F.struct("name", "keywords", "location", "remote_only", "job_type")
    files = t("search_criteria").groupBy(F.floor(F.col("id") / 10).alias("file")).agg(
        F.to_json(F.struct(F.collect_list(item).alias("recipes"))).alias("payload")
    )
    return documents.recipes(files).select("name", "keywords", "location", "remote_only", "job_type")


@query("a16_document_statistics", r"""
SELECT id, length(content) AS char_count, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS word_count FROM {user_documents}""")
def _(t):
    out = documents.document_statistics(t("user_documents"))
    return out.select("id", F.col("char_count").cast("bigint").alias("char_count"), F.col("word_count").cast("bigint").alias("word_count"))


@query("a16_csv_documents", """
SELECT CAST(floor(seq / 5) AS BIGINT) AS id,
 string_agg(concat(trim(name), ', ', CASE WHEN seq % 4 = 0 THEN concat(notes, ',', chr(10), 'second line', CASE WHEN seq % 40 = 0 THEN repeat(' "x"', 25000) ELSE '' END) ELSE coalesce(notes, '') END, ', ', priority), chr(10) ORDER BY seq) AS text,
 CAST(count(*) AS INT) AS row_count, 3 AS column_count FROM {company_records} GROUP BY 1""")
def _(t):
    def cell(value):
        return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))

    notes = F.when(F.col("seq") % 4 == 0, F.concat(F.coalesce("notes", F.lit("")), F.lit(",\nsecond line"), F.when(F.col("seq") % 40 == 0, F.repeat(F.lit(' "x"'), 25000)).otherwise(""))).otherwise(F.coalesce("notes", F.lit("")))
    line = F.concat_ws(",", cell(F.col("name")), cell(notes), F.col("priority").cast("string"))
    files = t("company_records").groupBy(F.floor(F.col("seq") / 5).alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("content")
    )
    return documents.csv_documents(files).select("id", "text", "row_count", "column_count")


@query("a17_new_table_version", """
SELECT status, count(*) AS jobs FROM (SELECT CASE WHEN discovered_at < TIMESTAMP '2001-08-02 00:00:00' - INTERVAL '90' DAY AND archived_at IS NULL
 AND status NOT IN ('applied','interviewing','accepted') THEN 'archived' ELSE status END AS status FROM {jobs}) GROUP BY 1""")
def _(t):
    from vacantia.operators.transitions import archive_jobs
    from vacantia.plans.views import AS_OF
    from vacantia.session import work_path
    from vacantia.sources.tables import scan, write_version

    changed = archive_jobs(t("jobs").drop("description"), AS_OF)
    path = write_version(changed, work_path(t.spark, "jobs"))
    return scan(t.spark, path).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


SPA = r"""<div[^>]*id=["''](root|app|__next)["'']|react|vue|angular|__next_data__|__react_query_state__|window\.__initial_state__|ng-app"""


METHODS = rf"""
WITH s AS (SELECT page_id, url, html, lower(html) AS low, trim(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '<[^>]*>', '', 'g')) AS txt FROM {{career_pages}}),
f AS (SELECT *, CAST(len(regexp_extract_all(low, '<script[^>]+src=')) AS INT) AS external_scripts, regexp_matches(low, '{SPA}') AS is_spa, CAST(length(txt) AS INT) AS text_chars FROM s)
SELECT page_id, external_scripts, is_spa, text_chars, CASE
 WHEN contains(html, 'greenhouse.io') AND regexp_extract(html, 'greenhouse\.io/([^/"'']+)', 1) NOT IN ('', 'jobs', 'careers', 'openings', 'boards-api') THEN 'api'
 WHEN contains(html, 'api.lever.co') AND regexp_matches(html, 'lever\.co/v0/postings/[^/"'']+|jobs\.lever\.co/[^/"'']+') THEN 'api'
 WHEN contains(html, 'workday.com') OR contains(html, 'myworkdayjobs.com') THEN 'api'
 WHEN contains(html, 'application/ld+json') AND regexp_matches(html, '"@type": ?"JobPosting"') THEN 'api'
 WHEN regexp_matches(html, '(?i)["''][^"'']*(api[^"'']*jobs|jobs[^"'']*api|api[^"'']*positions)[^"'']*\.json["'']|fetch\(["''][^"'']*api[^"'']*jobs[^"'']*["'']') THEN 'api'
 WHEN is_spa OR (text_chars < 500 AND regexp_matches(lower(txt), 'job|career')) OR external_scripts > 5 THEN 'browser'
 WHEN regexp_matches(lower(txt), 'job|position|career|opening|role')
  AND regexp_matches(low, '(class|id)=["''][^"'']*job|class=["''][^"'']*(position|opening)|<article\b|class=["'']([^"'']* )?listing[ "'']') THEN 'html' ELSE 'generic' END AS method FROM f"""


@query("g21_methods_of_odd_pages", METHODS)
def _(t):
    """Tags in comments, scripts and quoted values change nothing."""
    return pages.page_methods(t("odd_pages")).select("page_id", "external_scripts", "is_spa", "text_chars", "method")


@query("g21_page_methods", METHODS)
def _(t):
    return pages.page_methods(t("career_pages")).select("page_id", "external_scripts", "is_spa", "text_chars", "method")


@query("g21_api_kinds", r"""
SELECT page_id, CASE WHEN contains(html, 'greenhouse.io') THEN 'greenhouse' WHEN contains(html, 'lever.co') THEN 'lever' WHEN page_id % 5 = 1 THEN 'workday'
 WHEN page_id % 5 IN (0, 3) THEN 'jsonld' WHEN page_id % 5 = 2 THEN 'custom_json' END AS api_type FROM {pages}""")
def _(t):
    return pages.page_methods(t("career_pages")).select("page_id", "api_type")
