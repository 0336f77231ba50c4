"""Joins between postings, companies, searches, tasks, documents and logs.

Children are aggregated before they meet their parent, so nothing fans out and
hot keys shrink map-side. No side is forced into a broadcast: Spark broadcasts
by measured size and AQE splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, scores, text, urls
from vacantia.operators.filters import desc
from vacantia.operators.scale import top_rows
from vacantia.session import settled

#: Threshold of the task generator.
TASK_SCORE = 50
#: Longest exact gram of the keyword index; longer keywords are checked again.
GRAM = 12


def child_counts(children: DataFrame, key: str, name: str) -> DataFrame:
    return children.groupBy(F.col(key).alias("_parent")).agg(F.count(F.lit(1)).alias(name))


def with_counts(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """Parents with one count column per child table, 0 where there are none."""
    for name, (frame, child_key) in children.items():
        counts = child_counts(frame, child_key, name)
        parents = parents.join(counts, parents[key] == counts["_parent"], "left").drop("_parent")
        parents = parents.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return parents


def score_discrepancy(jobs: DataFrame, feedback: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Mean of AI score minus the user's score; a mean of exactly 0 is NULL."""
    since = dates.plus(dates.ts(as_of), -days, "day")
    told = dates.in_range(feedback, "created_at", since=since).filter(F.col("ai_match_score_actual").isNotNull())
    scored = jobs.filter(F.col("ai_match_score").isNotNull()).select(F.col("id").alias("job_id"), "ai_match_score")
    gap = F.avg(F.col("ai_match_score") - F.col("ai_match_score_actual"))
    return told.join(scored, "job_id").agg(F.nullif(gap, F.lit(0.0)).alias("avg_discrepancy"))


def jobs_to_review(jobs: DataFrame, feedback: DataFrame, limit: int = 10) -> DataFrame:
    """Postings with negative or low feedback, one row per feedback, latest first."""
    bad = feedback.filter(F.col("feedback_value").isin("negative", "low")).select(
        F.col("id").alias("feedback_id"), "job_id", F.col("created_at").alias("feedback_at")
    )
    rows = bad.join(jobs, bad["job_id"] == jobs["id"])
    return top_rows(rows, [desc("feedback_at"), F.col("feedback_id")], limit)


def jobs_per_company(companies: DataFrame, jobs: DataFrame, limit: int | None = 10) -> DataFrame:
    out = with_counts(companies.select("id", "name"), "id", job_count=(jobs, "company_id"))
    return top_rows(out, [F.col("job_count").desc(), F.col("id")], limit)


def logs_with_company(logs: DataFrame, companies: DataFrame) -> DataFrame:
    named = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), "crawler_type")
    out = logs.join(named, "company_id", "left")
    known = F.col("company_name").isNotNull()
    return out.withColumn("crawler_class", F.when(known, urls.crawler_class(F.col("crawler_type"))))


def applied_without_follow_up(jobs: DataFrame, follow_ups: DataFrame) -> DataFrame:
    applied = jobs.filter((F.col("status") == "applied") & ~F.col("is_new"))
    open_ones = follow_ups.filter(~F.col("completed")).select(F.col("job_id").alias("id"))
    return applied.join(open_ones, "id", "left_anti")


def action_recommendations(jobs: DataFrame, tasks: DataFrame, limit: int = 10, threshold: float = TASK_SCORE) -> DataFrame:
    """The best scored new postings among those without any task."""
    fit = jobs.filter((F.col("ai_match_score") >= threshold) & (F.col("status") == "new"))
    free = fit.join(tasks.select(F.col("job_id").alias("id")), "id", "left_anti")
    high = F.col("ai_match_score") >= 75
    out = free.filter(F.col("ai_match_score") >= 50).select(
        F.col("id").alias("job_id"),
        F.col("title").alias("job_title"),
        "company",
        F.col("ai_match_score").alias("match_score"),
        F.when(high, "apply").otherwise("research").alias("recommended_action"),
        F.when(high, "high").otherwise("medium").alias("priority"),
        F.when(high, "High match score - immediate action recommended")
        .otherwise("Medium match - research recommended before applying")
        .alias("reason"),
    )
    return top_rows(out, [F.col("match_score").desc(), F.col("job_id")], limit)


def follow_up_recommendations(jobs: DataFrame, tasks: DataFrame, limit: int | None = 10) -> DataFrame:
    """The latest of the applied postings that have no follow-up task."""
    done = tasks.filter(F.col("task_type") == "follow_up").select(F.col("job_id").alias("id"))
    lacking = jobs.filter(F.col("status") == "applied").join(done, "id", "left_anti")
    return top_rows(lacking, [desc("updated_at"), F.col("id")], limit).select(
        F.col("id").alias("job_id"),
        F.col("title").alias("job_title"),
        "company",
        F.col("ai_match_score").alias("match_score"),
        F.lit("follow_up").alias("recommended_action"),
        F.lit("high").alias("priority"),
        F.lit("Application submitted - follow-up recommended").alias("reason"),
        "updated_at",
    )


def known_names(companies: DataFrame, pending: DataFrame) -> DataFrame:
    """Distinct lower-case names of companies and of companies waiting for review."""
    waiting = pending.filter(F.col("status") == "pending")
    both = companies.select("name").union(waiting.select("name"))
    return both.select(F.lower("name").alias("known_name")).distinct()


def unknown_companies(records: DataFrame, companies: DataFrame, pending: DataFrame) -> DataFrame:
    names = known_names(companies, pending)
    return records.join(names, F.lower(F.trim(records["name"])) == names["known_name"], "left_anti")


def _targets(searches: DataFrame) -> Column:
    return F.coalesce(F.col("target_companies"), F.array().cast("array<bigint>"))


def search_targets(searches: DataFrame, companies: DataFrame) -> DataFrame:
    """(search_id, company_id) of active targets; a search without targets has one row with a NULL company, for all active ones."""
    active = companies.filter("is_active").select(F.col("id").alias("company_id"))
    live = searches.filter("is_active").select(F.col("id").alias("search_id"), _targets(searches).alias("targets"))
    named = live.select("search_id", F.explode(F.array_distinct("targets")).alias("company_id")).join(active, "company_id")
    everywhere = live.filter(F.size("targets") == 0).select("search_id", F.lit(None).cast("bigint").alias("company_id"))
    return named.select("search_id", "company_id").unionByName(everywhere)


def missing_targets(searches: DataFrame, companies: DataFrame) -> DataFrame:
    """Targets of saved searches that name no company, as one sorted array per search."""
    wanted = searches.select(F.col("id").alias("search_id"), F.explode(F.array_distinct(_targets(searches))).alias("id"))
    gone = wanted.join(companies.select("id"), "id", "left_anti")
    # one search row held the array, so the regrouped array is no longer than it
    return gone.groupBy("search_id").agg(F.sort_array(F.collect_list("id")).alias("missing_ids"))


@dataclass(frozen=True)
class Standing:
    """Saved searches made ready for matching: written once, used for every landing of postings."""

    live: DataFrame  # one row per kind of search, as the one with the smallest id
    members: DataFrame  # every search with the one it is like
    keywords: DataFrame  # distinct keywords with their grams
    sizes: tuple[int, ...]  # lengths of the grams, at most GRAM of them
    active: DataFrame  # companies that are looked at


def standing(searches: DataFrame, companies: DataFrame) -> Standing:
    """Active searches by what they ask for; searches that ask for the same are matched once."""
    asked = searches.filter("is_active").select(
        F.col("id").alias("search_id"),
        F.array_sort(F.array_distinct(text.keyword_tokens(F.col("keywords")))).alias("tokens"),
        F.coalesce(F.col("remote_only"), F.lit(False)).alias("remote_only"),
        F.lower(F.coalesce(F.col("job_type"), F.lit(""))).alias("wanted_type"),
        F.array_sort(F.array_distinct(_targets(searches))).alias("targets"),
    )
    signature = ["tokens", "remote_only", "wanted_type", "targets"]
    live = settled(asked.groupBy(*signature).agg(F.min("search_id").alias("search_id")), "searches")
    members = asked.join(live.withColumnRenamed("search_id", "_like"), signature).select(F.col("search_id").alias("_member"), "_like")
    words = live.select(F.explode("tokens").alias("keyword")).distinct()
    keywords = settled(words.withColumn("gram", F.substring("keyword", 1, GRAM)), "keywords")
    sizes = sorted(r["n"] for r in keywords.select(F.length("gram").alias("n")).distinct().collect())
    active = settled(companies.filter("is_active").select(F.col("id").alias("company_id")), "active")
    return Standing(live, settled(members, "members"), keywords, tuple(sizes), active)


def _body() -> Column:
    return F.concat_ws(" ", F.lower(F.coalesce(F.col("title"), F.lit(""))), F.lower(F.coalesce(F.col("description"), F.lit(""))))


def said(jobs: DataFrame) -> DataFrame:
    """Postings with the digest of their description (``said``) and the file it lies in; descriptions from elsewhere stay in hand."""
    named = jobs.withColumn("said", F.unhex(F.md5("description"))).withColumn("file", F.input_file_name())
    return named.withColumn("description", F.when(F.col("file") == "", F.col("description")))


def keyword_hits(jobs: DataFrame, index: Standing, texts: DataFrame | None = None) -> DataFrame:
    """(job_id, keyword): postings whose title or description contains a keyword.

    With ``texts`` (said, description) postings bring the digests of their
    descriptions: texts are looked through where they lie, and only the keywords
    found meet the postings.
    """
    if texts is None:
        return _heard(jobs.select(F.col("id").alias("job_id"), _body().alias("body")), "job_id", index)
    own = _heard(jobs.select(F.col("id").alias("job_id"), F.lower(F.coalesce("title", F.lit(""))).alias("body")), "job_id", index)
    read = settled(_heard(texts.select("said", F.lower("description").alias("body")), "said", index), "text-keywords")
    return own.unionByName(jobs.select(F.col("id").alias("job_id"), "said").join(read, "said").select("job_id", "keyword")).distinct()


def _heard(bodies: DataFrame, key: str, index: Standing) -> DataFrame:
    """(key, keyword) of the bodies that contain a keyword.

    A keyword has no white space, so it lies inside one word of the text. Words
    are matched once per distinct word through an equi-join on grams, and the
    matching words are joined back to the bodies that hold them.
    """
    # repeats of a word within a text fall to the map-side combine of the two distincts
    words = bodies.select(key, F.explode(F.split("body", text.PY_SPACE)).alias("word"))
    vocabulary = words.select("word").filter(F.col("word") != "").distinct()

    def cuts(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("word") - (n - 1))
        made = F.transform(starts, lambda p: F.substring(F.col("word"), p, F.lit(n)))
        return F.when(F.length("word") >= n, made).otherwise(F.array().cast("array<string>"))

    nothing = F.array().cast("array<string>")
    by_gram = vocabulary.select("word", F.explode(F.concat(nothing, *[cuts(n) for n in index.sizes])).alias("gram"))
    pairs = by_gram.join(index.keywords, "gram").filter(F.contains(F.col("word"), F.col("keyword"))).select("word", "keyword")
    pairs = settled(pairs, "keyword-words")
    return words.join(pairs, "word").select(key, "keyword").distinct()


def _posts(jobs: DataFrame, index: Standing) -> DataFrame:
    return jobs.select(
        F.col("id").alias("job_id"),
        "company_id",
        text.is_remote_location(F.col("location")).alias("is_remote"),
        F.lower(F.coalesce(F.col("job_type"), F.lit(""))).alias("type"),
    ).join(index.active, "company_id", "left_semi")


def _fits() -> Column:
    return (~F.col("remote_only") | F.col("is_remote")) & ((F.col("wanted_type") == "") | F.contains(F.col("type"), F.col("wanted_type")))


def posting_matches(index: Standing, jobs: DataFrame) -> DataFrame:
    """(search_id, job_id) of the searches that name words or companies and the postings they accept.

    The work grows with the postings given: distinct words, and rows that match.
    """
    posts = _posts(jobs, index)
    wanted = index.live.select("search_id", "targets", "remote_only", "wanted_type", F.explode("tokens").alias("keyword"))
    hits = keyword_hits(jobs, index).join(posts, "job_id")
    # searches with words: by word and company, or by word alone where every company will do
    named = wanted.filter(F.size("targets") > 0).withColumn("company_id", F.explode("targets")).drop("targets")
    open_ones = wanted.filter(F.size("targets") == 0).drop("targets")
    shown = ["search_id", "job_id", "remote_only", "is_remote", "wanted_type", "type"]
    worded = named.join(hits, ["keyword", "company_id"]).select(*shown).unionByName(open_ones.join(hits, "keyword").select(*shown))
    # searches without words: through their companies
    silent = index.live.filter(F.size("tokens") == 0).drop("tokens")
    scoped = silent.withColumn("company_id", F.explode("targets")).join(posts, "company_id").select(*shown)
    columns = ["search_id", "job_id"]
    found = worded.filter(_fits()).select(*columns).distinct().unionByName(scoped.filter(_fits()).select(*columns))
    return found.join(index.members, found["search_id"] == index.members["_like"]).select(F.col("_member").alias("search_id"), "job_id")


def matched_cells(index: Standing, jobs: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cell, job_id) and (search_id, cell): the pairs of ``posting_matches``, not multiplied out.

    Postings that no search tells apart share a cell: those with the same keywords,
    company, kind of place and type. Searches are met by cells, of which there are
    at most as many as postings. The search is the one that stands for all like it
    (``members``). ``texts`` as in ``keyword_hits``.
    """
    posts = _posts(jobs, index)
    place = ["company_id", "is_remote", "type"]
    # a posting id that comes with several companies or types is one posting
    shown = posts.groupBy("job_id").agg(F.sort_array(F.collect_set(F.struct(*place))).alias("posts"))
    heard = keyword_hits(jobs, index, texts).groupBy("job_id").agg(F.sort_array(F.collect_set("keyword")).alias("keywords"))
    alike = heard.join(shown, "job_id").withColumn("cell", F.md5(F.to_json(F.struct("keywords", "posts"))))
    alike = settled(alike.select("job_id", "cell", "keywords", "posts"), "worded-postings")
    cells = alike.select("cell", "keywords", "posts").distinct()
    cells = settled(cells.select("cell", "keywords", F.inline("posts")).withColumn("keyword", F.explode("keywords")).drop("keywords"), "worded-cells")
    wanted = index.live.select("search_id", "targets", "remote_only", "wanted_type", F.explode("tokens").alias("keyword"))
    named = wanted.filter(F.size("targets") > 0).withColumn("company_id", F.explode("targets")).drop("targets")
    open_ones = wanted.filter(F.size("targets") == 0).drop("targets")
    fits = [frame.filter(_fits()).select("search_id", "cell") for frame in (named.join(cells, ["keyword", "company_id"]), open_ones.join(cells, "keyword"))]
    worded = fits[0].unionByName(fits[1]).distinct()
    # searches without words: through their companies
    silent = index.live.filter(F.size("tokens") == 0).drop("tokens").withColumn("company_id", F.explode("targets"))
    dealt = posts.select("job_id", *place, F.md5(F.to_json(F.struct(*place))).alias("cell"))
    bare = settled(dealt.select("cell", *place).distinct(), "cells")
    scoped = silent.join(bare, "company_id").filter(_fits()).select("search_id", "cell")
    # only the companies of searches without words have cells of their own
    quiet = dealt.join(scoped.select("cell").distinct(), "cell", "left_semi")
    return alike.select("cell", "job_id").unionByName(quiet.select("cell", "job_id")), worded.unionByName(scoped)


def matched_totals(index: Standing, postings: DataFrame, hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(search_id, matches, id_sum) from what ``matched_cells`` gave, without a row per pair; ``by`` keeps landings apart."""
    sums = postings.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("job_id").alias("ids"))
    each = hits.join(settled(sums, "cell-sums"), [*by, "cell"]).groupBy("search_id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    every = each.join(index.members, each["search_id"] == index.members["_like"])
    return every.groupBy(F.col("_member").alias("search_id")).agg(F.sum("n").alias("matches"), F.sum("ids").alias("id_sum"))


def open_searches(index: Standing) -> DataFrame:
    """(search_id, remote_only, wanted_type) of searches without words and companies: they take whatever fits."""
    every = index.live.filter((F.size("tokens") == 0) & (F.size("targets") == 0))
    return every.join(index.members, every["search_id"] == index.members["_like"]).select(F.col("_member").alias("search_id"), "remote_only", "wanted_type")


def open_search_totals(index: Standing, jobs: DataFrame) -> DataFrame:
    """(search_id, matches, id_sum) of the open searches, from one row per kind of posting."""
    cells = _posts(jobs, index).groupBy("is_remote", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("job_id").alias("ids"))
    kinds = open_searches(index).select("remote_only", "wanted_type").distinct()
    sums = kinds.join(settled(cells, "cells"), _fits()).groupBy("remote_only", "wanted_type").agg(F.sum("n").alias("matches"), F.sum("ids").alias("id_sum"))
    return open_searches(index).join(sums, ["remote_only", "wanted_type"]).select("search_id", "matches", "id_sum")


def search_matches(searches: DataFrame, jobs: DataFrame, companies: DataFrame, since: Column | None = None) -> DataFrame:
    """(search_id, job_id) of active saved searches and the postings they accept, or those discovered ``since``.

    A search that names neither words nor companies is one row with a NULL
    posting: it takes whatever fits, and is not paired with every posting.
    """
    if since is not None:
        jobs = dates.in_range(jobs, "discovered_at", since=since)
    index = standing(searches, companies)
    every = open_searches(index).select("search_id", F.lit(None).cast("bigint").alias("job_id"))
    return posting_matches(index, jobs).unionByName(every)


def job_context(jobs: DataFrame, sections: Mapping[str, DataFrame], job_id: int | None = None) -> DataFrame:
    """Everything known about a posting, one row per item and section.

    Each section frame has ``job_id, item_id, at, label``. Rows, not arrays: a
    posting with very many items stays spread over tasks.
    """
    head = jobs.select("id", F.col("title").alias("job_title"), F.col("status").alias("job_status"))
    if job_id is not None:
        head = head.filter(F.col("id") == job_id)
    items = None
    for name, frame in sections.items():
        part = frame.select("job_id", F.lit(name).alias("section"), "item_id", "at", "label")
        items = part if items is None else items.unionByName(part)
    return items.join(head, items["job_id"] == head["id"]).drop("id")


def follow_ups_soon(follow_ups: DataFrame, jobs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    now = dates.ts(as_of)
    soon = follow_ups.filter(
        ~F.col("completed")
        & F.col("follow_up_date").between(now, dates.plus(now, hours, "hour"))
    )
    named = jobs.select(F.col("id").alias("job_id"), F.col("title").alias("job_title"), "company", "location")
    urgent = dates.seconds_between(now, F.col("follow_up_date")) < 3600
    return soon.join(named, "job_id").withColumn("priority", F.when(urgent, "high").otherwise("medium"))


def crawl_totals(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per company: last crawl ever, crawls and completed crawls of the last days."""
    now = dates.ts(as_of)
    recent = F.col("started_at") >= dates.plus(now, -days, "day")
    return (
        logs.filter(F.col("started_at") < now)
        .groupBy("company_id")
        .agg(
            F.max("started_at").alias("last_crawl_at"),
            F.count_if(recent).alias("total_crawls_30d"),
            F.count_if(recent & (F.col("status") == "completed")).alias("successful_crawls_30d"),
        )
    )


def companies_with_automation(companies: DataFrame, logs: DataFrame, as_of: str, active_only: bool = False) -> DataFrame:
    """Companies with their crawl totals, success rate and health class."""
    if active_only:
        companies = companies.filter("is_active")
    totals = crawl_totals(logs, as_of)
    out = companies.join(totals, companies["id"] == totals["company_id"], "left").drop("company_id")
    for name in ("total_crawls_30d", "successful_crawls_30d"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    rate = scores.percentage(F.col("successful_crawls_30d"), F.col("total_crawls_30d"))
    empty, viability = F.col("consecutive_empty_crawls"), F.col("viability_score")
    return (
        out.withColumn("_rate", rate)
        .withColumn("success_rate", F.bround("_rate", 1))
        .withColumn(
            "health_status",
            scores.company_health(F.col("is_active"), empty, F.col("_rate"), viability, F.col("total_crawls_30d")),
        )
        .withColumn("needs_attention", scores.needs_attention(empty, F.col("_rate"), viability))
        .drop("_rate")
    )


def with_job(children: DataFrame, jobs: DataFrame, *columns: str) -> DataFrame:
    """Children with ``job_<column>`` of their posting, NULL where it is gone."""
    named = jobs.select(F.col("id").alias("job_id"), *[F.col(c).alias(f"job_{c}") for c in columns])
    return children.join(named, "job_id", "left")


def recent_with_job(children: DataFrame, jobs: DataFrame, order: list[Column], limit: int = 50) -> DataFrame:
    """The first ``limit`` children in order, with the posting's title."""
    return with_job(top_rows(children, order, limit), jobs, "title")
