"""Rankings, streaks, versions and ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import dates
from vacantia.operators.filters import desc
from vacantia.operators.scale import keep_first, ordinals, salted_join, top_rows
from vacantia.session import settled

DEFAULT_CRAWL_SECONDS = 30


def daily_top(jobs: DataFrame, as_of: str, count: int = 5) -> DataFrame:
    """Best scored postings of the day with rank 1..N."""
    now = dates.ts(as_of)
    found = dates.in_range(jobs, "discovered_at", since=F.date_trunc("day", now), through=now)
    today = found.filter(F.col("ai_match_score").isNotNull())
    order = [F.col("ai_match_score").desc(), F.col("discovered_at").desc(), F.col("id")]
    best = today.orderBy(*order).limit(count * 3)
    # at most 3 x count rows reach this window
    ranked = best.withColumn("ai_rank", F.row_number().over(Window.orderBy(*order)))
    return (
        ranked.filter(F.col("ai_rank") <= count)
        .withColumn("ai_selected_date", now)
        .withColumn("ai_recommended", F.lit(True))
    )


def rank_latest(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """All postings with a description, or the newest ``limit`` of them, best score first."""
    newest = top_rows(jobs.filter(F.col("description").isNotNull()), [desc("discovered_at"), F.col("id")], limit)
    return newest.orderBy(F.coalesce("ai_match_score", F.lit(0.0)).desc(), "id")


def latest_per_company(jobs: DataFrame, count: int = 10) -> DataFrame:
    return keep_first(jobs, ["company_id"], [desc("discovered_at"), F.col("id")], count)


def numbered_versions(documents: DataFrame) -> DataFrame:
    """Versions 1..n per posting and type where missing; the last is current.

    Only the keys are sorted and numbered; the documents meet their numbers by id.
    """
    order = [F.col("generated_at").asc_nulls_first(), F.col("id")]
    keys = documents.select("id", "job_id", "document_type", "generated_at")
    numbers = ordinals(keys, ["job_id", "document_type"], order, name="_position", size="_versions")
    placed = documents.join(numbers.select("id", "_position", "_versions"), "id")
    missing = F.coalesce("version", F.lit(0)) == 0
    return (
        placed.withColumn("version", F.when(missing, F.col("_position").cast("int")).otherwise(F.col("version")))
        .withColumn("is_current", F.col("_position") == F.col("_versions"))
        .drop("_position", "_versions")
    )


def new_versions(documents: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """Documents after adding one new version per request.

    ``requests``: ``job_id, document_type, content, parent_version_id``, at most
    one per posting and type. The new version follows its parent, or the highest
    version; earlier versions are no longer current and stay as they are otherwise,
    with all their columns. ``id`` of a new row is NULL.
    """
    keys = ["job_id", "document_type"]
    top = documents.groupBy(*keys).agg(F.max("version").alias("_top"))
    parents = documents.select(F.col("id").alias("parent_version_id"), F.col("version").alias("_parent"))
    wanted = requests.join(top, keys, "left").join(parents, "parent_version_id", "left")
    after = F.when(F.col("parent_version_id").isNotNull(), F.coalesce(F.col("_parent") + 1, F.lit(1))).otherwise(
        F.coalesce(F.col("_top") + 1, F.lit(1))
    )
    fresh = wanted.select(
        F.lit(None).cast("bigint").alias("id"), *keys, "content",
        dates.ts(as_of).alias("generated_at"), after.cast("int").alias("version"),
        F.col("parent_version_id"), F.lit(True).alias("is_current"),
    )
    touched = requests.select(*keys, F.lit(True).alias("_touched")).distinct()
    old = documents.join(touched, keys, "left").withColumn("is_current", F.col("is_current") & F.col("_touched").isNull()).drop("_touched")
    if "parent_version_id" not in documents.columns:
        old = old.withColumn("parent_version_id", F.lit(None).cast("bigint"))
    return old.unionByName(fresh, allowMissingColumns=True)


def restore_requests(documents: DataFrame, document_ids: DataFrame) -> DataFrame:
    """Requests for :func:`new_versions` that bring back old documents."""
    return documents.join(document_ids.select("id"), "id", "left_semi").select(
        "job_id", "document_type", "content", F.col("id").alias("parent_version_id")
    )


def current_documents(documents: DataFrame) -> DataFrame:
    return documents.filter("is_current").orderBy("job_id", desc("generated_at"), "id")


def document_versions(documents: DataFrame, job_id: int | None = None, document_type: str | None = None) -> DataFrame:
    if job_id is not None:
        documents = documents.filter(F.col("job_id") == job_id)
    if document_type is not None:
        documents = documents.filter(F.col("document_type") == document_type)
    return documents.orderBy("job_id", "document_type", desc("version"), desc("generated_at"), "id")


def discovery_order(records: DataFrame, limit: int | None = 100) -> DataFrame:
    linkedin, indeed = F.col("source") == "linkedin", F.col("source") == "indeed"
    return top_rows(records, [F.col("priority").desc(), linkedin.desc(), indeed.desc(), F.col("seq")], limit)


def rows_since_last(
    rows: DataFrame, keys: list[str], reset: Column, order: list[str], tops: DataFrame | None = None
) -> DataFrame:
    """Rows of each key after its last ``reset`` row in ``order``.

    ``order[0]`` is a plain time, so its last reset per key is a hash aggregate.
    It is settled: small, it filters the rows without a shuffle; large, the rows
    meet it through a salted join. The other order columns then decide among the
    rows of that one time. No key is ever sorted as a whole. ``tops`` may bring
    the last times (``keys``, ``_top``) when they are known already.
    """
    head = F.col(order[0])
    if tops is None:
        tops = settled(rows.filter(reset).groupBy(*keys).agg(F.max(head).alias("_top")), "last-reset")
    tail = salted_join(rows, tops, keys, "left").filter(F.col("_top").isNull() | (head >= F.col("_top")))
    place = F.struct(*[F.col(c) for c in order])
    last = settled(tail.filter(reset).groupBy(*keys).agg(F.max(place).alias("_last")), "last-place")
    out = salted_join(tail.drop("_top"), last, keys, "left")
    return out.filter(F.col("_last").isNull() | (place > F.col("_last"))).drop("_last")


def empty_crawl_streaks(logs: DataFrame, as_of: str, order: list[str]) -> DataFrame:
    """Per company: crawls since the last one with new postings, that time, and totals."""
    done = logs.filter((F.col("started_at") < dates.ts(as_of)) & (F.col("status") != "running"))
    done = done.select("company_id", "status", "new_jobs", "completed_at", *[c for c in order if c != "company_id"])
    found = (F.col("status") == "completed") & (F.col("new_jobs") > 0)
    totals = done.groupBy("company_id").agg(
        F.max("started_at").alias("last_crawled_at"),
        F.max(F.when(found, F.col("completed_at"))).alias("last_successful_crawl"),
        F.coalesce(F.sum(F.when(found, F.col("new_jobs"))), F.lit(0)).cast("bigint").alias("jobs_found_total"),
        F.max(F.when(found, F.col(order[0]))).alias("_top"),
    )
    totals = settled(totals, "crawl-totals")
    tops = totals.select("company_id", "_top").filter(F.col("_top").isNotNull())
    streak = rows_since_last(done, ["company_id"], found, order, tops).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("consecutive_empty_crawls")
    )
    out = totals.drop("_top").join(streak, "company_id", "left")
    return out.withColumn("consecutive_empty_crawls", F.coalesce("consecutive_empty_crawls", F.lit(0)))


def crawl_eta(logs: DataFrame, companies: DataFrame, as_of: str, order: list[str], window: int = 10) -> DataFrame:
    """Mean of the last ten durations and the time the active companies will take."""
    from vacantia.operators.aggregates import one_row

    past = logs.filter((F.col("started_at") < dates.ts(as_of)) & F.col("completed_at").isNotNull())
    last = past.orderBy(F.col("completed_at").desc(), *[F.col(c) for c in order]).limit(window)
    mean = last.agg(F.avg(dates.seconds_between(F.col("started_at"), F.col("completed_at"))).alias("avg_duration"))
    both = one_row(mean, companies.agg(F.count_if("is_active").alias("remaining")))
    known = F.coalesce("avg_duration", F.lit(float(DEFAULT_CRAWL_SECONDS)))
    return both.select(known.alias("avg_duration"), "remaining", F.floor(known * F.col("remaining")).alias("eta_seconds"))


def moving_durations(logs: DataFrame, as_of: str, order: list[str], window: int = 10) -> DataFrame:
    """Every finished crawl with the mean duration of itself and the ``window - 1`` finished before it.

    All crawls are one sequence. Each gets its position in it, positions are cut
    into blocks of at least a thousand, and the last rows of a block are also given
    to the next one, so that every mean is found inside one block.
    """
    past = logs.filter((F.col("started_at") < dates.ts(as_of)) & F.col("completed_at").isNotNull())
    took = dates.seconds_between(F.col("started_at"), F.col("completed_at"))
    rows = past.select("company_id", *[c for c in order if c != "company_id"], "completed_at", took.alias("duration"), F.lit(0).alias("_all"))
    time = [F.col("completed_at"), *[F.col(c).desc() for c in order]]
    return moving_means(rows, ["_all"], time, "duration", "avg_duration", window).drop("_all")


def moving_means(rows: DataFrame, keys: list[str], order: list[Column], value: str, name: str, window: int) -> DataFrame:
    """``name``: mean of the last ``window`` values of a key up to each row, also for keys too big for a task."""
    size = max(1000, window)
    placed = ordinals(rows, keys, order, name="_at").withColumn("_block", F.floor((F.col("_at") - 1) / size))
    # rows that the next block needs are in both
    ahead = F.when((F.col("_at") - 1) % size > size - window, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = placed.withColumn("_ahead", F.explode(ahead)).withColumn("_block", F.col("_block") + F.col("_ahead"))
    last = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(1 - window, 0)
    return spread.withColumn(name, F.avg(value).over(last)).filter("_ahead = 0").drop("_at", "_block", "_ahead")


def last_seen_ids(jobs: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` external ids of each company, newest first; the list is one value, so the caller bounds it."""
    filled = jobs.filter(F.coalesce("external_id", F.lit("")) != "").select("company_id", "external_id", "discovered_at", "id")
    newest = keep_first(filled, ["company_id"], [F.col("discovered_at").desc_nulls_last(), F.col("id")], cap)
    place = F.struct((-F.unix_micros("discovered_at")).alias("t"), "id", "external_id")
    return newest.groupBy("company_id").agg(
        F.transform(F.sort_array(F.collect_list(place)), lambda s: s["external_id"]).alias("last_seen_ids")
    )


def capped_records(records: DataFrame, cap: int | None = None) -> DataFrame:
    """Records with results, then priority, then name — all descending — up to the caller's cap."""
    order = [F.col("has_crawl_results").desc(), F.col("priority").desc(), F.lower("name").desc(), F.col("seq")]
    return top_rows(records, order, cap)


def top_list(jobs: DataFrame, limit: int = 10) -> DataFrame:
    return top_rows(jobs.filter(F.col("ai_match_score") >= 70), [F.col("ai_match_score").desc(), F.col("id")], limit)


def newest_list(jobs: DataFrame, limit: int = 10, new_only: bool = False) -> DataFrame:
    kept = jobs.filter("is_new") if new_only else jobs
    return top_rows(kept, [desc("discovered_at"), F.col("id")], limit)


def lacking_documents(jobs: DataFrame, documents: DataFrame, limit: int = 10) -> DataFrame:
    """The best scored of the postings that lack a document, and which ones they lack."""
    best = jobs.filter(F.col("ai_match_score").isNotNull())
    have = documents.groupBy("job_id").agg(
        (F.count_if(F.col("document_type") == "resume") > 0).alias("_resume"),
        (F.count_if(F.col("document_type") == "cover_letter") > 0).alias("_letter"),
    )
    lacking = (
        best.join(have, best["id"] == have["job_id"], "left")
        .withColumn("needs_resume", ~F.coalesce("_resume", F.lit(False)))
        .withColumn("needs_cover_letter", ~F.coalesce("_letter", F.lit(False)))
        .filter("needs_resume OR needs_cover_letter")
    )
    return top_rows(lacking.drop("job_id", "_resume", "_letter"), [F.col("ai_match_score").desc(), F.col("id")], limit)


def recent_pending(pending: DataFrame, limit: int = 5) -> DataFrame:
    return top_rows(pending.filter(F.col("status") == "pending"), [desc("created_at"), F.col("id")], limit)


def automation_order(companies: DataFrame) -> DataFrame:
    return companies.orderBy(desc("priority_score"), "name", "id")
