"""Corner cases of the column functions."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_sources import one
from vacantia.functions import dates, scores, text, urls
from vacantia.operators import filters, joins, recommendations


def test_normalize_url(spark):
    got = one(spark, urls.normalize_url(F.col("x")), "HTTP://A.com/B//?q=1#f", "a#b?c", "", None, "/")
    assert got == ["http://a.com/b", "a", "", "", ""]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="aB/?#-_ .:", max_size=12), min_size=1, max_size=20))
def test_normalize_is_idempotent(spark, values):
    once = one(spark, urls.normalize_url(F.col("x")), *values)
    assert one(spark, urls.normalize_url(F.col("x")), *once) == once


def test_titles_keep_inner_runs(spark):
    assert one(spark, text.normalize_title(F.col("x")), " A -  B_c ", None) == ["a   b c", ""]


def test_relative_dates(spark):
    now = dt.datetime(2001, 8, 2)
    texts = ["Just posted", "3 days ago", "30+ days ago", "5 hours ago", "2 minutes ago", "", None, "soon", "Posted 1 hour, 2 days"]
    got = one(spark, dates.relative_date(F.col("x"), dates.ts("2001-08-02")), *texts)
    day, hour = dt.timedelta(days=1), dt.timedelta(hours=1)
    assert got == [now, now - 3 * day, now - 30 * day, now - 5 * hour, now - dt.timedelta(minutes=2), None, None, None, now - hour]


def test_due_dates(spark):
    rows = [("apply", 80.0, 100), ("apply", 60.0, 1), ("apply", None, None), ("apply", 10.0, 1), ("research", None, None), ("research", 60.0, None), ("follow_up", None, None), ("other", None, None)]
    df = spark.createDataFrame(rows, "kind string, score double, age int")
    base = dates.ts("2001-08-02")
    posted = dates.plus(base, -F.col("age"), "hour")
    due = dates.due_date(F.col("kind"), F.col("score"), base, posted, F.lit(None).cast("timestamp"), base)
    got = [(r[0] - dt.datetime(2001, 8, 2)).days for r in df.select(due).collect()]
    assert got == [1, 2, 3, 4, 1, 2, 7, 3]


def test_health_order(spark):
    rows = [(False, 5, 1.0, None, 0), (True, 3, None, None, 0), (True, 2, 90.0, None, 5), (True, 0, 40.0, None, 5), (True, 0, 90.0, 40.0, 5), (True, 0, None, None, 0), (True, 0, 90.0, None, 5)]
    df = spark.createDataFrame(rows, "a boolean, e int, r double, v double, n int")
    health = scores.company_health(*[F.col(c) for c in "aervn"])
    assert [r[0] for r in df.select(health).collect()] == ["inactive", "critical", "warning", "warning", "warning", "unknown", "healthy"]


def test_match_score_stays_between_50_and_100(spark):
    df = spark.createDataFrame([("Remote Python", "sql", "Paris", "python sql", "paris", True), ("x", None, None, "", None, False)], "t string, d string, l string, k string, w string, r boolean")
    score = scores.match_score(*[F.col(c) for c in "tdlkwr"])
    assert [r[0] for r in df.select(score).collect()] == [100.0, 50.0]


def test_title_case_and_names(spark):
    assert one(spark, urls.title_case(F.col("x")), "acme labs", "3m o'neil") == ["Acme Labs", "3M O'Neil"]


def test_absolute_urls(spark):
    page = F.lit("https://x.com/careers/list?a=1")
    got = one(spark, urls.absolute_url(F.col("x"), page), "/j/1", "j2", "https://y.com/z", "", None)
    assert got == ["https://x.com/j/1", "https://x.com/careers/j2", "https://y.com/z", "https://x.com/careers/list?a=1", "https://x.com/careers/list?a=1"]


def test_criteria_filter_keeps_commas_in_words(spark):
    jobs = spark.createDataFrame([(1, "Data person", None, None, None), (2, "data, more", "", "Remote", "full-time")], "id int, title string, description string, location string, job_type string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(filters.criteria_filter(jobs, "data,")) == [2]
    assert ids(filters.criteria_filter(jobs, "data,", split_on=r"[\s,]+")) == [1, 2]
    assert ids(filters.criteria_filter(jobs, "", remote_only=True)) == [2]


def test_next_steps_have_seven_ids(spark):
    job = spark.sql("SELECT 1L AS id, 'T' AS title, 'C' AS company, array('a') AS must_haves, array('n') AS nice_to_haves, 'w' AS what_they_want, array('r') AS simplified_requirements")
    ids = {r["suggestion_id"] for r in recommendations.next_steps(job, "2001-01-01").collect()}
    assert ids == {"apply_now", "research_company", "tailor_resume", "draft_cover_letter", "network_outreach", "schedule_follow_up", "close_skill_gap"}


def test_missing_targets(spark):
    searches = spark.sql("SELECT 1L AS id, array(1L, 9999L) AS target_companies UNION ALL SELECT 2L, array(1L)")
    got = joins.missing_targets(searches, spark.sql("SELECT 1L AS id")).collect()
    assert [(r["search_id"], r["missing_ids"]) for r in got] == [(1, [9999])]


def test_search_matches_agree_with_the_plain_filter(spark):
    words = ["alpha", "beta-gamma", "delta, x", "aprioristically-long-word here", "", "été  z"]
    jobs = spark.createDataFrame([(i, i % 3, w.upper() if i % 2 else w, None if i % 4 == 0 else f"{w} more", ["Remote", None][i % 2], ["contract", None][i % 2]) for i, w in enumerate(words * 2)], "id bigint, company_id bigint, title string, description string, location string, job_type string")
    asked = ["alp", "a-g", "delta,", "more zzz", "aprioristically-long-w", None, "é", "RE"]
    searches = spark.createDataFrame([(i, k, i % 3 == 2, "contract" if i % 4 == 3 else None, [] if i % 2 else [0, 2, 7], True) for i, k in enumerate(asked)], "id bigint, keywords string, remote_only boolean, job_type string, target_companies array<bigint>, is_active boolean")
    companies = spark.createDataFrame([(0, True), (1, True), (2, False)], "id bigint, is_active boolean")
    got = sorted((r["search_id"], r["job_id"]) for r in joins.search_matches(searches, jobs, companies).collect())
    want = []
    for s in searches.collect():
        if not s["keywords"] and not s["target_companies"]:
            want.append((s["id"], None))  # takes whatever fits
            continue
        scope = [c for c in (s["target_companies"] or [0, 1]) if c in (0, 1)]
        kept = filters.criteria_filter(jobs.filter(F.col("company_id").isin(scope)), s["keywords"] or "", s["remote_only"], s["job_type"])
        want += [(s["id"], r["id"]) for r in kept.collect()]
    assert got == sorted(want) and len(set(got)) == len(got)


def test_totals_of_searches_need_no_row_per_pair(spark):
    """Also with ids that come twice, alike or in another company, and with equal searches."""
    rows = [(i, i % 3, ["Data", "alpha beta", "nothing"][i % 3], None, ["Remote", None][i % 2], "contract") for i in range(300)]
    rows += [rows[0], (1, 0, "beta", None, "Remote", None), (None, 0, "beta", None, None, None)]
    jobs = spark.createDataFrame(rows, "id bigint, company_id bigint, title string, description string, location string, job_type string")
    asked = [(i, [None, "alp", "data beta", "ta", "absent"][i % 5], i % 3 == 2, "contract" if i % 4 == 3 else None, [] if i % 5 and i % 2 else [0, 2, 900 + i], True) for i in range(40)] * 2
    searches = spark.createDataFrame(asked, "id bigint, keywords string, remote_only boolean, job_type string, target_companies array<bigint>, is_active boolean")
    companies = spark.createDataFrame([(0, True), (1, True), (2, True)], "id bigint, is_active boolean")
    index = joins.standing(searches, companies)
    pairs = joins.posting_matches(index, jobs).groupBy("search_id").agg(F.count(F.lit(1)).alias("matches"), F.sum("job_id").alias("id_sum"))
    postings, hits = joins.matched_cells(index, jobs)
    got = joins.matched_totals(index, postings, hits)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and pairs.count() > 20
    assert hits.count() + postings.count() < pairs.agg(F.sum("matches")).first()[0] / 5
