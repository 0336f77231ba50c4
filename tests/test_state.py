"""Stored values survive state changes, and nothing is cut before it is tested."""

import csv
import datetime as dt
import io
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from vacantia.functions import urls
from vacantia.operators import filters, joins, ranking, scoring, transitions
from vacantia.session import shared_dir
from vacantia.sources import documents, pages

T0 = dt.datetime(2001, 1, 1, 9)
DOCUMENTS = (
    "id bigint, job_id bigint, document_type string, content string, generated_at timestamp, version int, is_current boolean, "
    "parent_version_id bigint, review_status string, reviewed_at timestamp, edited_content string, review_notes string"
)


def stored_documents(spark):
    return spark.createDataFrame(
        [(1, 1, "resume", "a", T0, 1, False, None, "approved", T0, "edit", "note"), (2, 1, "resume", "b", T0, 2, True, 1, None, T0, None, "n2")], DOCUMENTS
    )


def test_new_versions_keep_the_chain_and_all_columns(spark):
    old = stored_documents(spark)
    requests = spark.createDataFrame([(1, "resume", "c", 2)], "job_id bigint, document_type string, content string, parent_version_id bigint")
    out = {r.version: r for r in ranking.new_versions(old, requests, "2001-01-02").collect()}
    assert out[1].edited_content == "edit" and out[2].parent_version_id == 1 and out[2].review_notes == "n2"
    assert [out[v].is_current for v in (1, 2, 3)] == [False, False, True] and out[3].parent_version_id == 2
    same = ranking.new_versions(old, requests.limit(0), "2001-01-02")
    assert set(same.columns) == set(old.columns) and sorted(map(tuple, same.select(old.columns).collect())) == sorted(map(tuple, old.collect()))


def test_reviews_change_only_what_they_bring(spark):
    ddl = "review_id bigint, document_id bigint, action string, edited_content string, notes string, ts timestamp"
    reviews = spark.createDataFrame([(1, 2, "approved", None, "", T0 + dt.timedelta(days=1))], ddl)
    old = stored_documents(spark)
    out = {r.id: r for r in transitions.reviewed_documents(old, reviews).collect()}
    assert (out[1].review_status, out[1].reviewed_at, out[1].edited_content, out[1].review_notes) == ("approved", T0, "edit", "note")
    assert (out[2].review_status, out[2].reviewed_at, out[2].review_notes) == ("approved", T0 + dt.timedelta(days=1), "n2")
    same = transitions.reviewed_documents(old, reviews.limit(0)).select(old.columns)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, old.collect()))


def test_pending_reviews_keep_earlier_dates(spark):
    pending = spark.createDataFrame([(1, "approved", T0), (2, "pending", None), (3, "pending", None)], "id bigint, status string, reviewed_at timestamp")
    decisions = spark.createDataFrame([(2, "reject"), (2, "approve"), (1, "reject"), (3, "shrug")], "id bigint, decision string")
    out = sorted(map(tuple, transitions.reviewed_pending(pending, decisions, "2001-02-01").select("id", "status", "reviewed_at").collect()))
    assert out == [(1, "approved", T0), (2, "approved", dt.datetime(2001, 2, 1)), (3, "pending", None)]


def test_a_day_of_many_postings_is_scored_whole(spark):
    jobs = spark.range(3000).select(
        "id", F.lit("t").alias("title"), F.lit("d").alias("description"), (F.lit(T0) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") / 1000)).alias("discovered_at")
    )
    scorer = lambda df: df.select("id", F.col("id").cast("double").alias("ai_match_score"), F.lit(False).alias("ai_recommended"))
    top = scoring.daily_selection(jobs, scorer, "2001-01-01 10:00:00")
    assert [r.id for r in top.orderBy("ai_rank").collect()] == [2999, 2998, 2997, 2996, 2995]


def test_long_addresses_stay_apart(spark):
    df = spark.createDataFrame([("https://a.com/" + "x" * 300 + tail,) for tail in "ab"], "url string")
    ids = df.select(urls.generated_external_id("generic", F.lit("Co"), F.col("url"), F.lit("t")).alias("i")).distinct().collect()
    assert len(ids) == 2


def test_limits_come_after_the_tests(spark):
    jobs = spark.range(60).select(
        "id", F.lit("t").alias("title"), F.lit("c").alias("company"), (100 - F.col("id") / 2).alias("ai_match_score"), F.when(F.col("id") % 2 == 0, "new").otherwise("applied").alias("status"),
        (F.lit(T0) - F.make_dt_interval(F.col("id").cast("int"))).alias("updated_at"),
    )
    tasks = spark.range(30).select(F.col("id").alias("job_id"), F.lit("follow_up").alias("task_type"))
    assert [r.job_id for r in joins.action_recommendations(jobs, tasks, limit=5).collect()] == [30, 32, 34, 36, 38]
    assert [r.job_id for r in joins.follow_up_recommendations(jobs, tasks, limit=5).collect()] == [31, 33, 35, 37, 39]
    have = spark.range(30).select(F.col("id").alias("job_id"), F.explode(F.array(F.lit("resume"), F.lit("cover_letter"))).alias("document_type"))
    assert [r.id for r in ranking.lacking_documents(jobs, have, limit=3).collect()] == [30, 31, 32]


def test_all_endpoints_in_text_order(spark):
    found = [f"/{c}/api/jobs.json" for c in "zyxwvut"]
    html = spark.createDataFrame([("<script>" + " ".join(f"'{f}'" for f in [*found, found[0]]) + "</script>",)], "html string")
    assert html.select(pages.json_endpoints(F.col("html")).alias("e")).first().e == found


def test_csv_cells_as_the_standard_reader(spark):
    texts = ["a,b\nc,d", 'x,"y, z"\r\n"q ""r""",\n', "", "\n", "one", "a,", ',\n"two\nlines",b\n\nlast', " p , q "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {r.id: (r.text, r.row_count, r.column_count) for r in documents.csv_documents(df).collect()}
    for i, t in enumerate(texts):
        rows = list(csv.reader(io.StringIO(t, newline="")))
        assert got[i] == ("\n".join(", ".join(c.strip() for c in row) for row in rows), len(rows), len(rows[0]) if rows else 0), t


def test_robots_rules_hold_for_their_host(spark):
    asked = spark.createDataFrame([("http://a.com/x/1",), ("http://b.com/x/1",), ("http://a.com/y",), (None,), ("http://a.com/x/1",)], "url string")
    rules = spark.createDataFrame([("a.com", "/x"), ("a.com", "/x/1"), ("a.com", ""), ("b.com", "/y")], "host string, prefix string")
    got = sorted(((r.url or "", r.disallowed) for r in filters.robots_disallowed(asked, rules).collect()))
    assert got == [("", False), ("http://a.com/x/1", True), ("http://a.com/x/1", True), ("http://a.com/y", False), ("http://b.com/x/1", False)]


def test_a_cluster_must_name_its_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda key: None), getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
