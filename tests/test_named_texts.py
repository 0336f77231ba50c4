"""Texts that are carried by name: payloads and postings equal those that hold the texts all along."""

import json

import pytest
from pyspark.sql import functions as F

from vacantia.plans import landing, views
from vacantia.plans.registry import Tables
from vacantia.sources import postings

TEXTS = ['plain', 'with "quotes" and \\ and / ', 'two\nlines\t', '', 'Größe   \U0001F600', 'text:1:x', 'a' * 5000]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Orders with repeated and null keys over documents with repeated ids and null texts."""
    root = tmp_path_factory.mktemp("named")
    docs = [(i, TEXTS[i % 7] if i % 10 else None) for i in range(40)] + [(3, "another of 3"), (3, TEXTS[3]), (5, TEXTS[5]), (None, "lost")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{root}/documents.parquet")
    orders = [(i if i % 50 else None, i * 7 % 30 if i % 41 else None, "F", 1.5 * i, "3-MEDIUM") for i in [*range(600), 7, 7, 64]]
    frame = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string")
    frame.withColumn("o_orderdate", F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).write.parquet(f"{root}/orders.parquet")
    return str(root)


def test_filled_lists_equal_lists_of_whole_items(spark, sf_dir):
    t = Tables(spark, sf_dir)
    item = F.to_json(F.struct("id", "title", F.col("description").alias("content"), "url"))
    rows = t("jobs").withColumn("item", item).withColumn("bucket", F.floor(F.col("id") / 20))
    want = rows.groupBy("company", "company_id", "bucket").agg(F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    got = landing.listed(t, item)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert "text:" not in got.agg(F.max("payload")).first()[0].replace('"text:1:x"', "")


def test_lists_are_dealt_without_their_texts(spark, sf_dir):
    """The postings' side of every exchange holds names; documents alone are dealt with their texts."""
    t = Tables(spark, sf_dir)
    made = t.by_name("jobs").select("id", "description")
    named = t.texts()
    assert named.count() == named.select("name").distinct().count()
    back = made.join(named, made["description"] == named["name"], "left").select("id", F.col("text").alias("description"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, t("jobs").select("id", "description").collect()))
    lengths = made.agg(F.max(F.length("description")).alias("n")).first()
    assert lengths["n"] < 100 < max(map(len, TEXTS))


def test_kept_is_made_of_the_text_that_counts(spark):
    jobs = [{"id": 1, "content": "own"}, {"id": 2, "content": "", "description": "second"}, {"id": 3, "content": "own 3"}, {"id": 4}, {"id": 5, "content": "own 5"}]
    landed = spark.createDataFrame([("Co", "co", json.dumps({"jobs": jobs}))], "company string, slug string, payload string")
    details = spark.createDataFrame(
        [("co", "1", '{"content":"detail"}'), ("co", "3", '{"content":""}'), ("co", "5", "broken"), ("co", "1", '{"content":"again"}')],
        "slug string, job_id string, payload string",
    )
    whole = postings.greenhouse_postings(landed, details).select("external_id", F.md5("description").alias("d"))
    kept = postings.greenhouse_postings(landed, details, kept=F.md5).select("external_id", F.col("description").alias("d"))
    assert sorted(kept.collect()) == sorted(whole.collect()) and whole.count() == 6


def test_named_views_have_the_columns_of_the_views(spark, sf_dir):
    for name in ("jobs", "stored_jobs"):
        assert views.frame(spark, sf_dir, name, by_name=True).dtypes == views.frame(spark, sf_dir, name).dtypes


def test_ingest_gives_the_texts_it_was_given_by_name(spark, sf_dir):
    """Refreshed, kept and new postings; the tables that ingest moves hold no text of a document."""
    from vacantia.operators import transitions
    from vacantia.plans.views import AS_OF

    t = Tables(spark, sf_dir)
    whole = transitions.ingest(t("stored_jobs"), t("incoming"), AS_OF)
    named = transitions.ingest(t.stored_by_name(), t.incoming_in_hand(), AS_OF)
    got = t.with_descriptions(named).select(*whole.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    assert named.agg(F.max(F.length("description.text")).alias("n")).first()["n"] < 100


def test_technologies_of_a_text_are_found_once_for_all_its_postings(spark, tmp_path):
    """Same words as those of description and title together; no posting's text is lowered."""
    import re

    import __spark_entry__ as entry
    from vacantia.functions import text

    docs = [(0, "PYTHON and awsql"), (1, "nothing, but DocKerKubernetes"), (2, None), (3, "gi"), (3, "git\nlinux"), (3, "git\nlinux"), (None, "react"), (4, "döcker gİt"), (5, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    orders = [(i if i % 13 else None, i, "F", 1.5, "3-MEDIUM") for i in [*range(80), 3, 3]]
    frame = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string")
    frame.withColumn("o_orderdate", F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).write.parquet(f"{tmp_path}/orders.parquet")
    body = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), "title")
    want = Tables(spark, str(tmp_path))("jobs").select("id", F.array_join(text.technologies(body), ",").alias("technologies"))
    got = entry.queries()["g18_technologies"](spark, str(tmp_path))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    lowered = re.compile(r"lower\((coalesce\()?concat\(")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (want, got)]
    assert [bool(lowered.search(p)) for p in plans] == [True, False]
