"""Parts that grow in number with their rows, not in size."""

import datetime as dt
from itertools import takewhile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from vacantia.operators import breaker, filters
from vacantia.sources import duplicate_keys

T0 = dt.datetime(2001, 1, 1)


def test_unseen_postings_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filters, "PART_ROWS", 5)
    seen = spark.createDataFrame([(i % 9, f"e{i % 40}") for i in range(150)] + [(1, "hot")] * 300 + [(None, "e1"), (2, None)], "company_id bigint, external_id string")
    asked = [(i % 11 if i % 13 else None, f"e{i % 50}" if i % 17 else None) for i in range(200)] + [(1, "hot"), (2, None), (None, "e1")]
    got = filters.unseen_postings(spark.createDataFrame(asked, seen.schema), seen)
    known = {(r[0], r[1]) for r in seen.collect()}
    want = [a for a in asked if None in a or a not in known]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert f", {-(-seen.count() // 5)}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_the_breaker_have_a_size(spark, monkeypatch):
    monkeypatch.setattr(breaker, "CHUNK_ROWS", 40)
    cut = []

    def kept(df, label="settled", settle=breaker.settled):
        made = settle(df, label)
        if label == "breaker":
            cut.append(made)
        return made

    rows = [(i % 3, T0 + dt.timedelta(seconds=37 * i), "completed" if i % 13 == 0 else "failed", i) for i in range(2000)]
    logs = spark.createDataFrame(rows, "company_id bigint, started_at timestamp, status string, l_orderkey bigint")
    companies = spark.createDataFrame([(i, f"https://h{i}.com/x") for i in range(3)], "id bigint, career_page_url string")
    few = sorted(map(repr, breaker.breaker_episodes(logs, companies, "2002-01-01 00:00:00", ["started_at", "l_orderkey"]).collect()))
    monkeypatch.setattr(breaker, "settled", kept)
    many = sorted(map(repr, breaker.breaker_episodes(logs, companies, "2002-01-01 00:00:00", ["started_at", "l_orderkey"]).collect()))
    assert many == few and few
    assert cut[0].groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 4 * 40


def test_buckets_of_the_key_table_grow_with_the_postings(spark, monkeypatch):
    monkeypatch.setattr(duplicate_keys, "BUCKET_POSTINGS", 100)
    assert duplicate_keys.buckets_for(spark.range(4001)) == 41
    assert duplicate_keys.buckets_for(spark.range(3)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_wishes_meet_no_texts(spark):
    """What is dealt by company holds the names of texts."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = entry.queries()["g27_match_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in plan]
    dealt = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(company_id" in line)
    below = takewhile(lambda at: depth[at] > depth[dealt], range(dealt + 1, len(plan)))
    assert not any("AS description" in plan[at] for at in below)
