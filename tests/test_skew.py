"""Hot keys: results equal brute force on fixtures where one key holds most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import dedupe, ranking, scale, task_state, transitions

T0 = dt.datetime(2001, 1, 1)


def test_ordinals_with_one_hot_key(spark):
    random.seed(1)
    rows = [(0 if random.random() < 0.6 else random.randrange(1, 40), random.randrange(50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, o int, id int").repartition(7)
    got = {r["id"]: (r["n"], r["size"]) for r in scale.ordinals(df, ["k"], [F.col("o"), F.col("id")], "n", "size").collect()}
    by_key = {}
    for k, o, i in rows:
        by_key.setdefault(k, []).append((o, i))
    want = {i: (n, len(v)) for v in by_key.values() for n, (_, i) in enumerate(sorted(v), 1)}
    assert got == want


def test_replay_with_one_hot_task(spark):
    random.seed(2)
    rows = [(i, 0 if random.random() < 0.5 else random.randrange(1, 60), T0 + dt.timedelta(seconds=random.randrange(3000)), random.choice(task_state.STATES)) for i in range(6000)]
    # final states come late for the hot task, so that its run is long
    rows = [(i, k, ts, "pending" if k == 0 and i < 5500 and c in ("completed", "cancelled") else c) for i, k, ts, c in rows]
    got = {r["task_id"]: r for r in task_state.replay_commands(spark.createDataFrame(rows, "id bigint, task_id bigint, ts timestamp, new_status string")).collect()}
    by_task = {}
    for i, k, ts, c in rows:
        by_task.setdefault(k, []).append((ts, i, c))
    for k, commands in by_task.items():
        state, rejected, done = "pending", 0, None
        for ts, _, c in sorted(commands):
            new, good = task_state.outcome(state, c)
            rejected += not good
            if new == "completed" and state != "completed":
                done = ts
            state = new
        assert (got[k]["status"], got[k]["rejected"], got[k]["completed_at"], got[k]["commands"]) == (state, rejected, done, len(commands))


def test_transitions_of_final_states():
    assert task_state.outcome("snoozed", "completed") == ("snoozed", False)
    assert task_state.outcome("completed", "snoozed") == ("completed", True)
    assert task_state.outcome("cancelled", "cancelled") == ("cancelled", True)
    assert task_state.outcome("completed", "cancelled") == ("completed", False)


def brute_duplicates(incoming, stored, as_of):
    def url(u):
        return (u or "").split("?")[0].split("#")[0].rstrip("/").lower()

    def title(t):
        return " ".join((t or "").lower().split()).replace("-", " ").replace("_", " ")

    out = {}
    for seq, ext, comp, ttl, u, src in incoming:
        tiers = [
            [s[0] for s in stored if ext and comp is not None and s[1] == ext and s[2] == comp],
            [s[0] for s in stored if url(u or src) and url(u or src) in (url(s[4]), url(s[5])) and (comp is None or s[2] == comp)],
            [s[0] for s in stored if title(ttl) and comp is not None and title(s[3]) == title(ttl) and s[2] == comp],
            [max((s[6], -s[0]) for s in stored if s[1] == ext)[1] * -1] if ext and any(s[1] == ext for s in stored) and max(s[6] for s in stored if s[1] == ext) >= as_of - dt.timedelta(days=7) else [],
        ]
        hit = next(((n, min(ids)) for n, ids in enumerate(tiers, 1) if ids), (None, None))
        out[seq] = hit
    return out


@pytest.mark.parametrize("small_batch", [10**6, 0])
def test_cascade_with_hot_keys_on_both_sides(spark, monkeypatch, small_batch):
    monkeypatch.setattr(dedupe, "SMALL_BATCH_BYTES", small_batch)
    random.seed(3)
    hot = lambda a, b: "hot" if random.random() < 0.4 else f"{a}{random.randrange(b)}"
    stored = [(i, hot("e", 300), random.randrange(3), hot("T - ", 200), f"https://X.com/{hot('p', 200)}/?a=1", None if i % 3 else f"https://y.com/{i}/", T0 + dt.timedelta(hours=random.randrange(400))) for i in range(400)]
    incoming = [(i, random.choice([hot("e", 400), "", None]), random.choice([0, 1, 2, 9, None]), hot("t   ", 250).replace("t", "T -"), random.choice([f"https://x.com/{hot('p', 250)}", None, ""]), f"https://y.com/{random.randrange(600)}#z") for i in range(300)]
    as_of = T0 + dt.timedelta(hours=400)
    got = dedupe.find_duplicates(
        spark.createDataFrame(incoming, "seq int, external_id string, company_id bigint, title string, url string, source_url string"),
        spark.createDataFrame(stored, "id bigint, external_id string, company_id bigint, title string, url string, source_url string, discovered_at timestamp"),
        str(as_of),
    )
    assert {r["seq"]: (r["tier"], r["match_id"]) for r in got.collect()} == brute_duplicates(incoming, stored, as_of)


def test_big_duplicate_group_comes_in_pages(spark, monkeypatch):
    monkeypatch.setattr(scale, "PAGE_SIZE", 10)
    rows = [(i, "hot" if i < 95 else f"e{i // 2}", i % 3) for i in range(121)]
    got = dedupe.duplicate_groups(spark.createDataFrame(rows, "id bigint, external_id string, company_id bigint")).collect()
    hot = [r for r in got if r["external_id"] == "hot"]
    assert len(hot) > 5 and all(r["group_count"] == 95 and len(r["job_ids"]) < 30 for r in hot)
    assert sorted(i for r in hot for i in r["job_ids"]) == list(range(95))
    # ids 96..119 make twelve pairs; 95 and 120 stand alone
    assert len(got) - len(hot) == 12


def test_streaks_with_one_hot_company(spark):
    random.seed(4)
    rows = [(0 if random.random() < 0.7 else random.randrange(1, 30), T0 + dt.timedelta(hours=random.randrange(200)), i, random.choice(["completed"] * 3 + ["failed"]), int(random.random() < 0.02)) for i in range(3000)]
    df = spark.createDataFrame([(c, t, i, s, n, t) for c, t, i, s, n in rows], "company_id int, started_at timestamp, n int, status string, new_jobs int, completed_at timestamp")
    got = {r["company_id"]: r["consecutive_empty_crawls"] for r in ranking.empty_crawl_streaks(df, "2002-01-01", ["started_at", "n"]).collect()}
    for company in {r[0] for r in rows}:
        streak = 0
        for _, _, _, status, new in sorted((r for r in rows if r[0] == company), key=lambda r: (r[1], r[2])):
            streak = 0 if status == "completed" and new else streak + 1
        assert got[company] == streak


def test_keep_first_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id")
    plan = scale.keep_first(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_salted_join_is_whole(spark):
    facts = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 0 ELSE id END AS k", "id")
    keyed = spark.createDataFrame([(0, "hot"), (950, "rare")], "k bigint, name string")
    joined = scale.salted_join(facts, keyed, ["k"], "left")
    assert joined.count() == 1000 and joined.filter("name = 'hot'").count() == 900 and joined.filter("name = 'rare'").count() == 1


def test_ingest_twice_changes_nothing(spark):
    stored = spark.createDataFrame([(1, 1, "a", "A", "https://x.com/a", None, "d", T0, T0, "new")], "id bigint, company_id bigint, external_id string, title string, url string, source_url string, description string, posted_date timestamp, discovered_at timestamp, status string")
    incoming = spark.createDataFrame([(1, "a", 1, "A", "https://x.com/a", None, "newer", T0 + dt.timedelta(days=1)), (2, "b", 1, "B", "https://x.com/b", None, "e", None), (3, "b", 1, "B", "https://x.com/b", None, "again", None), (4, "", 1, "C", "u", None, None, None)], "seq int, external_id string, company_id bigint, title string, url string, source_url string, description string, posted_date timestamp")
    once = transitions.with_ids(transitions.ingest(stored, incoming, "2001-01-03"), 100, [F.col("external_id")])
    rows = {r["external_id"]: r for r in once.collect()}
    assert rows["a"]["change"] == "refreshed" and rows["a"]["description"] == "newer" and rows["b"]["id"] == 101 and len(rows) == 2
    twice = transitions.ingest(once.drop("change"), incoming, "2001-01-03")
    assert sorted((r["id"], r["description"]) for r in twice.collect()) == sorted((r["id"], r["description"]) for r in rows.values())
    assert twice.filter("change = 'new'").count() == 0


def test_archive_twice_changes_nothing(spark):
    jobs = spark.createDataFrame([(1, T0, None, "new"), (2, T0, None, "applied"), (3, T0, None, None), (4, dt.datetime(2001, 12, 31), None, "new")], "id int, discovered_at timestamp, archived_at timestamp, status string")
    once = transitions.archive_jobs(jobs, "2002-01-01")
    assert [r["status"] for r in once.orderBy("id").collect()] == ["archived", "applied", None, "new"]
    twice = transitions.archive_jobs(once, "2003-01-01")
    assert [r["archived_at"] for r in twice.filter("id = 1").collect()] == [dt.datetime(2002, 1, 1)]


def test_versions_have_no_gaps(spark):
    rows = [(i, 0 if i % 3 else i, "resume", T0 + dt.timedelta(hours=(i * 7) % 50), None) for i in range(300)]
    got = ranking.numbered_versions(spark.createDataFrame(rows, "id int, job_id int, document_type string, generated_at timestamp, version int")).collect()
    for job in {r["job_id"] for r in got}:
        versions = sorted(r["version"] for r in got if r["job_id"] == job)
        assert versions == list(range(1, len(versions) + 1))
        assert sum(r["is_current"] for r in got if r["job_id"] == job) == 1
