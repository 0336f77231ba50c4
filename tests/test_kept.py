"""Kept keys, moving means, breaker history, outcome partials and timers against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_skew import brute_duplicates
from vacantia.operators import breaker, dedupe, ranking, scale
from vacantia.session import work_path
from vacantia.sources.duplicate_keys import KeyTable
from vacantia.streaming import outcomes, timers
from vacantia.streaming.changelog import ChangeLog, PartialLog
from tests.test_streaming import land

T0 = dt.datetime(2001, 1, 1)
AS_OF = "2001-08-02 00:00:00"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts, window", [(3, 10), (30, 10), (1, 3)])
def test_moving_means_over_small_partitions(spark, parts, window):
    """Also where partitions hold fewer rows than the window."""
    random.seed(1)
    rows = [(0, random.randrange(40), i, float(random.randrange(100))) for i in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = ranking.moving_means(spark.createDataFrame(rows, "k int, o int, id int, v double"), ["k"], [F.col("o"), F.col("id")], "v", "m", window)
        got = {r.id: r.m for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    line = sorted(rows, key=lambda r: (r[1], r[2]))
    want = {r[2]: sum(x[3] for x in line[max(0, n - window + 1) : n + 1]) / min(n + 1, window) for n, r in enumerate(line)}
    assert got == pytest.approx(want)


def test_moving_means_of_many_blocks_have_no_global_window(spark):
    rows = spark.range(5000).selectExpr("0 AS k", "id", "CAST(id % 13 AS DOUBLE) AS v")
    out = ranking.moving_means(rows, ["k"], [F.col("id")], "v", "m", 10)
    got = {r.id: r.m for r in out.collect()}
    assert len(got) == 5000 and all(got[n] == pytest.approx(sum(i % 13 for i in range(max(0, n - 9), n + 1)) / min(10, n + 1)) for n in range(5000))
    windows = [line for line in plan_of(out).splitlines() if " Window " in line]
    assert windows and all("_block" in line or "_chunk" in line or "[k" in line for line in windows)


def test_duplicate_groups_deal_a_hot_id_to_many_tasks(spark):
    rows = [(i, "hot" if i % 3 else f"e{i // 6}", i % 7) for i in range(900)]
    out = dedupe.duplicate_groups(spark.createDataFrame(rows, "id bigint, external_id string, company_id bigint"))
    assert "_salt" in plan_of(out)
    groups = {}
    for r in out.collect():
        groups.setdefault(r.external_id, []).extend(zip(r.job_ids, r.company_ids))
        assert r.group_count == sum(x[1] == r.external_id for x in rows)
    want = {}
    for i, e, c in rows:
        want.setdefault(e, []).append((i, c))
    assert {e: sorted(v) for e, v in groups.items()} == {e: v for e, v in want.items() if len(v) > 1}


def test_duplicate_groups_join_only_the_counts_of_big_groups(spark, monkeypatch):
    """Many small groups are not joined, so no table of them is broadcast."""
    kept, settle = [], dedupe.settled
    monkeypatch.setattr(dedupe, "settled", lambda df, label: kept.append(settle(df, label)) or kept[-1])
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id < 1500 THEN 'hot' WHEN id % 10 < 4 THEN concat('e', id div 2) ELSE concat('own', id) END AS external_id", "id % 7 AS company_id")
    got = dedupe.duplicate_groups(rows).collect()
    assert [(r.external_id, r.group_count) for r in kept[0].collect()] == [("hot", 1500)]
    assert sum(len(r.job_ids) for r in got if r.external_id == "hot") == 1500 and {r.group_count for r in got if r.external_id == "hot"} == {1500}
    small = [r for r in got if r.external_id != "hot"]
    assert len(small) == 500 and all(r.group_count == len(r.job_ids) == len(r.company_ids) == 2 and r.page == 0 for r in small)


# kept keys

STORED = "id bigint, company_id bigint, external_id string, title string, url string, source_url string, discovered_at timestamp"
INCOMING = "seq bigint, company_id bigint, external_id string, title string, url string, source_url string"


def postings(rng, count, incoming=False):
    out = []
    for i in range(count):
        ids = (i, rng.choice([None, 1, 2, 3]), rng.choice([None, "", *[f"e{k}" for k in range(30)]]), rng.choice([None, "A-b", "Data  Analyst", f"Title {rng.randrange(20)}"]))
        links = tuple(rng.choice([None, "", f"https://X.com/{rng.randrange(25)}/?q", f"https://x.com/{rng.randrange(25)}"]) for _ in range(2))
        out.append((*ids, *links) if incoming else (*ids, *links, dt.datetime(2001, 8, 2) - dt.timedelta(days=rng.randrange(15))))
    return out


def test_kept_keys_find_what_a_scan_finds(spark):
    rng = random.Random(4)
    stored, incoming = spark.createDataFrame(postings(rng, 150), STORED), spark.createDataFrame(postings(rng, 200, True), INCOMING)
    keys = KeyTable(spark, work_path(spark, "keys"), 4).start(stored)
    by_scan = sorted(map(tuple, dedupe.find_duplicates(incoming, stored, AS_OF).collect()))
    assert sorted(map(tuple, dedupe.find_duplicates(incoming, None, AS_OF, keys=keys.first_rows()).collect())) == by_scan
    assert sorted(map(tuple, dedupe.find_duplicates(incoming, None, AS_OF, keys=keys.rows()).collect())) == by_scan
    assert len({t for _, t, _ in by_scan}) > 3


def test_kept_keys_follow_changes(spark):
    """New postings, postings with other addresses, and a batch that is written twice."""
    rng = random.Random(5)
    first = postings(rng, 100)
    keys = KeyTable(spark, work_path(spark, "keys"), 4).start(spark.createDataFrame(first, STORED))
    now = {r[0]: r for r in first}
    for batch in (1, 2, 3):
        fresh = [(1000 * batch + r[0], *r[1:]) for r in postings(rng, 20)]
        moved = [(*now[i][:4], f"https://x.com/{rng.randrange(25)}", *now[i][5:]) for i in rng.sample(sorted(now), 15)]
        before = spark.createDataFrame([now[r[0]] for r in moved], STORED)
        for _ in range(2 if batch == 2 else 1):
            keys.change(before, spark.createDataFrame(fresh + moved, STORED), batch)
        now |= {r[0]: r for r in fresh + moved}
    incoming = spark.createDataFrame(postings(rng, 200, True), INCOMING)
    want = sorted(map(tuple, dedupe.find_duplicates(incoming, spark.createDataFrame(list(now.values()), STORED), AS_OF).collect()))
    assert sorted(map(tuple, dedupe.find_duplicates(incoming, None, AS_OF, keys=keys.rows()).collect())) == want
    again = KeyTable(spark, keys.path, 4)  # another session finds the files
    assert sorted(map(tuple, dedupe.find_duplicates(incoming, None, AS_OF, keys=again.rows()).collect())) == want


def test_kept_keys_are_not_shuffled(spark):
    rng = random.Random(6)
    stored, incoming = spark.createDataFrame(postings(rng, 150), STORED), spark.createDataFrame(postings(rng, 200, True), INCOMING)
    keys = KeyTable(spark, work_path(spark, "keys"), 4).start(stored)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(dedupe.find_duplicates(incoming, None, AS_OF, keys=keys.rows()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # from the scan of the keys up to the join there is no exchange
    lines = plan.splitlines()
    scan = next(n for n, line in enumerate(lines) if "duplicate_keys" in line and "FileScan" in line)
    join = max(n for n, line in enumerate(lines[:scan]) if "SortMergeJoin" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    chain = []
    level = depth(lines[scan])
    for line in reversed(lines[join + 1 : scan]):
        if depth(line) < level:
            chain.append(line)
            level = depth(line)
        if depth(line) <= depth(lines[join]) + 3:
            break
    assert chain and not any("Exchange" in line for line in chain), plan


# breaker


def brute_episodes(rows):
    """rows: (host, seconds, failed) in order."""
    out, state = [], {}
    for host, at, failed in rows:
        s = state.setdefault(host, {"failures": 0, "open": None})
        if s["open"] is not None:
            if at - s["open"]["at"] < 300:
                s["open"]["refused"] += 1
                continue
            s["open"]["closed"] = at
            s["failures"], s["open"] = 0, None
        if not failed:
            s["failures"] = 0
            continue
        s["failures"] += 1
        if s["failures"] >= 5:
            s["open"] = {"host": host, "at": at, "closed": None, "refused": 0}
            out.append(s["open"])
    return [(e["host"], e["at"], e["closed"], e["refused"]) for e in out]


@pytest.mark.parametrize("seed, parts, share", [(1, 1, 0.8), (2, 7, 0.8), (3, 40, 0.9), (4, 40, 0.6), (5, 12, 1.0)])
def test_breaker_history_over_many_chunks(spark, seed, parts, share):
    """A host with most crawls lies in many chunks; times tie and lie close together."""
    rng = random.Random(seed)
    companies = spark.createDataFrame([(c, f"https://h{max(0, c - 6)}.example/jobs") for c in range(10)], "id bigint, career_page_url string")
    logs, at = [], 0
    for i in range(1500):
        at += rng.choice([0, 0, 1, 20, 100, 400])
        logs.append((rng.randrange(10), T0 + dt.timedelta(seconds=at), rng.choices(["failed", "completed", "running"], [share, 1 - share + 0.02, 0.05])[0], i))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(logs, "company_id bigint, started_at timestamp, status string, n int")
        got = breaker.breaker_episodes(frame, companies, AS_OF, ["started_at", "n"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = [(f"h{max(0, c - 6)}.example", int((t - T0).total_seconds()), s == "failed") for c, t, s, _ in logs if s != "running"]
    second = lambda t: None if t is None else int((t - T0).total_seconds())
    assert sorted(((r.domain, second(r.opened_at), second(r.closed_at), r.refused) for r in got), key=repr) == sorted(brute_episodes(rows), key=repr)
    assert all(r.failures == 5 for r in got) and len(got) > 3


def test_breaker_without_crawls(spark):
    logs = spark.createDataFrame([], "company_id bigint, started_at timestamp, status string, n int")
    companies = spark.createDataFrame([(1, None)], "id bigint, career_page_url string")
    assert breaker.breaker_episodes(logs, companies, AS_OF, ["started_at", "n"]).count() == 0


# outcomes


def test_outcomes_of_late_crawls_and_repeated_batches(spark, monkeypatch):
    from vacantia.streaming import changelog

    monkeypatch.setattr(changelog, "FOLD_EVERY", 2)
    rng = random.Random(7)
    companies = spark.createDataFrame([(1, "lever"), (2, "indeed"), (3, None)], "id bigint, crawler_type string")
    rows = [(rng.choice([1, 2, 3, 9]), rng.choice(["completed", "failed", "running"]), T0 + dt.timedelta(hours=rng.randrange(400)), None, rng.randrange(5)) for _ in range(300)]
    rows = [(c, s, a, a + dt.timedelta(seconds=n * 7) if s != "running" else None, n) for c, s, a, _, n in rows]
    ddl = "company_id bigint, status string, started_at timestamp, completed_at timestamp, new_jobs int"
    stream = land(spark, [rows[k : k + 50] for k in range(0, 300, 50)], ddl, work_path(spark, "t"))
    log = PartialLog(spark, work_path(spark, "o"), outcomes.KEYS, outcomes.PARTIALS)
    log.start(spark.createDataFrame([], outcomes.PARTIALS))
    outcomes.outcome_stream(stream, companies, log, work_path(spark, "c")).awaitTermination()
    assert log._folds()
    log.write(outcomes.outcome_partials(spark.createDataFrame(rows[250:], ddl), companies), 5)  # the last batch again
    whole = outcomes.outcome_partials(spark.createDataFrame(rows, ddl), companies)
    both = [sorted(map(tuple, outcomes.outcome_periods(p, [1, 3]).collect()), key=repr) for p in (log.current(), whole)]
    assert both[0] == both[1]
    kinds = {1: "api", 2: "selenium", 3: "unknown"}
    day = T0.date()
    own = [r for r in rows if kinds.get(r[0]) == "unknown" and day <= r[2].date() < day + dt.timedelta(days=3)]
    line = next(r for r in outcomes.outcome_periods(whole, [3]).collect() if (r.period_start, r.crawler_class) == (day, "unknown"))
    done = [r for r in own if r[1] == "completed"]
    assert (line.crawls, line.completed, line.new_jobs) == (len(own), len(done), sum(r[4] for r in done))
    assert line.avg_duration == pytest.approx(sum(r[4] * 7 for r in done) / len(done))


# timers


def test_snoozes_end_by_timer_and_survive_a_restart(spark):
    """Every landing is drained by a query of its own that goes on from the checkpoint."""
    hour = dt.timedelta(hours=1)
    ddl = "id bigint, task_id bigint, ts timestamp, new_status string, snooze_for string"
    landings = [
        [(1, 1, T0, "snoozed", "1h"), (2, 2, T0, "snoozed", "1w"), (3, 3, T0, "snoozed", "1h"), (4, 4, T0, "in_progress", None)],
        [(5, 3, T0 + 2 * hour, "completed", None), (6, 4, T0 + 2 * hour, "snoozed", "1h"), (7, 9, T0 + 2 * hour, "pending", None)],
        [(8, 4, T0 + 2.5 * hour, "snoozed", "1d"), (9, 9, T0 + 9 * hour, "in_progress", None)],
    ]
    root, log = work_path(spark, "t"), ChangeLog(spark, work_path(spark, "s"), ["task_id"], timers.TASKS)
    log.start(spark.createDataFrame([], timers.TASKS))
    checkpoint, seen = work_path(spark, "c"), []
    for n, rows in enumerate(landings):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{root}/{n}")
        timers.timer_stream(spark.readStream.schema(ddl).parquet(f"{root}/*"), log, checkpoint).awaitTermination()
        seen.append({r.task_id: r.status for r in log.current().collect()})
    assert seen[0] == {1: "snoozed", 2: "snoozed", 3: "snoozed", 4: "in_progress"}
    # at two hours the first snooze is over without a command; task 3 was pending again before it was completed
    assert seen[1] == {1: "pending", 2: "snoozed", 3: "completed", 4: "snoozed", 9: "pending"}
    # the second snooze of task 4 moves its end; the timer of the first changes nothing
    assert seen[2] == {1: "pending", 2: "snoozed", 3: "completed", 4: "snoozed", 9: "in_progress"}


# text index


def test_indexed_searches_equal_scans(spark):
    """Phrases with blanks, wildcards, short pieces and no piece at all; postings without a day; days added later."""
    from vacantia.operators import filters
    from vacantia.sources import tables
    from vacantia.sources.text_index import TextIndex

    rng = random.Random(8)
    words = ["Python", "python-dev", "Engineer", "engine", "NEW", "york", "a", "ab", "été", "50%", "x_y", "re\\mote"]
    text = lambda n: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(n)), "\t".join(rng.choice(words) for _ in range(n))])
    rows = [(i, text(3), text(8), text(2), text(2), rng.choice([None, T0 + dt.timedelta(days=rng.randrange(6))])) for i in range(200)]
    ddl = "id bigint, title string, description string, company string, location string, discovered_at timestamp"
    jobs = spark.read.parquet(tables.write_version(spark.createDataFrame(rows, ddl), work_path(spark, "jobs"), "jobs"))
    index = TextIndex(spark, work_path(spark, "index")).add(jobs.filter("id < 120")).add(jobs.filter("id >= 120"))
    for phrase in ("python", "Python-D", "new york", "engineer new", "ab", "py%eng", "x_y", "50%", "été", "absent", "python absent", "re\\\\mote"):
        for search in (lambda df, **k: filters.text_search(df, phrase, limit=None, **k), lambda df, **k: filters.screen_search(df, phrase, **k)):
            assert sorted(r.id for r in search(jobs, index=index).collect()) == sorted(r.id for r in search(jobs).collect()), phrase


def test_indexed_searches_read_only_hit_days(spark):
    from vacantia.operators import filters
    from vacantia.sources import tables
    from vacantia.sources.text_index import TextIndex

    rows = [(i, "rare word" if i == 7 else "common", "", "", "", T0 + dt.timedelta(days=i % 10)) for i in range(100)]
    ddl = "id bigint, title string, description string, company string, location string, discovered_at timestamp"
    jobs = spark.read.parquet(tables.write_version(spark.createDataFrame(rows, ddl), work_path(spark, "jobs"), "jobs"))
    index = TextIndex(spark, work_path(spark, "index")).add(jobs)
    found = filters.screen_search(jobs, "rare", index=index)
    assert [r.id for r in found.collect()] == [7]
    assert "dynamicpruning" in plan_of(found)


def test_index_of_named_texts_equals_scans_and_holds_a_text_once(spark):
    """Descriptions by name: phrases with and without pieces, postings without a text or a day, texts that come again in a later add."""
    from vacantia.operators import filters
    from vacantia.sources.text_index import TextIndex

    rng = random.Random(9)
    words = ["Python", "python-dev", "Engineer", "NEW", "york", "ab", "été", "50%", "x_y"]
    text = lambda n: rng.choice([None, " ".join(rng.choice(words) for _ in range(n)), "\t".join(rng.choice(words) for _ in range(n))])
    texts = [(f"n{k}", text(6) or "") for k in range(8)]
    rows = [(i, text(2), rng.choice([(None, None), *texts]), text(1), text(1), rng.choice([None, T0 + dt.timedelta(days=rng.randrange(6))])) for i in range(160)]
    ddl = "id bigint, title string, description string, company string, location string, discovered_at timestamp"
    by_name = spark.createDataFrame([(i, t, d[0], *rest) for i, t, d, *rest in rows], ddl)
    plain = spark.createDataFrame([(i, t, d[1], *rest) for i, t, d, *rest in rows], ddl)
    index = TextIndex(spark, work_path(spark, "index"), spark.createDataFrame(texts, "name string, text string"))
    index.add(by_name.filter("id < 80")).add(by_name.filter("id >= 80"))
    for phrase in ("python", "new york", "ab", "py%eng", "50%", "x_y", "absent", "python absent"):
        for search in (lambda df, **k: filters.text_search(df, phrase, limit=None, **k), lambda df, **k: filters.screen_search(df, phrase, **k)):
            assert sorted(r.id for r in search(by_name, index=index).collect()) == sorted(r.id for r in search(plain).collect()), phrase
    assert filters.text_search(by_name, "python", index=index).columns == by_name.columns
    said = {(w, n) for n, t in texts for w in t.lower().split() if n in {d[0] for _, _, d, *_ in rows}}
    assert spark.read.parquet(f"{index.root}/text_words/*").count() == len(said)
    assert "description" not in {r.field for r in spark.read.parquet(f"{index.root}/words").collect()}


def test_text_index_deals_postings_not_words(spark, monkeypatch):
    from vacantia.sources.text_index import TextIndex

    rows = [(i, "One two\tTWO", " three  one ", None, "", T0 if i else None) for i in range(5)]
    jobs = spark.createDataFrame(rows, "id bigint, title string, description string, company string, location string, discovered_at timestamp")
    dealt, sort = [], type(jobs).sortWithinPartitions
    monkeypatch.setattr(type(jobs), "sortWithinPartitions", lambda df, *by: dealt.append(df) or sort(df, *by))
    index = TextIndex(spark, work_path(spark, "index")).add(jobs)
    plan = plan_of(dealt[0])
    # the plan is printed from the top: words are made after the shuffle
    assert "Generate" in plan and plan.rindex("Generate") < plan.index("Exchange")
    got = sorted((r.id, r.field, r.word) for r in spark.read.parquet(f"{index.root}/words").collect())
    assert got == sorted((i, f, w) for i in range(5) for f, words in (("title", ("one", "two")), ("description", ("one", "three"))) for w in words)


def test_new_postings_alone_make_only_what_they_need(spark, monkeypatch):
    """The fourth tier asks without links and titles, and refreshes are not written for who wants new postings alone."""
    from vacantia.operators import transitions

    rng = random.Random(8)
    fields = "description string, posted_date timestamp"
    stored = spark.createDataFrame([(*r, f"d{r[0]}", r[6], "new") for r in postings(rng, 150)], f"{STORED}, {fields}, status string")
    incoming = spark.createDataFrame([(*r, f"n{r[0]}", dt.datetime(2001, 8, 1)) for r in [*postings(rng, 200, True), (900, 9, "fresh", "Never seen", "https://x.com/fresh", None)]], f"{INCOMING}, {fields}")
    keys = KeyTable(spark, work_path(spark, "keys"), 4).start(stored)
    want = transitions.ingest(stored, incoming, AS_OF)
    written = []
    settled = transitions.settled
    monkeypatch.setattr(transitions, "settled", lambda df, label="settled": written.append(label) or settled(df, label))
    got = transitions.ingest(stored, incoming, AS_OF, keys=keys.first_rows())
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r["change"] for r in got.select("change").distinct().collect()} == {"new", "kept", "refreshed"}
    assert "hits" in written and "refreshes" not in written
    plan = got.filter("change = 'new'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    hits = dedupe._kept_hits(incoming.select("seq", *[F.col(c).alias(k) for c, k in (("company_id", "k_company"), ("external_id", "k_ext"))], F.upper("url").alias("k_url"), F.lower("title").alias("k_title")), "seq", keys.first_rows(), AS_OF)
    made = hits._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("upper(") == 1 and made.count("lower(") == 1
