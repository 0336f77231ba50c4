"""Streams against brute force and against their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vacantia.operators import task_state
from vacantia.session import work_path
from vacantia.streaming import changelog
from vacantia.streaming import queries as streams
from vacantia.streaming.changelog import ChangeLog

T0 = dt.datetime(2001, 1, 1)


def land(spark, batches, ddl, tmp):
    """One folder per batch, in order, one batch per trigger."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp}/{n}")
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/*")


def test_dedupe_within_horizon(spark):
    random.seed(5)
    # a key has one time per batch, so it does not matter which of its rows comes first
    def row(n, i, k):
        return (f"e{k}", T0 + dt.timedelta(days=20 * n + k, hours=k), n * 100 + i)

    batches = [[row(n, i, random.randrange(15)) for i in range(12)] for n in range(5)]
    stream = land(spark, batches, "external_id string, discovered_at timestamp, id int", work_path(spark, "t"))
    path = work_path(spark, "o")
    streams.append_to(streams.dedupe_stream(stream), path, work_path(spark, "c")).awaitTermination()
    got = {}
    for r in spark.read.parquet(path).collect():
        got.setdefault(r["id"] // 100, []).append(r["external_id"])
    state, mark, week = {}, dt.datetime(1970, 1, 1), dt.timedelta(days=7)
    for n, rows in enumerate(batches):
        fresh = {e for e, t, _ in rows if t > mark} - set(state)
        assert len(got.get(n, [])) == len(set(got.get(n, []))) and set(got.get(n, [])) == fresh
        state.update({e: t for e, t, _ in rows if e in fresh})
        state = {e: t for e, t in state.items() if t + week > mark}
        mark = max(t for _, t, _ in rows) - week


def test_task_stream_equals_replay(spark):
    random.seed(6)
    rows = [(i, random.randrange(8), T0 + dt.timedelta(minutes=i), random.choice(task_state.STATES[:4])) for i in range(120)]
    ddl = "id bigint, task_id bigint, ts timestamp, new_status string"
    stream = land(spark, [rows[:40], rows[40:80], rows[80:]], ddl, work_path(spark, "t"))
    log = ChangeLog(spark, work_path(spark, "s"), ["task_id"], streams.STATE)
    log.start(spark.createDataFrame([], streams.STATE))
    streams.task_stream(stream, log, work_path(spark, "c")).awaitTermination()
    columns = ["task_id", "status", "rejected", "completed_at", "commands", "snooze_count", "snooze_until"]
    whole = task_state.replay_commands(spark.createDataFrame(rows, ddl))
    assert sorted(map(tuple, log.current().select(columns).collect()), key=str) == sorted(map(tuple, whole.select(columns).collect()), key=str)


def test_snoozed_task_wakes_up(spark):
    ddl = "id bigint, task_id bigint, ts timestamp, new_status string"
    first = [(1, 1, T0, "snoozed"), (2, 2, T0, "snoozed")]
    second = [(3, 2, T0 + dt.timedelta(hours=30), "snoozed")]
    log = ChangeLog(spark, work_path(spark, "s"), ["task_id"], streams.STATE)
    log.start(spark.createDataFrame([], streams.STATE))
    stream = land(spark, [first, second], ddl, work_path(spark, "t"))
    streams.task_stream(stream, log, work_path(spark, "c"), wake=True).awaitTermination()
    assert {r["task_id"]: r["status"] for r in log.current().collect()} == {1: "pending", 2: "snoozed"}


def test_reminders_are_sent_once(spark):
    tasks = spark.createDataFrame([(1, 1, T0, "pending"), (2, 1, T0 + dt.timedelta(hours=5), "in_progress"), (3, 1, T0, "completed")], "id bigint, job_id bigint, due_date timestamp, status string")
    ticks = land(spark, [[(T0,)], [(T0 + dt.timedelta(hours=1),)], [(T0 + dt.timedelta(hours=4),)]], "as_of timestamp", work_path(spark, "t"))
    sent = ChangeLog(spark, work_path(spark, "s"), ["id"], "id bigint, job_id bigint, due_date timestamp, sent_at timestamp")
    sent.start(spark.createDataFrame([], sent.schema))
    streams.reminder_stream(ticks, tasks, sent, work_path(spark, "c")).awaitTermination()
    assert sorted((r["id"], r["sent_at"]) for r in sent.rows().collect()) == [(1, T0), (2, T0 + dt.timedelta(hours=4))]


def test_change_log_batches_can_be_written_again(spark):
    log = ChangeLog(spark, work_path(spark, "l"), ["id"], "id bigint, v string")
    log.start(spark.createDataFrame([(1, "a"), (2, "b")], log.schema))
    for _ in range(2):
        log.write(spark.createDataFrame([(2, "c"), (3, "d")], log.schema), 0)
    assert sorted(map(tuple, log.current().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    small = log.compact(0, work_path(spark, "l2"))
    assert sorted(map(tuple, small.current().collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_change_log_folds_after_some_batches(spark, monkeypatch):
    monkeypatch.setattr(changelog, "FOLD_EVERY", 3)
    log = ChangeLog(spark, work_path(spark, "l"), ["id"], "id bigint, v string")
    log.start(spark.createDataFrame([(0, "base"), (99, "kept")], log.schema))
    want = {0: "base", 99: "kept"}
    for n in range(8):
        assert dict(map(tuple, log.current(n).collect())) == want
        changed = {n % 4: f"b{n}", 10 + n: "new"}
        log.write(spark.createDataFrame(list(changed.items()), log.schema), n)
        want |= changed
    assert sorted(log._folds()) == [3, 6]
    assert dict(map(tuple, log.current().collect())) == want
    again = {int(k): v for k, v in map(tuple, log.current(7).collect())}
    assert again == {k: v for k, v in want.items() if k != 17} | {3: "b3"}


def test_stuck_runs(spark):
    minute = dt.timedelta(minutes=1)
    starts = [[(1, T0), (2, T0 + minute), (3, T0 + 2 * minute)], [(4, T0 + 600 * minute)], [(5, T0 + 1200 * minute)]]
    ends = [[(1, T0 + 5 * minute)], [(3, T0 + 500 * minute)], [(5, T0 + 1201 * minute)]]
    s = land(spark, starts, "run int, started_at timestamp", work_path(spark, "a"))
    f = land(spark, ends, "run int, finished_at timestamp", work_path(spark, "b"))
    path = work_path(spark, "o")
    streams.append_to(streams.stuck_runs(s, f, ["run"]), path, work_path(spark, "c")).awaitTermination()
    assert sorted(r["run"] for r in spark.read.parquet(path).collect()) == [2, 3, 4]


def test_windows_of_stream_and_batch(spark):
    rows = [(T0 + dt.timedelta(hours=i), "new") for i in range(30)]
    df = spark.createDataFrame(rows, "at timestamp, status string")
    first = streams.window_counts(df, "at", ["status"]).filter(F.col("window_start") == F.lit(T0)).first()
    assert first["n"] == 24


def test_match_stream_writes_cells_not_pairs(spark):
    """Each pair once, also for postings that land again; the log holds rows per posting and per search, not their product."""
    from vacantia.operators import joins
    from vacantia.streaming import matches

    ddl = "id bigint, company_id bigint, title string, description string, location string, job_type string, discovered_at timestamp"
    rows = [(i, i % 3, ["Data", "alpha\tbeta beta", "nothing"][i % 3], "Zeta  data" if i % 4 == 0 else None, ["Remote", None][i % 2], "contract", T0 + dt.timedelta(minutes=i)) for i in range(200)]
    searches = spark.createDataFrame([(i, [None, "alp", "data beta"][i % 3], i % 5 == 0, None, [0, 2, 900 + i], True) for i in range(60)], "id bigint, keywords string, remote_only boolean, job_type string, target_companies array<bigint>, is_active boolean")
    companies = spark.createDataFrame([(0, True), (1, True), (2, True)], "id bigint, is_active boolean")
    index = joins.standing(searches, companies)
    found = ChangeLog(spark, work_path(spark, "m"), ["search_id", "cell", "job_id"], matches.MATCHES)
    found.start(spark.createDataFrame([], matches.MATCHES))
    stream = land(spark, [rows[:120], rows[:9] + rows[120:]], ddl, work_path(spark, "t"))
    matches.match_stream(stream, index, found, work_path(spark, "c")).awaitTermination()
    pairs = sorted(map(tuple, joins.posting_matches(index, spark.createDataFrame(rows, ddl)).collect()))
    assert sorted(map(tuple, matches.matched_pairs(found, index).collect())) == pairs and len(set(pairs)) == len(pairs)
    want = {}
    for search, job in pairs:
        want.setdefault(search, []).append(job)
    assert sorted(map(tuple, matches.matched_totals(found, index).collect())) == sorted((k, len(v), sum(v)) for k, v in want.items())
    assert found.rows().count() < len(pairs) / 4


def test_match_stream_leaves_texts_in_their_files(spark, monkeypatch):
    """A landing is written with digests; its texts, and those of rows without a file, are looked through where they are."""
    from vacantia.operators import joins
    from vacantia.streaming import matches

    ddl = "id bigint, company_id bigint, title string, description string, location string, job_type string, discovered_at timestamp"
    rows = [(i, 0, "Zeta" if i % 5 else None, ["alpha beta", None, "", "gamma\talphabet"][i % 4], None, None, T0) for i in range(40)]
    searches = spark.createDataFrame([(1, "alpha", False, None, [0], True), (2, "zeta", False, None, [0], True)], "id bigint, keywords string, remote_only boolean, job_type string, target_companies array<bigint>, is_active boolean")
    index = joins.standing(searches, spark.createDataFrame([(0, True)], "id bigint, is_active boolean"))
    found = ChangeLog(spark, work_path(spark, "m"), ["search_id", "cell", "job_id"], matches.MATCHES)
    found.start(spark.createDataFrame([], matches.MATCHES))
    written, settled = [], matches.settled
    monkeypatch.setattr(matches, "settled", lambda df, label="settled": written.append(settled(df, label)) or written[-1])
    matches.match_stream(land(spark, [rows], ddl, work_path(spark, "a landing")), index, found, work_path(spark, "c")).awaitTermination()
    kept = written[0].collect()
    assert len(kept) == 40 and not any(r["description"] for r in kept) and {r["title"] for r in kept} == {"Zeta", None}
    want = sorted((s, i) for i, _, title, text, *_ in rows for s, hit in ((1, "alpha" in (text or "")), (2, title)) if hit)
    assert sorted(map(tuple, matches.matched_pairs(found, index).collect())) == want
    in_hand = joins.said(spark.createDataFrame(rows, ddl))
    postings, hits = joins.matched_cells(index, in_hand, matches._texts(in_hand, in_hand.schema))
    assert sorted((r["search_id"], r["job_id"]) for r in hits.join(postings, "cell").collect()) == want


def test_stuck_runs_keep_a_hash_as_the_key_of_their_state(spark):
    starts = spark.createDataFrame([(1, "a", T0), (1, "b", T0), (None, "a", T0), (2, "a", T0)], "run int, part string, started_at timestamp")
    ends = spark.createDataFrame([(1, "a", T0), (None, "a", T0), (2, "a", T0 + dt.timedelta(hours=2))], "run int, part string, finished_at timestamp")
    open_ones = streams.stuck_runs(starts, ends, ["run", "part"])
    assert sorted((r["run"] or 0, r["part"]) for r in open_ones.collect()) == [(0, "a"), (1, "b"), (2, "a")]
    plan = open_ones._jdf.queryExecution().sparkPlan().toString()
    assert "Join [xxhash64(" in plan and plan.split("Join [")[1].split("]")[0].count("xxhash64") == 1
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "2"


def crawls(spark, folder, rows):
    """A lineitem table of (supplier, order, ship day or none, running) rows."""
    lines = [(s, o, 1, 1, 6.0, 1.5, "N" if running else "R", "O", None if day is None else (T0 + dt.timedelta(days=day)).date()) for s, o, day, running in rows]
    ddl = "l_suppkey bigint, l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date"
    spark.createDataFrame(lines, ddl).write.parquet(f"{folder}/lineitem.parquet")


def test_stuck_runs_land_in_slices_of_bounded_size(spark, tmp_path, monkeypatch):
    """Many crawls land in many slices, written in one pass, and every stuck run comes out once."""
    import __spark_entry__ as entry
    from vacantia.plans import streams as plans
    from vacantia.plans.registry import Tables

    monkeypatch.setattr(plans, "LANDING_CRAWLS", 40)
    rows = [(i % 7, i, i % 100, i % 3 == 0) for i in range(240)] + [(1, 1000, None, True)] + [(2, 2000, 5, True)] * 2
    crawls(spark, tmp_path, rows)
    logs = Tables(spark, str(tmp_path))("crawl_logs")
    bounds = plans.slice_bounds(logs, "started_at", 40)
    sizes = {r["s"]: r["count"] for r in logs.groupBy(plans.slice_of("started_at", bounds).alias("s")).count().collect()}
    assert len(bounds) == 6 and sorted(sizes) == list(range(7)) and max(sizes.values()) <= 50
    got = sorted(r["l_orderkey"] for r in entry.queries()["h4_stuck_runs"](spark, str(tmp_path)).collect())
    assert got == sorted(o for _, o, day, running in rows if running and day is not None)


def test_last_look_at_stuck_runs_leaves_what_the_stream_has_decided(spark):
    starts = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(days=2)), (None, T0), (3, T0 + dt.timedelta(days=3))], "run int, started_at timestamp")
    ends = spark.createDataFrame([(1, T0), (3, T0 + dt.timedelta(days=3, minutes=9))], "run int, finished_at timestamp")
    clock = streams.clock_of(starts, ends.filter("run = 1"))
    assert clock == int((T0 - dt.datetime(1970, 1, 1)).total_seconds() - 3600) * 1_000_000
    assert streams.clock_of(starts, ends.filter("run = 9")) is None
    two_days = clock + 48 * 3_600_000_000
    found = starts.filter("false")
    looked = [streams.stuck_as_of(found, starts.filter("run <> 1 or run is null"), ends, ["run"], "2001-02-01", clock=c) for c in (None, two_days)]
    assert [sorted((r["run"] or 0) for r in df.collect()) for df in looked] == [[0, 2], [0, 2]]
    early = streams.stuck_as_of(found, spark.createDataFrame([(8, T0)], starts.schema), ends, ["run"], "2001-02-01", clock=two_days)
    assert early.count() == 0
