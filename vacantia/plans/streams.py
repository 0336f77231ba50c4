"""Registered streams: table rows land as files in time order and are drained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators import joins
from vacantia.plans.changes import INGEST, REPLAY, UNTIL
from vacantia.plans.joined import MATCHES, searches
from vacantia.plans.registry import Tables, query
from vacantia.plans.views import AS_OF, TODAY
from vacantia.session import work_path
from vacantia.streaming import queries as streams
from vacantia.sources.duplicate_keys import KeyTable, buckets_for
from vacantia.streaming import matches, outcomes, timers
from vacantia.streaming.changelog import ChangeLog, PartialLog

PARTS = 3


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class Landing:
    """Rows that arrive in PARTS landings, in the order of ``part`` (0..PARTS-1)."""

    def __init__(self, t: Tables, df: DataFrame, part, label: str):
        self.df, self.part, self.root = df, part, work_path(t.spark, label)

    def land(self, n: int) -> None:
        self.df.filter(self.part == n).write.parquet(f"{self.root}/{n}")

    def stream(self) -> DataFrame:
        return self.df.sparkSession.readStream.schema(self.df.schema).parquet(f"{self.root}/*")


class SlicedLanding(Landing):
    """A landing of any number of parts: all are written in one pass over the rows, then put in place one by one."""

    def __init__(self, t: Tables, df: DataFrame, part, label: str):
        super().__init__(t, df, part, label)
        self.staged = work_path(t.spark, f"{label}-staged")
        df.withColumn("_slice", part).write.partitionBy("_slice").parquet(self.staged)

    def land(self, n: int) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        here, there = path(f"{self.staged}/_slice={n}"), path(f"{self.root}/{n}")
        fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(there.getParent())
        if not fs.exists(here):
            fs.mkdirs(there)
        elif not fs.rename(here, there):
            raise OSError(f"{here} can't be put in place")


def drained(start, *landings: Landing, parts: int = PARTS) -> None:
    """Land part after part, each as many files as Spark writes, and drain it before the next.

    ``start`` takes the streams and starts a query that ends when it has read
    all; its checkpoint stays the same, so the query goes on where it stopped.
    """
    for n in range(parts):
        for landing in landings:
            landing.land(n)
        start(*[landing.stream() for landing in landings]).awaitTermination()


def by_year(column: str):
    """0, 1, 2 in time order: before 1997, before 1999, later."""
    year = F.year(column)
    return F.when(year < 1997, 0).when(year < 1999, 1).otherwise(2)


def slice_bounds(rows: DataFrame, column: str, size: int) -> list[int]:
    """Times (microseconds) that cut rows into slices of about ``size``, at least PARTS of them."""
    at = F.unix_micros(column)
    parts = max(PARTS, -(-rows.count() // size))
    cuts = rows.agg(F.percentile_approx(at, [n / parts for n in range(1, parts)], 10_000)).first()[0]
    return sorted(set(cuts or []))


def slice_of(column: str, bounds: list[int]):
    """The slice of a time; rows without one come last."""
    before = F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b <= F.unix_micros(column))
    return F.when(F.col(column).isNull(), len(bounds)).otherwise(F.size(before))


@query("h1_ingest_stream", INGEST + " SELECT company_id, external_id, title, url, posted_date, status FROM after")
def _(t):
    """The store holds the texts of documents by name."""
    incoming = t.incoming_in_hand().select("seq", "external_id", "company_id", "title", "url", "source_url", "description", "posted_date")
    middle = incoming.agg((F.max("seq") / 2).alias("m")).scalar()
    part = F.when(F.col("seq") % 2 == 1, 2).when(F.col("seq") < middle, 0).otherwise(1)
    base = t.stored_by_name().withColumn("change", F.lit("kept"))
    store = ChangeLog(t.spark, work_path(t.spark, "postings"), ["id"], ddl(base))
    store.start(base)
    keys = KeyTable(t.spark, work_path(t.spark, "keys"), buckets_for(base)).start(base)
    checkpoint = work_path(t.spark, "ckpt")
    drained(lambda stream: streams.ingest_stream(stream, store, AS_OF, checkpoint, keys), Landing(t, incoming, part, "landing"))
    return store.current().select("company_id", "external_id", "title", "url", "posted_date", "status")


@query("h2_dedupe_stream", """
WITH p AS (SELECT external_id, discovered_at, CASE WHEN year(discovered_at) < 1997 THEN 0 WHEN year(discovered_at) < 1999 THEN 1 ELSE 2 END AS part FROM {jobs}),
clock AS (SELECT n AS part, (SELECT max(discovered_at) FROM p WHERE part < n) - INTERVAL '7' DAY AS watermark FROM (SELECT unnest([0, 1, 2]) AS n))
SELECT DISTINCT p.external_id, CAST(p.part AS INT) AS part FROM p JOIN clock USING (part) WHERE watermark IS NULL OR p.discovered_at >= watermark
 AND NOT EXISTS (SELECT 1 FROM p e WHERE e.external_id = p.external_id AND e.part < p.part AND e.discovered_at + INTERVAL '7' DAY > watermark)""")
def _(t):
    """Which ids each landing lets through; which of a landing's equal ids is the first depends on the order of arrival."""
    jobs = t("jobs").select("id", "external_id", "company_id", "discovered_at")
    path, checkpoint = work_path(t.spark, "deduped"), work_path(t.spark, "ckpt")
    drained(lambda stream: streams.append_to(streams.dedupe_stream(stream), path, checkpoint), Landing(t, jobs, by_year("discovered_at"), "jobs"))
    found = t.spark.read.schema(jobs.schema).parquet(path)
    return found.select("external_id", by_year("discovered_at").alias("part"))


WINDOWS = """
SELECT window_start, window_start + INTERVAL '24' HOUR AS window_end, status, count(*) AS n FROM (
 SELECT status, unnest(generate_series(date_trunc('hour', discovered_at) - INTERVAL '23' HOUR, date_trunc('hour', discovered_at), INTERVAL '1' HOUR)) AS window_start FROM {jobs})
GROUP BY 1, 2, 3"""


@query("h3_window_counts", WINDOWS)
def _(t):
    return streams.window_counts(t("jobs"), "discovered_at", ["status"])


@query("h3_window_stream", WINDOWS)
def _(t):
    jobs = t("jobs").select("id", "status", "discovered_at")
    log = ChangeLog(t.spark, work_path(t.spark, "windows"), ["window_start", "status"], "window_start timestamp, window_end timestamp, status string, n bigint")
    checkpoint = work_path(t.spark, "ckpt")
    drained(lambda stream: streams.window_stream(stream, "discovered_at", ["status"], log, checkpoint), Landing(t, jobs, by_year("discovered_at"), "jobs"))
    return log.current()


CLASS = "CASE WHEN c.id IS NULL THEN NULL WHEN crawler_type IN ('indeed', 'linkedin') THEN 'selenium' WHEN crawler_type IN ('greenhouse', 'lever') THEN 'api' WHEN crawler_type IN ('generic', 'workday') THEN 'ai' ELSE 'unknown' END"


@query("h3_outcome_stream", f"""
WITH l AS (SELECT l.*, CAST(started_at AS DATE) AS day, {CLASS} AS crawler_class FROM {{crawl_logs}} l LEFT JOIN {{companies}} c ON c.id = l.company_id),
spread AS (SELECT CAST(days AS INT) AS days, CAST(day - CAST(back AS INT) AS DATE) AS period_start, l.* FROM l, (SELECT unnest([1, 7, 30]) AS days), range(30) r(back) WHERE back < days)
SELECT days, period_start, crawler_class, count(*) AS crawls, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
 CAST(coalesce(sum(new_jobs) FILTER (status = 'completed'), 0) AS BIGINT) AS new_jobs, count(*) FILTER (status = 'completed') / count(*) AS success_rate,
 avg((epoch_us(completed_at) - epoch_us(started_at)) / 1e6) FILTER (status = 'completed') AS avg_duration FROM spread GROUP BY 1, 2, 3""")
def _(t):
    """One crawl in seven lands a year or more late."""
    logs = t("crawl_logs").select("company_id", "status", "started_at", "completed_at", "new_jobs", "l_orderkey")
    part = F.least(by_year("started_at") + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0), F.lit(PARTS - 1))
    log = PartialLog(t.spark, work_path(t.spark, "outcomes"), outcomes.KEYS, outcomes.PARTIALS)
    log.start(t.spark.createDataFrame([], outcomes.PARTIALS))
    checkpoint = work_path(t.spark, "ckpt")
    drained(lambda stream: outcomes.outcome_stream(stream, t("companies"), log, checkpoint), Landing(t, logs, part, "crawls"))
    return outcomes.outcome_periods(log.current(), [1, 7, 30])


@query("c14_match_stream", MATCHES.replace("s.target_1 IS NULL OR b.company_id IN (s.target_1, s.target_2, s.target_3)))\nSELECT", "b.company_id IN (s.target_1, s.target_2, s.target_3)))\nSELECT"))
def _(t):
    """Postings land by year, one in nine of them twice; searches that take everything are in c14_open_searches."""
    jobs = t("jobs").select("id", "company_id", "title", "description", "location", "job_type", "discovered_at")
    part = by_year("discovered_at")
    again = jobs.filter(F.col("id") % 9 == 0).withColumn("part", F.least(part + 1, F.lit(PARTS - 1)))
    landed = jobs.withColumn("part", part).unionByName(again)
    found = ChangeLog(t.spark, work_path(t.spark, "matches"), ["search_id", "cell", "job_id"], matches.MATCHES)
    found.start(t.spark.createDataFrame([], matches.MATCHES))
    index = joins.standing(searches(t), t("companies"))
    checkpoint = work_path(t.spark, "ckpt")
    drained(lambda stream: matches.match_stream(stream, index, found, checkpoint), Landing(t, landed, F.col("part"), "postings"))
    return matches.matched_totals(found, index)


#: Crawls in a landing of H4: what lands together lies in the state store together.
LANDING_CRAWLS = 5_000_000
RUN = ["company_id", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@query("h4_stuck_runs", f"""
SELECT company_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice, started_at FROM {{crawl_logs}} WHERE completed_at IS NULL AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL '60' MINUTE""")
def _(t):
    logs = t("crawl_logs").select(*RUN, "started_at", "completed_at")
    bounds = slice_bounds(logs, "started_at", LANDING_CRAWLS)
    begun = logs.drop("completed_at")
    starts = SlicedLanding(t, begun, slice_of("started_at", bounds), "starts")
    done = logs.filter("completed_at IS NOT NULL").select(*RUN, F.col("completed_at").alias("finished_at"))
    finishes = SlicedLanding(t, done, slice_of("finished_at", bounds), "finishes")
    path, checkpoint = work_path(t.spark, "stuck"), work_path(t.spark, "ckpt")
    drained(lambda s, f: streams.append_to(streams.stuck_runs(s, f, RUN), path, checkpoint), starts, finishes, parts=len(bounds) + 1)
    found = t.spark.read.schema(begun.schema).parquet(path)
    # the last landing was read with the clock of those before it
    last = F.timestamp_micros(F.lit(bounds[-1] if bounds else None).cast("bigint"))
    before = (begun.filter(F.col("started_at") < last), done.filter(F.col("finished_at") < last))
    return streams.stuck_as_of(found, begun, done, RUN, AS_OF, clock=streams.clock_of(*before))


@query("h5_task_stream", REPLAY)
def _(t):
    return task_log(t).current()


def task_log(t: Tables, wake: bool = False) -> ChangeLog:
    """Tasks after three landings of commands."""
    day = F.dayofmonth("ts")
    part = F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
    log = ChangeLog(t.spark, work_path(t.spark, "tasks"), ["task_id"], streams.STATE)
    log.start(t.spark.createDataFrame([], streams.STATE))
    checkpoint = work_path(t.spark, "ckpt")
    drained(lambda stream: streams.task_stream(stream, log, checkpoint, wake=wake), Landing(t, t("task_commands"), part, "commands"))
    return log


@query("h5_snooze_wake_up", f"""
WITH RECURSIVE e AS (SELECT *, {UNTIL} AS until, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS part FROM {{task_commands}}),
clock AS (SELECT part, max(ts) AS ts FROM e GROUP BY 1),
m AS (SELECT task_id, part, 0 AS look, ts, id, new_status, until FROM e UNION ALL SELECT t.task_id, k.part, 1, k.ts, 0, NULL, NULL FROM (SELECT DISTINCT task_id FROM e) t, clock k),
c AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY part, look, ts, id) AS n FROM m),
walk AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(NULL AS TIMESTAMP) AS until FROM c
 UNION ALL SELECT w.task_id, c.n, CASE WHEN look = 1 THEN CASE WHEN w.status = 'snoozed' AND w.until <= c.ts THEN 'pending' ELSE w.status END
   WHEN (w.status = 'pending' AND c.new_status IN ('in_progress', 'completed', 'snoozed', 'cancelled')) OR (w.status = 'in_progress' AND c.new_status IN ('completed', 'snoozed', 'cancelled'))
   OR (w.status = 'snoozed' AND c.new_status IN ('pending', 'in_progress', 'cancelled')) THEN c.new_status ELSE w.status END,
  CASE WHEN c.new_status = 'snoozed' THEN c.until ELSE w.until END
 FROM walk w JOIN c ON c.task_id = w.task_id AND c.n = w.n + 1)
SELECT task_id, status, until AS snooze_until FROM walk QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC) = 1""")
def _(t):
    return task_log(t, wake=True).current().select("task_id", "status", "snooze_until")


@query("h5_task_timers", f"""
WITH RECURSIVE e AS (SELECT *, {UNTIL} AS until, row_number() OVER (PARTITION BY task_id ORDER BY ts, id) AS n FROM {{task_commands}}),
clock AS (SELECT max(ts) AS ts FROM e),
walk AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(NULL AS TIMESTAMP) AS until FROM e
 UNION ALL SELECT task_id, n, CASE WHEN (status = 'pending' AND new_status IN ('in_progress', 'completed', 'snoozed', 'cancelled')) OR (status = 'in_progress' AND new_status IN ('completed', 'snoozed', 'cancelled'))
   OR (status = 'snoozed' AND new_status IN ('pending', 'in_progress', 'cancelled')) THEN new_status ELSE status END, CASE WHEN new_status = 'snoozed' THEN ends ELSE until END
 FROM (SELECT e.task_id, e.n, e.new_status, e.until AS ends, w.until, CASE WHEN w.status = 'snoozed' AND w.until <= e.ts THEN 'pending' ELSE w.status END AS status
  FROM walk w JOIN e ON e.task_id = w.task_id AND e.n = w.n + 1))
SELECT task_id, CASE WHEN status = 'snoozed' AND until < (SELECT ts FROM clock) THEN 'pending' ELSE status END AS status, until AS snooze_until
FROM walk QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC) = 1""")
def _(t):
    """Commands land in the order of their times, in thirds of the span."""
    commands = t("task_commands")
    ends = commands.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("z")).first()
    place = (F.unix_micros("ts") - (ends["a"] or 0)) * PARTS / ((ends["z"] or 0) - (ends["a"] or 0) + 1)
    log = ChangeLog(t.spark, work_path(t.spark, "timers"), ["task_id"], timers.TASKS)
    log.start(t.spark.createDataFrame([], timers.TASKS))
    checkpoint = work_path(t.spark, "ckpt")
    drained(lambda stream: timers.timer_stream(stream, log, checkpoint), Landing(t, commands, F.floor(place).cast("int"), "commands"))
    return log.current().select("task_id", "status", "snooze_until")


@query("h6_due_reminders", f"""
SELECT id, job_id, due_date FROM {{tasks}} WHERE due_date <= TIMESTAMP '{TODAY}' + INTERVAL '1' HOUR AND status IN ('pending', 'in_progress')""")
def _(t):
    before = F.col("discovered_at") <= F.lit(TODAY).cast("timestamp")
    clock = F.greatest("discovered_at", F.when(F.col("discovered_at") >= F.lit("1998-06-30"), F.lit(TODAY).cast("timestamp")))
    ticks = t("jobs").filter(before).select(clock.alias("as_of")).distinct()
    tasks = t("tasks").select("id", "job_id", "due_date", "status")
    sent = ChangeLog(t.spark, work_path(t.spark, "sent"), ["id"], "id bigint, job_id bigint, due_date timestamp, sent_at timestamp")
    sent.start(t.spark.createDataFrame([], sent.schema))
    checkpoint = work_path(t.spark, "ckpt")
    drained(lambda stream: streams.reminder_stream(stream, tasks, sent, checkpoint), Landing(t, ticks, by_year("as_of"), "ticks"))
    return sent.rows().select("id", "job_id", "due_date")


@query("h7_activity_timeline", "SELECT id, job_id, activity_type, created_at FROM {job_activities}")
def _(t):
    rows = t("job_activities")
    day = F.dayofmonth("created_at")
    part = F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
    path, checkpoint = work_path(t.spark, "timeline"), work_path(t.spark, "ckpt")
    drained(lambda stream: streams.activity_stream(stream, path, checkpoint), Landing(t, rows, part, "activities"))
    return t.spark.read.parquet(path).select("id", "job_id", "activity_type", "created_at")
