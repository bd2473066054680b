"""Registered queries: the event feed replayed as streams; each equals its batch statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelayout.operators import jobs
from pagelayout.plans.job_queries import BATCH, CHANGES_SQL, batches
from pagelayout.plans.registry import query
from pagelayout.sources import views
from pagelayout.sources.views import with_views
from pagelayout.streaming import feeds


def feed(spark: SparkSession, sf: str) -> DataFrame:
    schema = views.table(spark, sf, "events").schema
    return feeds.read_job_events(spark, f"{sf}/events*.parquet", schema)


def raw_feed(spark: SparkSession, sf: str) -> DataFrame:
    schema = views.table(spark, sf, "events").schema
    return feeds.read_feed(spark, f"{sf}/events*.parquet", schema)


@query("S7_read_job_events", with_views("job_events", "SELECT event_id, job_id, status, stage, queue_kind, batch_id, image_key, CAST(attempt AS INTEGER) AS attempt FROM job_events"))
def q_read_job_events(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.replay(feed(spark, sf).select("event_id", "job_id", "status", "stage", "queue_kind", "batch_id", "image_key", "attempt"))


# A stream in the order of time has given out what the final watermark has passed.
PASSED = "us < (SELECT max(epoch_us(ts)) - 3600000000 FROM events)"


def walk_sql(source: str, key: str, row_id: str, fresh: str, select: str) -> str:
    """A greedy walk along each key's rows: a row is fresh by its distance from the last fresh one."""
    return f"""WITH RECURSIVE src AS ({source}), stream AS (SELECT {key} AS key, {row_id} AS rid, us, row_number() OVER (PARTITION BY {key} ORDER BY us, {row_id}) AS n FROM src),
  walk AS (SELECT key, rid, us, n, us AS anchor, rid AS owner, true AS fresh FROM stream WHERE n = 1 UNION ALL
  SELECT s.key, s.rid, s.us, s.n, CASE WHEN {fresh} THEN s.us ELSE w.anchor END, CASE WHEN {fresh} THEN s.rid ELSE w.owner END, {fresh} FROM walk w JOIN stream s ON s.key = w.key AND s.n = w.n + 1) {select}"""


@query(
    "R1_idempotent_submissions",
    walk_sql("SELECT event_id, 'tp:' || user_id || '-' || hour(ts) AS k, epoch_us(ts) AS us FROM events", "k", "event_id", "(s.us - w.anchor > 864000000000)", "SELECT key AS idempotency_key, rid AS event_id, owner AS job_event, NOT fresh AS idempotent FROM walk"),
)
def q_idempotent_submissions(spark: SparkSession, sf: str) -> DataFrame:
    sent = feed(spark, sf).select("ts", "event_id", "idempotency_key")
    return feeds.replay_whole(sent, lambda s: feeds.idempotent_submissions(s, 10 * jobs.DAY_MICROS)).select("idempotency_key", "event_id", "job_event", "idempotent")


@query(
    "R3_renewed_submissions",
    f"""WITH RECURSIVE src AS (SELECT event_id AS rid, 'tp:' || user_id || '-' || (hour(ts) // 6) AS key, epoch_us(ts) AS us, event_type = 'view' AS renews FROM events),
  stream AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, CASE WHEN renews THEN -1 ELSE rid END) AS n FROM src),
  walk AS (SELECT key, rid, us, n, renews, CASE WHEN NOT renews THEN us END AS anchor, CASE WHEN NOT renews THEN rid END AS owner, NOT renews AS fresh FROM stream WHERE n = 1 UNION ALL
  SELECT s.key, s.rid, s.us, s.n, s.renews, CASE WHEN s.renews = (s.us - coalesce(w.anchor, -1000000000000) <= 432000000000) THEN s.us ELSE w.anchor END,
  CASE WHEN NOT s.renews AND s.us - coalesce(w.anchor, -1000000000000) > 432000000000 THEN s.rid ELSE w.owner END, NOT s.renews AND s.us - coalesce(w.anchor, -1000000000000) > 432000000000
  FROM walk w JOIN stream s ON s.key = w.key AND s.n = w.n + 1) SELECT key AS idempotency_key, rid AS event_id, owner AS job_event, NOT fresh AS idempotent FROM walk WHERE NOT renews AND {PASSED}""",
)
def q_renewed_submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Views are updates of the job that holds their user's key; a job lives five days after its last update."""
    key = F.concat(F.lit("tp:"), F.col("user_id").cast("string"), F.lit("-"), F.floor(F.hour("ts") / 6).cast("string"))
    views_ = raw_feed(spark, sf).filter("event_type = 'view'").select(key.alias("key"), jobs.micros("ts").alias("us"))
    sent = raw_feed(spark, sf).filter("event_type <> 'view'").select("event_id", "ts", key.alias("idempotency_key"))
    return feeds.replay(feeds.idempotent_submissions(sent, 5 * jobs.DAY_MICROS, updates=views_)).select("idempotency_key", "event_id", "job_event", "idempotent")


@query("R1_first_submissions", with_views("job_events", "SELECT idempotency_key FROM job_events GROUP BY 1"))
def q_first_submissions(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.replay(feeds.first_submissions(feed(spark, sf)).select("idempotency_key"))


@query(
    "R2_job_state_stream",
    with_views(
        "job_events",
        """SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(stage, (ts, event_id)) AS stage, max(CASE WHEN pg IS NULL OR pg <> stage THEN epoch_us(ts) END) AS stage_us, max(epoch_us(ts)) AS last_us, (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM job_events) >= max(epoch_us(ts)) // 1000 + 864000000 AS expired FROM changes GROUP BY job_id""",
        changes=CHANGES_SQL,
    ),
)
def q_job_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.newest(feeds.replay(feeds.job_state_stream(feed(spark, sf), ttl_ms=864_000_000), "update"), ["job_id"])


@query("R4_batch_progress_stream", with_views("job_events", "SELECT * FROM progress", **BATCH))
def q_batch_progress_stream(spark: SparkSession, sf: str) -> DataFrame:
    it = feeds.newest(feeds.replay(feeds.batch_items_stream(feed(spark, sf)), "update"), ["batch_id", "image_key"])
    return jobs.batch_progress(it, batches(it))


@query(
    "R6_throttle_stream",
    walk_sql("SELECT event_id, strftime(ts, '%Y-%m-%d') AS k, epoch_us(ts) AS us FROM events", "k", "event_id", "(s.us - w.anchor >= 600000000)", "SELECT key AS batch_id, rid AS event_id FROM walk WHERE fresh"),
)
def q_throttle_stream(spark: SparkSession, sf: str) -> DataFrame:
    asked = feed(spark, sf).select("ts", "event_id", "batch_id")
    out = feeds.replay_whole(asked, lambda s: feeds.throttle_stream(s, F.col("batch_id"), 600_000_000))
    return out.select(F.col("key").alias("batch_id"), "event_id")


@query(
    "R7_stale_results_stream",
    """WITH sess AS (SELECT user_id AS tab_id, CAST(event_id AS VARCHAR) AS session_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'), res AS (SELECT event_id AS result_id, user_id AS tab_id, epoch_us(ts) AS us, CAST(event_id - event_id % 50 AS VARCHAR) AS session_id FROM events WHERE event_type = 'purchase')
  SELECT r.result_id, r.tab_id, CASE WHEN r.us - s.us <= 2592000000000 THEN s.session_id END AS session_now, coalesce(r.us - s.us <= 2592000000000 AND r.session_id <> s.session_id, false) AS moved FROM res r ASOF LEFT JOIN sess s ON s.tab_id = r.tab_id AND r.us >= s.us
  WHERE r.us < (SELECT max(epoch_us(ts)) - 3600000000 FROM events WHERE event_type IN ('signup', 'purchase'))""",
)
def q_stale_results_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = raw_feed(spark, sf).withColumn("us", jobs.micros("ts"))
    eid = F.col("event_id")
    sess = e.filter("event_type = 'signup'").select(F.col("user_id").alias("tab_id"), "us", eid.cast("string").alias("session_id"))
    e2 = raw_feed(spark, sf).withColumn("us", jobs.micros("ts"))
    res = e2.filter("event_type = 'purchase'").select(F.col("user_id").alias("tab_id"), "us", eid.alias("result_id"), (eid - eid % 50).cast("string").alias("session_id"))
    return feeds.replay(feeds.stale_results_stream(res, sess)).select("result_id", "tab_id", "session_now", "moved")


@query(
    "R8_cancelled_jobs_stream",
    """WITH nav AS (SELECT user_id AS tab_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'),
  gone AS (SELECT user_id AS tab_id, event_id % 4 AS batch_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error'),
  work AS (SELECT event_id AS job_id, user_id AS tab_id, event_id % 4 AS batch_id, epoch_us(ts) AS opened, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) + (event_id % 480) * 3600000000 END AS closed FROM events WHERE event_type = 'view'),
  hits AS (SELECT job_id, w.tab_id, n.us, 3 AS rank FROM work w JOIN nav n ON n.tab_id = w.tab_id AND n.us >= opened AND (closed IS NULL OR n.us < closed)
  UNION ALL SELECT job_id, w.tab_id, g.us, 2 FROM work w JOIN gone g ON g.tab_id = w.tab_id AND g.batch_id = w.batch_id AND g.us >= opened AND (closed IS NULL OR g.us < closed))
  SELECT job_id, tab_id, min(us) AS aborted_us, CASE WHEN arg_min(rank, (us, rank)) = 3 THEN 'navigation' ELSE 'cancel' END AS reason FROM hits
  WHERE us < (SELECT max(epoch_us(ts)) - 3600000000 FROM events WHERE event_type IN ('signup', 'view', 'error')) GROUP BY 1, 2""",
)
def q_cancelled_jobs_stream(spark: SparkSession, sf: str) -> DataFrame:
    eid, us = F.col("event_id"), jobs.micros("ts")
    kind = lambda name: raw_feed(spark, sf).filter(F.col("event_type") == name)
    closed = F.when(eid % 3 != 0, us + (eid % 480) * 3_600_000_000)
    opened = kind("view").select(eid.alias("job_id"), F.col("user_id").alias("tab_id"), us.alias("us"), closed.alias("closed_us"), (eid % 4).alias("batch_id"))
    nav = kind("signup").select(F.col("user_id").alias("tab_id"), us.alias("us"))
    cancels = kind("error").select(F.col("user_id").alias("tab_id"), us.alias("us"), (eid % 4).alias("batch_id"))
    return feeds.replay(feeds.cancelled_jobs_stream(opened, nav, cancels))


@query(
    "R9_bounded_cache_stream",
    f"""WITH RECURSIVE lookups AS (SELECT event_type AS cache, event_id AS request_id, 'k' || (event_id * 7 % 41) AS cache_key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS n FROM events),
  walk AS (SELECT cache, request_id, cache_key, us, n, [{{'k': cache_key, 's': us}}] AS held, false AS hit FROM lookups WHERE n = 1 UNION ALL
  SELECT l.cache, l.request_id, l.cache_key, l.us, l.n, list_slice(list_append(list_filter(w.held, lambda e: e.k <> l.cache_key), {{'k': l.cache_key, 's': CASE WHEN len(list_filter(w.held, lambda e: e.k = l.cache_key AND l.us - e.s <= 172800000000)) > 0 THEN list_filter(w.held, lambda e: e.k = l.cache_key)[1].s ELSE l.us END}}), -24, -1),
  len(list_filter(w.held, lambda e: e.k = l.cache_key AND l.us - e.s <= 172800000000)) > 0 FROM walk w JOIN lookups l ON l.cache = w.cache AND l.n = w.n + 1)
  SELECT cache, request_id, cache_key, hit FROM walk WHERE {PASSED}""",
)
def q_bounded_cache_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A cache of 24 entries per kind of event, for two days."""
    e = raw_feed(spark, sf).select("ts", F.col("event_type").alias("cache"), F.col("event_id").alias("request_id"), F.concat(F.lit("k"), (F.col("event_id") * 7 % 41).cast("string")).alias("cache_key"))
    return feeds.replay(feeds.bounded_cache_stream(e, 24, 2 * jobs.DAY_MICROS)).select("cache", "request_id", "cache_key", "hit")


@query(
    "R9_ttl_cache_stream",
    walk_sql("SELECT event_id AS request_id, 'k' || (event_id % 97) AS k, epoch_us(ts) AS us FROM events", "k", "request_id", "(s.us - w.anchor > 86400000000)", f"SELECT key AS cache_key, rid AS request_id, NOT fresh AS hit FROM walk WHERE {PASSED}"),
)
def q_ttl_cache_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = raw_feed(spark, sf).select("ts", F.col("event_id").alias("request_id"), F.concat(F.lit("k"), (F.col("event_id") % 97).cast("string")).alias("cache_key"))
    return feeds.replay(feeds.ttl_cache_stream(e, jobs.DAY_MICROS)).select("cache_key", "request_id", "hit")


@query(
    "R10_event_windows_stream",
    with_views("job_events", "SELECT win_start, win_end, queue_kind, status, count(*) AS n FROM (SELECT time_bucket(INTERVAL '6 hours', ts) AS win_start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS win_end, queue_kind, status FROM job_events) WHERE win_end <= (SELECT max(ts) - INTERVAL '1 hour' FROM job_events) GROUP BY ALL"),
)
def q_event_windows_stream(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.replay(feeds.event_windows_stream(feed(spark, sf), "6 hours"))
