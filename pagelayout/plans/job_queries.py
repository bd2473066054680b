"""Registered queries: job telemetry, keys and error classes over the event feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelayout.functions import errors as er
from pagelayout.functions import keys as ky
from pagelayout.functions.exprs import fixed
from pagelayout.operators import jobs
from pagelayout.plans.registry import query
from pagelayout.sources import views
from pagelayout.sources.views import with_views

PERM_SQL, LABEL_SQL, STAGE_SQL = er.classify_error_sql("message")
ITEMS_SQL = f"""SELECT batch_id, image_key, attempt, CASE WHEN status = 'running' THEN 'processing' ELSE status END AS status, message AS last_error, CASE WHEN message IS NULL THEN false ELSE {PERM_SQL} END AS permanent
  FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, image_key ORDER BY ts DESC, event_id DESC) AS rn FROM job_events) WHERE rn = 1"""
# Odd batches are in their first pass; their total counts first attempts only, so some are complete.
BATCHES_SQL = """SELECT batch_id, CASE WHEN CAST(right(batch_id, 2) AS INTEGER) % 4 = 0 THEN 2 ELSE 1 END AS pass,
  CAST(CASE WHEN CAST(right(batch_id, 2) AS INTEGER) % 4 = 1 THEN count(*) FILTER (WHERE attempt = 1) ELSE count(*) FILTER (WHERE attempt = 1 AND status IN ('done','error')) END AS BIGINT) AS total1,
  CAST(count(*) FILTER (WHERE attempt = 2) AS BIGINT) AS total2 FROM items GROUP BY batch_id"""
PROGRESS_SQL = """SELECT batch_id, pass, total, queued, processing, inserting, done, error, aborted, done+error+aborted AS finished,
  CAST(CASE WHEN total > 0 THEN greatest(0, least(100, floor(100.0::DOUBLE*(done+error+aborted)/total + 0.5))) ELSE 0 END AS INTEGER) AS pct FROM (
  SELECT b.batch_id, b.pass, CASE WHEN b.pass = 2 THEN b.total2 ELSE b.total1 END AS total, count(*) FILTER (WHERE i.status='queued') AS queued, count(*) FILTER (WHERE i.status='processing') AS processing,
  count(*) FILTER (WHERE i.status='inserting') AS inserting, count(*) FILTER (WHERE i.status='done') AS done, count(*) FILTER (WHERE i.status='error') AS error, count(*) FILTER (WHERE i.status='aborted') AS aborted
  FROM batches b LEFT JOIN items i ON i.batch_id = b.batch_id AND i.attempt = b.pass GROUP BY ALL)"""
BATCH = {"items": ITEMS_SQL, "batches": BATCHES_SQL, "progress": PROGRESS_SQL}


def items(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.batch_items(views.job_events(spark, sf))


def batches(it: DataFrame) -> DataFrame:
    day = F.right("batch_id", F.lit(2)).cast("int")
    first = F.count_if(F.col("attempt") == 1)
    closed = F.count_if((F.col("attempt") == 1) & F.col("status").isin("done", "error"))
    g = it.groupBy("batch_id").agg(first.alias("n1"), closed.alias("n1c"), F.count_if(F.col("attempt") == 2).alias("total2"))
    return g.select("batch_id", F.when(day % 4 == 0, 2).otherwise(1).alias("pass"), F.when(day % 4 == 1, F.col("n1")).otherwise(F.col("n1c")).alias("total1"), "total2")


@query("A7_batch_progress", with_views("job_events", "SELECT * FROM progress", **BATCH))
def q_batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    it = items(spark, sf)
    return jobs.batch_progress(it, batches(it))


@query("A8_error_histogram", with_views("job_events", f"SELECT batch_id, label, count(*) AS n FROM (SELECT batch_id, {er.classify_error_sql('last_error')[1]} AS label FROM items WHERE status = 'error' AND coalesce(last_error, '') <> '') GROUP BY ALL", items=ITEMS_SQL))
def q_error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.error_histogram(items(spark, sf))


@query("R5_second_pass", with_views("job_events", "SELECT batch_id, image_key, 2 AS attempt, 'queued' AS status, last_error FROM items SEMI JOIN (SELECT batch_id FROM progress WHERE pass = 1 AND total > 0 AND finished >= total) r USING (batch_id) WHERE attempt = 1 AND status = 'error' AND NOT permanent", **BATCH))
def q_second_pass(spark: SparkSession, sf: str) -> DataFrame:
    it = items(spark, sf)
    return jobs.second_pass(it, jobs.batch_progress(it, batches(it))).select("batch_id", "image_key", "attempt", "status", "last_error")


@query("R5_second_pass_plan", with_views("job_events", "SELECT p.batch_id, count(i.image_key) AS total2, count(i.image_key) = 0 AS finished FROM progress p LEFT JOIN (SELECT * FROM items WHERE attempt = 1 AND status = 'error' AND NOT permanent) i USING (batch_id) WHERE p.pass = 1 AND p.total > 0 AND p.finished >= p.total GROUP BY 1", **BATCH))
def q_second_pass_plan(spark: SparkSession, sf: str) -> DataFrame:
    it = items(spark, sf)
    return jobs.second_pass_plan(it, jobs.batch_progress(it, batches(it)))


STATE_SQL = """SELECT job_id, status, stage, queue_kind, coalesce(queued_us, last_us) AS queued_us, first_us, last_us, n_events FROM (
  SELECT job_id, arg_max(status, (epoch_us(ts), event_id)) AS status, arg_max(stage, (epoch_us(ts), event_id)) AS stage, arg_max(queue_kind, (epoch_us(ts), event_id)) AS queue_kind,
  max(epoch_us(ts)) FILTER (WHERE status = 'queued') AS queued_us, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS n_events FROM job_events GROUP BY job_id)"""


def state(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.job_state(views.job_events(spark, sf))


@query("R2_job_state", with_views("job_events", "SELECT * FROM state", state=STATE_SQL))
def q_job_state(spark: SparkSession, sf: str) -> DataFrame:
    return state(spark, sf).select("job_id", "status", "stage", "queue_kind", "queued_us", "first_us", "last_us", "n_events")


@query("A13_queue_depths", with_views("job_events", "SELECT count(*) FILTER (WHERE status='queued') AS queue_depth, count(*) FILTER (WHERE status='queued' AND queue_kind='direct') AS queue_depth_direct, count(*) FILTER (WHERE status='queued' AND queue_kind='ai') AS queue_depth_ai FROM state", state=STATE_SQL))
def q_queue_depths(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.queue_depths(state(spark, sf))


_POSITIONS = """SELECT s.job_id, s.status, s.stage, s.queue_kind, p.pos AS queue_position, coalesce(d.n, 0) AS lane_depth,
  CASE WHEN s.status IN ('done','error') THEN 0 WHEN coalesce(d.n,0) > 20 THEN 1500 WHEN coalesce(d.n,0) > 5 THEN 800 WHEN s.status = 'running' THEN 500 ELSE 400 END AS poll_after_ms FROM state s
  LEFT JOIN (SELECT job_id, row_number() OVER (PARTITION BY queue_kind ORDER BY queued_us, job_id) AS pos FROM state WHERE status = 'queued') p USING (job_id)
  LEFT JOIN (SELECT queue_kind, count(*) AS n FROM state WHERE status = 'queued' GROUP BY 1) d USING (queue_kind)"""


@query("W10_queue_position", with_views("job_events", "SELECT job_id, queue_kind, queue_position, lane_depth, poll_after_ms FROM positions", state=STATE_SQL, positions=_POSITIONS))
def q_queue_position(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.queue_position(state(spark, sf)).select("job_id", "queue_kind", "queue_position", "lane_depth", "poll_after_ms")


@query(
    "T34_queue_label",
    with_views(
        "job_events",
        """SELECT job_id, CASE status WHEN 'queued' THEN CASE WHEN queue_position > 0 AND lane_depth > 0 THEN kind || ' queue #' || queue_position || '/' || lane_depth WHEN lane_depth > 0 THEN kind || ' queue ' || lane_depth ELSE kind || ' queue' END
  WHEN 'running' THEN kind || ': ' || stage ELSE '' END AS label FROM (SELECT *, CASE WHEN queue_kind = 'ai' THEN 'AI' ELSE 'Direct' END AS kind FROM positions)""",
        state=STATE_SQL, positions=_POSITIONS,
    ),
)
def q_queue_label(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    p = jobs.queue_position(state(spark, sf))
    return p.select("job_id", jobs.queue_label(c("queue_kind"), c("status"), c("stage"), c("queue_position"), c("lane_depth"), c("lane_depth")).alias("label"))


CHANGES_SQL = """SELECT * FROM (SELECT event_id, job_id, ts, status, stage, lag(status) OVER w AS ps, lag(stage) OVER w AS pg FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))"""


@query("W11_status_changes", with_views("job_events", "SELECT event_id, job_id, status, stage FROM changes WHERE ps IS NULL OR ps <> status OR pg <> stage", changes=CHANGES_SQL))
def q_status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.status_changes(views.job_events(spark, sf)).select("event_id", "job_id", "status", "stage")


_DURATIONS = """SELECT *, max(CASE WHEN pg IS NULL OR pg <> stage THEN epoch_us(ts) END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS stage_us,
  min(CASE WHEN status = 'running' THEN epoch_us(ts) END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS run_us FROM changes"""


@query(
    "W12_stage_durations",
    with_views("job_events", "SELECT event_id, job_id, stage_us, floor((epoch_us(ts) - coalesce(run_us, epoch_us(ts)))/1000.0::DOUBLE*10+0.5)/10 AS elapsed_ms, floor((epoch_us(ts) - stage_us)/1000.0::DOUBLE*10+0.5)/10 AS stage_elapsed_ms FROM durations", changes=CHANGES_SQL, durations=_DURATIONS),
)
def q_stage_durations(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.stage_durations(views.job_events(spark, sf)).select("event_id", "job_id", "stage_us", "elapsed_ms", "stage_elapsed_ms")


@query(
    "A14_stage_latency",
    with_views(
        "job_events",
        """SELECT stage, count(*) AS n, CAST(sum(ms) AS BIGINT) AS sum_ms, max(ms) AS max_ms, floor(quantile_cont(CAST(ms AS DOUBLE), 0.5)*100+0.5)/100 AS p50_ms, floor(quantile_cont(CAST(ms AS DOUBLE), 0.95)*100+0.5)/100 AS p95_ms FROM (
  SELECT stage, (lead(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts, event_id) - epoch_us(ts)) // 1000 AS ms FROM changes WHERE pg IS NULL OR pg <> stage) WHERE ms IS NOT NULL GROUP BY stage""",
        changes=CHANGES_SQL,
    ),
)
def q_stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.stage_latency(jobs.stage_spans(views.job_events(spark, sf)))
    return out.select("stage", "n", "sum_ms", "max_ms", fixed("p50_ms", 2).alias("p50_ms"), fixed("p95_ms", 2).alias("p95_ms"))


# ---------------------------------------------------------------- retention, upserts, cache

_KEPT = """SELECT queue_kind, job_id, last_us FROM (SELECT *, row_number() OVER (PARTITION BY queue_kind ORDER BY last_us DESC, job_id) AS rn FROM state, (SELECT max(epoch_us(ts)) AS now_us FROM job_events) WHERE now_us - last_us <= 864000000000) WHERE rn <= 24"""


def with_now(df: DataFrame, events: DataFrame) -> DataFrame:
    """The newest event is 'now' of a replay; one row, so joining it is free."""
    now = events.agg(F.max(jobs.micros("ts")).alias("now_us"))
    return df.join(F.broadcast(now))


@query("O3_retain_recent", with_views("job_events", _KEPT, state=STATE_SQL))
def q_retain_recent(spark: SparkSession, sf: str) -> DataFrame:
    s = with_now(state(spark, sf), views.job_events(spark, sf))
    return jobs.retain_recent(s, ["queue_kind"], "last_us", F.col("now_us"), 10 * jobs.DAY_MICROS, 24, ["job_id"]).select("queue_kind", "job_id", "last_us")


@query("R3_expire_jobs", with_views("job_events", "SELECT job_id, last_us FROM state, (SELECT max(epoch_us(ts)) AS now_us FROM job_events) WHERE last_us >= now_us - 3600000000*24", state=STATE_SQL))
def q_expire_jobs(spark: SparkSession, sf: str) -> DataFrame:
    s = with_now(state(spark, sf), views.job_events(spark, sf))
    return jobs.expire_jobs(s, F.col("now_us"), 24 * 3_600_000_000).select("job_id", "last_us")


@query("S9_upsert_results", "SELECT user_id, event_id, epoch_us(ts) AS us, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def q_upsert_results(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select("user_id", "event_id", jobs.micros("ts").alias("us"), "event_type")
    old = F.col("event_type") == "view"
    return jobs.upsert_results(e.filter(old), e.filter(~old), ["user_id"], ["us", "event_id"])


@query("O5_keep_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def q_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    from pagelayout.operators.scans import first_by

    e = views.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return first_by(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


_ENGINE_SQL = "CASE WHEN replace(lower(trim(ocr_engine)), '-', '_') IN ('paddle','paddle_ocr','paddleocr') THEN 'paddleocr' ELSE 'google_lens' END"
_KEYED_SQL = f"""SELECT request_id, epoch_us(ts) AS us, mode, kind, img_hash || '|' || trim(lang) || '|' || trim(mode) || '|' || CASE kind WHEN 'ai' THEN trim(source) ELSE 'text' END || '|' || {_ENGINE_SQL}
|| CASE kind WHEN 'ai' THEN concat('|', trim(provider), '|', trim(model), '|', trim(base_url), '|') ELSE '' END AS cache_key
FROM (SELECT *, CASE WHEN source = 'ai' OR starts_with(source, 'cli_') THEN 'ai' ELSE 'plain' END AS kind FROM requests)"""


def keyed_requests(spark: SparkSession, sf: str) -> DataFrame:
    r = views.requests(spark, sf).withColumn("cache_kind", jobs.cache_kind(F.col("source")))
    c = F.col
    ai = c("cache_kind") == "ai"
    plain_key = ky.cache_key(c("img_hash"), F.trim("lang"), c("mode"), F.lit("text"), c("ocr_engine"))
    ai_key = ky.cache_key(c("img_hash"), F.trim("lang"), c("mode"), c("source"), c("ocr_engine"), (c("provider"), c("model"), c("base_url"), F.lit("")))
    return r.select("request_id", jobs.micros("ts").alias("us"), "mode", "img_hash", "cache_kind", F.when(ai, ai_key).otherwise(plain_key).alias("cache_key"))


@query(
    "J7_cache_lookup",
    with_views(
        "requests",
        """SELECT request_id, kind AS cache_kind, CASE WHEN mode <> 'lens_text' THEN 'off' WHEN us > min(us) OVER (PARTITION BY kind, cache_key) THEN 'hit' ELSE 'miss' END AS cache FROM keyed""",
        keyed=_KEYED_SQL,
    ),
)
def q_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each request against the results of all earlier ones."""
    r = keyed_requests(spark, sf)
    stored = r.filter("mode = 'lens_text'").select("cache_kind", "cache_key", "us")
    return jobs.cache_lookup(r, stored).select("request_id", "cache_kind", "cache")


# ---------------------------------------------------------------- as-of rules

_SESS = "SELECT user_id AS tab_id, CAST(event_id AS VARCHAR) AS session_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'"
_RES = "SELECT event_id AS result_id, user_id AS tab_id, epoch_us(ts) AS us, epoch_us(ts) - (event_id % 480)*3600000000 AS sent_us, event_id % 11 = 0 AS old_settings, event_id % 2 = 0 AS keep_cache FROM events WHERE event_type = 'purchase'"


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").filter("event_type = 'signup'")
    return e.select(F.col("user_id").alias("tab_id"), F.col("event_id").cast("string").alias("session_id"), jobs.micros("ts").alias("us"))


@query(
    "J13_stale_results",
    f"""WITH sess AS ({_SESS}), res AS ({_RES}), sent AS (SELECT r.*, s.session_id FROM res r ASOF LEFT JOIN sess s ON s.tab_id = r.tab_id AND r.sent_us >= s.us),
  got AS (SELECT r.*, s.session_id AS session_now FROM sent r ASOF LEFT JOIN sess s ON s.tab_id = r.tab_id AND r.us >= s.us),
  judged AS (SELECT *, coalesce(session_id <> session_now, false) OR old_settings AS stale FROM got)
  SELECT result_id, tab_id, session_now, stale, CASE WHEN stale AND keep_cache THEN 'done' WHEN stale THEN 'aborted' ELSE 'inserting' END AS status, stale AND keep_cache AS cached_only FROM judged""",
)
def q_stale_results(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    e = views.table(spark, sf, "events").filter("event_type = 'purchase'").withColumn("at", jobs.micros("ts"))
    sent = e.select(
        eid.alias("result_id"), F.col("user_id").alias("tab_id"), (F.col("at") - (eid % 480) * 3_600_000_000).alias("us"), "at",
        F.when(eid % 11 == 0, 0).otherwise(1).alias("settings_epoch"), F.lit(1).alias("epoch_now"), (eid % 2 == 0).alias("keep_cache"),
    )
    s = sessions(spark, sf)
    asked = jobs.asof(sent, s, ["tab_id"], "us", F.col("session_id"), "session_id", "result_id")
    arrived = asked.withColumn("us", F.col("at")).drop("at")
    return jobs.stale_results(arrived, s).select("result_id", "tab_id", "session_now", "stale", "status", "cached_only")


@query(
    "J14_suppress_errors",
    """WITH rep AS (SELECT user_id AS url, epoch_us(ts) AS us, CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'pending' END AS state FROM events WHERE event_type IN ('purchase','click')),
  err AS (SELECT event_id AS error_id, user_id AS url, epoch_us(ts) AS us FROM events WHERE event_type = 'error')
  SELECT error_id, e.url, NOT coalesce(state = 'ok' OR (state = 'pending' AND e.us - r.us < 12*3600000000), false) AS shown FROM err e ASOF LEFT JOIN rep r ON r.url = e.url AND e.us >= r.us""",
)
def q_suppress_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select("event_id", F.col("user_id").alias("url"), jobs.micros("ts").alias("us"), "event_type")
    rep = e.filter(F.col("event_type").isin("purchase", "click")).select("url", "us", F.when(F.col("event_type") == "purchase", "ok").otherwise("pending").alias("state"))
    err = e.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "url", "us")
    return jobs.suppress_errors(err, rep, grace_ms=12 * 3_600_000).select("error_id", "url", "shown")


@query(
    "R8_cancel_tab_work",
    """WITH nav AS (SELECT user_id AS tab_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'),
  work AS (SELECT event_id AS job_id, user_id AS tab_id, epoch_us(ts) AS opened_us, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) + (event_id % 480)*3600000000 END AS closed_us FROM events WHERE event_type = 'view')
  SELECT job_id, tab_id, aborted_us FROM (SELECT w.*, n.us AS aborted_us FROM work w ASOF JOIN nav n ON n.tab_id = w.tab_id AND w.opened_us <= n.us) WHERE closed_us IS NULL OR aborted_us < closed_us""",
)
def q_cancel_tab_work(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select("event_id", F.col("user_id").alias("tab_id"), jobs.micros("ts").alias("us"), "event_type")
    nav = e.filter("event_type = 'signup'").select("tab_id", "us")
    eid = F.col("event_id")
    work = e.filter("event_type = 'view'").select(eid.alias("job_id"), "tab_id", F.col("us").alias("opened_us"), F.when(eid % 3 != 0, F.col("us") + (eid % 480) * 3_600_000_000).alias("closed_us"))
    return jobs.cancel_tab_work(work, nav)


@query(
    "R6_throttle",
    with_views(
        "job_events",
        """SELECT batch_id, event_id FROM walk WHERE keep""",
        stream="SELECT batch_id, event_id, epoch_us(ts) AS us, message IS NOT NULL AS forced, row_number() OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS n FROM job_events",
        walk="""SELECT batch_id, event_id, n, us AS last_us, true AS keep FROM stream WHERE n = 1 UNION ALL
  SELECT s.batch_id, s.event_id, s.n, CASE WHEN s.forced OR s.us - w.last_us >= 600000000 THEN s.us ELSE w.last_us END, s.forced OR s.us - w.last_us >= 600000000 FROM walk w JOIN stream s ON s.batch_id = w.batch_id AND s.n = w.n + 1""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def q_throttle(spark: SparkSession, sf: str) -> DataFrame:
    e = views.job_events(spark, sf).select("batch_id", "event_id", jobs.micros("ts").alias("us"), F.col("message").isNotNull().alias("forced"))
    return jobs.throttle(e, ["batch_id"], "us", "event_id", 600_000_000, F.col("forced")).select("batch_id", "event_id")


@query("R10_event_windows", with_views("job_events", "SELECT time_bucket(INTERVAL '6 hours', ts) AS win_start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS win_end, queue_kind, status, count(*) AS n FROM job_events GROUP BY ALL"))
def q_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.event_windows(views.job_events(spark, sf), "6 hours")


@query(
    "R10_sliding_windows",
    with_views("job_events", "SELECT s AS win_start, s + INTERVAL '6 hours' AS win_end, queue_kind, status, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL '2 hours', ts) - INTERVAL '2 hours' * CAST(unnest(range(3)) AS INTEGER) AS s FROM job_events) GROUP BY ALL"),
)
def q_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.event_windows(views.job_events(spark, sf), "6 hours", "2 hours")


@query(
    "R10_event_sessions",
    with_views(
        "job_events",
        """SELECT job_id, min(ts) AS win_start, max(ts) + INTERVAL '8 hours' AS win_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS g FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) < INTERVAL '8 hours' THEN 0 ELSE 1 END AS fresh FROM job_events)) GROUP BY job_id, g""",
    ),
)
def q_event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.event_sessions(views.job_events(spark, sf), "8 hours")


# ---------------------------------------------------------------- routing, outcomes, keys


@query(
    "F13_route_requests",
    with_views(
        "requests",
        f"""SELECT request_id, CASE WHEN lower(trim(mode)) = 'lens_text' AND (lower(source) = 'ai' OR starts_with(lower(source), 'cli_')) THEN 'ai' ELSE 'direct' END AS lane,
  CASE WHEN trim(mode) IN ('lens_images','lens_text') THEN trim(mode) ELSE 'lens_images' END AS service_mode, {_ENGINE_SQL} AS service_engine, ui_mode, ui_engine,
  CASE WHEN ui_mode = 'lens_text' AND ui_engine = 'paddleocr' AND source = 'translated' THEN 'original' ELSE source END AS ui_source, CASE WHEN model IN ('low','medium','high','xhigh') THEN model ELSE 'medium' END AS effort FROM
  (SELECT *, CASE WHEN um = 'lens_text' AND replace(lower(ocr_engine), '-', '_') = 'paddleocr' THEN 'paddleocr' ELSE 'google_lens' END AS ui_engine, um AS ui_mode FROM
  (SELECT *, CASE WHEN trim(mode) IN ('lens_images','lens_text') THEN trim(mode) ELSE 'lens_text' END AS um FROM requests))""",
    ),
)
def q_route_requests(spark: SparkSession, sf: str) -> DataFrame:
    r = views.requests(spark, sf).withColumn("effort", F.col("model"))
    return jobs.route_requests(r).select("request_id", "lane", "service_mode", "service_engine", "ui_mode", "ui_engine", "ui_source", "effort")


@query(
    "F18_result_outcome",
    """SELECT event_id, (need_r OR need_o) AND NOT bad_r AND NOT bad_o AS ok, CASE WHEN NOT img AND NOT html THEN 'API returned no overlay data' ELSE concat_ws(' + ', CASE WHEN bad_r THEN 'DOM replace failed' END, CASE WHEN bad_o THEN 'Overlay insert failed' END) END AS error_text FROM
  (SELECT *, need_r AND event_id % 5 = 0 AS bad_r, need_o AND event_id % 7 = 0 AS bad_o FROM (SELECT event_id, event_id % 3 > 0 AS img, event_id % 4 > 0 AS html, event_id % 3 > 0 AND event_type <> 'view' AS need_r, event_id % 4 > 0 AS need_o FROM events))""",
)
def q_result_outcome(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    e = views.table(spark, sf, "events").select(
        "event_id", (eid % 3 > 0).alias("has_image"), (eid % 4 > 0).alias("has_html"), F.when(F.col("event_type") == "view", "lens_text").otherwise("lens_images").alias("mode"),
        (eid % 5 != 0).alias("replace_applied"), (eid % 7 != 0).alias("overlay_applied"),
    )
    return jobs.result_outcome(e).select("event_id", "ok", "error_text")


_CODES = "list_extract([200,204,404,429,500,599,302,413], CAST(event_id % 8 + 1 AS BIGINT))"
_STATUS_SQL = "CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in jobs.HTTP_STATUS.items()) + " ELSE event_type END"


@query("J15_enrich_http_status", f"SELECT event_id, CAST(code AS INTEGER) AS code, {_STATUS_SQL} AS status_text FROM (SELECT event_id, event_type, {_CODES} AS code FROM events)")
def q_enrich_http_status(spark: SparkSession, sf: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(x) for x in (200, 204, 404, 429, 500, 599, 302, 413)]), (F.col("event_id") % 8 + 1).cast("int"))
    log = views.table(spark, sf, "events").select("event_id", code.alias("code"), F.col("event_type").alias("text"))
    return jobs.enrich_http_status(log).select("event_id", "code", "status_text")


@query("T21_classify_error", with_views("job_events", f"SELECT event_id, {PERM_SQL} AS permanent, {LABEL_SQL} AS label, {STAGE_SQL} AS stage FROM job_events WHERE message IS NOT NULL"))
def q_classify_error(spark: SparkSession, sf: str) -> DataFrame:
    e = views.job_events(spark, sf).filter(F.col("message").isNotNull())
    return e.select("event_id", er.classify_error("message").alias("c")).select("event_id", "c.permanent", "c.label", "c.stage")


def _any_sql(words: list[str], m: str = "lower(message)") -> str:
    return "(" + " OR ".join(f"contains({m}, '{w}')" for w in words) + ")"


def errors_only(spark: SparkSession, sf: str) -> DataFrame:
    return views.job_events(spark, sf).filter(F.col("message").isNotNull()).select("event_id", "message")


_ERR = "FROM job_events WHERE message IS NOT NULL"


@query("T22_tag_error_stage", with_views("job_events", f"SELECT event_id, CASE WHEN {_any_sql(er.AI_WORDS)} THEN '[ai] ' WHEN {_any_sql(er.IMAGE_WORDS)} THEN '[ocr] ' ELSE '[render] ' END || message AS tagged {_ERR}"))
def q_tag_error_stage(spark: SparkSession, sf: str) -> DataFrame:
    return errors_only(spark, sf).select("event_id", er.tag_error_stage("message").alias("tagged"))


@query("T23_is_retryable", with_views("job_events", f"SELECT event_id, NOT {_any_sql(er.PERMANENT_WORDS)} AND {_any_sql(er.RETRY_WORDS)} AS retryable, {_any_sql(er.RATE_WORDS)} AS rate_limited {_ERR}"))
def q_is_retryable(spark: SparkSession, sf: str) -> DataFrame:
    return errors_only(spark, sf).select("event_id", er.is_retryable("message").alias("retryable"), er.is_rate_limited("message").alias("rate_limited"))


_KIND_SQL = "CASE " + " ".join(f"WHEN {_any_sql(w)} THEN '{k}'" for k, w in er.ERROR_KINDS) + " ELSE 'provider_error' END"


@query("T24_resolve_error_kind", with_views("job_events", f"SELECT event_id, {_KIND_SQL} AS kind {_ERR}"))
def q_resolve_error_kind(spark: SparkSession, sf: str) -> DataFrame:
    return errors_only(spark, sf).select("event_id", er.resolve_error_kind("message").alias("kind"))


_LIMIT = ["usage limit", "quota exceeded", "resource exhausted", "daily limit", "limit reached", "too many requests"]


@query(
    "T25_short_cli_error",
    with_views(
        "job_events",
        f"""SELECT event_id, CASE WHEN contains(lower(message), 'authentication') AND contains(lower(message), 'browser') THEN 'auth' WHEN {_any_sql(_LIMIT)} THEN 'usage_limit' ELSE 'other' END AS kind,
  CASE WHEN contains(lower(message), 'authentication') AND contains(lower(message), 'browser') THEN '' WHEN {_any_sql(_LIMIT)} THEN coalesce('Try again ' || nullif(regexp_extract(message, '(?i)try again(?: at| in)?\\s+([^\\r\\n.]+)', 1), '') || '.', '') ELSE left(message, 500) END AS detail {_ERR}""",
    ),
)
def q_short_cli_error(spark: SparkSession, sf: str) -> DataFrame:
    return errors_only(spark, sf).select("event_id", er.short_cli_error("message").alias("c")).select("event_id", "c.kind", "c.detail")


_SAMPLE_KEYS = ["AIzaXX", "hf_abc", "sk-or-1", "sk-oc-2", "oc_3", "opencode_4", "sk-ant-5", "gsk_6", "Ollama", "local-7", "none", "cli-codex", "CLI_GEMINI", "sk-8", ""]
_SK = views.sql_pick(_SAMPLE_KEYS, "event_id")


@query(
    "T26_provider_from_key",
    f"""SELECT provider, count(*) AS n FROM (SELECT CASE WHEN lower(k) IN ('cli-gemini','cli_gemini') THEN 'cli_gemini' WHEN lower(k) IN ('cli-codex','cli_codex') THEN 'cli_codex' WHEN lower(k) IN ('ollama','none') OR starts_with(lower(k), 'local-') THEN 'local'
  WHEN starts_with(k, 'AIza') THEN 'gemini' WHEN starts_with(k, 'hf_') THEN 'huggingface' WHEN starts_with(k, 'sk-or-') THEN 'openrouter' WHEN starts_with(k, 'sk-oc-') OR starts_with(k, 'oc_') OR starts_with(k, 'opencode_') THEN 'opencode'
  WHEN starts_with(k, 'sk-ant-') THEN 'anthropic' WHEN starts_with(k, 'gsk_') THEN 'groq' ELSE 'openai' END AS provider FROM (SELECT {_SK} AS k FROM events)) GROUP BY 1""",
)
def q_provider_from_key(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select(ky.provider_from_key(views.pick(_SAMPLE_KEYS, F.col("event_id"))).alias("provider"))
    return e.groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


@query("T27_backoff_sec", "SELECT event_id, least(15.0::DOUBLE, greatest(5.0::DOUBLE, 2.0::DOUBLE*pow(2.0::DOUBLE, least(event_id % 7, 4)))) AS wait FROM events")
def q_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "events").select("event_id", jobs.backoff_sec(F.col("event_id") % 7).alias("wait"))


_TAGS = [*jobs.STAGE_OF_TAG, "ai.call.begin", "image.single.stage", "image.merge.stage", "unknown"]
_TAG_SQL = "CASE tag " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in jobs.STAGE_OF_TAG.items())


@query("T28_stage_of", f"SELECT event_id, {_TAG_SQL} WHEN 'ai.call.begin' THEN CASE WHEN event_id % 2 = 0 THEN 'ai' ELSE 'groq' END WHEN 'image.single.stage' THEN event_type WHEN 'image.merge.stage' THEN event_type ELSE '' END AS stage FROM (SELECT event_id, event_type, {views.sql_pick(_TAGS, 'event_id')} AS tag FROM events)")
def q_stage_of(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events")
    return e.select("event_id", jobs.stage_of(views.pick(_TAGS, F.col("event_id")), F.when(F.col("event_id") % 2 == 0, " ").otherwise("groq"), F.col("event_type")).alias("stage"))


@query(
    "T18_cache_key",
    with_views(
        "requests",
        f"""SELECT request_id, img_hash || '|' || trim(lang) || '|' || trim(mode) || '|' || source || '|' || {_ENGINE_SQL} || '|' || provider || '|' || model || '|' || base_url || '|' || left(sha256(src), 12) AS full_key,
  CASE WHEN trim(lang) = '' THEN '' ELSE 'md:' || img_hash || '::' || trim(lang) || '::' || CASE mode WHEN 'lens_text' THEN 'text' WHEN 'lens_images' THEN 'images' ELSE mode END || '::' || CASE WHEN ocr_engine = '' THEN 'google_lens' ELSE ocr_engine END END AS page_key,
  sha1('{{"provider": "' || provider || '", "m": "' || model || '", "u": "' || base_url || '", "l": "' || lang || '", "p": "sig", "t": "' || src || '"}}') AS translation_key FROM requests""",
    ),
)
def q_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    r = views.requests(spark, sf)
    return r.select(
        "request_id",
        ky.cache_key(c("img_hash"), F.trim("lang"), c("mode"), c("source"), c("ocr_engine"), [c("provider"), c("model"), c("base_url"), c("src")]).alias("full_key"),
        ky.page_cache_key(F.concat(F.lit("md:"), "img_hash"), F.trim("lang"), c("mode"), c("ocr_engine")).alias("page_key"),
        ky.translation_key(c("provider"), c("model"), c("base_url"), c("lang"), F.lit("sig"), c("src")).alias("translation_key"),
    )


@query(
    "T19_request_fingerprint",
    with_views(
        "requests",
        """SELECT request_id, 'tp:' || sha256('{"src":"' || src || '","imageDataUri":"","mode":"' || mode || '","lang":"' || lang || '","source":"' || source || '","ocrEngine":"' || CASE WHEN ocr_engine = '' THEN 'google_lens' ELSE ocr_engine END ||
  '","aiProvider":"' || provider || '","aiModel":"' || model || '","aiBaseUrl":"' || base_url || '","aiPrompt":"","aiReasoningEffort":"","pageUrl":""}') AS fingerprint FROM requests""",
    ),
)
def q_request_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    r = views.requests(spark, sf)
    values = {"src": c("src"), "mode": c("mode"), "lang": c("lang"), "source": c("source"), "ocrEngine": c("ocr_engine"), "aiProvider": c("provider"), "aiModel": c("model"), "aiBaseUrl": c("base_url")}
    return r.select("request_id", ky.request_fingerprint(values).alias("fingerprint"))


@query(
    "T20_valid_idempotency_key",
    "SELECT event_id, CASE WHEN k <> '' AND length(k) <= 256 AND regexp_full_match(k, '[A-Za-z0-9._:-]+') THEN k ELSE '' END AS key FROM (SELECT event_id, trim(CASE event_id % 4 WHEN 0 THEN ' tp:' || user_id || ' ' WHEN 1 THEN props WHEN 2 THEN repeat('k', CAST(200 + event_id % 100 AS INTEGER)) ELSE '' END) AS k FROM events)",
)
def q_valid_idempotency_key(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit(" tp:"), F.col("user_id").cast("string"), F.lit(" "))).when(k == 1, F.col("props")).when(k == 2, F.repeat(F.lit("k"), (200 + F.col("event_id") % 100).cast("int"))).otherwise("")
    return views.table(spark, sf, "events").select("event_id", ky.valid_idempotency_key(raw).alias("key"))
