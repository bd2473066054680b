"""Job telemetry: state, queues, stages, batches, retention, staleness.

Per-job and per-lane orderings use ordered scans over ranges, so a lane or job that holds a large share of
all events is spread over time.  Everything else is a combinable aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelayout.functions.errors import classify_error
from pagelayout.functions.exprs import fixed, trim_ws
from pagelayout.functions.keys import normalize_engine
from pagelayout.operators.scans import exact_percentiles, first_by, large_keys, ordered_scan, ranged, top_n, unranged

DAY_MICROS = 86_400_000_000
OPEN_STATES = ["done", "error"]


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    d = c.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), d)
    whole = part("DAY").cast("long") * 86_400 + part("HOUR").cast("long") * 3_600 + part("MINUTE").cast("long") * 60
    return whole * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


# ---------------------------------------------------------------- state


def job_state(events: DataFrame) -> DataFrame:
    """Latest status and stage per job, with the first time seen and the last update."""
    e = events.withColumn("us", micros("ts"))
    return e.groupBy("job_id").agg(
        F.max_by(F.struct("status", "stage", "queue_kind", "batch_id", "image_key", "message"), F.struct("us", "event_id")).alias("s"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.max(F.when(F.col("status") == "queued", F.col("us"))).alias("queued_us"),
        F.count(F.lit(1)).alias("n_events"),
    ).select("job_id", "s.*", "first_us", "last_us", F.coalesce("queued_us", "last_us").alias("queued_us"), "n_events")


def batch_items(events: DataFrame) -> DataFrame:
    """Latest state of every image of every batch, with its error class."""
    e = events.withColumn("us", micros("ts")).select("batch_id", "image_key", "us", "event_id", "status", "attempt", "message")
    last = first_by(e, ["batch_id", "image_key"], ["us", "event_id"], descending=True)
    return last.select(
        "batch_id", "image_key", "attempt",
        F.when(F.col("status") == "running", "processing").otherwise(F.col("status")).alias("status"),
        F.col("message").alias("last_error"),
        classify_error("message")["permanent"].alias("permanent"),
    )


def batch_progress(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Counts per status for the items of the batch's running pass, and percent finished.

    ``batches``: batch_id, pass, total1, total2.
    """
    states = ["queued", "processing", "inserting", "done", "error", "aborted"]
    counts = items.groupBy("batch_id", "attempt").agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])
    b = batches.join(counts.withColumnRenamed("attempt", "pass"), ["batch_id", "pass"], "left").na.fill(0, states)
    total = F.when(F.col("pass") == 2, F.col("total2")).otherwise(F.col("total1"))
    finished = F.col("done") + F.col("error") + F.col("aborted")
    pct = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.try_divide(100.0 * finished, total.cast("double")) + 0.5)))
    return b.select("batch_id", "pass", total.alias("total"), *states, finished.alias("finished"), F.when(total > 0, pct).otherwise(0).cast("int").alias("pct"))


def error_histogram(items: DataFrame) -> DataFrame:
    """Per batch, how often each error label occurs over all failed items."""
    bad = items.filter((F.col("status") == "error") & (F.coalesce("last_error", F.lit("")) != ""))
    return bad.groupBy("batch_id", classify_error("last_error")["label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


def second_pass(items: DataFrame, progress: DataFrame) -> DataFrame:
    """Items to run again: the first pass of the batch is complete and the failure is not permanent."""
    ready = progress.filter((F.col("pass") == 1) & (F.col("total") > 0) & (F.col("finished") >= F.col("total"))).select("batch_id")
    again = items.filter((F.col("attempt") == 1) & (F.col("status") == "error") & ~F.coalesce("permanent", F.lit(False)))
    return again.join(ready, "batch_id", "left_semi").withColumns({"attempt": F.lit(2), "status": F.lit("queued")})


def second_pass_plan(items: DataFrame, progress: DataFrame) -> DataFrame:
    """Per completed first pass: how many items go again, and whether the batch is finished instead."""
    ready = progress.filter((F.col("pass") == 1) & (F.col("total") > 0) & (F.col("finished") >= F.col("total"))).select("batch_id")
    n = second_pass(items, progress).groupBy("batch_id").agg(F.count(F.lit(1)).alias("total2"))
    return ready.join(n, "batch_id", "left").select("batch_id", F.coalesce("total2", F.lit(0)).alias("total2"), F.col("total2").isNull().alias("finished"))


# ---------------------------------------------------------------- queues


def queue_depths(jobs: DataFrame) -> DataFrame:
    queued = F.col("status") == "queued"
    return jobs.agg(
        F.count_if(queued).alias("queue_depth"),
        F.count_if(queued & (F.col("queue_kind") == "direct")).alias("queue_depth_direct"),
        F.count_if(queued & (F.col("queue_kind") == "ai")).alias("queue_depth_ai"),
    )


def poll_after_ms(status: Column, depth: Column) -> Column:
    return F.when(status.isin("done", "error"), 0).when(depth > 20, 1500).when(depth > 5, 800).when(status == "running", 500).otherwise(400)


def queue_position(jobs: DataFrame) -> DataFrame:
    """Position among the queued jobs of the same lane, lane depth and the delay before the next poll."""
    kind = F.coalesce(F.when(trim_ws("queue_kind") != "", trim_ws("queue_kind")), F.lit("direct"))
    j = jobs.withColumn("queue_kind", kind)
    waiting = j.filter(F.col("status") == "queued").select("job_id", "queue_kind", "queued_us")
    placed = ordered_scan(waiting, ["queue_kind"], ["queued_us", "job_id"], number="n")
    depth = waiting.groupBy("queue_kind").agg(F.count(F.lit(1)).alias("lane_depth"))
    out = j.join(placed.select("job_id", (F.col("n") + 1).alias("queue_position")), "job_id", "left")
    out = out.join(depth, "queue_kind", "left").withColumn("lane_depth", F.coalesce("lane_depth", F.lit(0)))
    return out.withColumn("poll_after_ms", poll_after_ms(F.col("status"), F.col("lane_depth")))


def queue_label(kind: Column, status: Column, stage: Column, position: Column, lane_depth: Column, total_depth: Column) -> Column:
    k = F.lower(trim_ws(F.coalesce(kind, F.lit(""))))
    name = F.when(k == "ai", "AI").otherwise("Direct")
    st = F.lower(trim_ws(F.coalesce(status, F.lit(""))))
    sg = trim_ws(F.coalesce(stage, F.lit("")))
    depth = F.when(F.coalesce(lane_depth, F.lit(0)) != 0, lane_depth).otherwise(F.coalesce(total_depth, F.lit(0)))
    pos = F.coalesce(position, F.lit(0))
    waiting = (
        F.when((pos > 0) & (depth > 0), F.concat(name, F.lit(" queue #"), pos.cast("string"), F.lit("/"), depth.cast("string")))
        .when(depth > 0, F.concat(name, F.lit(" queue "), depth.cast("string")))
        .otherwise(F.concat(name, F.lit(" queue")))
    )
    running = F.concat(name, F.lit(": "), F.when(sg != "", sg).otherwise("running"))
    return F.when(k == "", "").when(st == "queued", waiting).when(st == "running", running).otherwise("")


# ---------------------------------------------------------------- stages

# Trace tags and the stage each of them starts.
STAGE_OF_TAG = {
    "payload.start": "download",
    "payload.image.ready": "image_ready",
    "payload.ai.config": "ai_config",
    "payload.cache.hit": "cache_hit",
    "payload.process.begin": "process",
    "image.single.begin": "lens_ocr",
    "ai.retry.begin": "ai_retry",
    "ai.retry.done": "ai_retry_done",
    "ai.call.done": "ai_done",
}


def stage_of(tag: Column, provider: Column, stage: Column) -> Column:
    p = trim_ws(F.coalesce(provider, F.lit("")))
    chain = F.when(tag == "ai.call.begin", F.when(p == "", "ai").otherwise(p))
    for t, s in STAGE_OF_TAG.items():
        chain = chain.when(tag == t, s)
    return chain.when(tag.isin("image.single.stage", "image.merge.stage"), trim_ws(F.coalesce(stage, F.lit("")))).otherwise("")


def status_changes(events: DataFrame) -> DataFrame:
    """Events whose status or stage differs from the job's event before (its first event counts)."""
    e = events.withColumn("us", micros("ts"))
    d = ordered_scan(e, ["job_id"], ["us", "event_id"], lags={"__p": F.struct("status", "stage")})
    p = F.col("__p")
    changed = p.isNull() | (p["status"] != F.col("status")) | (p["stage"] != F.col("stage"))
    return d.filter(changed).drop("__p")


def stage_durations(events: DataFrame) -> DataFrame:
    """Elapsed time of the job and of its current stage at every event; the stage clock restarts only on change."""
    return unranged(_durations(*_timed(events)))


def _timed(events: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    e = events.withColumn("us", micros("ts"))
    large = large_keys(e, ["job_id"], ["us", "event_id"])
    return ranged(e, ["job_id"], ["us", "event_id"], large), large


def _durations(e: DataFrame, large: DataFrame | None) -> DataFrame:
    keys, order = ["job_id"], ["us", "event_id"]
    d = ordered_scan(e, keys, order, large=large, lags={"__p": F.col("stage")})
    fresh = F.col("__p").isNull() | (F.col("__p") != F.col("stage"))
    d = d.withColumn("__start", F.when(fresh, F.col("us"))).withColumn("__run", F.when(F.col("status") == "running", -F.col("us"))).drop("__p")
    d = ordered_scan(d, keys, order, large=large, lasts={"stage_us": F.col("__start")}, maxs={"__ran": F.col("__run")})
    started = F.coalesce(-F.greatest("__ran", "__run"), F.col("us"))
    return d.withColumns({
        "is_start": F.col("__start").isNotNull(),
        "elapsed_ms": fixed((F.col("us") - started) / 1000.0, 1),
        "stage_elapsed_ms": fixed((F.col("us") - F.col("stage_us")) / 1000.0, 1),
    }).drop("__start", "__run", "__ran")


def stage_spans(events: DataFrame) -> DataFrame:
    """One row per stage a job went through, with its length in whole milliseconds (null while it lasts)."""
    e, large = _timed(events)
    d = _durations(e, large).filter("is_start")
    d = ordered_scan(d, ["job_id"], ["us", "event_id"], large=large, leads={"__next": F.col("us")})
    return d.select("job_id", "stage", "us", F.floor((F.col("__next") - F.col("us")) / 1000).cast("long").alias("ms"))


def stage_latency(spans: DataFrame) -> DataFrame:
    """Count, sum, maximum and exact median and 95th percentile of stage lengths.

    There are few stages, so each holds a large share of the rows: percentiles come from value counts.
    """
    s = spans.filter(F.col("ms").isNotNull()).select("stage", "ms")
    basic = s.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("sum_ms"), F.max("ms").alias("max_ms"))
    pct = exact_percentiles(s, ["stage"], "ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return basic.join(pct, "stage")


# ---------------------------------------------------------------- retention and upserts


def upsert_results(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Put by key, the last write wins."""
    return first_by(existing.unionByName(new), list(keys), list(order), descending=True)


def retain_recent(df: DataFrame, keys: Sequence[str], us: str, now_us: Column, ttl_us: int | None, max_items: int | None, tie: Sequence[str]) -> DataFrame:
    """Drop what has outlived its time, then keep the newest ``max_items`` per key."""
    out = df if ttl_us is None else df.filter(now_us - F.col(us) <= ttl_us)
    return out if max_items is None else top_n(out, keys, [F.col(us).desc()], max_items, tie)


def expire_jobs(state: DataFrame, now_us: Column, ttl_us: int = 3_600_000_000) -> DataFrame:
    """Jobs updated within their time to live."""
    return state.filter(F.col("last_us") >= now_us - ttl_us)


def cache_kind(source: Column) -> Column:
    """Which cache a request uses: ai for the source ``ai`` and command-line models, plain for all others, null included."""
    src = F.coalesce(source, F.lit(""))
    return F.when((src == "ai") | src.startswith("cli_"), "ai").otherwise("plain")


def cache_lookup(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Add ``cache``: hit or miss for cacheable requests (text mode with a hash and a key), off for the rest.

    requests: mode, img_hash, cache_kind, cache_key, us; results: cache_kind, cache_key, us (when stored). A hit is a result of the same
    kind and key that was stored before the request; a key stored in one cache is not known in the other. Results at an unknown time or
    without a key count for nothing, requests at an unknown time miss.
    """
    cacheable = (F.col("mode") == "lens_text") & (F.coalesce("img_hash", F.lit("")) != "") & (F.coalesce("cache_key", F.lit("")) != "")
    r = requests.withColumn("__k", F.when(cacheable, F.col("cache_key")))
    known = results.filter(F.col("us").isNotNull() & (F.coalesce("cache_key", F.lit("")) != ""))
    known = known.groupBy(F.col("cache_kind").alias("__kind"), F.col("cache_key").alias("__known")).agg(F.min("us").alias("__since"))
    j = r.join(known, (F.col("__k") == F.col("__known")) & (F.col("cache_kind") == F.col("__kind")), "left")
    cache = F.when(F.col("__k").isNull(), "off").when(F.col("__since") < F.col("us"), "hit").otherwise("miss")
    return j.withColumn("cache", cache).drop("__k", "__kind", "__known", "__since")


# ---------------------------------------------------------------- as-of rules


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], us: str, value: Column, name: str, tie: str) -> DataFrame:
    """Add to ``left`` the value of the last ``right`` row of the same key not later than it.

    Both sides become one ordered stream; at equal times the right side comes first.
    """
    cols = [c for c in left.columns if c not in (*keys, us)]
    ls = left.select(*keys, us, F.lit(1).alias("__side"), F.col(tie).cast("string").alias("__tie"), F.struct(*cols).alias("__row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__v"))
    empty = F.lit(None).cast(ls.schema["__row"].dataType)
    rs = right.select(*keys, us, F.lit(0).alias("__side"), F.lit("").alias("__tie"), empty.alias("__row"), value.alias("__v"))
    both = ls.unionByName(rs)
    d = ordered_scan(both, list(keys), [us, "__side", "__tie"], lasts={name: F.col("__v")})
    return d.filter(F.col("__side") == 1).select(*keys, us, *[F.col("__row")[c].alias(c) for c in cols], name)


def stale_results(results: DataFrame, sessions: DataFrame) -> DataFrame:
    """Status of arriving results: stale if the tab's session or the settings changed since the request.

    ``results``: result_id, tab_id, us, session_id, settings_epoch, epoch_now, keep_cache;
    ``sessions``: tab_id, us, session_id.
    """
    j = asof(results, sessions, ["tab_id"], "us", F.col("session_id"), "session_now", "result_id")
    moved = (F.coalesce("session_id", F.lit("")) != "") & (F.coalesce("session_now", F.lit("")) != "") & (F.col("session_id") != F.col("session_now"))
    stale = moved | F.coalesce(F.col("settings_epoch") != F.col("epoch_now"), F.lit(False))
    return j.withColumns({
        "stale": stale,
        "status": F.when(stale & F.col("keep_cache"), "done").when(stale, "aborted").otherwise("inserting"),
        "cached_only": stale & F.col("keep_cache"),
    })


def suppress_errors(errors: DataFrame, replaces: DataFrame, grace_ms: int = 12_000) -> DataFrame:
    """Add ``shown``: false while the picture was replaced, or is being replaced since less than the grace time."""
    j = asof(errors, replaces, ["url"], "us", F.struct("state", F.col("us").alias("since")), "last", "error_id")
    s = F.col("last")
    hidden = (s["state"] == "ok") | ((s["state"] == "pending") & (F.col("us") - s["since"] < grace_ms * 1000))
    return j.withColumn("shown", ~F.coalesce(hidden, F.lit(False))).drop("last")


def cancel_tab_work(jobs: DataFrame, navigations: DataFrame, cancels: DataFrame | None = None) -> DataFrame:
    """Jobs aborted because their tab moved on, or their batch was cancelled, while they were open.

    ``jobs``: job_id, tab_id, opened_us, closed_us (null while open), and batch_id with ``cancels``; ``navigations``: tab_id, us;
    ``cancels``: tab_id, batch_id, us.
    """
    cols = ["job_id", "tab_id", "opened_us", "closed_us", *(["batch_id"] if cancels is not None else [])]
    held = F.struct(*cols)

    def next_of(rows: DataFrame, keys: list[str], events: DataFrame, name: str) -> DataFrame:
        """Add to each job the time of the next event of its keys, at or after its opening."""
        more = [c for c in rows.columns if c not in cols]
        j = rows.select(*keys, F.col("opened_us").alias("us"), F.lit(1).alias("__side"), F.col("job_id").cast("string").alias("__tie"), held.alias("__job"), F.lit(None).cast("long").alias("__event"), *more)
        e = events.select(*keys, "us", F.lit(2).alias("__side"), F.lit("").alias("__tie"), F.lit(None).cast(j.schema["__job"].dataType).alias("__job"), F.col("us").alias("__event"), *[F.lit(None).cast(j.schema[c].dataType).alias(c) for c in more])
        d = ordered_scan(j.unionByName(e), keys, ["us", "__side", "__tie"], suffix_mins={name: F.col("__event")})
        return d.filter("__side = 1").select("__job.*", *more, name)

    d = next_of(jobs.select(*cols), ["tab_id"], navigations, "__moved")
    at = F.col("__moved")
    if cancels is not None:
        d = next_of(d, ["tab_id", "batch_id"], cancels, "__cancelled")
        at = F.least("__moved", "__cancelled")
    d = d.withColumn("aborted_us", at)
    return d.filter(F.col("aborted_us").isNotNull() & (F.col("closed_us").isNull() | (F.col("aborted_us") < F.col("closed_us")))).select("job_id", "tab_id", "aborted_us")


def throttle(events: DataFrame, keys: Sequence[str], us: str, tie: str, every_us: int, forced: Column | None = None) -> DataFrame:
    """Events let through: forced ones, and those at least ``every_us`` after the last one let through.

    An event that follows a pause of at least ``every_us`` is always let through, so each key's events fall
    apart there into independent stretches that are folded separately.
    """
    from pagelayout.operators.folds import ordered_label

    force = F.lit(False) if forced is None else forced
    e = events.withColumn("__force", F.coalesce(force, F.lit(False)))
    order = [us, tie]
    large = large_keys(e, list(keys), order)
    d = ordered_scan(ranged(e, list(keys), order, large), list(keys), order, large=large, lags={"__p": F.col(us)})
    fresh = F.col("__p").isNull() | (F.col(us) - F.col("__p") >= every_us)
    d = d.withColumn("__new", F.when(fresh, 1).otherwise(0)).drop("__p")
    d = unranged(ordered_scan(d, list(keys), order, large=large, sums={"__run": F.col("__new")}))
    d = d.withColumn("__run", F.col("__run") + F.col("__new")).drop("__new")

    def make():
        last = None

        def step(row: tuple) -> int:
            nonlocal last
            t, force_it = row
            if force_it or last is None or t - last >= every_us:
                last = t
                return 1
            return 0

        return step

    out = ordered_label(d, [*keys, "__run"], order, [us, "__force"], make, "__out")
    return out.filter("__out = 1").drop("__run", "__force", "__out")


# ---------------------------------------------------------------- requests and results

# Status texts by HTTP code.
HTTP_STATUS = {
    200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden",
    404: "Not Found", 408: "Request Timeout", 409: "Conflict", 413: "Payload Too Large", 415: "Unsupported Media Type",
    429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}


def enrich_http_status(log: DataFrame, code: str = "code", text: str = "text") -> DataFrame:
    """Add ``status_text``: the known text of the code, else the given one. The table is fixed and tiny."""
    spark = log.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in HTTP_STATUS.items()], "__code int, __text string")
    j = log.join(F.broadcast(table), F.col(code) == F.col("__code"), "left")
    return j.withColumn("status_text", F.coalesce("__text", text, F.lit(""))).drop("__code", "__text")


def route_requests(df: DataFrame) -> DataFrame:
    """Normal forms of a request and its lane."""
    mode = F.lower(trim_ws(F.coalesce("mode", F.lit(""))))
    exact = trim_ws(F.coalesce("mode", F.lit("")))
    source = F.lower(trim_ws(F.coalesce("source", F.lit(""))))
    raw_engine = F.replace(F.lower(trim_ws(F.coalesce("ocr_engine", F.lit("")))), F.lit("-"), F.lit("_"))
    ai = (source == "ai") | source.startswith("cli_")
    ui_mode = F.when(exact.isin("lens_images", "lens_text"), exact).otherwise("lens_text")
    ui_engine = F.when((ui_mode == "lens_text") & (raw_engine == "paddleocr"), "paddleocr").otherwise("google_lens")
    trimmed = trim_ws(F.coalesce("source", F.lit("")))
    ui_source = F.when(trimmed == "", "translated").otherwise(trimmed)
    out = df.withColumns({
        "lane": F.when((mode == "lens_text") & ai, "ai").otherwise("direct"),
        "service_mode": F.when(exact.isin("lens_images", "lens_text"), exact).otherwise("lens_images"),
        "service_engine": normalize_engine("ocr_engine"),
        "ui_mode": ui_mode,
        "ui_engine": ui_engine,
        "ui_source": F.when((ui_mode == "lens_text") & (ui_engine == "paddleocr") & (ui_source == "translated"), "original").otherwise(ui_source),
    })
    if "effort" in df.columns:
        e = F.lower(trim_ws(F.coalesce("effort", F.lit(""))))
        out = out.withColumn("effort", F.when(e.isin("low", "medium", "high", "xhigh"), e).otherwise("medium"))
    return out


def result_outcome(df: DataFrame) -> DataFrame:
    """Add ``ok`` and ``error_text``: every needed change must have been applied to the page.

    Needs has_image, has_html, mode, replace_applied, overlay_applied.
    """
    replace = F.col("has_image") & ~F.coalesce(F.col("mode") == "lens_text", F.lit(False))
    overlay = F.col("has_html")
    bad_replace = replace & ~F.col("replace_applied")
    bad_overlay = overlay & ~F.col("overlay_applied")
    nothing = ~F.col("has_html") & ~F.col("has_image")
    msg = F.concat_ws(" + ", F.when(bad_replace, F.lit("DOM replace failed")), F.when(bad_overlay, F.lit("Overlay insert failed")))
    return df.withColumns({
        "ok": (replace | overlay) & ~bad_replace & ~bad_overlay,
        "error_text": F.when(nothing, "API returned no overlay data").otherwise(msg),
    })


def backoff_sec(attempt: Column, base: float = 2.0, least: float = 5.0, most: float = 15.0) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(4)))))


def event_windows(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Events per lane and status in tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "queue_kind", "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "queue_kind", "status", "n")


def event_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Bursts of a job's events, closed by a quiet gap."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "job_id").agg(F.count(F.lit(1)).alias("n")).select("job_id", F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "n")
