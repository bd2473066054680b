"""The job feed as a stream: idempotent submissions, job state, progress, throttling, staleness, caches.

Stateful operators use ``transformWithStateInPandas`` on the RocksDB state store: state is per key, checkpointed to
the shared folder, and survives lost executors.  A micro-batch is put in time order per key before it is applied.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pagelayout.operators import jobs
from pagelayout.operators.scans import first_by, shared_dir
from pagelayout.sources.views import job_events_from

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "1 hour"
SLOTS = 512  # groups that keys are dealt to where they share their state
SPAN_US = 3_600_000_000  # time that the waiting rows of a large key are dealt by
HELD_ROWS = 1 << 17  # rows that are dealt to such spans at once


def read_feed(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    """Append-only files as a stream; the schema is given, never inferred."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def read_job_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Status and stage feed of the jobs."""
    return job_events_from(read_feed(spark, path, schema))


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all files that are there and give back what it wrote.

    In update mode every micro-batch is kept with its number (``epoch``): the newest row of a key counts.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{base}/rows").start()
    else:
        def keep(batch: DataFrame, epoch: int) -> None:
            # Overwriting the batch's own folder makes a repeated micro-batch harmless.
            batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{base}/rows/batch={epoch}")

        query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else StructType(stream.schema.fields).add("epoch", "long")
    return spark.read.schema(schema).parquet(f"{base}/rows").select(*schema.names)


# A time later than any in a feed, within the range of nanoseconds.
END = datetime.datetime(2262, 1, 1)


def replay_whole(feed: DataFrame, stream_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``replay`` of ``stream_of(feed)`` for a feed that is complete: the rows that still wait for the watermark are given out, too.

    When all files are read, a closing row (all columns null but ``ts``) takes the watermark past the others; it waits itself and never comes out.
    """
    spark = feed.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    end = spark.readStream.schema(feed.schema).parquet(f"{base}/end*.parquet")
    stream = stream_of(feed.unionByName(end))
    ts = feed.schema["ts"].dataType

    def run() -> None:
        stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{base}/rows").start().awaitTermination()

    run()
    last = spark.range(1).select(*[F.lit(END).cast(ts).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in feed.schema])
    last.write.parquet(f"{base}/end.parquet")
    run()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last version of every key of an update-mode replay."""
    return first_by(rows, list(keys), ["epoch"], descending=True).drop("epoch")


def zoneless(us: Column) -> Column:
    """Time stamp without zone from microseconds since 1970, whatever the session time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=us.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"))


def _slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def _timed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("us", jobs.micros("ts"))


# ---------------------------------------------------------------- rows in the order of time


class _InOrder(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them, and are then applied in the order of ``us`` and the columns after it.

    So late rows (within the watermark's delay) take their right place, and nothing depends on how the feed was cut in micro-batches. A key
    holds the rows of the delay, what ``apply`` keeps, and one timer; when both are gone, so is the key.
    """

    row: str  # schema of the waiting rows, us first
    out: str  # schema of the result

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [part.split() for part in self.row.split(", ")]
        self.names = [f[0] for f in fields]
        self.whole = [f[1] in ("int", "long") for f in fields]  # columns with nulls come as floats
        self.waiting = handle.getListState("waiting", self.row)
        self.timer = handle.getValueState("timer", "ms long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def apply(self, key: tuple, rows: list[tuple], until_us: int) -> list[tuple]:
        """Result rows of ``rows``, all in order; afterwards, forget what no row at ``until_us`` or later can need."""
        raise NotImplementedError

    def order(self, row: tuple) -> tuple:
        """What rows are put in order by."""
        return row

    def forget_at(self) -> int | None:
        """The time (us) from which the state that is left can be forgotten; None if there is none."""
        raise NotImplementedError

    def _wake(self, us: int | None) -> None:
        now = self.timer.get()[0] if self.timer.exists() else None
        ms = None if us is None else us // 1000 + 1
        if ms == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.timer.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            columns = [[None if v is None or v != v else int(v) if whole else v for v in part[n].tolist()] for n, whole in zip(self.names, self.whole)]
            held = list(zip(*columns))
            if held:
                self.waiting.appendList(held)
                first = min(r[0] for r in held) if first is None else min(first, min(r[0] for r in held))
        wake = self.timer.get()[0] * 1000 - 1000 if self.timer.exists() else None
        self._wake(first if wake is None else min(first, wake) if first is not None else wake)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] < until), key=self.order)
        later = [r for r in rows if r[0] >= until]
        if ready and later:
            self.waiting.put(later)
        elif ready:
            self.waiting.clear()
        out = self.apply(tuple(key), ready, until)
        at = [r[0] for r in later]
        gone = self.forget_at()
        if gone is not None:
            at.append(max(gone, until))
        self._wake(min(at) if at else None)
        if out:
            yield pd.DataFrame(out, columns=[part.split()[0] for part in self.out.split(", ")])

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, keys: list[str], processor: _InOrder, wait: str) -> DataFrame:
    """``stream`` has ``keys``, us and the processor's columns."""
    s = stream.withColumn("at", F.timestamp_micros("us")).withWatermark("at", wait).select(*keys, "at", *[part.split()[0] for part in processor.row.split(", ")])
    return s.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=processor.out, outputMode="Append", timeMode="EventTime")


class _Anchor(_InOrder):
    """Per key, the row that last started anew; rows within the span of the anchor belong to it. Renewing rows move a living anchor's time.

    The keys of a slot are held together: most keys have few rows, and calls of the state cost more than rows.
    """

    row = "us long, id long, force boolean, renews boolean, key string"

    def __init__(self, span_us: int, closed: bool, id_col: str) -> None:
        self.span, self.closed = span_us, closed
        self.out = f"key string, {id_col} long, us long, fresh boolean, owner long"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.anchors = handle.getListState("anchors", "key string, us long, owner long")

    def order(self, row: tuple) -> tuple:
        return row[:4]

    def _over(self, age: int) -> bool:
        return age > self.span or (self.closed and age == self.span)

    def apply(self, key: tuple, rows: list[tuple], until_us: int) -> list[tuple]:
        held = {name: (us, owner) for name, us, owner in self.anchors.get()} if self.anchors.exists() else {}
        had, out = bool(held), []
        for us, row_id, force, renews, name in rows:
            last, owner = held.get(name, (None, None))
            living = last is not None and not self._over(us - last)
            if renews:
                if living:
                    held[name] = (us, owner)
                continue
            if force or not living:
                last, owner = held[name] = us, row_id
            out.append((name, row_id, us, bool(force or not living), owner))
        held = {name: a for name, a in held.items() if not self._over(until_us - a[0])}
        if held:
            self.anchors.put([(name, int(us), int(owner)) for name, (us, owner) in held.items()])
        elif had:
            self.anchors.clear()
        self.oldest = min((us for us, _ in held.values()), default=None)
        return out

    def forget_at(self) -> int | None:
        return None if self.oldest is None else self.oldest + self.span + 1


def anchored(stream: DataFrame, key: Column, row_id: str, span_us: int, closed: bool, force: Column | None = None, renewals: DataFrame | None = None, wait: str = WATERMARK) -> DataFrame:
    """Rows with ``fresh`` and the ``owner`` they belong to, once the watermark (``wait`` behind the newest row) has passed them.

    ``stream`` has ts and ``row_id``; ``renewals`` has key and us. With ``closed`` a row exactly at the end of the span is fresh.
    Anchors are forgotten when their span is over.
    """
    forced = F.lit(False) if force is None else F.coalesce(force, F.lit(False))
    s = _timed(stream).select(key.cast("string").alias("key"), "us", F.col(row_id).cast("long").alias("id"), forced.alias("force"), F.lit(False).alias("renews"))
    if renewals is not None:
        s = s.unionByName(renewals.select(F.col("key").cast("string").alias("key"), "us", F.lit(-1).cast("long").alias("id"), F.lit(False).alias("force"), F.lit(True).alias("renews")))
    return _in_order(s.withColumn("slot", _slot("key")), ["slot"], _Anchor(span_us, closed, row_id), wait)


def idempotent_submissions(stream: DataFrame, ttl_us: int = 3_600_000_000, updates: DataFrame | None = None, wait: str = WATERMARK) -> DataFrame:
    """Submissions with the job they get: within a job's life the same key gets the same job again.

    A job lives for ``ttl_us`` after it was made or last updated; ``updates`` (key, us) are updates of the job that holds the key. With the job its key is forgotten.
    """
    a = anchored(stream, F.col("idempotency_key"), "event_id", ttl_us, closed=False, renewals=updates, wait=wait)
    return a.select(F.col("key").alias("idempotency_key"), "event_id", "us", F.col("owner").alias("job_event"), (~F.col("fresh")).alias("idempotent"))


def first_submissions(stream: DataFrame, life: str = WATERMARK) -> DataFrame:
    """The simple form: only first submissions pass, counted from first sight and forgotten with the watermark."""
    zoned = stream.withColumn("at", F.timestamp_micros(jobs.micros("ts")))
    return zoned.withWatermark("at", life).dropDuplicatesWithinWatermark(["idempotency_key"]).drop("at")


def throttle_stream(stream: DataFrame, key: Column, every_us: int, forced: Column | None = None) -> DataFrame:
    """Only rows at least ``every_us`` after the last one let through, and forced ones."""
    return anchored(stream, key, "event_id", every_us, closed=True, force=forced).filter("fresh").select("key", "event_id", "us")


def ttl_cache_stream(stream: DataFrame, ttl_us: int) -> DataFrame:
    """Lookups with ``hit``: whether the key was stored at most ``ttl_us`` ago; a miss stores it."""
    a = anchored(stream, F.col("cache_key"), "request_id", ttl_us, closed=False)
    return a.select(F.col("key").alias("cache_key"), "request_id", "us", (~F.col("fresh")).alias("hit"))


class _BoundedCache(_InOrder):
    """The entries of one cache, at most ``most`` of them, least recently used first.

    There are few caches, so one has a large part of the feed: its waiting rows lie in spans of time, of which Python holds one at a time.
    """

    row = "us long, request_id long, cache_key string"
    out = "cache string, request_id long, us long, cache_key string, hit boolean"

    def __init__(self, most: int, ttl_us: int) -> None:
        self.most, self.ttl = most, ttl_us

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "cache_key string, stored_us long")
        # parts of a span; ``first_us`` is a part's smallest time
        self.spans = handle.getMapState("spans", "span long, part long", "first_us long, rows binary")
        self.parts = handle.getValueState("parts", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n, first = [], 0, None
        for part in rows:
            held.append(part[self.names])
            n += len(part)
            if n >= HELD_ROWS:
                first = self._store(held, first)
                held, n = [], 0
        if n:
            first = self._store(held, first)
        wake = self.timer.get()[0] * 1000 - 1000 if self.timer.exists() else None
        self._wake(first if wake is None else min(first, wake) if first is not None else wake)
        return iter(())

    def _store(self, held: list[pd.DataFrame], first: int | None) -> int:
        """Deals rows to their spans; the smallest time so far."""
        rows = pd.concat(held, ignore_index=True)
        for span, part in rows.groupby(rows["us"] // SPAN_US, dropna=False):
            self._keep(int(span), part)
        low = int(rows["us"].min())
        return low if first is None else min(first, low)

    def _keep(self, span: int, rows: pd.DataFrame) -> None:
        n = self.parts.get()[0] if self.parts.exists() else 0
        self.parts.update((n + 1,))
        batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        self.spans.updateValue((span, n), (int(rows["us"].min()), sink.getvalue().to_pybytes()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        held = dict(tuple(e) for e in self.entries.get()) if self.entries.exists() else {}
        parts: dict[int, list[int]] = {}
        for span, part in self.spans.keys():
            parts.setdefault(span, []).append(part)
        at = []
        for span in sorted(parts):
            if span * SPAN_US >= until:  # nothing further is ready
                at += [self.spans.getValue((span, n))[0] for n in parts[span]]
                break
            stored = [pa.ipc.open_stream(self.spans.getValue((span, n))[1]).read_pandas() for n in parts[span]]
            for n in parts[span]:
                self.spans.removeKey((span, n))
            rows = pd.concat(stored, ignore_index=True)
            later = rows[rows["us"] >= until]
            if len(later):
                self._keep(span, later)
                at.append(int(later["us"].min()))
                rows = rows[rows["us"] < until]
            columns = [[None if v is None or v != v else int(v) if whole else v for v in rows[n].tolist()] for n, whole in zip(self.names, self.whole)]
            out = self._looked_up(tuple(key), sorted(zip(*columns), key=self.order), held)
            if out:
                yield pd.DataFrame(out, columns=[part.split()[0] for part in self.out.split(", ")])
        held = {k: v for k, v in held.items() if until - v <= self.ttl}
        if held:
            self.entries.put(list(held.items()))
            at.append(max(max(held.values()) + self.ttl + 1, until))
        else:
            self.entries.clear()
        self._wake(min(at) if at else None)

    def _looked_up(self, key: tuple, rows: list[tuple], held: dict[str, int]) -> list[tuple]:
        out = []
        for us, request, name in rows:
            stored = held.pop(name, None)
            hit = stored is not None and us - stored <= self.ttl
            held[name] = stored if hit else us  # to the end: used last
            if len(held) > self.most:
                del held[next(iter(held))]
            out.append((*key, request, us, name, hit))
        return out


def bounded_cache_stream(stream: DataFrame, most: int, ttl_us: int, wait: str = WATERMARK) -> DataFrame:
    """Lookups with ``hit`` in caches of the ``most`` entries used last, none older than ``ttl_us``; a miss stores its key.

    ``stream``: cache, cache_key, request_id, ts.
    """
    s = _timed(stream).select(F.col("cache").cast("string").alias("cache"), "us", F.col("request_id").cast("long").alias("request_id"), F.col("cache_key").cast("string").alias("cache_key"))
    return _in_order(s, ["cache"], _BoundedCache(most, ttl_us), wait)


# ---------------------------------------------------------------- job state


class _JobState(StatefulProcessor):
    """Last status and stage of a job; the stage clock restarts on change, silent jobs are dropped."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, stage string, stage_us long, us long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        status, stage, stage_us, last, last_id = self.job.get() if self.job.exists() else (None, None, None, None, None)
        for us, event_id, new_status, new_stage in zip(batch["us"].tolist(), batch["event_id"].tolist(), batch["status"].tolist(), batch["stage"].tolist()):
            if last is not None and (us, event_id) <= (last, last_id):
                continue  # came after a newer event
            if new_stage != stage:
                stage_us = us
            status, stage, last, last_id = new_status, new_stage, us, event_id
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.ttl_ms)
        self.job.update((status, stage, int(stage_us), int(last), int(last_id)))
        yield self._row(key, status, stage, stage_us, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, stage, stage_us, last, _ = self.job.get()
        self.job.clear()
        yield self._row(key, status, stage, stage_us, last, True)

    @staticmethod
    def _row(key, status, stage, stage_us, last, expired) -> pd.DataFrame:
        return pd.DataFrame([(*key, status, stage, stage_us, last, expired)], columns=["job_id", "status", "stage", "stage_us", "last_us", "expired"])

    def close(self) -> None:
        pass


def job_state_stream(stream: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Changes of job state; ``expired`` once a job was silent for its time to live (by event time, an hour being left for late events)."""
    # State timers compare with the watermark, which needs a zoned time stamp.
    s = _timed(stream).withColumn("at", F.timestamp_micros("us")).withWatermark("at", WATERMARK).select("job_id", "at", "us", "event_id", "status", "stage")
    return s.groupBy("job_id").transformWithStateInPandas(
        _JobState(ttl_ms), outputStructType="job_id string, status string, stage string, stage_us long, last_us long, expired boolean", outputMode="Update", timeMode="EventTime",
    )


class _NewestRow(StatefulProcessor):
    """The newest states of a slot's images of batches; an image is forgotten once it has not changed for its time to live.

    The images of a slot are held together, for most of them have one or two rows.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "batch_id string, image_key string, us long, event_id long, status string, attempt int, message string")
        self.timer = handle.getValueState("timer", "ms long")

    def _images(self) -> dict:
        return {tuple(r)[:2]: tuple(r)[2:] for r in self.held.get()} if self.held.exists() else {}

    def _keep(self, images: dict) -> None:
        if images:
            self.held.put([(*k, *v) for k, v in images.items()])
        else:
            self.held.clear()
        now = self.timer.get()[0] if self.timer.exists() else None
        ms = min((v[0] // 1000 + self.ttl_ms for v in images.values()), default=None)
        if ms == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.timer.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        images, changed = self._images(), {}
        for part in rows:
            for *image, us, event_id, status, attempt, message in zip(*[part[c].tolist() for c in ("batch_id", "image_key", "us", "event_id", "status", "attempt", "message")]):
                image = tuple(image)
                best = images.get(image)
                if best is None or (us, event_id) > best[:2]:
                    status, attempt, message = (None if v is None or v != v else v for v in (status, attempt, message))
                    images[image] = changed[image] = (int(us), int(event_id), status, None if attempt is None else int(attempt), message)
        if changed:
            self._keep(images)
            yield pd.DataFrame([(*image, v[3], v[2], v[4]) for image, v in changed.items()], columns=["batch_id", "image_key", "attempt", "status", "message"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        self._keep({k: v for k, v in self._images().items() if v[0] // 1000 + self.ttl_ms > passed})
        return iter(())

    def close(self) -> None:
        pass


def batch_items_stream(stream: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """Newest state of every image of every batch, as updates. An image that does not change for ``ttl_ms`` leaves the state."""
    s = _timed(stream).withColumn("at", F.timestamp_micros("us")).withWatermark("at", WATERMARK).select(_slot("batch_id", "image_key").alias("slot"), "batch_id", "image_key", "at", "us", "event_id", "status", F.col("attempt").cast("int").alias("attempt"), "message")
    g = s.groupBy("slot").transformWithStateInPandas(
        _NewestRow(ttl_ms), outputStructType="batch_id string, image_key string, attempt int, status string, message string", outputMode="Update", timeMode="EventTime",
    )
    status = F.when(F.col("status") == "running", "processing").otherwise(F.col("status"))
    return g.select("batch_id", "image_key", "attempt", status.alias("status"), F.col("message").alias("last_error"))


# ---------------------------------------------------------------- sessions and tabs


class _LastSession(_InOrder):
    """Last session of a tab; results are compared with it in the order of time."""

    row = "us long, side int, result_id long, session_id string"
    out = "tab_id long, result_id long, us long, session_now string, moved boolean"

    def __init__(self, ttl_us: int) -> None:
        self.ttl = ttl_us

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "id string, us long")

    def apply(self, key: tuple, rows: list[tuple], until_us: int) -> list[tuple]:
        now, since = self.session.get() if self.session.exists() else (None, None)
        out = []
        for us, side, result_id, session in rows:
            if side == 0:
                now, since = session, us
                continue
            known = now if since is not None and us - since <= self.ttl else None
            out.append((*key, result_id, us, known, bool(session and known and session != known)))
        if since is not None and until_us - since > self.ttl:
            since = None
        if since is None:
            self.session.clear()
        else:
            self.session.update((now, int(since)))
        return out

    def forget_at(self) -> int | None:
        return self.session.get()[1] + self.ttl + 1 if self.session.exists() else None


def stale_results_stream(results: DataFrame, sessions: DataFrame, ttl_us: int = 30 * jobs.DAY_MICROS, wait: str = WATERMARK) -> DataFrame:
    """Results whose tab moved to another session since they were asked for; a session counts for ``ttl_us`` and is then forgotten.

    ``results``: tab_id, result_id, us, session_id; ``sessions``: tab_id, us, session_id.
    """
    r = results.select("tab_id", "us", F.lit(1).alias("side"), "result_id", "session_id")
    s = sessions.select("tab_id", "us", F.lit(0).alias("side"), F.lit(-1).cast("long").alias("result_id"), "session_id")
    return _in_order(r.unionByName(s), ["tab_id"], _LastSession(ttl_us), wait)


class _OpenJobs(_InOrder):
    """The open jobs of a tab. A job leaves when it is closed, when its tab moves on or when its batch is cancelled."""

    row = "us long, side int, job_id long, batch_id string, closed_us long"
    out = "job_id long, tab_id long, aborted_us long, reason string"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job_id long", "batch_id string, closed_us long")

    def apply(self, key: tuple, rows: list[tuple], until_us: int) -> list[tuple]:
        held = {k[0]: tuple(v) for k, v in self.jobs.iterator()} if self.jobs.exists() else {}
        before, out = dict(held), []
        for us, side, job, batch, closed in rows:
            if side == 1:
                held[job] = (batch, closed)
                continue
            for j, (b, z) in list(held.items()):
                if z is not None and z <= us:
                    del held[j]
                elif side == 3 or b == batch:
                    del held[j]
                    out.append((j, *key, us, "navigation" if side == 3 else "cancel"))
        held = {j: v for j, v in held.items() if v[1] is None or v[1] > until_us}
        for j in before.keys() - held.keys():
            self.jobs.removeKey((j,))
        for j, v in held.items():
            if before.get(j) != v:
                self.jobs.updateValue((j,), v)
        self.ends = min((v[1] for v in held.values() if v[1] is not None), default=None)
        return out

    def forget_at(self) -> int | None:
        return self.ends


def cancelled_jobs_stream(opened: DataFrame, navigations: DataFrame, cancels: DataFrame | None = None, wait: str = WATERMARK) -> DataFrame:
    """Jobs aborted while they were open, each once: its tab moved on (``navigation``) or its batch was cancelled (``cancel``), whichever came first.

    Only open jobs are in the state, however long they stay open. At one time jobs open first, then batches are cancelled, then tabs move on.
    ``opened``: job_id, tab_id, us, closed_us, batch_id; ``navigations``: tab_id, us; ``cancels``: tab_id, batch_id, us.
    """
    none = F.lit(None)
    rows = opened.select("tab_id", "us", F.lit(1).alias("side"), F.col("job_id").cast("long").alias("job_id"), F.col("batch_id").cast("string").alias("batch_id"), F.col("closed_us").cast("long").alias("closed_us"))
    rows = rows.unionByName(navigations.select("tab_id", "us", F.lit(3).alias("side"), F.lit(-1).cast("long").alias("job_id"), none.cast("string").alias("batch_id"), none.cast("long").alias("closed_us")))
    if cancels is not None:
        rows = rows.unionByName(cancels.select("tab_id", "us", F.lit(2).alias("side"), F.lit(-1).cast("long").alias("job_id"), F.col("batch_id").cast("string").alias("batch_id"), none.cast("long").alias("closed_us")))
    return _in_order(rows, ["tab_id"], _OpenJobs(), wait)


def event_windows_stream(stream: DataFrame, length: str, slide: str | None = None, late: str = WATERMARK) -> DataFrame:
    """Closed windows of events per lane and status; later events than the watermark are dropped."""
    s = stream.withColumn("ts", F.timestamp_micros(jobs.micros("ts"))).withWatermark("ts", late)
    w = jobs.event_windows(s, length, slide)
    return w.withColumns({c: zoneless(F.unix_micros(c)) for c in ("win_start", "win_end")})
