"""Structured Streaming operators.

Event time must be a session-zone ``timestamp`` for watermarks; the stored
tables hold UTC wall-clock ``timestamp_ntz`` values, and the session zone is
UTC, so streams cast event time with ``as_event_time`` and outputs are cast
back.  Every sink here is append-only and every query has a checkpoint, so a
restarted or retried micro-batch does not double-count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewops import schemas as K
from reviewops.session import ensure_checkpoint_dir
from reviewops.sources.tables import Tables, file_system


def as_event_time(c) -> "F.Column":
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def table_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """A file stream over one parquet table of ``sf_dir``: a single
    ``<table>.parquet`` file or a folder of that name.  The schema is taken
    from the files (no inference at stream time)."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    fs, p = file_system(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for a sink or checkpoint."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def run_to_table(df: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Drain a streaming frame once (``availableNow``) into parquet and read it
    back as a batch DataFrame."""
    spark = df.sparkSession
    base = scratch(spark, name)
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")

# --------------------------------------------------------------------- J1


INGEST_KEYS = {"source": ["review_id"], "review": ["review_id"], "place": ["place_id"]}


def ingest_tables(spark: SparkSession, root: str, review: DataFrame, places: DataFrame, buckets: int = 64) -> Tables:
    """The six tables of ``stream_ingest``, loaded with the current reviews and places if they are new.

    ``source`` (landed raw), ``review`` and ``place`` hold one row per key;
    ``changed`` (place, batch), ``stats`` and ``log`` take rows.
    """
    review_type, place_type = review.schema, places.schema
    landed = T.StructType([T.StructField("review_id", T.StringType()), T.StructField("place_id", T.StringType()),
                           T.StructField("raw_json", T.StringType()), T.StructField("scraped_at", T.TimestampNTZType())])
    changed = T.StructType([T.StructField("place_id", T.StringType()), T.StructField("batch", T.LongType())])
    stats = T.StructType([T.StructField(c, T.LongType()) for c in (
        "batch", "raw_count", "invalid_skipped", "non_low_star_skipped", "filter_skipped", "source_count", "review_count",
        "generic_pr_store_count", "dedupe_skipped", "skipped")])
    tables = Tables(spark, root, {"source": landed, "review": review_type, "place": place_type, "changed": changed, "stats": stats, "log": K.EXECUTION_LOG},
                    INGEST_KEYS, buckets)
    if tables.manifest()["version"] == 0:
        tables.commit({"review": review, "place": places})
    return tables


def stream_ingest(raw_stream: DataFrame, tables: Tables, checkpoint: str, now, allowed=None, detect_generic: bool = True,
                  compact_after: int = 8, **trigger):
    """Run I8 on every micro-batch of parsed raw reviews and commit all its outputs at once.

    A batch writes its own rows only: landed raw rows, reviews, places whose
    flag flipped, counters, log row; the last version of a key counts.  The
    commit is idempotent by batch id, so a replayed batch changes nothing.
    ``now`` is an instant or a function of the batch id; ``allowed`` is a
    function of the place table as the last batch left it.  Buckets with more
    than ``compact_after`` versions are folded after a batch.  Returns the
    started StreamingQuery (trigger: available data once, unless given).
    """
    from reviewops.operators.ingest import ingest_delta

    def each(batch: DataFrame, batch_id: int):
        if batch_id > tables.manifest()["batch"]:
            places = tables.read("place")
            d = ingest_delta(batch, now(batch_id) if callable(now) else now, None if allowed is None else allowed(places),
                             detect_generic=detect_generic)
            flagged = places.join(d.generic, "place_id", "left_semi").filter(~F.coalesce(F.col("skip_review_fetch"), F.lit(False)))
            number = F.lit(batch_id).cast("long").alias("batch")
            tables.commit({"source": d.source, "review": d.review, "place": flagged.withColumn("skip_review_fetch", F.lit(True)),
                           "changed": flagged.select("place_id", number), "stats": d.stats.select("*", number), "log": d.log}, batch_id)
        for name in INGEST_KEYS:
            tables.compact(name, compact_after)

    return (raw_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())

# --------------------------------------------------------------------- J2


def stream_dedupe(stream: DataFrame, keys, ts: str, delay: str = f"{K.RECHECK_MAX_AGE_DAYS} days") -> DataFrame:
    """The first event per key within ``delay`` of event time."""
    present = None
    for k in keys:
        ok = F.coalesce(F.col(k).cast("string"), F.lit("")) != ""
        present = ok if present is None else (present & ok)
    s = stream.filter(present).withColumn("_et", as_event_time(ts))
    return s.withWatermark("_et", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_et")

# --------------------------------------------------------------------- J3

RECHECK_OUT = T.StructType([
    T.StructField("review_id", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("owner_reply_recheck", T.BooleanType()), T.StructField("at", T.TimestampType()),
    T.StructField("next_check_at", T.TimestampType()),
])

_DAY_MS = 86_400_000


def recheck_step(published_ms: int | None, reply: str | None, at_ms: int,
                 after_days: int = K.RECHECK_AFTER_DAYS, max_age_days: int = K.RECHECK_MAX_AGE_DAYS):
    """The I4/I5 transition for one observation: (event, active, next_ms)."""
    pub = published_ms if published_ms is not None else at_ms
    if reply is not None and str(reply).strip():
        return "replied", False, None
    if at_ms > pub + max_age_days * _DAY_MS:
        return "expired", False, None
    return "scheduled", True, at_ms + after_days * _DAY_MS


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_ONE_MS = timedelta(milliseconds=1)


def _ms(dt: datetime) -> int:
    """Epoch milliseconds of a Row timestamp (naive values are in the
    worker's local zone, as PySpark hands them over)."""
    return (dt.astimezone(timezone.utc) - _EPOCH) // _ONE_MS


RECHECK_STATE = T.StructType([
    T.StructField("review_id", T.StringType()), T.StructField("published_ms", T.LongType()),
    T.StructField("next_ms", T.LongType()), T.StructField("last_ms", T.LongType()),
    T.StructField("stopped", T.BooleanType()),
])


def _recheck_expiry(published_ms: int) -> int:
    return published_ms + K.RECHECK_MAX_AGE_DAYS * _DAY_MS + 1


def _recheck_wake(state: tuple) -> int:
    """When a review next needs care: a check, its expiry, or, once stopped, to
    be forgotten because no check could follow."""
    published, nxt, last, stopped = state
    expiry = _recheck_expiry(published)
    return max(expiry, last + 1) if stopped else min(nxt, expiry)


def _recheck_processor():
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class RecheckProcessor(StatefulProcessor):
        """Keyed by bucket of reviews.  The state is a list with a row per live
        review, read and written at once, so a call to the state store serves
        all reviews of a bucket; one event-time timer stands at the earliest
        time one of them needs care."""

        def init(self, handle) -> None:
            self.handle = handle
            self.reviews = handle.getListState("reviews", RECHECK_STATE)

        def kept(self) -> dict:
            return {r[0]: tuple(r[1:]) for r in self.reviews.get()}

        def store(self, kept: dict) -> int | None:
            """Writes the reviews; the time of the bucket's timer."""
            if not kept:
                self.reviews.clear()
                return None
            self.reviews.put([(rid, *state) for rid, state in kept.items()])
            return min(map(_recheck_wake, kept.values()))

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            # observations count in event time: one older than the last is
            # late news, and none revives a row that was replied or expired
            kept, found, news = self.kept(), {}, False
            timer = min(map(_recheck_wake, kept.values()), default=None)
            for r in rows:
                found.setdefault(r.review_id, []).append((r.at_ms, r.published_ms, r.owner_reply))
            for rid, obs in found.items():
                known = kept.get(rid)
                seen, stopped = (known[2], known[3]) if known else (None, False)
                for at, pub, reply in sorted(obs, key=lambda t: t[0]):
                    if stopped or (seen is not None and at < seen):
                        continue
                    event, active, nxt = recheck_step(pub, reply, at)
                    seen, stopped, news = at, not active, True
                    kept[rid] = (pub if pub is not None else at, nxt, at, stopped)
                    yield Row(review_id=rid, event=event, owner_reply_recheck=active, at=at, next_check_at=nxt)
            if not news:
                return
            wake = self.store(kept)
            if wake != timer:
                if timer is not None:        # left by an earlier batch
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(wake)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            # all that the watermark has passed comes at once, in time order per review
            mark, step, kept = timerValues.getCurrentWatermarkInMs(), K.RECHECK_AFTER_DAYS * _DAY_MS, self.kept()
            for rid, state in list(kept.items()):
                if _recheck_wake(state) > mark:
                    continue
                pub, nxt, last, stopped = state
                expiry = _recheck_expiry(pub)
                # a check without news is due again after the same wait, until the row expires
                while not stopped and nxt <= mark and nxt < expiry:
                    yield Row(review_id=rid, event="due", owner_reply_recheck=True, at=nxt, next_check_at=nxt + step)
                    nxt += step
                kept[rid] = (pub, nxt, last, stopped)
                if stopped or expiry <= mark:
                    del kept[rid]
                    if not stopped:
                        yield Row(review_id=rid, event="expired", owner_reply_recheck=False, at=expiry, next_check_at=None)
            wake = self.store(kept)
            if wake is not None:
                self.handle.registerTimer(wake)

        def close(self) -> None:
            pass

    return RecheckProcessor()


def stream_recheck(stream: DataFrame, key: str = "review_id", ts: str = "event_time",
                   delay: str = "1 day", buckets: int = 1 << 14) -> DataFrame:
    """I4/I5 as keyed state with event-time timers.

    Input rows: ``review_id, published_at, owner_reply, event_time``.  Output
    (append): one row per transition: ``scheduled`` / ``replied`` /
    ``expired`` on observations, ``due`` when a next-check timer fires, and
    ``expired`` when the 10-day limit passes without a reply.

    Reviews are dealt to ``buckets`` state keys by hash; a batch reads and
    writes the buckets it has rows or timers for.  The number stays as it is
    for the life of a checkpoint.
    """
    s = stream.select(F.col(key).alias("review_id"), F.unix_millis(as_event_time("published_at")).alias("published_ms"),
                      F.col("owner_reply").cast("string").alias("owner_reply"),
                      as_event_time(ts).alias("event_time"))
    s = s.withWatermark("event_time", delay).withColumn("at_ms", F.unix_millis("event_time"))
    s = s.withColumn("bucket", F.pmod(F.xxhash64("review_id"), F.lit(buckets)))
    millis = T.StructType([T.StructField(f.name, T.LongType() if f.name in ("at", "next_check_at") else f.dataType)
                           for f in RECHECK_OUT])
    out = s.groupBy("bucket").transformWithState(
        statefulProcessor=_recheck_processor(), outputStructType=millis,
        outputMode="Append", timeMode="EventTime")
    return out.select(*[F.timestamp_millis(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
                        for f in RECHECK_OUT])

# --------------------------------------------------------------------- J4


def stream_daily_counts(stream: DataFrame, ts: str, value: str, delay: str = "2 days") -> DataFrame:
    """Per-day row count and mean ``value``; rows later than the
    watermark are dropped, a day is emitted once it is closed."""
    s = stream.withColumn("_et", as_event_time(ts)).withWatermark("_et", delay)
    agg = s.groupBy(F.window("_et", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.col(value).cast("double")).alias("mean_value"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "cases", "mean_value")

# --------------------------------------------------------------------- J5


def stream_backlog(started: DataFrame, success: DataFrame, within: str = "1 hour",
                   delay: str = "10 minutes", key: str = "run_id", ts: str = "started_at") -> DataFrame:
    """Started runs with no success for the same run id within ``within``.

    A stream-stream left outer join with watermarks on both sides and a time
    bound, so state is dropped once a start can no longer be matched; the
    unmatched starts are emitted then.  Beside the run id the rows meet by
    slot of event time, ``within`` long: a start's success lies in the same
    slot or the next, so a row is held against those near it in time and not
    against all that a long-lived run id ever had."""
    width = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {within}"))
    slot = lambda c: F.floor(F.unix_micros(c) / width)
    a = (started.select(F.col(key).alias("a_run"), "pipeline", as_event_time(ts).alias("a_ts"))
         .withWatermark("a_ts", delay).withColumn("a_slot", slot("a_ts")))
    b = (success.select(F.col(key).alias("b_run"), as_event_time(ts).alias("b_ts"))
         .withWatermark("b_ts", delay)
         .select("b_run", "b_ts", F.explode(F.array(slot("b_ts"), slot("b_ts") - 1)).alias("b_slot")))
    cond = ((F.col("a_run") == F.col("b_run")) & (F.col("a_slot") == F.col("b_slot")) & (F.col("b_ts") >= F.col("a_ts"))
            & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}")))
    j = a.join(b, cond, "left_outer")
    return j.filter(F.col("b_run").isNull()).select(
        "pipeline", F.col("a_run").alias("run_id"), F.col("a_ts").cast("timestamp_ntz").alias("started_at"))
