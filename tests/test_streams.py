"""Streaming forms equal their batch forms on drained (availableNow) input."""

from __future__ import annotations

import tempfile
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.bindings import NOW
from reviewops.streaming import streams as J

from conftest import SF_SMALL

DAY = 86_400_000


def test_recheck_step_rules():
    pub = 0
    assert J.recheck_step(pub, "thanks", DAY) == ("replied", False, None)
    assert J.recheck_step(pub, "  ", 10 * DAY) == ("scheduled", True, 12 * DAY)   # strict '>' edge
    assert J.recheck_step(pub, None, 10 * DAY + 1) == ("expired", False, None)
    assert J.recheck_step(None, None, 5) == ("scheduled", True, 5 + 2 * DAY)


def _write(spark, rows, schema):
    d = tempfile.mkdtemp(prefix="reviewops-test-")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/t.parquet")
    return d


def test_stream_dedupe_equals_batch(spark):
    rows = [("a", datetime(2026, 7, 1), 1), ("a", datetime(2026, 7, 1), 2), ("b", datetime(2026, 7, 2), 3),
            ("", datetime(2026, 7, 2), 4), ("c", datetime(2026, 7, 3), 5)]
    d = _write(spark, rows, "id string, ts timestamp_ntz, seq int")
    s = J.table_stream(spark, d, "t")
    out = J.run_to_table(J.stream_dedupe(s.select("id", "ts"), ["id"], "ts"), name="t-dedupe")
    assert sorted((r["id"], r["ts"]) for r in out.collect()) == [
        ("a", datetime(2026, 7, 1)), ("b", datetime(2026, 7, 2)), ("c", datetime(2026, 7, 3))]


def test_stream_daily_counts_closed_days(spark):
    rows = [(datetime(2026, 7, d, h), float(d)) for d in range(1, 8) for h in (1, 13)]
    d = _write(spark, rows, "ts timestamp_ntz, v double")
    s = J.table_stream(spark, d, "t")
    out = J.run_to_table(J.stream_daily_counts(s, "ts", "v", "1 day"), name="t-daily")
    got = sorted((r["day"].day, r["cases"], r["mean_value"]) for r in out.collect())
    # watermark = max(ts) - 1 day = 7-06 13:00: days 1..5 are closed
    assert got == [(i, 2, float(i)) for i in range(1, 6)]


def test_stream_ingest_equals_batch_ingest(spark):
    import __spark_entry__ as entry
    streamed = entry.queries()["stream_ingest"](spark, SF_SMALL)
    batch = entry.queries()["ingest_batch"](spark, SF_SMALL)
    key = lambda r: (r["review_id"], r["stars"], r["owner_reply_recheck"], r["next_check_at"])
    assert sorted(map(key, streamed.collect())) == sorted(map(key, batch.collect()))


def test_stream_recheck_emits_transitions(spark):
    import __spark_entry__ as entry
    out = entry.queries()["stream_recheck"](spark, SF_SMALL)
    events = {r["event"] for r in out.collect()}
    assert {"replied", "expired"} <= events
    assert events <= {"replied", "expired", "scheduled", "due"}


def _recheck_brute_force(rows, delay_ms=DAY):
    """Expected J3 output for one drained batch: every observation gives its
    step; then the no-data batch fires the last state's timers up to the
    watermark (max event time - delay) in time order."""
    by_key = {}
    for rid, pub, reply, at in rows:
        by_key.setdefault(rid, []).append((at, pub, reply))
    wm = max(at for _, _, _, at in rows) - delay_ms
    out = Counter()
    for rid, obs in by_key.items():
        last = None
        for at, pub, reply in sorted(obs, key=lambda t: t[0]):
            if last is not None and not last[0]:
                break
            event, active, nxt = J.recheck_step(pub, reply, at)
            out[(rid, event, active, at, nxt)] += 1
            last = (active, pub if pub is not None else at, nxt)
        active, p, nxt = last
        if not active:
            continue
        expiry = p + K.RECHECK_MAX_AGE_DAYS * DAY + 1
        step = K.RECHECK_AFTER_DAYS * DAY
        for t in range(nxt, min(expiry, wm + 1), step):
            out[(rid, "due", True, t, t + step)] += 1
        if expiry <= wm:
            out[(rid, "expired", False, expiry, None)] += 1
    return out


def test_stream_recheck_matches_brute_force(spark):
    import __spark_entry__ as entry
    from reviewops.bindings import views
    rv = views(spark, SF_SMALL)["rv"].select(
        "review_id", J.as_event_time("published_at").alias("published_at"),
        F.col("owner_reply").cast("string").alias("owner_reply"), J.as_event_time("scraped_at").alias("at"))
    ms = lambda d: None if d is None else J._ms(d)
    rows = [(r["review_id"], ms(r["published_at"]), r["owner_reply"], ms(r["at"])) for r in rv.collect()]
    got = Counter((r["review_id"], r["event"], r["owner_reply_recheck"], ms(r["at"]), ms(r["next_check_at"]))
                  for r in entry.queries()["stream_recheck"](spark, SF_SMALL).collect())
    expected = _recheck_brute_force(rows)
    assert got == expected
    assert {e for _, e, *_ in expected} == {"replied", "expired", "scheduled", "due"}



class _Store:
    """A bucket's state: a list and timers, which count the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def clear(self):
        self.calls += 1
        self.rows = []

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.discard(t)


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_stream_recheck_calls_the_state_store_by_bucket_not_by_review():
    from pyspark.sql import Row
    store, processor = _Store(), J._recheck_processor()
    processor.init(store)
    rows = [Row(review_id=f"r{i}", published_ms=0, owner_reply=None, at_ms=DAY) for i in range(1000)]
    assert len(list(processor.handleInputRows((0,), iter(rows), _Mark(0)))) == 1000
    assert store.calls <= 4 and store.timers == {3 * DAY}
    # one is replied, one has late news, the rest goes on
    news = [Row(review_id="r1", published_ms=0, owner_reply="thanks", at_ms=2 * DAY),
            Row(review_id="r2", published_ms=0, owner_reply="thanks", at_ms=DAY - 1)]
    assert [(r.review_id, r.event) for r in processor.handleInputRows((0,), iter(news), _Mark(0))] == [("r1", "replied")]
    due = list(processor.handleExpiredTimer((0,), _Mark(5 * DAY), None))
    assert Counter((r.event, r.at) for r in due) == {("due", 3 * DAY): 999, ("due", 5 * DAY): 999}
    store.timers.discard(3 * DAY)                # Spark drops the timer that fired
    assert store.timers == {7 * DAY}
    ended = list(processor.handleExpiredTimer((0,), _Mark(30 * DAY), None))
    assert Counter(r.event for r in ended) == {"due": 1998, "expired": 999} and store.rows == []
    assert store.calls <= 13


def test_stream_recheck_is_the_same_for_any_number_of_buckets(spark):
    schema = "review_id string, published_at timestamp_ntz, owner_reply string, event_time timestamp_ntz"
    day = lambda d: datetime(2026, 7, d)
    first = [("a", day(1), None, day(2)), ("a", day(1), None, day(3)), ("b", day(1), None, day(2)), (None, day(1), " ", day(2)), ("c", None, "x", day(2))]
    later = [("a", day(1), "thanks", day(4)), ("b", day(1), "old news", day(1)), ("c", None, None, day(4)), ("d", day(1), None, day(20))]
    got = []
    for buckets in (1, 1 << 14):
        d = tempfile.mkdtemp(prefix="reviewops-test-")
        for i, rows in enumerate((first, later)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/t.parquet")
        s = J.table_stream(spark, d, "t", max_files=1)
        out = J.run_to_table(J.stream_recheck(s, buckets=buckets), name="t-recheck")
        assert out.schema == J.RECHECK_OUT
        got.append(Counter((r["review_id"], r["event"], r["at"].day, r["next_check_at"] and r["next_check_at"].day) for r in out.collect()))
    assert got[0] == got[1]
    assert got[0][("a", "replied", 4, None)] == 1 and ("a", "due", 5, 7) not in got[0]
    assert {k[1:] for k in got[0] if k[0] == "b"} >= {("scheduled", 2, 4), ("due", 4, 6), ("due", 10, 12), ("expired", 11, None)}
    assert {k[1:] for k in got[0] if k[0] is None} == {k[1:] for k in got[0] if k[0] == "b"}
    assert [k[1] for k in got[0] if k[0] == "c"] == ["replied"]


def test_stream_backlog_holds_a_row_against_those_near_it_in_time(spark):
    schema = "run_id string, pipeline string, status string, started_at timestamp_ntz"
    at = lambda m: datetime(2026, 7, 1 + m // 1440, m // 60 % 24, m % 60)
    # one run id for all: starts every 90 minutes; successes at the bounds, just beyond them and before the start
    starts = [(90 * i, ("review_daily", "store")[i % 2]) for i in range(64)]
    after = [(0, 60, 61, -1, 30)[i % 5] for i in range(64)]
    rows = [("r", p, "started", at(m)) for m, p in starts]
    rows += [("r", "x", "success", at(m + a)) for (m, _), a in zip(starts, after, strict=True) if m + a >= 0]
    rows += [("r", "x", "success", at(30))] * 3 + [("r", "store", "started", at(90))] + [("end", "x", s, at(12000)) for s in ("started", "success")]
    d = _write(spark, rows, schema)
    s = J.table_stream(spark, d, "t")
    backlog = J.stream_backlog(s.filter("status = 'started'"), s.filter("status = 'success'"))
    out = J.run_to_table(backlog, name="t-backlog")
    done = [r[3] for r in rows if r[2] == "success"]
    want = Counter((r[1], r[3]) for r in rows if r[2] == "started" and not any(0 <= (x - r[3]).total_seconds() <= 3600 for x in done))
    assert Counter((r["pipeline"], r["started_at"]) for r in out.collect()) == want and len(want) > 20
    keys = backlog._jdf.queryExecution().analyzed().toString()
    assert "a_slot" in keys and "b_slot" in keys
