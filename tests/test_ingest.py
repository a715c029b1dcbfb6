"""Stored tables, streamed ingest of several batches, salvage run after run."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.bindings import NOW, views
from reviewops.operators.ingest import classify_raw, etl_stats, ingest_batch, salvage_ingest
from reviewops.operators.merge import merge_upsert
from reviewops.operators.recheck import apply_recheck, recheck_ingest
from reviewops.plans import queries_ingest as Q
from reviewops.sources.raw import parse_json_column
from reviewops.sources.tables import Tables
from reviewops.streaming import streams as J

from conftest import SF_SMALL, rows

TEMPLATE = K.GENERIC_REPLY_TEMPLATES[0]
RAW = "seq long, raw_json string, dataset_id string"


def raw(spark, items):
    """(seq, review, place, stars, reply, text[, dataset]) as parsed raw reviews."""
    body = lambda r, p, s, reply, text: json.dumps({k: v for k, v in {"reviewId": r, "placeId": p, "stars": s, "text": text,
                                                                      "responseFromOwnerText": reply, "publishedAtDate": "1998-05-30T00:00:00Z"}.items() if v is not None}, ensure_ascii=False)
    return parse_json_column(spark.createDataFrame([(i[0], body(*i[1:6]), i[6] if len(i) > 6 else None) for i in items], RAW), "raw_json", K.RAW_REVIEW, once=True)


def empty_state(spark):
    return spark.createDataFrame([], K.REVIEW)


def places(spark, *ids):
    return spark.createDataFrame([(p, False) for p in ids], "place_id string, skip_review_fetch boolean")


# ------------------------------------------------------------------ stored tables


def keyed(spark, root, buckets=16):
    schema = spark.createDataFrame([], "k long, v string").schema
    return Tables(spark, str(root), {"t": schema, "log": schema}, {"t": ["k"]}, buckets)


def test_tables_last_version_wins(spark, tmp_path):
    t = keyed(spark, tmp_path)
    assert rows(t.read("t")) == [] and t.manifest()["version"] == 0
    make = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "k long, v string")
    assert t.commit({"t": make(range(50), "a"), "log": make([1], "a")}, 0)
    assert t.commit({"t": make(range(40, 60), "b"), "log": make([1], "b")}, 1)
    assert not t.commit({"t": make(range(60), "again")}, 1), "a batch is committed once"
    want = [(i, "a" if i < 40 else "b") for i in range(60)]
    assert sorted(rows(t.read("t"))) == want and sorted(rows(t.read("log"))) == [(1, "a"), (1, "b")]
    t.compact("t")
    assert sorted(rows(t.read("t"))) == want and all(len(v) == 1 for v in t.manifest()["live"]["t"].values())
    assert t.vacuum() > 0 and sorted(rows(t.read("t"))) == want and t.vacuum() == 0


def test_tables_merge_touches_its_buckets_only(spark, tmp_path):
    t = keyed(spark, tmp_path, buckets=200)
    base = spark.range(20_000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    t.commit({"t": base})
    before = t.manifest()["live"]["t"]
    few = spark.createDataFrame([(7, "b"), (8, "b")], "k long, v string")
    touched = t.merge("t", few)
    after = t.manifest()["live"]["t"]
    assert len(touched) <= 2 and {b for b in after if after[b] != before[b]} == {str(b) for b in touched}
    assert sorted(rows(t.read("t"))) == sorted(rows(merge_upsert(base, few, ["k"], ["v"])))
    files = t.read("t", touched).inputFiles()
    assert files and all(any(f"key_bucket={b}/" in f for b in touched) for f in files)


def test_tables_ignore_a_commit_that_did_not_end(spark, tmp_path):
    t = keyed(spark, tmp_path)
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    t.commit({"t": one})
    t._write("t", one.withColumn("v", F.lit("lost")), 2)          # files without a manifest
    assert rows(t.read("t")) == [(1, "a")]
    t.commit({"t": one.withColumn("v", F.lit("b"))})
    assert rows(t.read("t")) == [(1, "b")]
    with pytest.raises(RuntimeError):
        t._publish({"version": 2, "batch": -1, "live": {}})


# ------------------------------------------------------------------ E15 / I8


def test_stats_from_one_pass(spark):
    items = [(1, "a", "p", 1, None, "text"), (2, "a", "p", 2, "thanks", "text"), (3, None, "p", 1, None, "text"), (4, "", "p", 1, None, "text"),
             (5, "b", None, 1, None, "text"), (6, "c", "p", 5, None, "text"), (7, "d", "p", 1, "x", " a "), (8, "e", "q", 1, TEMPLATE, "text"), (9, "f", "q", 2, TEMPLATE + " ", "text")]
    s = etl_stats(classify_raw(raw(spark, items))).first().asDict()
    assert s == {"raw_count": 9, "invalid_skipped": 1, "non_low_star_skipped": 1, "filter_skipped": 3, "source_count": 4, "review_count": 1,
                 "generic_pr_store_count": 1, "dedupe_skipped": 3, "skipped": 8}
    assert etl_stats(classify_raw(raw(spark, []))).first()["raw_count"] == 0


def test_stats_plan_has_one_scan_and_one_parse(spark):
    plan = etl_stats(classify_raw(Q.raw_reviews(views(spark, SF_SMALL)["ev"]), detect_generic=False))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1 and plan.count("from_json") == 1


def test_ingest_upserts_landed_rows(spark):
    old = spark.createDataFrame([("a", "p", "old", datetime(2020, 1, 1)), ("z", "p", "old", datetime(2020, 1, 1))], "review_id string, place_id string, raw_json string, scraped_at timestamp_ntz")
    res = ingest_batch(raw(spark, [(1, "a", "p", 1, None, "text"), (2, "b", "p", 1, TEMPLATE, "text")]), empty_state(spark), places(spark, "p", "q"), NOW, landing=old)
    assert sorted((r["review_id"], r["raw_json"] == "old") for r in res.source.collect()) == [("a", False), ("b", False), ("z", True)]
    assert rows(res.changed) == [("p",)] and sorted(rows(res.places)) == [("p", True), ("q", False)]


# ------------------------------------------------------------------ J1


def test_stream_of_three_batches_with_a_replay(spark, tmp_path):
    batches = [[(1, "a", "p", 1, None, "first"), (2, "b", "p", 2, "thanks", "text"), (3, "c", "q", 1, TEMPLATE, "text")],
               [(4, "a", "p", 2, "reply", "second"), (5, "d", "q", 1, None, "not allowed any more"), (6, "e", "r", 5, None, "text")],
               [(7, "b", "p", 1, None, "third"), (8, "a", "p", 4, None, "five stars now"), (9, None, "p", 1, None, "text")]]
    src = str(tmp_path / "in")
    state, landing, flags = empty_state(spark), None, places(spark, "p", "q", "r")
    tables = J.ingest_tables(spark, str(tmp_path / "tables"), state, flags, buckets=4)
    open_ = lambda p: p.filter(~F.col("skip_review_fetch"))
    stats, changed, logs = [], [], 0
    for i, items in enumerate(batches):
        frame = raw(spark, items)
        frame.select("seq", "raw_json").coalesce(1).write.mode("append").parquet(src)
        stream = parse_json_column(spark.readStream.schema("seq long, raw_json string").parquet(src), "raw_json", K.RAW_REVIEW, once=True)
        J.stream_ingest(stream, tables, str(tmp_path / "ckpt"), NOW, allowed=open_, compact_after=1).awaitTermination()
        r = ingest_batch(frame, state, flags, NOW, allowed=open_(flags), landing=landing)
        state, landing, flags = (spark.createDataFrame(x.collect(), x.schema) for x in (r.review, r.source, r.places))
        stats.append(tuple(r.stats.select(*Q.COUNTERS).first()))
        changed += [(x["place_id"], i) for x in r.changed.collect()]
        logs += 1
    same = lambda a, b, cols: sorted(map(str, rows(a, *cols))) == sorted(map(str, rows(b, *cols)))
    assert same(tables.read("review"), state, state.columns) and same(tables.read("source"), landing, landing.columns)
    assert same(tables.read("place"), flags, flags.columns)
    assert [tuple(x[1:]) for x in sorted(rows(tables.read("stats"), "batch", *Q.COUNTERS))] == stats
    assert sorted(rows(tables.read("changed"))) == changed == [("q", 0)]
    assert tables.read("log").count() == logs
    # the same files again under a new checkpoint: batch ids start anew and are all known
    version = tables.manifest()["version"]
    stream = parse_json_column(spark.readStream.schema("seq long, raw_json string").option("maxFilesPerTrigger", 1).parquet(src), "raw_json", K.RAW_REVIEW, once=True)
    J.stream_ingest(stream, tables, str(tmp_path / "ckpt2"), NOW, allowed=open_).awaitTermination()
    assert tables.manifest()["version"] == version and same(tables.read("review"), state, state.columns)


def test_stream_batch_writes_its_own_rows_only(spark, tmp_path):
    many = spark.range(5000).select(F.concat(F.lit("x"), "id").alias("review_id"))
    state = many.select(*[F.col("review_id") if f.name == "review_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in K.REVIEW])
    tables = J.ingest_tables(spark, str(tmp_path / "tables"), state, places(spark, "p"), buckets=4)
    src = str(tmp_path / "in")
    raw(spark, [(1, "a", "p", 1, None, "first"), (2, "x7", "p", 2, None, "text")]).select("seq", "raw_json").write.parquet(src)
    stream = parse_json_column(spark.readStream.schema("seq long, raw_json string").parquet(src), "raw_json", K.RAW_REVIEW, once=True)
    J.stream_ingest(stream, tables, str(tmp_path / "ckpt"), lambda batch: NOW).awaitTermination()
    v = tables.manifest()["version"]
    assert spark.read.parquet(f"{tmp_path}/tables/review/table_version={v}").count() == 2 and tables.read("review").count() == 5001


# ------------------------------------------------------------------ I9


def test_salvage_run_after_run(spark):
    runs = spark.createDataFrame([("r1", "d1", "SUCCEEDED", 3), ("r2", "d2", "SUCCEEDED", 1), ("r3", "d3", "FAILED", 2), ("r4", "d4", "SUCCEEDED", 9), ("r5", "d5", "SUCCEEDED", 8)],
                                 "run_id string, dataset_id string, status string, finished_at int")
    items = [(1, "a", "p", 1, None, "one", "d1"), (2, "a", "p", 2, None, "first in d2", "d2"), (3, "a", "p", 1, None, "not first", "d2"), (9, "b", "p", 1, None, "old", "d2"),
             (4, "b", "p", 1, TEMPLATE, "generic later", "d1"), (5, "c", "p", 1, None, "failed run", "d3"), (6, "d", "q", 1, None, "known run", "d4")]
    log = spark.createDataFrame([("success", "r4"), ("failed", "r1")], "status string, run_id string")
    res = salvage_ingest(runs, raw(spark, items), empty_state(spark), places(spark, "p", "q"), NOW, log=log)
    # r2 ends before r1: its "a" is replaced; its "b" stays, as r1's is generic and no review
    assert sorted(rows(res.review, "review_id", "review_text")) == [("a", "one"), ("b", "old")]
    assert sorted((r["review_id"], json.loads(r["raw_json"])["text"]) for r in res.source.collect()) == [("a", "one"), ("b", "generic later")]
    assert rows(res.changed) == [("p",)]
    assert sorted(rows(res.stats, "run_id", "raw_count", "review_count", "dedupe_skipped")) == [("r1", 2, 1, 0), ("r2", 3, 2, 1)]
    done = sorted(rows(res.log, "run_id", "dataset_id", "items_count", "status"))
    assert done == [("r1", "d1", 2, "success"), ("r2", "d2", 3, "success"), ("r5", "d5", 0, "success")]
    assert json.loads(res.log.filter("run_id = 'r1'").first()["response_json"]) == {"dataset_id": "d1", "item_count": 2, "run_status": "SUCCEEDED"}
    again = salvage_ingest(runs, raw(spark, items), res.review, res.places, NOW, log=log.unionByName(res.log.select("status", "run_id")))
    assert again.stats.count() == again.log.count() == again.source.count() == 0 and again.review.count() == 2


# ------------------------------------------------------------------ recheck run


def test_recheck_ingest(spark):
    """A reply, a generic place and old age stop a review; others come again in two days; reviews that are not due stay."""
    now, young, old = datetime(1998, 6, 1), datetime(1998, 5, 30), datetime(1998, 5, 1)
    have = [("answered", "P1", young, True, now), ("silent", "P1", young, True, now), ("old", "P1", old, True, now), ("undated", "P1", None, True, now),
            ("not due", "P1", young, True, datetime(1998, 6, 2)), ("of generic", "P2", young, True, now), ("blocked", "P3", young, True, now),
            ("stopped", "P1", young, False, None)]
    state = spark.createDataFrame([(r, p, t, f, n) for r, p, t, f, n in have],
                                  "review_id string, place_id string, published_at timestamp_ntz, owner_reply_recheck boolean, next_check_at timestamp_ntz")
    state = state.select(*[F.col(f.name) if f.name in state.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in K.REVIEW])
    place = spark.createDataFrame([("P1", False, False), ("P2", False, False), ("P3", True, False)], "place_id string, blocked boolean, skip_review_fetch boolean")
    items = raw(spark, [(1, "answered", "P1", 1, None, "text"), (2, "answered", "P1", 1, "thanks for it", "text"), (3, "silent", "P1", 1, " ", "text"),
                        (4, "new", "P2", 1, TEMPLATE, "text"), (5, "elsewhere", "P9", 1, None, "text"), (6, "found", "P1", 2, None, "text")])
    out = recheck_ingest(items, state, place, now)
    got = {r["review_id"]: (r["owner_reply_recheck"], r["next_check_at"]) for r in out.review.collect()}
    again = (True, datetime(1998, 6, 3))
    assert got == {"answered": (False, None), "silent": again, "old": (False, None), "undated": again, "not due": (True, datetime(1998, 6, 2)),
                   "of generic": (False, None), "blocked": (True, now), "stopped": (False, None), "found": again}
    assert {r["place_id"] for r in out.places.filter("skip_review_fetch").collect()} == {"P2"} and out.changed.count() == 1
    log = out.log.collect()[0]
    assert log["items_count"] == 5 and json.loads(log["response_json"])["recheck_rows_updated"] == 5
    none = recheck_ingest(items.limit(0), state.limit(0), place, now)
    assert none.review.count() == 0 and json.loads(none.log.collect()[0]["response_json"])["recheck_rows_updated"] == 0


def test_apply_recheck_takes_the_latest_state(spark):
    table = spark.createDataFrame([("a", True, None, None), ("b", True, None, None)],
                                  "review_id string, owner_reply_recheck boolean, owner_reply_recheck_at timestamp_ntz, next_check_at timestamp_ntz")
    ups = spark.createDataFrame([("a", True, datetime(1998, 6, 1), datetime(1998, 6, 3)), ("a", False, datetime(1998, 6, 3), None), ("x", False, None, None)], table.schema)
    assert sorted((r["review_id"], r["owner_reply_recheck"]) for r in apply_recheck(table, ups).collect()) == [("a", False), ("b", True)]
