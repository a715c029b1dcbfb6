"""Operators against brute-force Python on small inline frames."""

from __future__ import annotations

import difflib
import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions.similarity import gestalt_ratio, ratio
from reviewops.operators import joins as D
from reviewops.operators import merge as M
from reviewops.operators import ordering as O
from reviewops.operators import scoring as SC
from reviewops.operators.batching import batches, global_index
from reviewops.operators.best import best_by
from reviewops.operators.quality import generic_reply
from reviewops.operators.recheck import advance_recheck
from reviewops.operators.rollups import review_rollup
from reviewops.sources import raw as RAW

T0 = datetime(2026, 7, 1)


def test_best_by_nulls_ties_and_filter(spark):
    data = [("p1", "r1", 1, None, "a"), ("p1", "r2", 1, T0, "b"), ("p1", "r0", 1, T0, "c"),
            ("p1", "r3", None, T0, "d"), ("p2", "r4", None, None, "e"), ("p2", "r5", 2, T0, None)]
    df = spark.createDataFrame(data, "k string, id string, s int, t timestamp_ntz, v string")
    out = df.groupBy("k").agg(
        best_by("v", [("s", "asc"), ("t", "desc", "ts")], tie="id").alias("first"),
        best_by("v", [("s", "asc")], where=F.col("v") != "a", tie="id").alias("filtered"))
    got = {r["k"]: (r["first"], r["filtered"]) for r in out.collect()}
    # s asc (NULL last), t desc (NULL first, PostgreSQL default), id asc
    assert got["p1"] == ("a", "c")
    assert got["p2"] == (None, "e")   # NULL v fails the filter, so r4 is the only row left


def test_review_rollup_counts_blank_replies(spark):
    rows = [("r1", "p", 1, "t1", T0, "u1", "  "), ("r2", "p", 2, "t2", T0 + timedelta(days=1), "u2", "real"),
            ("r3", "p", 5, "t3", T0, "u3", "x")]
    df = spark.createDataFrame(rows, "review_id string, place_id string, stars int, review_text string, "
                                     "published_at timestamp_ntz, review_url string, owner_reply string")
    r = review_rollup(df).collect()[0]
    assert (r["review_rows"], r["owner_reply_rows"]) == (2, 2)
    assert r["latest_owner_reply"] == "real"       # blank reply skipped
    assert r["drama_stars"] == 1 and r["latest_review_url"] == "u1"


def small_table(spark):
    return spark.createDataFrame([("a", 1, False), ("b", 2, True), ("c", 3, False)],
                                 "k string, v int, flag boolean")


def test_merge_upsert_idempotent_and_last_wins(spark):
    t = small_table(spark)
    s = spark.createDataFrame([("b", 20, False, 1), ("b", 21, False, 2), ("d", 4, False, 1)],
                              "k string, v int, flag boolean, seq int")
    once = M.merge_upsert(t, s, ["k"], ["seq"])
    twice = M.merge_upsert(once, s, ["k"], ["seq"])
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    assert a == [("a", 1, False), ("b", 21, False), ("c", 3, False), ("d", 4, False)]
    kept = M.merge_upsert(t, s, ["k"], ["seq"], preserve=["flag"])
    assert dict((r["k"], r["flag"]) for r in kept.collect())["b"] is True


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.integers(0, 9)), min_size=1, max_size=12))
def test_merge_upsert_property(spark, src):
    t = small_table(spark)
    s = spark.createDataFrame([(k, v, False, i) for i, (k, v) in enumerate(src)],
                              "k string, v int, flag boolean, seq int")
    once = M.merge_upsert(t, s, ["k"], ["seq"])
    twice = M.merge_upsert(once, s, ["k"], ["seq"])
    expect = {r[0]: (r[1], r[2]) for r in [("a", 1, False), ("b", 2, True), ("c", 3, False)]}
    for k, v in src:
        expect[k] = (v, False)
    got = {r["k"]: (r["v"], r["flag"]) for r in once.collect()}
    assert got == expect
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_merge_columns_and_mark_skip(spark):
    t = small_table(spark)
    s = spark.createDataFrame([("b", 99, False), ("z", 7, False)], "k string, v int, flag boolean")
    got = {r["k"]: (r["v"], r["flag"]) for r in M.merge_columns(t, s, ["k"], ["v"], {"flag": True}).collect()}
    assert got == {"a": (1, False), "b": (99, True), "c": (3, False), "z": (7, True)}
    ids = spark.createDataFrame([("a",), ("b",), ("q",)], "k string")
    new, changed = M.mark_skip(t, ids, key="k", flag="flag")
    assert sorted(r["k"] for r in changed.collect()) == ["a"]
    assert {r["k"]: r["flag"] for r in new.collect()} == {"a": True, "b": True, "c": False}


def test_dedupe_first_and_last_wins(spark):
    rows = [("x", 3, "late"), ("x", 1, "first"), ("y", 2, "only"), (None, 0, "no id"), ("", 5, "empty")]
    df = spark.createDataFrame(rows, "id string, seq int, v string")
    first = {r["id"]: r["v"] for r in O.dedupe_first(df, ["id"], "seq").collect()}
    last = {r["id"]: r["v"] for r in O.last_wins(df, ["id"], "seq").collect()}
    assert first == {"x": "first", "y": "only"}
    assert last == {"x": "late", "y": "only"}


def test_global_index_and_batches(spark):
    n = 237
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.lit(1).alias("one"))
    idx = global_index(df, [F.col("k").desc()], partitions=5)
    got = sorted((r["row_index"], r["k"]) for r in idx.collect())
    assert got == [(i, n - 1 - i) for i in range(n)]
    b = batches(df.withColumn("key", F.col("k").cast("string")), [F.col("k").asc()], 50, "key",
                {"m": F.max("k")}, partitions=4).collect()
    b = sorted(b, key=lambda r: r["batch_index"])
    assert [len(r["keys"]) for r in b] == [50, 50, 50, 50, 37]
    assert [k for r in b for k in r["keys"]] == [str(i) for i in range(n)]
    assert [r["m"] for r in b] == [49, 99, 149, 199, 236]


def test_page_offset_and_keyset(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    page3, total = O.page(df, ["k"], page_no=3, size=3)
    assert [r["k"] for r in page3.collect()] == [6, 7, 8] and total.collect()[0]["total"] == 10
    after, _ = O.page(df, ["k"], size=3, after=[5])
    assert [r["k"] for r in after.collect()] == [6, 7, 8]
    odd = spark.createDataFrame([(a, i) for i, a in enumerate([3, None, 1, 3, None, 2])], "a int, i int")
    for way in ("asc", "desc"):
        for nulls in ("nulls_first", "nulls_last"):
            order = [("a", way, nulls), ("i", "desc")]
            whole = [tuple(r) for r in O.page(odd, order, size=6, max_size=6)[0].collect()]
            seen = whole[:1]
            while more := O.page(odd, order, size=2, after=seen[-1])[0].collect():
                seen += [tuple(r) for r in more]
            assert seen == whole and len(whole) == 6
    with pytest.warns(UserWarning, match="cut to 3"):
        capped, _ = O.page(df, ["k"], page_no=1, size=99)
    assert capped.count() == K.PAGE_SIZE_MAX
    assert O.last_page(10, 3) == 4


def test_advance_recheck_rules(spark):
    now = datetime(2026, 7, 11)
    due = spark.createDataFrame(
        [("r1", "pg", T0 + timedelta(days=5)), ("r2", "p", T0 + timedelta(days=5)),
         ("r3", "p", T0 - timedelta(hours=1)), ("r4", "p", T0 + timedelta(days=5)), ("r5", "p", None),
         ("r6", "p", T0)],
        "review_id string, place_id string, published_at timestamp_ntz")
    fresh = spark.createDataFrame([("r2", "got it", 1), ("r4", "reply", 1), ("r4", "  ", 2)],
                                  "reviewId string, responseFromOwnerText string, seq int")
    generic = spark.createDataFrame([("pg",)], "place_id string")
    got = {r["review_id"]: (r["owner_reply_recheck"], r["next_check_at"])
           for r in advance_recheck(due, fresh, generic, now).collect()}
    assert got["r1"] == (False, None)            # generic place stops
    assert got["r2"] == (False, None)            # reply found stops
    assert got["r3"] == (False, None)            # older than 10 days stops
    assert got["r4"] == (True, now + timedelta(days=2))   # later blank item overwrites the reply
    assert got["r5"] == (True, now + timedelta(days=2))   # missing date = now
    assert got["r6"] == (True, now + timedelta(days=2))   # exactly 10 days: strict '>' keeps it on


def test_gestalt_ratio_matches_difflib(spark):
    rnd = random.Random(5)
    alphabet = "ab cd感謝您的抱歉"
    pairs = [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))),
              "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))) for _ in range(60)]
    pairs += [("", "x"), (None, "x"), (" a b ", "ab")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["r"] for r in df.select("i", gestalt_ratio("a", "b").alias("r")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(ratio(a, b))
    assert ratio("abcd", "abce") == pytest.approx(difflib.SequenceMatcher(None, "abcd", "abce").ratio())


def test_generic_reply_prefilter_keeps_every_true_hit(spark):
    rnd = random.Random(11)
    tpls = list(K.GENERIC_REPLY_TEMPLATES)
    replies = []
    for i in range(120):
        base = rnd.choice(tpls)
        cut = rnd.randint(0, len(base) // 3)
        text = base[cut:] if i % 3 else base + "！" * rnd.randint(0, 12)
        if i % 5 == 0:
            text = "完全不同的回覆內容" * rnd.randint(1, 3)
        replies.append(text)
    df = spark.createDataFrame([(f"r{i}", "p", t) for i, t in enumerate(replies)],
                               "review_id string, place_id string, owner_reply string")
    got = {r["review_id"]: r["is_generic"] for r in generic_reply(df).collect()}
    for i, t in enumerate(replies):
        brute = any(ratio(t, tp) >= K.SIMILARITY_THRESHOLD for tp in tpls)
        assert got[f"r{i}"] == brute


def test_nearest_place_matches_brute_force(spark):
    rnd = random.Random(3)
    places = [(f"s{i}", rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(60)]
    places += [("dup", places[0][1], places[0][2])]          # tie with s0
    points = [(i, rnd.uniform(-2, 3), rnd.uniform(-2, 3)) for i in range(80)]
    pdf = spark.createDataFrame(places, "place_id string, lat double, lng double")
    qdf = spark.createDataFrame(points, "point_id long, lat double, lng double")
    got = {r["point_id"]: r["place_id"] for r in D.nearest_place(qdf, pdf, cell=0.05).collect()}
    for pid, la, ln in points:
        best = min(places, key=lambda p: ((la - p[1]) ** 2 + (ln - p[2]) ** 2, p[0]))
        assert got[pid] == best[0]


def test_scorer_completeness_statuses(spark):
    req = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "review_id string, x int")
    resp = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("z", 9)], "review_id string, y int")
    got = {r["review_id"]: r["status"] for r in D.scorer_completeness(req, resp).collect()}
    assert got == {"a": "ok", "b": "duplicate", "c": "missing", "z": "unknown"}


def test_score_pairs_isolates_failing_batch(spark):
    rows = [(f"r{i:03d}", "p", f"text {i}", "reply") for i in range(120)]
    df = spark.createDataFrame(rows, "review_id string, place_id string, review_text string, owner_reply string")

    def flaky(pdf):
        if "r060" in set(pdf["review_id"]):
            raise RuntimeError("model down")
        return SC.keyword_scorer(pdf)

    out = SC.score_pairs(df.coalesce(1), flaky, batch=50).collect()
    assert len(out) == 120
    failed = [r for r in out if r["status"] != "SUCCESS"]
    assert len(failed) == 50 and all(r["review_score"] is None for r in failed)
    good, bad = SC.validate_scores(spark.createDataFrame([r for r in out if r["status"] == "SUCCESS"]))
    assert good.count() == 70 and bad.count() == 0


def test_read_json_dataset(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"reviewId": "r1", "placeId": "p", "stars": 2}, 5, "x",
                                                 {"reviewId": "r2", "location": {"lat": 1.5, "lng": 2}}]))
    (tmp_path / "b.json").write_text(json.dumps({"reviewId": "not in an array"}))
    df = RAW.read_json_dataset(spark, str(tmp_path), K.RAW_REVIEW)
    got = sorted((r["reviewId"], r["stars"]) for r in df.collect())
    assert got == [("r1", "2"), ("r2", None)]


def test_parse_once_equals_pruned_parse(spark):
    rows = [(1, json.dumps({"reviewId": "r1", "placeId": "p", "stars": 2})), (2, "not json"), (3, "7"),
            (4, json.dumps({"reviewId": "", "placeId": "p"})), (5, None),
            (6, json.dumps({"reviewId": "r6", "placeId": None, "text": "t"}))]
    df = spark.createDataFrame(rows, "seq long, raw_json string")
    a = RAW.parse_json_column(df, "raw_json", K.RAW_REVIEW)
    b = RAW.parse_json_column(df, "raw_json", K.RAW_REVIEW, once=True)
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    keep = F.coalesce(F.col("reviewId"), F.lit("")) != ""
    fa, fb = a.filter(keep).select("seq", "stars"), b.filter(keep).select("seq", "stars")
    assert sorted(fa.collect()) == sorted(fb.collect())
    # the filter stays above the single parse instead of parsing again below it
    plan = fb._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_conform_and_flatten(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("k", T.StringType(), False), T.StructField("n", T.IntegerType(), True)])
    df = spark.createDataFrame([("a", "1"), (None, "2"), ("long-key", "x")], "k string, n string")
    good, bad = RAW.conform(df, schema, max_len={"k": 3})
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert sorted(tuple(r["_errors"]) for r in bad.collect()) == [("null:k",), ("too_long:k",)]
    nested = spark.createDataFrame([(1, (2.0, (3,)))], "id int, loc struct<lat double, deep struct<x int>>")
    assert RAW.flatten_nested(nested).columns == ["id", "loc.lat", "loc.deep.x"]


def test_rollups_and_top_k_under_a_hot_place(spark):
    """One place holds a third of all reviews: results equal brute force."""
    import pandas as pd
    rnd = random.Random(17)
    rows = []
    for i in range(900):
        place = "hot" if i % 3 == 0 else f"p{rnd.randint(0, 40)}"
        rows.append((f"r{i:04d}", place, rnd.choice([1, 2, 3]), f"text {i}",
                     T0 + timedelta(hours=rnd.randint(0, 500)), f"u{i}",
                     rnd.choice([None, "  ", f"reply {i}"])))
    schema = ("review_id string, place_id string, stars int, review_text string, "
              "published_at timestamp_ntz, review_url string, owner_reply string")
    df = spark.createDataFrame(rows, schema).repartition(8)
    got = {r["place_id"]: r for r in review_rollup(df).collect()}
    pdf = pd.DataFrame(rows, columns=["review_id", "place_id", "stars", "review_text", "published_at",
                                      "review_url", "owner_reply"])
    low = pdf[pdf.stars <= 2]
    for place, g in low.groupby("place_id"):
        r = got[place]
        assert r["review_rows"] == len(g)
        assert r["owner_reply_rows"] == g.owner_reply.notna().sum()
        first = g.sort_values(["stars", "published_at", "review_id"], ascending=[True, False, True]).iloc[0]
        assert r["drama_stars"] == first.stars and r["latest_review_url"] == first.review_url
    w = df.filter(F.col("stars") <= 2).select("place_id", "review_id", "published_at")
    top = O.distinct_on(w, ["place_id"], [F.col("published_at").desc(), F.col("review_id").asc()])
    want = low.sort_values(["published_at", "review_id"], ascending=[False, True]).groupby("place_id").head(1)
    assert sorted(r["review_id"] for r in top.collect()) == sorted(want.review_id)


def test_page_clamps_to_last_and_missing_parents(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    last, total = O.page(df, ["k"], page_no=9, size=3, clamp_to_last=True)
    assert [r["k"] for r in last.collect()] == [9]
    mid, _ = O.page(df, ["k"], page_no=2, size=3, clamp_to_last=True)
    assert [r["k"] for r in mid.collect()] == [3, 4, 5]
    child = spark.createDataFrame([("a",), ("b",), ("z",)], "place_id string")
    parent = spark.createDataFrame([("a",), ("b",)], "place_id string")
    missing = D.missing_parents(child, parent)
    assert [r[0] for r in missing.collect()] == ["z"]
    with pytest.raises(ValueError, match="z"):
        D.assert_no_missing(missing)
    D.assert_no_missing(D.missing_parents(parent, child))


def test_clamped_page_is_the_rest_and_keeps_no_copy(spark):
    import itertools
    rows_ = [(i, v) for i, v in enumerate([3, None, 1, 3, 2, None, 1])]
    df = spark.createDataFrame(rows_, "k long, v int")
    for way, nulls in itertools.product(("asc", "desc"), ("nulls_first", "nulls_last")):
        order = [("v", way, nulls), "k"]
        whole = [tuple(r) for r in df.orderBy(*O._order_cols(order)).collect()]
        for size in (1, 2, 3, 7, 9):
            pages = [whole[i:i + size] for i in range(0, len(whole), size)]
            for n in (1, 2, 3, 50):
                got, _ = O.page(df, order, n, size, max_size=None, clamp_to_last=True)
                assert [tuple(r) for r in got.collect()] == pages[min(n, len(pages)) - 1]
    assert O.page(df.filter("k < 0"), ["k"], 2, 3, clamp_to_last=True)[0].collect() == []
    plan = O.page(spark.range(1000), ["id"], 300, 3, clamp_to_last=True)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2
    with pytest.raises(ValueError, match="names"):
        O.page(df, [F.col("k").desc()], 9, 3, clamp_to_last=True)


def test_offsets_run_over_blocks(spark, monkeypatch):
    from reviewops.operators import batching
    monkeypatch.setattr(batching, "_BLOCK", 3)
    counts = [(i, (i * 7) % 5) for i in range(40) if i % 6]
    got = batching.running_offsets(spark.createDataFrame(counts, "_part long, _n long"), 40).collect()
    assert {r["_part"]: r["_off"] for r in got} == {p: sum(n for q, n in counts if q < p) for p, _ in counts}
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("lim"), F.lit("x" * 10).alias("wide"))
    out = batching.batches(df, [F.col("lim").desc(), "k"], 30, "k", {"m": F.max("lim")}, partitions=17, of=["lim"]).orderBy("batch_index").collect()
    want = sorted(range(500), key=lambda i: (-(i % 7), i))
    assert [r["ks"] for r in out] == [want[i:i + 30] for i in range(0, 500, 30)] and [r["m"] for r in out][:3] == [6, 6, 6]
    index = batching.global_index(df, ["k"], 17, keep=["k"])
    assert index.columns == ["k", "row_index"] and "wide" not in index._jdf.queryExecution().toString()


def test_random_case_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    one = [r["k"] for r in O.random_case(df, "k", 5, seed=3).collect()]
    assert one == [r["k"] for r in O.random_case(df.repartition(9), "k", 5, seed=3).collect()] != [r["k"] for r in O.random_case(df, "k", 5, seed=4).collect()]


def test_log_fits_its_schema(spark):
    from reviewops.operators.oplog import log_rows
    good, bad = RAW.conform(log_rows(spark.range(3), "p", "success", started=F.current_timestamp()), K.EXECUTION_LOG)
    assert good.count() == good.select("id").distinct().count() == 3 and bad.count() == 0


def test_resume_picks_failed_rows_again(spark):
    from reviewops.operators.joins import resume_anti
    reviews = spark.createDataFrame([("a", "p", "t", "r"), ("b", "p", "t", "r"), ("c", "p", "t", "r")],
                                    "review_id string, place_id string, review_text string, owner_reply string")
    done = spark.createDataFrame([("a", "ok"), ("b", "failed: timeout")], "review_id string, status string")
    assert sorted(r["review_id"] for r in resume_anti(reviews, done).collect()) == ["b", "c"]


def test_nearest_place_answers_every_point(spark):
    from reviewops.operators.joins import nearest_place
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, -80.0, 170.0)], "point_id long, lat double, lng double")
    places = spark.createDataFrame([("x", 10.0, 10.5), ("y", 60.0, -170.0)], "place_id string, lat double, lng double")
    for cell in (0.001, 0.5):
        got = {r["point_id"]: r["place_id"] for r in nearest_place(pts, places, cell=cell, levels=3).collect()}
        assert got == {1: "x", 2: "x"}


def test_merge_columns_counts_a_repeated_key_once(spark):
    from reviewops.operators.merge import merge_columns
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    source = spark.createDataFrame([("a", 2), ("a", 3)], "k string, v int")
    assert [tuple(r) for r in merge_columns(target, source, ["k"], ["v"], order=["v"]).collect()] == [("a", 3)]


def test_salvage_logs_each_run(spark):
    from reviewops.operators.ingest import salvage_ingest
    rows = [(i, json.dumps({"reviewId": f"r{i}", "placeId": "p", "stars": 1, "text": "cold soup"}), d)
            for i, d in enumerate(["d1", "d1", "d2", "d3"])]
    raw = RAW.parse_json_column(spark.createDataFrame(rows, "seq long, raw_json string, dataset_id string"), "raw_json", K.RAW_REVIEW, once=True)
    runs = spark.createDataFrame([("a", "d1", "SUCCEEDED"), ("b", "d2", "FAILED"), ("c", "d4", "SUCCEEDED"), ("e", None, "SUCCEEDED")],
                                 "run_id string, dataset_id string, status string")
    state = spark.createDataFrame([], K.REVIEW)
    places = spark.createDataFrame([("p", False)], "place_id string, skip_review_fetch boolean")
    log = salvage_ingest(runs, raw, state, places, "2026-01-01 00:00:00").log
    assert sorted((r["run_id"], r["dataset_id"], r["status"], r["items_count"]) for r in log.collect()) == [
        ("a", "d1", "success", 2), ("c", "d4", "success", 0)]
