"""Queries: filters, joins, ordering, set operations (C*, D*, F*, G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewops.bindings import NOW
from reviewops.functions.text import district
from reviewops.operators import filters as C
from reviewops.operators import joins as D
from reviewops.operators import ordering as O
from reviewops.operators import setops as G
from reviewops.operators.batching import batches, recheck_batches
from reviewops.operators.recheck import due_by_place, due_rechecks
from reviewops.operators.rollups import max_positive
from reviewops.functions.scores import fetch_limit
from reviewops.plans.queries_sources import parsed_ev
from reviewops.plans.registry import query
from reviewops.plans.sqltext import IN_CITY, district as sql_district, py_nonblank, sql_nonblank, strip

SCORED_SQL = f"""SELECT r.*, a.review_score, a.owner_score, a.review_sentiment, a.owner_sentiment,
  a.review_summary, a.owner_summary, a.pr_reply
FROM rv r JOIN ai a ON a.review_id = r.review_id
WHERE r.stars <= 2 AND {sql_nonblank('r.owner_reply')}
  AND a.review_score IS NOT NULL AND a.owner_score IS NOT NULL"""

# ---------------------------------------------------------------- C filters


@query("valid_ids", """
SELECT seq, CASE WHEN coalesce(json_extract_string(raw_json, '$.reviewId'), '') = '' THEN 'missing_reviewId'
  WHEN coalesce(json_extract_string(raw_json, '$.placeId'), '') = '' THEN 'missing_placeId' ELSE 'ok' END AS reason
FROM ev""", ("ev",))
def q_valid_ids(v):
    return C.valid_ids(parsed_ev(v), ("reviewId", "placeId"), reason_col="reason").select("seq", "reason")


@query("low_star", "SELECT review_id, stars FROM rv WHERE stars IN (1, 2)", ("rv",))
def q_low_star(v):
    return C.low_star(v["rv"]).select("review_id", "stars")


@query("min_text_len", f"SELECT doc_id, lang FROM documents WHERE length({strip('coalesce(text, %s)' % repr(''))}) >= 2")
def q_min_text_len(v):
    return C.min_text_len(v["dc"], "text").select("doc_id", "lang")


@query("classify_review", f"""
SELECT review_id, CASE WHEN coalesce(review_id, '') = '' THEN 'missing_review_id'
  WHEN coalesce(place_id, '') = '' THEN 'missing_place_id'
  WHEN coalesce(stars, 0) NOT IN (1, 2) THEN 'not_low_star_review'
  WHEN length({strip("coalesce(review_text, '')")}) < 2 THEN 'empty_review_text'
  WHEN NOT {py_nonblank('owner_reply')} THEN 'needs_owner_recheck' ELSE 'ok' END AS reason
FROM rv""", ("rv",))
def q_classify_review(v):
    return C.classify_review(v["rv"]).select("review_id", "reason")


@query("contested_places", """
SELECT place_id FROM st
WHERE coalesce(reviews_count, 0) >= 30
  AND (google_score <= 4.3 OR (CASE WHEN coalesce(reviews_count, 0) > 0
       THEN CAST(coalesce(one_star, 0) AS DOUBLE) / reviews_count ELSE 0.0 END) >= 0.1)
  AND NOT (coalesce(permanently_closed, false) OR coalesce(temporarily_closed, false))""", ("st",))
def q_contested_places(v):
    return C.contested_places(v["st"]).select("place_id")


@query("drop_null_title", "SELECT place_id, title FROM st WHERE title IS NOT NULL", ("st",))
def q_drop_null_title(v):
    return C.drop_null(v["st"], ["title"]).select("place_id", "title")


BRANDS = ("Customer#0000001", "Customer#00000077", "(Customer#00000088)", "Customer#000000.1")


@query("brand_exclusion", """
SELECT place_id, coalesce(contains(title, 'Customer#0000001') OR contains(title, 'Customer#00000077')
  OR contains(title, '(Customer#00000088)') OR contains(title, 'Customer#000000.1'), false) AS skip_review_fetch
FROM st""", ("st",))
def q_brand_exclusion(v):
    return C.flag_brands(v["st"], "title", BRANDS).select("place_id", "skip_review_fetch")


@query("eligible_places", """
SELECT place_id, one_star, two_star, reviews_count, skip_review_fetch FROM st
WHERE NOT blocked AND NOT skip_review_fetch""", ("st",))
def q_eligible_places(v):
    return C.eligible_places(v["st"])


@query("due_rechecks", f"""
SELECT r.review_id, r.place_id, r.published_at, r.owner_reply, r.owner_reply_recheck, r.next_check_at
FROM rv r JOIN st s ON s.place_id = r.place_id
WHERE NOT s.blocked AND NOT s.skip_review_fetch AND r.owner_reply_recheck
  AND r.next_check_at IS NOT NULL AND r.next_check_at <= TIMESTAMP '{NOW}'""", ("rv", "st"))
def q_due_rechecks(v):
    return due_rechecks(v["rv"], v["st"], NOW)


@query("region_filter", f"SELECT place_id, address FROM st s WHERE {IN_CITY}", ("st",))
def q_region_filter(v):
    return C.region_filter(v["st"]).select("place_id", "address")


@query("geo_box", "SELECT place_id, lat, lng FROM st WHERE lat BETWEEN 24.8 AND 25.3 AND lng BETWEEN 121.2 AND 122.0",
       ("st",))
def q_geo_box(v):
    return C.geo_box(v["st"]).select("place_id", "lat", "lng")


@query("has_reply", f"SELECT review_id FROM rv WHERE stars <= 2 AND {sql_nonblank('owner_reply')}", ("rv",))
def q_has_reply(v):
    return C.has_reply(v["rv"]).select("review_id")


@query("search_places", f"""
SELECT place_id, title AS name, address, district FROM (SELECT *, {sql_district('address')} AS district FROM st) s
WHERE (coalesce(regexp_matches(title, '(?i)customer#00000[1-3]'), false)
       OR coalesce(regexp_matches(address, '(?i)customer#00000[1-3]'), false))
  AND district = '大安區'""", ("st",))
def q_search_places(v):
    st = v["st"].select("place_id", F.col("title").alias("name"), "address",
                        district("address").alias("district"))
    return C.search_places(st, keyword="customer#00000[1-3]", district="大安區")


@query("scored_case", f"SELECT review_id, place_id, review_score, owner_score FROM ({SCORED_SQL}) c",
       ("rv", "ai"))
def q_scored_case(v):
    return C.scored_cases(v["rv"], v["ai"]).select("review_id", "place_id", "review_score", "owner_score")


@query("has_scores", f"""
SELECT r.review_id,
  (coalesce(CAST(a.review_score AS DOUBLE), 0) > 0 OR coalesce(CAST(a.owner_score AS DOUBLE), 0) > 0
   OR {py_nonblank('a.review_sentiment')} OR {py_nonblank('a.owner_sentiment')} OR {py_nonblank('a.pr_reply')}) AS has_ai
FROM rv r LEFT JOIN ai a ON a.review_id = r.review_id""", ("rv", "ai"))
def q_has_scores(v):
    a = v["ai"].drop("place_id")
    j = v["rv"].select("review_id").join(a, "review_id", "left")
    return C.with_has_scores(j).select("review_id", "has_ai")


@query("analysis_window", f"""
SELECT review_id FROM rv WHERE owner_reply IS NOT NULL AND owner_reply <> ''
  AND scraped_at > TIMESTAMP '{NOW}' - INTERVAL 1 DAY""", ("rv",))
def q_analysis_window(v):
    return C.analysis_window(v["rv"], NOW).select("review_id")


@query("min_intensity_cases", f"""
SELECT review_id, (review_score + owner_score) / 2.0 AS intensity FROM ({SCORED_SQL}) c
WHERE (review_score + owner_score) / 2.0 >= 7""", ("rv", "ai"))
def q_min_intensity_cases(v):
    return C.min_intensity_cases(C.scored_cases(v["rv"], v["ai"]), 7).select("review_id", "intensity")

# ------------------------------------------------------------------ D joins


@query("recheck_join", """
SELECT r.review_id, r.place_id FROM rv r JOIN st s ON s.place_id = r.place_id
WHERE NOT s.blocked AND NOT s.skip_review_fetch""", ("rv", "st"))
def q_recheck_join(v):
    return D.recheck_join(v["rv"], v["st"]).select("review_id", "place_id")


@query("reviews_with_scores", """
SELECT review_id, place_id, review_text, stars, review_url, published_at, likes_count, owner_reply,
  guest_score, owner_score, guest_sentiment, owner_sentiment, guest_summary, owner_summary, pr_reply FROM (
  SELECT r.review_id, r.place_id, r.review_text, r.stars, r.review_url, r.published_at, r.likes_count, r.owner_reply,
    coalesce(a.review_score, 0) AS guest_score, coalesce(a.owner_score, 0) AS owner_score,
    coalesce(a.review_sentiment, '') AS guest_sentiment, coalesce(a.owner_sentiment, '') AS owner_sentiment,
    coalesce(a.review_summary, '') AS guest_summary, coalesce(a.owner_summary, '') AS owner_summary,
    coalesce(a.pr_reply, '') AS pr_reply,
    row_number() OVER (PARTITION BY r.place_id ORDER BY r.stars ASC NULLS LAST, r.published_at DESC NULLS LAST,
                       r.review_id) AS rn
  FROM rv r LEFT JOIN ai a ON a.review_id = r.review_id WHERE r.stars <= 2) t
WHERE rn <= 5""", ("rv", "ai"))
def q_reviews_with_scores(v):
    return D.reviews_with_scores(v["rv"], v["ai"], limit=5)


CASE_INV_SQL = f"""SELECT s.place_id AS store_id, s.title AS store_name, s.address, c.review_id,
  c.review_score AS guest_score, c.owner_score, (c.review_score + c.owner_score) / 2.0 AS intensity,
  {sql_district('s.address')} AS district, c.published_at
FROM st s JOIN ({SCORED_SQL}) c ON c.place_id = s.place_id
WHERE NOT s.blocked AND {IN_CITY}"""


@query("case_inventory", CASE_INV_SQL, ("st", "rv", "ai"))
def q_case_inventory(v):
    return D.case_inventory(v["st"], v["rv"], v["ai"])


@query("allowed_places", """
SELECT review_id FROM rv WHERE place_id IN (SELECT place_id FROM st WHERE NOT blocked AND NOT skip_review_fetch)""",
       ("rv", "st"))
def q_allowed_places(v):
    return D.allowed_places(v["rv"], D.eligible(v["st"])).select("review_id")


@query("resume_anti", """
SELECT review_id, place_id, review_text, owner_reply FROM rv
WHERE owner_reply IS NOT NULL AND owner_reply <> '' AND review_id NOT IN (SELECT review_id FROM ai)""", ("rv", "ai"))
def q_resume_anti(v):
    return D.resume_anti(v["rv"], v["ai"])


@query("orphan_runs", """
SELECT e.pipeline, e.run_id, strftime(e.started_at, '%m-%d %H:%M') AS started, e.started_at
FROM lg e WHERE e.status = 'started' AND e.run_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM lg s WHERE s.status = 'success' AND s.run_id = e.run_id)""", ("lg",))
def q_orphan_runs(v):
    return D.orphan_runs(v["lg"])


@query("missing_parents", """
SELECT DISTINCT place_id FROM rv WHERE place_id IS NOT NULL
  AND place_id NOT IN (SELECT place_id FROM st WHERE NOT blocked AND NOT skip_review_fetch)""", ("rv", "st"))
def q_missing_parents(v):
    return D.missing_parents(v["rv"], D.eligible(v["st"]))


@query("scorer_completeness", """
, req AS (SELECT review_id, place_id FROM rv WHERE CAST(substr(review_id, 2) AS BIGINT) % 7 <> 0),
  resp AS (SELECT review_id, count(*) AS answers FROM
    (SELECT review_id FROM ai UNION ALL SELECT review_id FROM ai WHERE CAST(substr(review_id, 2) AS BIGINT) % 11 = 0) x
    GROUP BY review_id)
SELECT coalesce(req.review_id, resp.review_id) AS review_id,
  CASE WHEN req.review_id IS NULL THEN 'unknown' WHEN resp.answers IS NULL THEN 'missing'
       WHEN resp.answers > 1 THEN 'duplicate' ELSE 'ok' END AS status,
  coalesce(resp.answers, 0) AS answers
FROM req FULL JOIN resp ON req.review_id = resp.review_id""", ("rv", "ai"))
def q_scorer_completeness(v):
    req = v["rv"].filter(F.substring("review_id", 2, 20).cast("long") % 7 != 0).select("review_id", "place_id")
    a = v["ai"].select("review_id", "review_score")
    resp = a.unionByName(a.filter(F.substring("review_id", 2, 20).cast("long") % 11 == 0))
    return D.scorer_completeness(req, resp).select("review_id", "status", "answers")


POINTS_SQL = """SELECT o_orderkey AS point_id, 24.7 + CAST(o_orderkey % 997 AS DOUBLE) / 1000.0 AS lat,
  121.1 + CAST(o_custkey % 1009 AS DOUBLE) / 1000.0 AS lng FROM orders"""


@query("nearest_place", f"""
, pts AS ({POINTS_SQL})
SELECT point_id, place_id, distance2 FROM (
  SELECT p.point_id, s.place_id, (p.lat - s.lat) * (p.lat - s.lat) + (p.lng - s.lng) * (p.lng - s.lng) AS distance2,
    row_number() OVER (PARTITION BY p.point_id ORDER BY (p.lat - s.lat) * (p.lat - s.lat) + (p.lng - s.lng) * (p.lng - s.lng),
                       s.place_id) AS rn
  FROM pts p, st s) t WHERE rn = 1""", ("st",))
def q_nearest_place(v):
    pts = v["st"].sparkSession.sql(POINTS_SQL)
    return D.nearest_place(pts, v["st"])


@query("attach_max_score", """
SELECT s.place_id, s.title, m.max_owner_score FROM st s
LEFT JOIN (SELECT place_id, CAST(max(owner_score) AS DOUBLE) AS max_owner_score FROM ai WHERE owner_score > 0
           GROUP BY place_id) m ON m.place_id = s.place_id""", ("st", "ai"))
def q_attach_max_score(v):
    st = v["st"].select("place_id", "title", F.lit(None).cast("double").alias("max_owner_score"))
    return D.attach(st, max_positive(v["ai"]), "place_id", "max_owner_score")


@query("outer_counts", f"""
, a AS (SELECT {sql_district('address')} AS district, count(*) AS places FROM st s WHERE {IN_CITY} AND reviews_count > 200
        GROUP BY 1),
  b AS (SELECT {sql_district('s.address')} AS district, count(*) AS reviews FROM rv r JOIN st s ON s.place_id = r.place_id
        WHERE r.stars = 1 AND NOT {IN_CITY} GROUP BY 1)
SELECT coalesce(a.district, b.district) AS district, coalesce(a.places, 0) AS places, coalesce(b.reviews, 0) AS reviews
FROM a FULL JOIN b ON a.district = b.district""", ("st", "rv"))
def q_outer_counts(v):
    st = v["st"].withColumn("district", district("address"))
    a = (st.filter(D.in_city_col() & (F.col("reviews_count") > 200)).groupBy("district")
         .agg(F.count(F.lit(1)).alias("places")))
    b = (v["rv"].filter(F.col("stars") == 1).join(st.filter(~D.in_city_col()).select("place_id", "district"),
                                                   "place_id")
         .groupBy("district").agg(F.count(F.lit(1)).alias("reviews")))
    return D.outer_counts(a, b, "district", {"places": 0, "reviews": 0})

# ----------------------------------------------------- F ordering / batching


@query("distinct_on", f"""
SELECT place_id, review_id, stars, published_at FROM (
  SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY stars ASC NULLS LAST,
    published_at DESC NULLS LAST, review_id) AS rn
  FROM rv WHERE stars <= 2 AND {sql_nonblank('owner_reply')}) t WHERE rn = 1""", ("rv",))
def q_distinct_on(v):
    r = C.has_reply(v["rv"])
    return O.distinct_on(r, ["place_id"], [F.col("stars").asc_nulls_last(), F.col("published_at").desc_nulls_last(),
                                            F.col("review_id").asc()]).select("place_id", "review_id", "stars",
                                                                               "published_at")


@query("dedupe_first", """
SELECT json_extract_string(raw_json, '$.reviewId') AS reviewId, arg_min(seq, seq) AS seq,
  arg_min(json_extract_string(raw_json, '$.stars'), seq) AS stars
FROM ev WHERE coalesce(json_extract_string(raw_json, '$.reviewId'), '') <> '' GROUP BY 1""", ("ev",))
def q_dedupe_first(v):
    return O.dedupe_first(parsed_ev(v).select("reviewId", "seq", "stars"), ["reviewId"], "seq")


@query("last_wins", """
SELECT json_extract_string(raw_json, '$.reviewId') AS reviewId, arg_max(seq, seq) AS seq,
  arg_max(json_extract_string(raw_json, '$.stars'), seq) AS stars
FROM ev WHERE coalesce(json_extract_string(raw_json, '$.reviewId'), '') <> '' GROUP BY 1""", ("ev",))
def q_last_wins(v):
    return O.last_wins(parsed_ev(v).select("reviewId", "seq", "stars"), ["reviewId"], "seq")


@query("top_daily", """
SELECT a.review_id, a.review_score, a.owner_score, r.review_url FROM ai a JOIN rv r ON r.review_id = a.review_id
WHERE r.scraped_at >= TIMESTAMP '1998-05-31 00:00:00'
ORDER BY a.review_score + a.owner_score DESC, a.review_id LIMIT 1""", ("ai", "rv"))
def q_top_daily(v):
    return O.top_daily(v["rv"], v["ai"], NOW).select("review_id", "review_score", "owner_score", "review_url")


@query("top_cases_per_place", f"""
SELECT review_id, place_id, review_score AS guest_score, owner_score, intensity, rn AS rank FROM (
  SELECT *, (review_score + owner_score) / 2.0 AS intensity,
    row_number() OVER (PARTITION BY place_id ORDER BY (review_score + owner_score) / 2.0 DESC NULLS LAST,
                       published_at DESC NULLS LAST, review_id) AS rn
  FROM ({SCORED_SQL}) c) t WHERE rn <= 3""", ("rv", "ai"))
def q_top_cases_per_place(v):
    return O.top_cases_per_place(v["rv"], v["ai"], k=3).select(
        "review_id", "place_id", "guest_score", "owner_score", "intensity", "rank")


@query("reply_examples", f"""
SELECT a.review_id, s.title AS store_name, a.pr_reply, a.review_score AS guest_score, a.owner_score
FROM ai a JOIN rv r ON r.review_id = a.review_id JOIN st s ON s.place_id = a.place_id
WHERE NOT s.blocked AND {IN_CITY} AND {sql_nonblank('a.pr_reply')} AND r.stars <= 2
ORDER BY greatest(a.review_score, a.owner_score) DESC, a.review_id LIMIT 100""", ("ai", "rv", "st"))
def q_reply_examples(v):
    return O.reply_examples(v["st"], v["rv"], v["ai"], 100).select(
        "review_id", "store_name", "pr_reply", "guest_score", "owner_score")


@query("page", f"""
SELECT review_id, place_id, published_at FROM rv WHERE stars <= 2 AND {sql_nonblank('owner_reply')}
ORDER BY published_at DESC NULLS LAST, review_id LIMIT 3 OFFSET 6""", ("rv",))
def q_page(v):
    pg, _total = O.page(C.has_reply(v["rv"]), [F.col("published_at").desc_nulls_last(), F.col("review_id").asc()],
                        page_no=3, size=3)
    return pg.select("review_id", "place_id", "published_at")


@query("page_total", f"SELECT count(*) AS total FROM rv WHERE stars <= 2 AND {sql_nonblank('owner_reply')}", ("rv",))
def q_page_total(v):
    return O.page(C.has_reply(v["rv"]), ["review_id"], 1, 3)[1]


@query("latest_runs", """
SELECT id, pipeline, status, items_count, run_id, strftime(started_at, '%m-%d %H:%M') AS started
FROM lg ORDER BY id DESC LIMIT 15""", ("lg",))
def q_latest_runs(v):
    return O.latest_runs(v["lg"], 15)


@query("random_case", """
SELECT place_id, title FROM st ORDER BY md5(concat('11:', place_id)), place_id LIMIT 1""", ("st",))
def q_random_case(v):
    return O.random_case(v["st"].select("place_id", "title"), "place_id", 1, seed=11)


@query("batches", """
SELECT CAST(floor((rn - 1) / 50) AS BIGINT) AS batch_index, list(place_id ORDER BY rn) AS place_ids,
  max(lim) AS max_reviews FROM (
  SELECT place_id, coalesce(one_star, 0) + coalesce(two_star, 0) + 50 AS lim,
    row_number() OVER (ORDER BY coalesce(one_star, 0) + coalesce(two_star, 0) + 50 DESC, place_id) AS rn
  FROM st WHERE NOT blocked AND NOT skip_review_fetch) t GROUP BY 1""", ("st",))
def q_batches(v):
    e = C.eligible_places(v["st"]).withColumn("lim", fetch_limit("one_star", "two_star"))
    return batches(e, [F.col("lim").desc(), F.col("place_id").asc()], 50, "place_id",
                   {"max_reviews": F.max("lim")}, of=["lim"])


@query("recheck_batches", f"""
, due AS (SELECT r.review_id, r.place_id FROM rv r JOIN st s ON s.place_id = r.place_id
          WHERE NOT s.blocked AND NOT s.skip_review_fetch AND r.owner_reply_recheck
            AND r.next_check_at IS NOT NULL AND r.next_check_at <= TIMESTAMP '{NOW}'),
  p AS (SELECT place_id, CAST(floor((row_number() OVER (ORDER BY place_id) - 1) / 50) AS BIGINT) AS batch_index
        FROM (SELECT DISTINCT place_id FROM due) d)
SELECT due.review_id, due.place_id, p.batch_index FROM due JOIN p ON p.place_id = due.place_id""", ("rv", "st"))
def q_recheck_batches(v):
    due = due_rechecks(v["rv"], v["st"], NOW)
    _b, reviews = recheck_batches(due, D.eligible(v["st"]))
    return reviews.select("review_id", "place_id", "batch_index")


@query("recheck_batch_places", f"""
, p AS (SELECT place_id, CAST(floor((row_number() OVER (ORDER BY place_id) - 1) / 50) AS BIGINT) AS batch_index
        FROM (SELECT DISTINCT r.place_id FROM rv r JOIN st s ON s.place_id = r.place_id
              WHERE NOT s.blocked AND NOT s.skip_review_fetch AND r.owner_reply_recheck
                AND r.next_check_at IS NOT NULL AND r.next_check_at <= TIMESTAMP '{NOW}') d)
SELECT batch_index, list(place_id ORDER BY place_id) AS place_ids FROM p GROUP BY batch_index""", ("rv", "st"))
def q_recheck_batch_places(v):
    return recheck_batches(due_rechecks(v["rv"], v["st"], NOW), D.eligible(v["st"]))[0]


@query("due_by_place", f"""
, due AS (SELECT r.review_id, r.place_id FROM rv r JOIN st s ON s.place_id = r.place_id
          WHERE NOT s.blocked AND NOT s.skip_review_fetch AND r.owner_reply_recheck
            AND r.next_check_at IS NOT NULL AND r.next_check_at <= TIMESTAMP '{NOW}')
SELECT place_id, review_id, count(*) OVER (PARTITION BY place_id) AS due_count FROM due""", ("rv", "st"))
def q_due_by_place(v):
    due = due_rechecks(v["rv"], v["st"], NOW)
    return due_by_place(due, D.eligible(v["st"])).select("place_id", "review_id", "due_count")

# ------------------------------------------------------------- G set ops


@query("table_counts", """
SELECT 'store' AS "table", count(*) AS "rows" FROM st WHERE title IS NOT NULL UNION ALL SELECT 'store_source', count(*) FROM st
UNION ALL SELECT 'review', count(*) FROM rv
UNION ALL SELECT 'review_source', count(DISTINCT json_extract_string(raw_json, '$.reviewId')) FROM ev
UNION ALL SELECT 'ai_analysis', count(*) FROM ai UNION ALL SELECT 'execution_log', count(*) FROM lg""",
       ("st", "rv", "ai", "lg", "ev"))
def q_table_counts(v):
    # the landed raw rows: places as they came, reviews one per id
    landed = v["ev"].select(F.get_json_object("raw_json", "$.reviewId").alias("review_id")).filter("review_id IS NOT NULL").distinct()
    return G.table_counts({"store": C.drop_null(v["st"]), "store_source": v["st"], "review": v["rv"], "review_source": landed,
                           "ai_analysis": v["ai"], "execution_log": v["lg"]})


@query("ingested_run_ids", "SELECT DISTINCT run_id FROM lg WHERE status = 'success' AND run_id IS NOT NULL", ("lg",))
def q_ingested_run_ids(v):
    return G.ingested_run_ids(v["lg"])


@query("ordered_union_ids", """
, e AS (SELECT run_id, 0 AS src, id AS pos FROM lg WHERE status = 'failed' AND run_id IS NOT NULL),
  f AS (SELECT run_id, 1 AS src, id AS pos FROM lg WHERE status = 'success' AND run_id IS NOT NULL),
  u AS (SELECT * FROM e UNION ALL SELECT * FROM f)
SELECT run_id, arg_min(src, (src, pos)) AS _src, arg_min(pos, (src, pos)) AS pos FROM u GROUP BY run_id""", ("lg",))
def q_ordered_union_ids(v):
    lg = v["lg"]
    e = lg.filter((F.col("status") == "failed") & F.col("run_id").isNotNull()).select("run_id", F.col("id").alias("pos"))
    f = lg.filter((F.col("status") == "success") & F.col("run_id").isNotNull()).select("run_id", F.col("id").alias("pos"))
    return G.ordered_union_ids(e, f)


@query("missing_ids", "SELECT DISTINCT place_id FROM rv WHERE place_id NOT IN (SELECT place_id FROM st WHERE title IS NOT NULL)",
       ("rv", "st"))
def q_missing_ids(v):
    return G.missing_ids(v["rv"], v["st"].filter(F.col("title").isNotNull()))
