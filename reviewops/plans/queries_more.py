"""Queries: normalised board, KPIs and aggregates, expressions, upserts,
run log and scoring (B14, C16, D5, D11, E*, F4, F5, H*, I*, K*, A5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions import scores as S
from reviewops.functions import text as X
from reviewops.operators import aggregates as E
from reviewops.operators import filters as C
from reviewops.operators import joins as D
from reviewops.operators import ordering as O
from reviewops.operators.rollups import intensity_board, max_positive, place_board
from reviewops.plans.queries_board import BOARD_STEPS
from reviewops.plans.queries_ops import CASE_INV_SQL, SCORED_SQL
from reviewops.plans.queries_sources import parsed_ev
from reviewops.plans.registry import query
from reviewops.plans.sqltext import IN_CITY, PY_WS, district, has_scores, py_nonblank, strip
from reviewops.sources.rows import normalise_places


def short_name_sql(x: str, limit: int = K.DISPLAY_NAME_LIMIT) -> str:
    t = strip(f"coalesce({x}, '')")
    cand = t
    for sep in K.DISPLAY_NAME_SEPARATORS:
        cand = strip(f"split_part({cand}, '{sep}', 1)")
    cut = f"concat(regexp_replace(substr({t}, 1, {limit}), '{PY_WS}+$', ''), '…')"
    return (f"CASE WHEN length({t}) <= {limit} THEN {t} WHEN length({cand}) > 0 AND length({cand}) <= {limit} "
            f"THEN {cand} ELSE {cut} END")


BOARD_SQL = BOARD_STEPS + f""",
mx AS (SELECT place_id AS store_id, CAST(max(owner_score) AS DOUBLE) AS max_owner_score FROM ai WHERE owner_score > 0
       GROUP BY place_id),
nb0 AS (
  SELECT coalesce(store_id, '') AS store_id, coalesce(name, '') AS name, coalesce(category, '') AS category,
    coalesce(address, '') AS address, coalesce(store_url, '') AS store_url, review_text, owner_reply, pr_reply,
    review_url, review_sentiment, owner_sentiment,
    CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng, CAST(google_score AS DOUBLE) AS google_score,
    CAST(reviews AS DOUBLE) AS reviews, CAST(db_review_count AS DOUBLE) AS db_review_count,
    CAST(owner_replies AS DOUBLE) AS owner_replies, CAST(drama_stars AS DOUBLE) AS drama_stars,
    CAST(review_score AS DOUBLE) AS review_score, CAST(owner_score AS DOUBLE) AS owner_score
  FROM board WHERE lat BETWEEN 24.8 AND 25.3 AND lng BETWEEN 121.2 AND 122.0),
nb AS (
  SELECT nb0.*, {district('address')} AS district, {short_name_sql('name')} AS display_name,
    {has_scores('review_score', 'owner_score', 'review_sentiment', 'owner_sentiment', 'pr_reply')} AS has_ai,
    CASE WHEN {has_scores('review_score', 'owner_score', 'review_sentiment', 'owner_sentiment', 'pr_reply')}
      THEN (review_score + owner_score) / 2.0 END AS intensity,
    CASE WHEN coalesce(db_review_count, 0) > 0 THEN coalesce(owner_replies, 0) / db_review_count * 100.0 ELSE 0.0 END
      AS reply_rate,
    mx.max_owner_score
  FROM nb0 LEFT JOIN mx ON mx.store_id = nb0.store_id),
vis AS (SELECT * FROM nb WHERE coalesce(owner_replies, 0) > 0 AND has_ai AND intensity IS NOT NULL),
inv AS ({CASE_INV_SQL})"""

BOARD_VIEWS = ("st", "rv", "ai")


def normalised(v):
    """B14 + D6: the whole board (no top-k cut), normalised, with the best
    positive owner score attached."""
    board = normalise_places(place_board(v["st"], v["rv"], v["ai"], limit=None))
    mx = max_positive(v["ai"]).withColumnRenamed("place_id", "store_id")
    return D.attach(board, mx, "store_id", "max_owner_score")


def visible(v):
    return C.visible_places(normalised(v))


NB_COLS = ("store_id", "name", "district", "display_name", "has_ai", "intensity", "reply_rate", "db_review_count",
           "max_owner_score", "lat")


@query("normalise_frame", BOARD_SQL + f"\nSELECT {', '.join(NB_COLS)} FROM nb", BOARD_VIEWS)
def q_normalise_frame(v):
    return normalised(v).select(*NB_COLS)


@query("visible_places", BOARD_SQL + "\nSELECT store_id, intensity FROM vis", BOARD_VIEWS)
def q_visible_places(v):
    return visible(v).select("store_id", "intensity")


@query("ranking", BOARD_SQL + """
SELECT store_id, name, intensity, db_review_count FROM vis WHERE has_ai AND intensity IS NOT NULL
ORDER BY intensity DESC NULLS LAST, db_review_count DESC NULLS LAST, store_id LIMIT 30""", BOARD_VIEWS)
def q_ranking(v):
    return O.ranking(visible(v), "hottest", 30).select("store_id", "name", "intensity", "db_review_count")


@query("ranking_owner", BOARD_SQL + """
SELECT store_id, max_owner_score, owner_score, db_review_count FROM vis
WHERE has_ai AND max_owner_score IS NOT NULL AND max_owner_score > 0
ORDER BY max_owner_score DESC NULLS LAST, owner_score DESC NULLS LAST, db_review_count DESC NULLS LAST, store_id
LIMIT 30""", BOARD_VIEWS)
def q_ranking_owner(v):
    return O.ranking(visible(v), "fiercest_owner", 30).select("store_id", "max_owner_score", "owner_score",
                                                              "db_review_count")


@query("rank_split", BOARD_SQL + """
SELECT store_id, google_score, rank, CASE WHEN rank <= 3 THEN 'podium' ELSE 'list' END AS tier FROM (
  SELECT store_id, google_score, row_number() OVER (ORDER BY google_score ASC NULLS LAST,
    db_review_count DESC NULLS LAST, store_id) AS rank FROM vis WHERE google_score IS NOT NULL) t
WHERE rank <= 30""", BOARD_VIEWS)
def q_rank_split(v):
    return O.rank_split(visible(v), "lowest_rating").select("store_id", "google_score", "rank", "tier")


@query("intensity_board", f"""
, facts AS (SELECT place_id, owner_reply IS NOT NULL AS replied, NULL AS peak FROM rv
  UNION ALL SELECT place_id, FALSE, greatest(review_score, owner_score) FROM ai)
SELECT s.place_id, max(s.title) AS name, max(s.reviews_count) AS reviews,
  CAST(count_if(f.replied) AS INT) AS owner_replies,
  coalesce(CAST(round(avg(CAST(f.peak AS DECIMAL(30,10))), 2) AS DOUBLE), 0.0) AS intensity
FROM st s LEFT JOIN facts f ON f.place_id = s.place_id WHERE NOT s.blocked AND {IN_CITY} GROUP BY s.place_id
ORDER BY intensity DESC, reviews DESC, s.place_id LIMIT 50""", ("st", "rv", "ai"))
def q_intensity_board(v):
    return intensity_board(v["st"], v["rv"], v["ai"], limit=50)

# --------------------------------------------------------------- E aggregates


@query("max_owner_score", """
SELECT place_id, CAST(max(owner_score) AS DOUBLE) AS max_owner_score FROM ai WHERE owner_score > 0
GROUP BY place_id""", ("ai",))
def q_max_owner_score(v):
    return max_positive(v["ai"])


@query("star_distribution", f"""
SELECT r.stars, CAST(count(*) AS INT) AS review_count FROM rv r JOIN st s ON s.place_id = r.place_id
WHERE NOT s.blocked AND {IN_CITY} GROUP BY r.stars""", ("rv", "st"))
def q_star_distribution(v):
    return E.star_distribution(v["rv"], v["st"])


@query("place_score_summary", """
SELECT place_id, round(guest_avg, 9) AS guest_avg, round(owner_avg, 9) AS owner_avg,
  round(intensity_avg, 9) AS intensity_avg,
  CASE WHEN abs(guest_avg - owner_avg) < 0.5 THEN 'even' WHEN guest_avg > owner_avg THEN 'guest' ELSE 'owner' END
    AS verdict
FROM (SELECT place_id, avg(CAST(review_score AS DOUBLE)) AS guest_avg, avg(CAST(owner_score AS DOUBLE)) AS owner_avg,
        avg((CAST(review_score AS DOUBLE) + owner_score) / 2.0) AS intensity_avg FROM ai GROUP BY place_id) t""",
       ("ai",))
def q_place_score_summary(v):
    out = E.place_score_summary(v["ai"])
    return out.select("place_id", F.round("guest_avg", 9).alias("guest_avg"),
                      F.round("owner_avg", 9).alias("owner_avg"),
                      F.round("intensity_avg", 9).alias("intensity_avg"), "verdict")


INV_VIS = "(SELECT * FROM inv WHERE store_id IN (SELECT store_id FROM vis))"
VALID_D = f"({py_nonblank('district')} AND district <> '未辨識行政區')"


@query("kpis", BOARD_SQL + f"""
, iv AS {INV_VIS},
  heat AS (SELECT district, avg(intensity) AS m, count(DISTINCT review_id) AS c FROM iv WHERE {VALID_D}
           GROUP BY district ORDER BY m DESC, c DESC, district LIMIT 1)
SELECT (SELECT count(DISTINCT store_id) FROM vis) AS stores, (SELECT count(DISTINCT review_id) FROM iv) AS cases,
  (SELECT count(DISTINCT CASE WHEN {VALID_D} THEN district END) FROM iv) AS districts,
  (SELECT district FROM heat) AS hottest_district, round((SELECT m FROM heat), 9) AS hottest_score""", BOARD_VIEWS)
def q_kpis(v):
    inv = D.case_inventory(v["st"], v["rv"], v["ai"])
    return E.kpis(visible(v), inv).withColumn("hottest_score", F.round("hottest_score", 9))


@query("district_heat", BOARD_SQL + f"""
SELECT district, round(avg(intensity), 9) AS mean_intensity, count(DISTINCT review_id) AS cases FROM inv
WHERE {VALID_D} GROUP BY district""", BOARD_VIEWS)
def q_district_heat(v):
    out = E.district_heat(D.case_inventory(v["st"], v["rv"], v["ai"]))
    return out.withColumn("mean_intensity", F.round("mean_intensity", 9))


@query("district_summary", BOARD_SQL + f"""
, iv AS {INV_VIS},
  a AS (SELECT district, count(DISTINCT store_id) AS stores FROM vis GROUP BY district),
  b AS (SELECT district, count(DISTINCT review_id) AS cases FROM iv WHERE {VALID_D} GROUP BY district)
SELECT coalesce(a.district, b.district) AS district, coalesce(a.stores, 0) AS stores, coalesce(b.cases, 0) AS cases
FROM a FULL JOIN b ON a.district = b.district
WHERE {py_nonblank('coalesce(a.district, b.district)')} AND coalesce(a.district, b.district) <> '未辨識行政區'""",
       BOARD_VIEWS)
def q_district_summary(v):
    return E.district_summary(visible(v), D.case_inventory(v["st"], v["rv"], v["ai"]))


HEUR_SQL = """round_even(CASE WHEN greatest(coalesce(review_score, 0), coalesce(owner_score, 0)) > 0 THEN
  greatest(1.0, least(CASE WHEN greatest(coalesce(review_score, 0), coalesce(owner_score, 0)) > 10
    THEN greatest(coalesce(review_score, 0), coalesce(owner_score, 0)) / 10
    ELSE greatest(coalesce(review_score, 0), coalesce(owner_score, 0)) END, 10.0))
ELSE CASE WHEN contains(coalesce(owner_reply, ''), '不要來') OR contains(coalesce(owner_reply, ''), '不缺')
            OR contains(coalesce(owner_reply, ''), '不爽')
       THEN least(10.0, greatest(1.0, least(10.0, (6.0 - CASE WHEN coalesce(drama_stars, 0) = 0 THEN 3.0 ELSE drama_stars END) * 1.6 + 1.0)) + 2.5)
     WHEN coalesce(owner_reply, '') <> '' AND coalesce(owner_reply, '') <> '店家尚未回覆'
       THEN least(10.0, greatest(1.0, least(10.0, (6.0 - CASE WHEN coalesce(drama_stars, 0) = 0 THEN 3.0 ELSE drama_stars END) * 1.6 + 1.0)) + 1.0)
     ELSE greatest(1.0, least(10.0, (6.0 - CASE WHEN coalesce(drama_stars, 0) = 0 THEN 3.0 ELSE drama_stars END) * 1.6 + 1.0))
END END, 1)"""


def chart_frame(v):
    b = place_board(v["st"], v["rv"], v["ai"], limit=None)
    return b.withColumn("intensity", S.heuristic_intensity("review_score", "owner_score", "drama_stars",
                                                           "owner_reply"))


@query("heuristic_intensity", BOARD_SQL + f"\nSELECT store_id, {HEUR_SQL} AS intensity FROM board", BOARD_VIEWS)
def q_heuristic_intensity(v):
    return chart_frame(v).select("store_id", "intensity")


@query("region_means", BOARD_SQL + f"""
, cf AS (SELECT store_id, regexp_extract(address, '(台北市|臺北市)', 1) AS city, {district('address')} AS district,
         {HEUR_SQL} AS intensity FROM board)
SELECT city, district, round(avg(intensity), 9) AS mean_intensity, count(store_id) AS stores,
  concat(coalesce(city, ''), coalesce(district, '')) AS region FROM cf GROUP BY city, district""", BOARD_VIEWS)
def q_region_means(v):
    cf = chart_frame(v).select("store_id", F.regexp_extract("address", "(台北市|臺北市)", 1).alias("city"),
                               X.district("address").alias("district"), "intensity")
    out = E.region_means(cf)
    return out.withColumn("mean_intensity", F.round("mean_intensity", 9))


@query("intensity_buckets", BOARD_SQL + f"""
, cf AS (SELECT {HEUR_SQL} AS intensity FROM board),
  bins AS (SELECT * FROM (VALUES (0, '1–3 理性', 0.0, 3.0), (1, '4–5 升溫', 3.0, 5.0), (2, '6–7 激烈', 5.0, 7.0),
           (3, '8–9 火爆', 7.0, 9.0), (4, '10 史詩', 9.0, 10.1)) t(bin, bucket, lo, hi))
SELECT bins.bin, bins.bucket, count(cf.intensity) AS count FROM bins
LEFT JOIN cf ON cf.intensity > bins.lo AND cf.intensity <= bins.hi GROUP BY bins.bin, bins.bucket""", BOARD_VIEWS)
def q_intensity_buckets(v):
    return E.buckets(chart_frame(v), "intensity")


@query("value_counts", """
SELECT owner_sentiment AS value, count(*) AS count FROM ai WHERE owner_sentiment IS NOT NULL GROUP BY 1""", ("ai",))
def q_value_counts(v):
    return E.value_counts(v["ai"], "owner_sentiment")


@query("progress_counts", """
, marked AS (SELECT coalesce(r.owner_reply, '') <> '' AS replied, d.review_id IS NOT NULL AS done
  FROM rv r LEFT JOIN (SELECT DISTINCT review_id FROM ai) d ON d.review_id = r.review_id)
SELECT count(*) AS reviews, count_if(replied) AS with_reply, count_if(replied AND done) AS analysed,
  count_if(replied AND NOT done) AS pending, (SELECT count(*) FROM ai) AS analysis_rows
FROM marked""", ("rv", "ai"))
def q_progress_counts(v):
    return E.progress_counts(v["rv"], v["ai"])


@query("flag_counts", """
SELECT count(*) AS total, count(*) FILTER (WHERE blocked) AS blocked,
  count(*) FILTER (WHERE skip_review_fetch) AS skip_review_fetch FROM st""", ("st",))
def q_flag_counts(v):
    return E.flag_counts(v["st"])


@query("role_tag_counts", """
SELECT role, tag, count(*) AS count FROM (
  SELECT 'guest' AS role, review_sentiment AS tag FROM ai UNION ALL SELECT 'owner', owner_sentiment FROM ai) t
WHERE tag IS NOT NULL GROUP BY role, tag""", ("ai",))
def q_role_tag_counts(v):
    return E.role_tag_counts(v["ai"], {"guest": "review_sentiment", "owner": "owner_sentiment"})


@query("map_extent", BOARD_SQL + """
SELECT round(avg(lat), 9) AS center_lat, round(avg(lng), 9) AS center_lng, min(lat) AS min_lat, max(lat) AS max_lat,
  min(lng) AS min_lng, max(lng) AS max_lng, count(*) AS points, sum(intensity) AS weight FROM vis""", BOARD_VIEWS)
def q_map_extent(v):
    out = E.map_extent(visible(v))
    return out.select(*[F.round(c, 9).alias(c) if c.startswith("center") else F.col(c) for c in out.columns])


@query("salvage_summary", """
SELECT count(*) AS attempted, count(*) FILTER (WHERE status = 'success') AS ingested,
  CAST(coalesce(sum(CASE WHEN status = 'success' THEN items_count END), 0) AS BIGINT) AS total_raw FROM lg""", ("lg",))
def q_salvage_summary(v):
    res = v["lg"].select((F.col("status") == "success").alias("ingested"), F.col("items_count").alias("raw_count"))
    return E.salvage_summary(res)


@query("distinct_filter_values", BOARD_SQL + f"""
SELECT DISTINCT district AS value FROM nb WHERE {py_nonblank('district')}""", BOARD_VIEWS)
def q_distinct_filter_values(v):
    return E.distinct_values(normalised(v), "district")


@query("case_count", f"SELECT place_id, count(*) AS cases FROM ({SCORED_SQL}) c GROUP BY place_id", ("rv", "ai"))
def q_case_count(v):
    return E.case_count(C.scored_cases(v["rv"], v["ai"]))


@query("rating_histogram", """
SELECT place_id, stars, count, CASE WHEN total > 0 THEN round(CAST(count AS DOUBLE) / total, 6) ELSE 0.0 END AS share
FROM (SELECT place_id, coalesce(one_star, 0) + coalesce(two_star, 0) + coalesce(three_star, 0)
        + coalesce(four_star, 0) + coalesce(five_star, 0) AS total,
      unnest([1, 2, 3, 4, 5]) AS stars,
      unnest([coalesce(one_star, 0), coalesce(two_star, 0), coalesce(three_star, 0), coalesce(four_star, 0),
              coalesce(five_star, 0)]) AS count FROM st WHERE NOT blocked) t""", ("st",))
def q_rating_histogram(v):
    return E.rating_histogram(v["st"])


@query("normalise_reviews", f"""
SELECT review_id, place_id, has_owner_reply, has_ai,
  CASE WHEN has_ai THEN (guest_score + owner_score) / 2.0 END AS intensity FROM (
  SELECT r.review_id, r.place_id, {py_nonblank('r.owner_reply')} AS has_owner_reply,
    CAST(coalesce(a.review_score, 0) AS DOUBLE) AS guest_score, CAST(coalesce(a.owner_score, 0) AS DOUBLE) AS owner_score,
    {has_scores('coalesce(a.review_score, 0)', 'coalesce(a.owner_score, 0)', "coalesce(a.review_sentiment, '')",
                "coalesce(a.owner_sentiment, '')", "coalesce(a.pr_reply, '')")} AS has_ai,
    row_number() OVER (PARTITION BY r.place_id ORDER BY r.stars ASC NULLS LAST, r.published_at DESC NULLS LAST,
                       r.review_id) AS rn
  FROM rv r LEFT JOIN ai a ON a.review_id = r.review_id WHERE r.stars <= 2) t""", ("rv", "ai"))
def q_normalise_reviews(v):
    from reviewops.sources.rows import normalise_reviews
    out = normalise_reviews(D.reviews_with_scores(v["rv"], v["ai"], limit=None))
    return out.select("review_id", "place_id", "has_owner_reply", "has_ai", "intensity")
