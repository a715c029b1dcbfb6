"""Queries: sources, landing and cleaning expressions (A*, B*)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewops import schemas as K
from reviewops.bindings import NOW
from reviewops.functions import values as V
from reviewops.functions.scores import fetch_limit
from reviewops.operators.filters import eligible_places
from reviewops.plans.registry import query
from reviewops.session import ensure_checkpoint_dir
from reviewops.sources import raw as RAW
from reviewops.sources import rows as ROWS


def parsed_ev(v, once: bool = False):
    return RAW.parse_json_column(v["ev"], "raw_json", K.RAW_REVIEW, once=once)


J = "json_extract_string(raw_json, '$.{}')"


def j(field):
    return J.format(field)


@query("json_dataset", f"""
SELECT seq, {j('reviewId')} AS reviewId, {j('placeId')} AS placeId, {j('stars')} AS stars,
  {j('publishedAtDate')} AS publishedAtDate,
  CAST(json_extract(raw_json, '$.location.lat') AS DOUBLE) AS lat,
  CAST(json_extract(raw_json, '$.location.lng') AS DOUBLE) AS lng
FROM ev""", ("ev",))
def q_json_dataset(v):
    return parsed_ev(v).select("seq", "reviewId", "placeId", "stars", "publishedAtDate",
                               F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"))


#: Rows of one JSON array file, some 180 MB.
ROWS_A_FILE = 1 << 19


def array_files(v, rows_a_file: int = ROWS_A_FILE) -> str:
    """The raw reviews as JSON array files of some ``rows_a_file`` rows, four at least; a row a line, so that no task holds a file.

    The number of files grows with the rows, and a task writes few of them: what it sorts has a bound.
    """
    spark = v["ev"].sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arrays-{uuid.uuid4().hex[:12]}"
    files = max(4, -(-v["ev"].count() // rows_a_file))
    rows = v["ev"].select("seq", "raw_json", F.pmod(F.xxhash64("seq"), F.lit(files)).alias("file")).repartition(4 * files, "file")
    order = Window.partitionBy("file").orderBy("seq")
    line = F.concat(F.when(F.lag("seq").over(order).isNull(), "[").otherwise(","), "raw_json", F.when(F.lead("seq").over(order).isNull(), "]").otherwise(""))
    rows.select("file", line.alias("value")).write.partitionBy("file").text(path)
    return path


@query("json_array_dataset", f"""
SELECT {j('reviewId')} AS reviewId, {j('placeId')} AS placeId, {j('text')} AS text,
  CAST({j('location.lng')} AS DOUBLE) AS lng, raw_json FROM ev""", ("ev",))
def q_json_array_dataset(v):
    rows = RAW.read_json_dataset(v["ev"].sparkSession, array_files(v), K.RAW_REVIEW)
    return rows.select("reviewId", "placeId", "text", F.col("location.lng").alias("lng"), "raw_json")


@query("land_raw", f"SELECT {j('reviewId')} AS reviewId, raw_json, ts AS scraped_at FROM ev", ("ev",))
def q_land_raw(v):
    return RAW.land_raw(parsed_ev(v), "reviewId", "ts", raw="raw_json")


@query("raw_variant_get", """
SELECT seq, json_extract_string(raw_json, '$.placeId') AS place_id,
  TRY_CAST(json_extract(raw_json, '$.stars') AS INT) AS stars,
  TRY_CAST(json_extract(raw_json, '$.location.lat') AS DOUBLE) AS lat
FROM ev""", ("ev",))
def q_raw_variant_get(v):
    out = RAW.raw_fields(v["ev"], "raw_json", {"place_id": ("$.placeId", "string"),
                                                "stars": ("$.stars", "int"),
                                                "lat": ("$.location.lat", "double")})
    return out.select("seq", "place_id", "stars", "lat")


CONFORM_SCHEMA = T.StructType([
    T.StructField("place_id", T.StringType(), False), T.StructField("title", T.StringType(), False),
    T.StructField("category", T.StringType(), False), T.StructField("address", T.StringType(), True),
    T.StructField("lat", T.DoubleType(), False), T.StructField("reviews_count", T.IntegerType(), False),
    T.StructField("one_star", T.IntegerType(), False),
])


@query("conform_schema", """
SELECT place_id, concat_ws(',', CASE WHEN title IS NULL THEN 'null:title' END,
  CASE WHEN one_star IS NULL THEN 'null:one_star' END,
  CASE WHEN length(category) > 9 THEN 'too_long:category' END) AS errors
FROM st""", ("st",))
def q_conform_schema(v):
    good, bad = RAW.conform(v["st"], CONFORM_SCHEMA, max_len={"category": 9})
    return (good.select("place_id", F.lit("").alias("errors"))
            .unionByName(bad.select("place_id", F.array_join("_errors", ",").alias("errors"))))


@query("post_log_rows", """
SELECT CAST(event_id AS VARCHAR) AS id, props AS text, 'TEXT_POST' AS media_type, NULL::VARCHAR AS media_url,
  date_trunc('second', ts) AS timestamp, concat('https://example.com/post/', event_id) AS permalink
FROM events""")
def q_post_log_rows(v):
    ev = v["pg"].sparkSession.table("events")
    resp = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("props").alias("text"),
        F.lit("TEXT_POST").alias("media_type"),
        F.concat(F.lit("https://example.com/post/"), F.col("event_id")).alias("permalink"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssZ").alias("timestamp")))
    return RAW.post_log(ev.select(resp.alias("response")), "response")


@query("flatten_nested", """
SELECT seq, CAST(json_extract(raw_json, '$.location.lat') AS DOUBLE) AS "location.lat",
  CAST(json_extract(raw_json, '$.location.lng') AS DOUBLE) AS "location.lng"
FROM ev""", ("ev",))
def q_flatten_nested(v):
    return RAW.flatten_nested(parsed_ev(v).select("seq", "location"))


@query("safe_numeric", f"""
SELECT seq, coalesce(TRY_CAST({j('stars')} AS INT), 0) AS stars,
  coalesce(TRY_CAST({j('likesCount')} AS INT), 0) AS likes,
  coalesce(TRY_CAST(json_extract(raw_json, '$.location.lat') AS DOUBLE), 0.0) AS lat
FROM ev""", ("ev",))
def q_safe_numeric(v):
    p = parsed_ev(v)
    return p.select("seq", V.safe_int("stars").alias("stars"), V.safe_int("likesCount").alias("likes"),
                    V.safe_float("location.lat").alias("lat"))


@query("safe_timestamp", f"""
SELECT seq, TRY_CAST({j('publishedAtDate')} AS TIMESTAMP) AS published_at,
  TRY_CAST({j('startedAt')} AS TIMESTAMP) AS started_at, TRY_CAST({j('stars')} AS TIMESTAMP) AS junk
FROM ev""", ("ev",))
def q_safe_timestamp(v):
    p = parsed_ev(v)
    return p.select("seq", V.safe_timestamp("publishedAtDate").alias("published_at"),
                    V.safe_timestamp("startedAt").alias("started_at"),
                    V.safe_timestamp("stars").alias("junk"))


@query("coalesce_truthy", """
SELECT review_id, coalesce(nullif(owner_reply, ''), nullif(review_url, ''), 'none') AS first_value
FROM rv""", ("rv",))
def q_coalesce_truthy(v):
    return v["rv"].select("review_id", V.coalesce_truthy("owner_reply", "review_url", default="none")
                          .alias("first_value"))


IMAGES = "list_filter(CAST(json_extract(raw_json, '$.reviewImageUrls') AS VARCHAR[]), lambda x: x IS NOT NULL AND x <> '')"


@query("list_to_json_text", f"""
SELECT seq, CASE WHEN coalesce(len({IMAGES}), 0) = 0 THEN NULL
  ELSE concat('[', array_to_string(list_transform({IMAGES}, lambda x: concat('"', x, '"')), ', '), ']') END AS images
FROM ev""", ("ev",))
def q_list_to_json_text(v):
    return parsed_ev(v).select("seq", V.list_to_json_text("reviewImageUrls").alias("images"))


@query("join_categories", """
SELECT place_id, coalesce(array_to_string(CASE WHEN CAST(substr(place_id, 2) AS BIGINT) % 5 = 0 THEN NULL
  ELSE string_split(category, 'O') END, ','), '') AS categories
FROM st""", ("st",))
def q_join_categories(v):
    st = v["st"]
    arr = F.when(F.substring("place_id", 2, 20).cast("long") % 5 == 0, F.lit(None)).otherwise(
        F.split("category", "O"))
    return st.select("place_id", V.join_list(arr).alias("categories"))


@query("business_status", """
SELECT place_id, CASE WHEN coalesce(permanently_closed, false) OR coalesce(temporarily_closed, false)
  THEN 'CLOSED' ELSE 'OPEN' END AS business_status FROM st""", ("st",))
def q_business_status(v):
    return v["st"].select("place_id", V.business_status("permanently_closed", "temporarily_closed")
                          .alias("business_status"))


@query("fill_defaults", """
SELECT place_id, coalesce(title, '') AS title, coalesce(one_star, 0) AS one_star,
  coalesce(temporarily_closed, false) AS temporarily_closed FROM st""", ("st",))
def q_fill_defaults(v):
    out = V.fill_defaults(v["st"], {"title": "", "one_star": 0, "temporarily_closed": False})
    return out.select("place_id", "title", "one_star", "temporarily_closed")


@query("guarded_ratio", """
SELECT place_id,
  CASE WHEN reviews_count > 0 THEN CAST(coalesce(one_star, 0) AS DOUBLE) / reviews_count * 1.0 ELSE 0.0 END AS one_star_share,
  CASE WHEN five_star > 0 THEN CAST(two_star AS DOUBLE) / five_star * 100.0 ELSE 0.0 END AS rate_pct
FROM st""", ("st",))
def q_guarded_ratio(v):
    return v["st"].select("place_id", V.guarded_ratio(F.coalesce("one_star", F.lit(0)), "reviews_count")
                          .alias("one_star_share"),
                          V.guarded_ratio("two_star", "five_star", 100.0).alias("rate_pct"))


REVIEW_ROW_SQL = f"""
, p AS (SELECT {j('reviewId')} AS review_id, {j('placeId')} AS place_id, {j('originalLanguage')} AS ol,
    {j('language')} AS lang, {j('text')} AS t, {j('reviewUrl')} AS url, {j('stars')} AS s,
    {j('responseFromOwnerText')} AS reply, raw_json,
    coalesce(TRY_CAST({j('publishedAtDate')} AS TIMESTAMP), TIMESTAMP '{NOW}') AS pub
  FROM ev)
SELECT review_id, place_id, coalesce(nullif(ol, ''), nullif(lang, ''), 'unknown') AS original_language,
  coalesce(t, '') AS review_text, pub AS published_at, coalesce(url, '') AS review_url,
  CASE WHEN coalesce(len({IMAGES}), 0) = 0 THEN NULL
    ELSE concat('[', array_to_string(list_transform({IMAGES}, lambda x: concat('"', x, '"')), ', '), ']') END
    AS review_image_urls,
  0 AS likes_count, CAST(coalesce(TRY_CAST(s AS INT), 0) AS DOUBLE) AS total_score,
  coalesce(TRY_CAST(s AS INT), 0) AS stars, NULL::TIMESTAMP AS owner_reply_date, reply AS owner_reply,
  TIMESTAMP '{NOW}' AS scraped_at,
  NOT (coalesce(length(trim(reply)) > 0, false) OR TIMESTAMP '{NOW}' > pub + INTERVAL 10 DAY) AS owner_reply_recheck,
  NULL::TIMESTAMP AS owner_reply_recheck_at,
  CASE WHEN NOT (coalesce(length(trim(reply)) > 0, false) OR TIMESTAMP '{NOW}' > pub + INTERVAL 10 DAY)
    THEN TIMESTAMP '{NOW}' + INTERVAL 2 DAY END AS next_check_at
FROM p"""


@query("review_row", REVIEW_ROW_SQL, ("ev",))
def q_review_row(v):
    return ROWS.review_row(parsed_ev(v), NOW)


BRANDS = ("Customer#0000001", "Customer#00000077", "[Customer#00000088]")


def raw_places(v):
    st = v["st"]
    obj = F.to_json(F.struct(
        F.col("place_id").alias("placeId"), "title", F.col("category").alias("categoryName"),
        F.split("category", "O").alias("categories"), "address", F.col("store_url").alias("url"),
        F.struct("lat", "lng").alias("location"), F.col("google_score").alias("totalScore"),
        F.col("reviews_count").alias("reviewsCount"),
        F.col("permanently_closed").alias("permanentlyClosed"),
        F.col("temporarily_closed").alias("temporarilyClosed"),
        F.struct(F.col("one_star").alias("oneStar"), F.col("two_star").alias("twoStar"),
                 F.col("three_star").alias("threeStar"), F.col("four_star").alias("fourStar"),
                 F.col("five_star").alias("fiveStar")).alias("reviewsDistribution")))
    return RAW.parse_json_column(st.select(obj.alias("raw")), "raw", K.RAW_PLACE, keep_raw=False)


@query("place_row", """
SELECT place_id, title, category, array_to_string(string_split(category, 'O'), ',') AS categories, address,
  lat, lng, store_url, 'OPEN' AS business_status, google_score, reviews_count,
  coalesce(one_star, 0) AS one_star, two_star, three_star, four_star, five_star,
  CASE WHEN reviews_count > 0 THEN CAST(coalesce(one_star, 0) AS DOUBLE) / reviews_count ELSE 0.0 END AS one_star_share,
  contains(title, 'Customer#0000001') OR contains(title, 'Customer#00000077') OR contains(title, '[Customer#00000088]')
    AS skip_review_fetch,
  false AS blocked
FROM st
WHERE title IS NOT NULL AND reviews_count >= 30
  AND (google_score <= 4.3 OR (CASE WHEN reviews_count > 0 THEN CAST(coalesce(one_star, 0) AS DOUBLE) / reviews_count ELSE 0.0 END) >= 0.1)
  AND NOT (coalesce(permanently_closed, false) OR coalesce(temporarily_closed, false))""", ("st",))
def q_place_row(v):
    out = ROWS.place_row(raw_places(v), brands=BRANDS)
    return out.drop("image_url", "scraped_at")


@query("fetch_request", """
SELECT place_id, json_object('language', 'zh-TW', 'personalData', true, 'placeIds', [place_id],
  'reviewsFilterString', '', 'reviewsOrigin', 'all', 'reviewsSort', 'lowestRanking',
  'maxReviews', coalesce(one_star, 0) + coalesce(two_star, 0) + 50) AS request
FROM st WHERE NOT blocked AND NOT skip_review_fetch""", ("st",))
def q_fetch_request(v):
    e = eligible_places(v["st"])
    return e.select("place_id", ROWS.fetch_request(F.array("place_id"), fetch_limit("one_star", "two_star"),
                                                   sort="lowestRanking").alias("request"))


@query("first_named_field", f"""
SELECT seq, coalesce(nullif({j('publishAt')}, ''), nullif({j('publishedAtDate')}, '')) AS published,
  coalesce(nullif({j('started_at')}, ''), nullif({j('startedAt')}, '')) AS started
FROM ev""", ("ev",))
def q_first_named_field(v):
    p = parsed_ev(v)
    return p.select("seq", V.first_named_field(p, ["publishAt", "publishedAtDate"]).alias("published"),
                    V.first_named_field(p, ["started_at", "startedAt"]).alias("started"))
