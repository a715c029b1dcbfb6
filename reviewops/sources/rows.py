"""Row builders: raw review / place -> table rows, request structs, and the
dashboard's frame normalisation (B10-B12, B14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions.scores import has_scores, initial_recheck, intensity
from reviewops.functions.text import district, py_nonblank, short_name
from reviewops.functions.values import (business_status, coalesce_truthy, guarded_ratio, join_list, 
                                        list_to_json_text, now_col, safe_float, safe_int, safe_timestamp)
from reviewops.operators.filters import flag_brands, geo_box


def review_row(raw: DataFrame, now, keep=()) -> DataFrame:
    """Parsed raw review (``schemas.RAW_REVIEW`` fields) -> review row.

    published time defaults to ``now``; total score defaults to the stars;
    language falls back originalLanguage -> language -> 'unknown'; recheck
    columns from I4.  ``keep`` passes extra input columns through.
    """
    n = now_col(now)
    stars = safe_int("stars", 0, numbers=True)
    published = F.coalesce(safe_timestamp("publishedAtDate"), n)
    state = initial_recheck("responseFromOwnerText", published, n)
    return raw.select(
        F.col("reviewId").cast("string").alias("review_id"),
        F.col("placeId").cast("string").alias("place_id"),
        coalesce_truthy("originalLanguage", "language", default="unknown").alias("original_language"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("review_text"),
        published.alias("published_at"),
        F.coalesce(F.nullif(F.col("reviewUrl"), F.lit("")), F.lit("")).alias("review_url"),
        list_to_json_text("reviewImageUrls").alias("review_image_urls"),
        safe_int("likesCount", 0, numbers=True).alias("likes_count"),
        F.coalesce(safe_float("totalScore", None), stars.cast("double")).alias("total_score"),
        stars.alias("stars"),
        safe_timestamp("responseFromOwnerDate").alias("owner_reply_date"),
        F.col("responseFromOwnerText").alias("owner_reply"),
        n.alias("scraped_at"),
        state["owner_reply_recheck"].alias("owner_reply_recheck"),
        state["owner_reply_recheck_at"].alias("owner_reply_recheck_at"),
        state["next_check_at"].alias("next_check_at"),
        *keep,
    )


def place_row(raw: DataFrame, brands=(), min_reviews: int = K.CONTESTED_MIN_REVIEWS,
              max_score: float = K.CONTESTED_MAX_SCORE,
              min_share: float = K.CONTESTED_MIN_ONE_STAR_SHARE) -> DataFrame:
    """Parsed raw place (``schemas.RAW_PLACE``) -> store row.

    Drops rows without title (C6), fills counts with 0 (B8), joins categories
    (B6), derives status (B7) and one-star share (B9), keeps contested open
    places (C5) and flags brand names (C7); ``blocked`` starts false.
    """
    dist = "reviewsDistribution"
    counts = {name: F.coalesce(F.col(f"{dist}.{src}"), F.lit(0)).cast("int")
              for name, src in (("one_star", "oneStar"), ("two_star", "twoStar"), ("three_star", "threeStar"),
                                ("four_star", "fourStar"), ("five_star", "fiveStar"))}
    reviews = F.coalesce(F.col("reviewsCount"), F.lit(0)).cast("int")
    base = raw.filter(F.col("title").isNotNull()).select(
        F.col("placeId").alias("place_id"), "title", F.col("categoryName").alias("category"),
        join_list("categories").alias("categories"), "address",
        F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"),
        F.col("url").alias("store_url"), F.col("imageUrl").alias("image_url"),
        business_status("permanentlyClosed", "temporarilyClosed").alias("business_status"),
        safe_timestamp("scrapedAt").alias("scraped_at"),
        F.col("totalScore").alias("google_score"), reviews.alias("reviews_count"),
        *[c.alias(n) for n, c in counts.items()],
        guarded_ratio(counts["one_star"], reviews).alias("one_star_share"))
    kept = base.filter((F.col("reviews_count") >= min_reviews)
                       & ((F.col("google_score") <= max_score) | (F.col("one_star_share") >= min_share))
                       & (F.col("business_status") != "CLOSED"))
    return flag_brands(kept, "title", brands, "skip_review_fetch").withColumn("blocked", F.lit(False))


def fetch_request(place_ids: Column, max_reviews: Column | None = None, sort: str | None = None,
                  start_date: Column | None = None, language: str = "zh-TW") -> Column:
    """Scraper request as JSON text; optional fields are omitted when NULL."""
    fields = [F.lit(language).alias("language"), F.lit(True).alias("personalData"),
              place_ids.alias("placeIds"), F.lit("").alias("reviewsFilterString"),
              F.lit("all").alias("reviewsOrigin")]
    fields.append((F.lit(sort) if sort else F.lit(None).cast("string")).alias("reviewsSort"))
    fields.append((max_reviews.cast("int") if max_reviews is not None else F.lit(None).cast("int"))
                  .alias("maxReviews"))
    fields.append((start_date if start_date is not None else F.lit(None).cast("string"))
                  .alias("reviewsStartDate"))
    return F.to_json(F.struct(*fields))


PLACE_TEXT = ("store_id", "name", "category", "address", "store_url", "review_text", "owner_reply",
              "pr_reply", "review_url", "review_sentiment", "owner_sentiment")
PLACE_NUM = ("lat", "lng", "google_score", "reviews", "db_review_count", "owner_replies", "drama_stars",
             "review_score", "owner_score", "max_owner_score")


def _text(df, c):
    return (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c)


def _num(df, c):
    return (F.trim(F.col(c).cast("string")).try_cast("double") if c in df.columns
            else F.lit(None).cast("double")).alias(c)


def normalise_places(df: DataFrame, box=K.GEO_BOX) -> DataFrame:
    """B14 (places): fill text, coerce numbers, derive district, display
    name, has-scores flag, intensity and reply rate; keep the geo box (C11)."""
    others = [c for c in df.columns if c not in PLACE_TEXT and c not in PLACE_NUM]
    base = df.select(*[_text(df, c) for c in PLACE_TEXT], *[_num(df, c) for c in PLACE_NUM], *others)
    has = has_scores("review_score", "owner_score", "review_sentiment", "owner_sentiment", "pr_reply")
    out = base.select(
        "*", district("address").alias("district"), short_name("name").alias("display_name"),
        has.alias("has_ai"),
        F.when(has, intensity("review_score", "owner_score")).alias("intensity"),
        guarded_ratio(F.coalesce(F.col("owner_replies"), F.lit(0.0)),
                      F.coalesce(F.col("db_review_count"), F.lit(0.0)), 100.0).alias("reply_rate"))
    return geo_box(out, box=box)


REVIEW_TEXT = ("review_id", "place_id", "review_text", "review_url", "owner_reply", "guest_sentiment",
               "owner_sentiment", "guest_summary", "owner_summary", "pr_reply")
REVIEW_NUM = ("stars", "likes_count", "guest_score", "owner_score")


def normalise_reviews(df: DataFrame) -> DataFrame:
    """B14 (reviews): fill text, coerce numbers, reply flag, has-scores, intensity."""
    others = [c for c in df.columns if c not in REVIEW_TEXT and c not in REVIEW_NUM]
    base = df.select(*[_text(df, c) for c in REVIEW_TEXT], *[_num(df, c) for c in REVIEW_NUM], *others)
    has = has_scores("guest_score", "owner_score", "guest_sentiment", "owner_sentiment", "pr_reply")
    return base.select("*", py_nonblank("owner_reply").alias("has_owner_reply"), has.alias("has_ai"),
                       F.when(has, intensity("guest_score", "owner_score")).alias("intensity"))
