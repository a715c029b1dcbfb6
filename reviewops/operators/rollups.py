"""Per-place rollups (E1-E3) and the boards built on them.

Aggregates are pre-computed per key *before* any join, so every join sees
one row per place on the rollup side and the big review/analysis tables are
shuffled once, on the place key, with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions.text import sql_nonblank
from reviewops.operators.best import best_by


def round_avg(c, scale: int = 2):
    """``ROUND(AVG(x)::numeric, scale)``: exact decimal mean, half-up, as double."""
    return F.round(F.avg(F.col(c).cast("decimal(30,10)")), scale).cast("double")


def review_rollup(reviews: DataFrame, key: str = "place_id", max_stars: int = 2) -> DataFrame:
    """One row per place over its low-star reviews.

    ``owner_reply_rows`` counts non-NULL replies (blank ones too); the best
    reply skips blank ones.  Each "best" column has its own order; the review
    id breaks ties.
    """
    r = reviews.filter(F.col("stars") <= max_stars)
    replied = sql_nonblank("owner_reply")
    by_stars = [("stars", "asc"), ("published_at", "desc", "ts")]
    return r.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("review_rows"),
        F.count("owner_reply").cast("int").alias("owner_reply_rows"),
        best_by("review_text", [("stars", "asc"),
                                (F.when(replied, 0).otherwise(1), "asc"),
                                ("published_at", "desc", "ts")], tie="review_id")
        .alias("latest_review_text"),
        best_by("owner_reply", by_stars, where=replied, tie="review_id").alias("latest_owner_reply"),
        best_by("stars", by_stars, tie="review_id").alias("drama_stars"),
        best_by("review_url", by_stars, tie="review_id").alias("latest_review_url"),
    )


def analysis_rollup(analyses: DataFrame, key: str = "place_id") -> DataFrame:
    """Per place mean scores (2 decimals), best positive owner score and
    the summaries / tags / suggested reply of the most intense analysis."""
    heat = F.greatest("review_score", "owner_score")
    tie = "review_id"
    return analyses.groupBy(key).agg(
        round_avg("review_score").alias("review_score"),
        round_avg("owner_score").alias("owner_score"),
        F.max(F.when(F.col("owner_score") > 0, F.col("owner_score"))).cast("double")
        .alias("max_owner_score"),
        best_by("review_summary", [(heat, "desc")], tie=tie).alias("review_summary"),
        best_by("owner_summary", [(heat, "desc")], tie=tie).alias("owner_summary"),
        best_by("review_sentiment", [("review_score", "desc")], tie=tie).alias("review_sentiment"),
        best_by("owner_sentiment", [("owner_score", "desc")], tie=tie).alias("owner_sentiment"),
        best_by("pr_reply", [(heat, "desc")], where=sql_nonblank("pr_reply"), tie=tie)
        .alias("pr_reply"),
    )


def max_positive(df: DataFrame, key: str = "place_id", score: str = "owner_score",
                 out: str = "max_owner_score") -> DataFrame:
    """Per key maximum of the positive scores (as double)."""
    return (df.filter(F.col(score) > 0).groupBy(key)
            .agg(F.max(score).cast("double").alias(out)))


def in_city(address: str = "address", spellings=K.CITY_SPELLINGS):
    cond = None
    for s in spellings:
        hit = F.col(address).contains(s)
        cond = hit if cond is None else (cond | hit)
    return cond


def place_board(places: DataFrame, reviews: DataFrame, analyses: DataFrame,
                limit: int | None = 300) -> DataFrame:
    """The dashboard's place table.

    Eligible, in-city places INNER the review rollup, LEFT the analysis
    rollup, with the fallback text chain, ordered by heat, rows, reviews (and
    the place id for a total order).  ``limit=None`` keeps every row.
    """
    p = places.filter(~F.col("blocked") & in_city()).select(
        "place_id", F.col("title").alias("name"), "category", "address", "store_url",
        "lat", "lng", "google_score", F.col("reviews_count").alias("reviews"))
    rr = review_rollup(reviews).filter(F.col("review_rows") > 0)
    ar = analysis_rollup(analyses)
    j = p.join(rr, "place_id", "inner").join(ar, "place_id", "left")
    out = j.select(
        F.col("place_id").alias("store_id"), "name", "category", "address", "store_url",
        "lat", "lng", "google_score", "reviews",
        F.coalesce("review_rows", F.lit(0)).alias("db_review_count"),
        F.coalesce("owner_reply_rows", F.lit(0)).alias("owner_replies"),
        F.coalesce("latest_review_text", "review_summary", F.lit(K.NO_REVIEW_TEXT)).alias("review_text"),
        F.coalesce("latest_owner_reply", "owner_summary", F.lit(K.NO_OWNER_REPLY)).alias("owner_reply"),
        F.coalesce("pr_reply", F.lit("")).alias("pr_reply"),
        F.coalesce("latest_review_url", F.lit("")).alias("review_url"),
        F.coalesce("drama_stars", F.lit(0)).alias("drama_stars"),
        F.coalesce("review_score", F.lit(0.0)).alias("review_score"),
        F.coalesce("owner_score", F.lit(0.0)).alias("owner_score"),
        "max_owner_score",
        F.coalesce("review_sentiment", F.lit("")).alias("review_sentiment"),
        F.coalesce("owner_sentiment", F.lit("")).alias("owner_sentiment"),
    )
    order = [F.greatest("owner_score", "review_score").desc_nulls_last(),
             F.col("db_review_count").desc_nulls_last(), F.col("reviews").desc_nulls_last(),
             F.col("store_id").asc_nulls_last()]
    out = out.orderBy(*order)
    return out if limit is None else out.limit(max(1, int(limit)))


def intensity_board(places: DataFrame, reviews: DataFrame, analyses: DataFrame,
                    limit: int = 10) -> DataFrame:
    """In-city places by mean per-analysis max score (2 decimals)."""
    rr = reviews.groupBy("place_id").agg(F.count("owner_reply").cast("int").alias("owner_reply_rows"))
    ar = analyses.groupBy("place_id").agg(
        F.round(F.avg(F.greatest("review_score", "owner_score").cast("decimal(30,10)")), 2)
        .cast("double").alias("max_score"))
    p = places.filter(~F.col("blocked") & in_city())
    j = p.join(rr, "place_id", "left").join(ar, "place_id", "left")
    return (j.select("place_id", F.col("title").alias("name"),
                     F.coalesce("max_score", F.lit(0.0)).alias("intensity"),
                     F.col("reviews_count").alias("reviews"),
                     F.coalesce("owner_reply_rows", F.lit(0)).alias("owner_replies"))
            .orderBy(F.col("intensity").desc_nulls_last(), F.col("reviews").desc_nulls_last(),
                     F.col("place_id").asc())
            .limit(max(1, int(limit))))
