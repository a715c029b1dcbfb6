"""Predicates over places, reviews and analyses.

All are plain ``filter`` / ``when`` expressions, so Catalyst pushes the
column-only parts into the parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions.scores import has_scores as _has_scores, intensity as _intensity
from reviewops.functions.text import blank_test, col_, py_nonblank, py_strip, sql_nonblank
from reviewops.functions.values import guarded_ratio, now_col, safe_int, business_status


def valid_ids(df: DataFrame, ids=("review_id", "place_id"), reason_col: str | None = None) -> DataFrame:
    """Both ids present and non-empty.  With ``reason_col`` rows are kept
    and labelled ``missing_<id>`` (first failing id) or ``ok``."""
    checks = [(F.coalesce(col_(c).cast("string"), F.lit("")) == "", f"missing_{c}") for c in ids]
    if reason_col is None:
        cond = None
        for bad, _ in checks:
            cond = ~bad if cond is None else (cond & ~bad)
        return df.filter(cond)
    expr = None
    for bad, label in checks:
        expr = F.when(bad, label) if expr is None else expr.when(bad, label)
    return df.withColumn(reason_col, expr.otherwise("ok"))


def low_star(df: DataFrame, stars: str = "stars", allowed=K.LOW_STARS) -> DataFrame:
    """Stars in the allowed set."""
    return df.filter(col_(stars).isin(*allowed))


def min_text_len(df: DataFrame, text: str = "text", n: int = K.MIN_REVIEW_TEXT_LEN) -> DataFrame:
    """Stripped text has at least ``n`` characters."""
    return df.filter(F.length(py_strip(F.coalesce(col_(text), F.lit("")))) >= n)


#: Labels of the raw names of ids.
MISSING = {"reviewId": "missing_review_id", "placeId": "missing_place_id"}


def review_reason(ids=("review_id", "place_id"), stars="stars", text="review_text",
                  reply="owner_reply", generic=None):
    """C4 as a Column: the first failing rule, in the reference's order.

    missing ids -> not_low_star_review (unparsable stars = 0) ->
    empty_review_text -> needs_owner_recheck (kept) -> generic_pr_reply -> ok
    """
    expr = None
    for c in ids:
        bad, label = F.coalesce(col_(c).cast("string"), F.lit("")) == "", MISSING.get(c, f"missing_{c}")
        expr = F.when(bad, label) if expr is None else expr.when(bad, label)
    s = safe_int(stars, 0, numbers=True)
    expr = expr.when(~s.isin(*K.LOW_STARS), "not_low_star_review")
    expr = expr.when(F.length(py_strip(F.coalesce(col_(text), F.lit("")))) < K.MIN_REVIEW_TEXT_LEN,
                     "empty_review_text")
    expr = expr.when(~py_nonblank(reply), "needs_owner_recheck")
    if generic is not None:
        expr = expr.when(F.coalesce(col_(generic), F.lit(False)), "generic_pr_reply")
    return expr.otherwise("ok")


KEPT_REASONS = ("ok", "needs_owner_recheck")


def classify_review(df: DataFrame, generic: str | None = None, out: str = "reason", **cols) -> DataFrame:
    """C4: label every review with the first failing rule (``reason``)."""
    return df.withColumn(out, review_reason(generic=generic, **cols))


def one_star_share(one_star="one_star", reviews="reviews_count"):
    return guarded_ratio(F.coalesce(col_(one_star), F.lit(0)), F.coalesce(col_(reviews), F.lit(0)))


def contested_places(df: DataFrame, min_reviews: int = K.CONTESTED_MIN_REVIEWS,
                     max_score: float = K.CONTESTED_MAX_SCORE,
                     min_share: float = K.CONTESTED_MIN_ONE_STAR_SHARE) -> DataFrame:
    """Many reviews, and a low score or a high one-star share, and open."""
    reviews = F.coalesce(F.col("reviews_count"), F.lit(0))
    status = business_status("permanently_closed", "temporarily_closed")
    return df.filter((reviews >= min_reviews)
                     & ((F.col("google_score") <= max_score) | (one_star_share() >= min_share))
                     & (status != "CLOSED"))


def drop_null(df: DataFrame, cols=("title",)) -> DataFrame:
    """Drop rows with NULL in any of ``cols``."""
    return df.na.drop(subset=list(cols))


def brand_pattern(brands) -> str:
    """A regex matching any brand as a literal substring."""
    return "|".join(re.escape(b) for b in brands if b)


def flag_brands(df: DataFrame, title: str = "title", brands=(), out: str = "skip_review_fetch") -> DataFrame:
    """Flag (not delete) rows whose title contains any brand literally.

    The brand list is configuration, bounded by its author; it is compiled
    into one JVM regex evaluated inside whole-stage codegen.
    """
    pattern = "|".join(f"\\Q{b}\\E" for b in brands if b)
    if not pattern:
        return df.withColumn(out, F.lit(False))
    return df.withColumn(out, F.coalesce(col_(title).rlike(pattern), F.lit(False)))


def eligible_places(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Places to fetch: not blocked, not skipped; most reviewed first."""
    out = (df.filter(~F.col("blocked") & ~F.col("skip_review_fetch"))
           .select("place_id", "one_star", "two_star", "reviews_count", "skip_review_fetch")
           .orderBy(F.col("reviews_count").desc_nulls_last(), F.col("place_id").asc()))
    return out if limit is None else out.limit(max(1, int(limit)))


def region_filter(df: DataFrame, address: str = "address", spellings=K.CITY_SPELLINGS) -> DataFrame:
    """Address contains any spelling of the city."""
    cond = None
    for s in spellings:
        hit = col_(address).contains(s)
        cond = hit if cond is None else (cond | hit)
    return df.filter(cond)


def geo_box(df: DataFrame, lat: str = "lat", lng: str = "lng", box=K.GEO_BOX) -> DataFrame:
    """C11: inclusive lat/lng box; NULL coordinates are dropped."""
    (la0, la1), (ln0, ln1) = box["lat"], box["lng"]
    return df.filter(col_(lat).between(la0, la1) & col_(lng).between(ln0, ln1))


def has_reply(df: DataFrame, reply: str = "owner_reply", mode: str = "sql",
              stars: str | None = "stars", max_stars: int = 2) -> DataFrame:
    """Low star and a non-blank reply (blank test per ``mode``)."""
    cond = blank_test(reply, mode)
    if stars is not None:
        cond = cond & (col_(stars) <= max_stars)
    return df.filter(cond)


def search_places(df: DataFrame, keyword: str | None = None, district: str | None = None,
                  min_intensity: float | None = None, literal: bool = False,
                  name: str = "name", address: str = "address") -> DataFrame:
    """Keyword on name OR address (case-insensitive regex, or literal),
    district equality, minimum intensity.  ``None``/'all' turns a filter off."""
    out = df
    if keyword and keyword.strip():
        kw = keyword.strip()
        if literal:
            pattern = "(?i)" + "\\Q" + kw + "\\E"
        else:
            try:
                re.compile(kw)
            except re.error as exc:
                raise ValueError(f"invalid search pattern: {kw!r}") from exc
            pattern = "(?i)" + kw
        out = out.filter(F.coalesce(col_(name).rlike(pattern), F.lit(False))
                         | F.coalesce(col_(address).rlike(pattern), F.lit(False)))
    if district and district != "all":
        out = out.filter(F.col("district") == district)
    if min_intensity is not None:
        out = out.filter(F.col("intensity") >= float(min_intensity))
    return out


def scored_cases(reviews: DataFrame, analyses: DataFrame, max_stars: int = 2) -> DataFrame:
    """C14: low-star reviews with a real reply and both scores present."""
    a = analyses.select("review_id", "review_score", "owner_score", "review_sentiment",
                        "owner_sentiment", "review_summary", "owner_summary", "pr_reply")
    r = reviews.filter((F.col("stars") <= max_stars) & sql_nonblank("owner_reply"))
    return (r.join(a, "review_id", "inner")
            .filter(F.col("review_score").isNotNull() & F.col("owner_score").isNotNull()))


def with_has_scores(df: DataFrame, out: str = "has_ai", a="review_score", b="owner_score",
                    tag_a="review_sentiment", tag_b="owner_sentiment", reply="pr_reply") -> DataFrame:
    """C15 as a column on a frame."""
    return df.withColumn(out, _has_scores(a, b, tag_a, tag_b, reply))


def visible_places(df: DataFrame) -> DataFrame:
    """Places with owner replies, real scores and an intensity."""
    return df.filter((F.coalesce(F.col("owner_replies"), F.lit(0)) > 0) & F.col("has_ai")
                     & F.col("intensity").isNotNull())


def analysis_window(df: DataFrame, now, days: int = 1, reply: str = "owner_reply",
                    scraped: str = "scraped_at") -> DataFrame:
    """C17: replied (raw test) and scraped strictly after ``now - days``."""
    since = now_col(now) - F.make_dt_interval(F.lit(days))
    return df.filter(col_(reply).isNotNull() & (col_(reply) != "")
                     & (col_(scraped).cast("timestamp_ntz") > since))


def min_intensity_cases(cases: DataFrame, m: float) -> DataFrame:
    """Cases with intensity >= m, most intense and newest first."""
    out = cases.withColumn("intensity", _intensity("review_score", "owner_score"))
    return (out.filter(F.col("intensity") >= float(m))
            .orderBy(F.col("intensity").desc_nulls_last(), F.col("published_at").desc_nulls_last(),
                     F.col("review_id").asc()))
