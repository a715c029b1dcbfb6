"""Joins (D1-D15).

Sides are joined on their keys and Spark chooses the strategy: a broadcast
only when the optimizer's size estimate is under
``spark.sql.autoBroadcastJoinThreshold`` (a checked bound), a sort-merge join
otherwise; AQE splits skewed partitions of a hot place.  Membership tests are
semi/anti joins, never ``IN (<collected list>)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from reviewops import schemas as K
from reviewops.functions.text import district as _district, raw_nonblank
from reviewops.operators.filters import scored_cases
from reviewops.operators.nearest import nearest_place  # noqa: F401 - D15 among the joins


def eligible(places: DataFrame) -> DataFrame:
    return places.filter(~F.col("blocked") & ~F.col("skip_review_fetch"))


def in_city_col(address: str = "address"):
    cond = None
    for s in K.CITY_SPELLINGS:
        hit = F.col(address).contains(s)
        cond = hit if cond is None else (cond | hit)
    return cond


def recheck_join(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """Reviews of eligible places (inner join on the place key)."""
    p = eligible(places).select("place_id")
    return reviews.join(p, "place_id", "inner")


def reviews_with_scores(reviews: DataFrame, analyses: DataFrame, place: str | None = None,
                        limit: int | None = 50, max_stars: int = 2) -> DataFrame:
    """Low-star reviews LEFT JOIN analyses with defaults; per place the
    first ``limit`` (None: all) by stars asc, newest first (one place or all at once)."""
    r = reviews.filter(F.col("stars") <= max_stars)
    if place is not None:
        r = r.filter(F.col("place_id") == place)
    a = analyses.select("review_id", "review_score", "owner_score", "review_sentiment",
                        "owner_sentiment", "review_summary", "owner_summary", "pr_reply")
    j = r.join(a, "review_id", "left").select(
        "review_id", "place_id", "review_text", "stars", "review_url", "published_at", "likes_count",
        "owner_reply",
        F.coalesce("review_score", F.lit(0)).alias("guest_score"),
        F.coalesce("owner_score", F.lit(0)).alias("owner_score"),
        F.coalesce("review_sentiment", F.lit("")).alias("guest_sentiment"),
        F.coalesce("owner_sentiment", F.lit("")).alias("owner_sentiment"),
        F.coalesce("review_summary", F.lit("")).alias("guest_summary"),
        F.coalesce("owner_summary", F.lit("")).alias("owner_summary"),
        F.coalesce("pr_reply", F.lit("")).alias("pr_reply"))
    w = Window.partitionBy("place_id").orderBy(F.col("stars").asc_nulls_last(),
                                               F.col("published_at").desc_nulls_last(),
                                               F.col("review_id").asc())
    if limit is None:
        return j
    n = max(1, int(limit))
    # row_number() <= n is planned as WindowGroupLimit: each task keeps n rows
    # per place before the shuffle.
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("rank")


def case_inventory(places: DataFrame, reviews: DataFrame, analyses: DataFrame) -> DataFrame:
    """D3: one row per case (low star, real reply, both scores) of an
    eligible in-city place, with intensity and district."""
    p = places.filter(~F.col("blocked") & in_city_col()).select(
        F.col("place_id"), F.col("title").alias("store_name"), "address")
    cases = scored_cases(reviews, analyses).select("review_id", "place_id", "review_score", "owner_score",
                                                   "published_at")
    j = p.join(cases, "place_id", "inner")
    return j.select(
        F.col("place_id").alias("store_id"), "store_name", "address", "review_id",
        F.col("review_score").alias("guest_score"), "owner_score",
        ((F.col("review_score") + F.col("owner_score")) / F.lit(2.0)).alias("intensity"),
        _district("address").alias("district"), "published_at")


def attach(df: DataFrame, other: DataFrame, key: str, col: str) -> DataFrame:
    """Replace ``col`` of ``df`` by ``other``'s value (left join on key)."""
    base = df.drop(col) if col in df.columns else df
    return base.join(other.select(key, col), key, "left")


def outer_counts(a: DataFrame, b: DataFrame, key: str, fills: dict) -> DataFrame:
    """Full outer join on ``key``; missing counts become the fill value."""
    return a.join(b, key, "full").na.fill(fills)


def allowed_places(df: DataFrame, allowed: DataFrame, key: str = "place_id") -> DataFrame:
    """Keep rows whose key is in ``allowed`` (left semi join)."""
    return df.join(allowed.select(key), key, "left_semi")


def resume_anti(reviews: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Replied reviews not analysed yet; ``force`` re-selects all.

    Rows of ``done`` whose ``status`` says that their scoring failed do not
    count, so a rerun picks them up.
    A non-null-aware ``left_anti`` (the key is NOT NULL in analyses), so no
    null-aware anti join plan is needed."""
    r = reviews.filter(raw_nonblank("owner_reply")).select(
        "review_id", "place_id", "review_text", "owner_reply")
    if "status" in done.columns:
        done = done.filter(~F.startswith(F.coalesce("status", F.lit("")), F.lit("failed")))
    return r if force else r.join(done.select("review_id"), "review_id", "left_anti")


def orphan_runs(log: DataFrame) -> DataFrame:
    """Started runs whose run id never logged a success."""
    started = log.filter((F.col("status") == "started") & F.col("run_id").isNotNull())
    ok = log.filter(F.col("status") == "success").select("run_id")
    return (started.join(ok, "run_id", "left_anti")
            .select("pipeline", "run_id", F.date_format("started_at", "MM-dd HH:mm").alias("started"),
                    "started_at"))


def missing_parents(child: DataFrame, parent: DataFrame, key: str = "place_id") -> DataFrame:
    """Distinct child keys with no parent row (report, or raise via
    ``assert_no_missing``)."""
    return child.select(key).filter(F.col(key).isNotNull()).distinct().join(
        parent.select(key), key, "left_anti")


def assert_no_missing(missing: DataFrame, what: str = "parent rows") -> None:
    """D13 fail mode: raise when any child key lacks its parent.

    Reads at most a handful of keys for the message (no full collect)."""
    sample = missing.limit(5).collect()
    if sample:
        keys = ", ".join(str(r[0]) for r in sample)
        raise ValueError(f"missing {what} for keys: {keys}{' ...' if len(sample) == 5 else ''}")


def scorer_completeness(request: DataFrame, response: DataFrame, key: str = "review_id") -> DataFrame:
    """Pair scorer output with its request row by id.

    status: ``ok`` (1:1), ``missing`` (asked, no answer), ``unknown`` (answer
    to an id never asked), ``duplicate`` (answered more than once)."""
    resp = response.groupBy(key).agg(F.count(F.lit(1)).alias("answers"),
                                     F.min(F.to_json(F.struct(*response.columns)))
                                     .alias("response_json"))
    req = request.select(key, F.to_json(F.struct(*request.columns)).alias("request_json"),
                         F.lit(True).alias("asked"))
    j = req.join(resp, key, "full")
    status = (F.when(F.col("asked").isNull(), "unknown")
              .when(F.col("answers").isNull(), "missing")
              .when(F.col("answers") > 1, "duplicate").otherwise("ok"))
    return j.select(key, status.alias("status"), F.coalesce("answers", F.lit(0)).alias("answers"),
                    "request_json", "response_json")
