"""Aggregations (E5-E21 except E15): counts, means, histograms, KPIs.

All are ``groupBy().agg`` with partial (map-side) aggregation; distinct
counts are exact by default and ``approx=True`` switches to HyperLogLog++
(``approx_count_distinct``) for very large inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions.text import col_, py_nonblank, raw_nonblank
from reviewops.operators.joins import in_city_col


def star_distribution(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """E5: review count per star over unblocked in-city places."""
    p = places.filter(~F.col("blocked") & in_city_col()).select("place_id")
    return (reviews.join(p, "place_id", "inner").groupBy("stars")
            .agg(F.count(F.lit(1)).cast("int").alias("review_count")).orderBy("stars"))


def place_score_summary(analyses: DataFrame, even: float = K.EVEN_MATCH_GAP,
                        key: str = "place_id") -> DataFrame:
    """Mean guest / owner / intensity per place and who is fiercer."""
    g = F.col("review_score").cast("double")
    o = F.col("owner_score").cast("double")
    out = analyses.groupBy(key).agg(
        F.avg(g).alias("guest_avg"), F.avg(o).alias("owner_avg"),
        F.avg((g + o) / F.lit(2.0)).alias("intensity_avg"))
    verdict = (F.when(F.abs(F.col("guest_avg") - F.col("owner_avg")) < even, "even")
               .when(F.col("guest_avg") > F.col("owner_avg"), "guest").otherwise("owner"))
    return out.withColumn("verdict", verdict)


def _distinct(c, approx: bool):
    return F.approx_count_distinct(c) if approx else F.countDistinct(c)


def valid_district(c="district"):
    return py_nonblank(c) & (col_(c) != K.UNKNOWN_DISTRICT)


def district_heat(inventory: DataFrame, approx: bool = False) -> DataFrame:
    """Per known district mean intensity and distinct cases, hottest first."""
    return (inventory.filter(valid_district()).groupBy("district")
            .agg(F.avg("intensity").alias("mean_intensity"),
                 _distinct("review_id", approx).cast("long").alias("cases"))
            .orderBy(F.col("mean_intensity").desc_nulls_last(), F.col("cases").desc_nulls_last(),
                     F.col("district").asc()))


def kpis(visible: DataFrame, inventory: DataFrame, approx: bool = False) -> DataFrame:
    """One row: visible places, their cases, known districts, hottest district.

    Both uses of ``visible`` read the same projection, so Spark plans its
    subtree once and reuses the exchange."""
    ids = visible.select("store_id")
    inv = inventory.join(ids.distinct(), "store_id", "left_semi")
    stores = ids.agg(_distinct("store_id", approx).cast("long").alias("stores"))
    cases = inv.agg(_distinct("review_id", approx).cast("long").alias("cases"),
                    _distinct(F.when(valid_district(), F.col("district")), approx).cast("long")
                    .alias("districts"))
    heat = district_heat(inv, approx).limit(1).select(
        F.col("district").alias("hottest_district"), F.col("mean_intensity").alias("hottest_score"))
    return one_row(stores, cases, heat)


def one_row(*frames: DataFrame) -> DataFrame:
    """Side by side columns of frames with at most one row each.

    A union of the frames (each padded with NULL columns) aggregated with
    ``max``: no join, so no keyless (nested-loop) join in the plan.
    """
    names = [c for f in frames for c in f.columns]
    types = {c: t for f in frames for c, t in f.dtypes}
    padded = [f.select(*[F.col(c) if c in f.columns else F.lit(None).cast(types[c]).alias(c) for c in names])
              for f in frames]
    u = padded[0]
    for p in padded[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.max(c).alias(c) for c in names])


def district_summary(visible: DataFrame, inventory: DataFrame) -> DataFrame:
    """Places vs cases per known district (full outer, missing = 0)."""
    vd = visible.select("store_id", "district")
    inv = inventory.join(vd.select("store_id").distinct(), "store_id", "left_semi")
    a = vd.groupBy("district").agg(F.countDistinct("store_id").cast("long").alias("stores"))
    b = inv.filter(valid_district()).groupBy("district").agg(
        F.countDistinct("review_id").cast("long").alias("cases"))
    out = a.join(b, "district", "full").na.fill({"stores": 0, "cases": 0})
    return (out.filter(valid_district())
            .orderBy(F.col("cases").desc(), F.col("stores").desc(), F.col("district").asc()))


def region_means(df: DataFrame, keys=("city", "district"), score: str = "intensity",
                 key: str = "store_id") -> DataFrame:
    """Mean score and row count per (city, district), label = city+district."""
    out = df.groupBy(*keys).agg(F.avg(score).alias("mean_intensity"),
                                F.count(key).cast("long").alias("stores"))
    return (out.withColumn("region", F.concat(*[F.coalesce(F.col(k), F.lit("")) for k in keys]))
            .orderBy(F.col("mean_intensity").desc_nulls_last(), F.col("region").asc()))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each non-NULL value, most frequent first."""
    return (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).cast("long").alias("count"))
            .orderBy(F.col("count").desc(), F.col("value").asc()))


def buckets(df: DataFrame, col: str, edges=K.INTENSITY_EDGES, labels=K.INTENSITY_LABELS) -> DataFrame:
    """Right-closed bins ``(e0, e1], (e1, e2] ...`` with empty bins kept.

    Values outside every bin (and NULLs) are not counted.  The bin table is a
    literal of ``len(labels)`` rows built on the executors (no driver data).
    """
    v = F.col(col).cast("double")
    expr = None
    for i, lab in enumerate(labels):
        cond = (v > edges[i]) & (v <= edges[i + 1])
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    counted = df.select(expr.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).cast("long").alias("count"))
    spark = df.sparkSession
    table = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(lab).alias("bucket")) for i, lab in enumerate(labels)])))
    return (table.join(counted, "bin", "left").select("bin", "bucket", F.coalesce("count", F.lit(0)).alias("count"))
            .orderBy("bin"))


def progress_counts(reviews: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row: reviews, with reply, analysed, pending, analysis rows.

    Membership inside the conditional counts is a left join to the distinct
    analysed ids (a flag), not a correlated ``IN``.
    """
    done = analyses.select("review_id").distinct().withColumn("_done", F.lit(True))
    r = reviews.select("review_id", "owner_reply").join(done, "review_id", "left")
    replied = raw_nonblank("owner_reply")
    counts = r.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(replied).alias("with_reply"),
        F.count_if(replied & F.col("_done").isNotNull()).alias("analysed"),
        F.count_if(replied & F.col("_done").isNull()).alias("pending"))
    total = analyses.agg(F.count(F.lit(1)).alias("analysis_rows"))
    return one_row(counts, total)


def flag_counts(df: DataFrame, flags=("blocked", "skip_review_fetch")) -> DataFrame:
    """Total and per-flag counts in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags])


def role_tag_counts(df: DataFrame, roles: dict) -> DataFrame:
    """Long table (role, tag, count) from several tag columns."""
    cols = list(roles.values())
    long = df.select(*cols).unpivot([], cols, "column", "tag")
    mapping = F.create_map(*[x for role, c in roles.items() for x in (F.lit(c), F.lit(role))])
    return (long.filter(F.col("tag").isNotNull())
            .groupBy(mapping[F.col("column")].alias("role"), "tag")
            .agg(F.count(F.lit(1)).cast("long").alias("count")))


def map_extent(df: DataFrame, lat: str = "lat", lng: str = "lng", weight: str | None = "intensity") -> DataFrame:
    """Centroid, bounding box, row count and total weight."""
    aggs = [F.avg(lat).alias("center_lat"), F.avg(lng).alias("center_lng"),
            F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"),
            F.min(lng).alias("min_lng"), F.max(lng).alias("max_lng"),
            F.count(F.lit(1)).alias("points")]
    if weight:
        aggs.append(F.sum(weight).alias("weight"))
    return df.agg(*aggs)


def salvage_summary(results: DataFrame) -> DataFrame:
    """Attempted runs, ingested runs, raw rows of the ingested ones."""
    return results.agg(F.count(F.lit(1)).alias("attempted"),
                       F.count_if(F.col("ingested")).alias("ingested"),
                       F.coalesce(F.sum(F.when(F.col("ingested"), F.col("raw_count"))), F.lit(0))
                       .cast("long").alias("total_raw"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-blank values."""
    return df.select(F.col(col).alias("value")).filter(py_nonblank("value")).distinct().orderBy("value")


def case_count(cases: DataFrame, key: str | None = "place_id") -> DataFrame:
    """Scored case count per place (or in total with ``key=None``)."""
    if key is None:
        return cases.agg(F.count(F.lit(1)).alias("cases"))
    return cases.groupBy(key).agg(F.count(F.lit(1)).alias("cases"))


STAR_COLUMNS = ("one_star", "two_star", "three_star", "four_star", "five_star")


def rating_histogram(places: DataFrame, key: str = "place_id") -> DataFrame:
    """Per unblocked place the count and share of each star level."""
    p = places.filter(~F.col("blocked"))
    total = sum((F.coalesce(F.col(c), F.lit(0)).cast("long") for c in STAR_COLUMNS), F.lit(0))
    long = p.select(key, total.alias("_total"), F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("stars"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("count"))
        for i, c in enumerate(STAR_COLUMNS)])))
    return long.select(
        key, "stars", "count",
        F.when(F.col("_total") > 0, F.round(F.col("count") / F.col("_total"), 6)).otherwise(F.lit(0.0))
        .alias("share"))
