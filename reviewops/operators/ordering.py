"""Best row per key, dedupe, rankings, paging and top-k."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from reviewops import schemas as K
from reviewops.functions.text import col_, sql_nonblank
from reviewops.functions.values import now_col
from reviewops.operators.best import sort_key
from reviewops.operators.filters import scored_cases


def _order_cols(order: Sequence) -> list[Column]:
    """Sort columns; a key is a name, a Column or (name, "asc" | "desc"[, "nulls_first" | "nulls_last"])."""
    return [getattr(F.col(o[0]), "_".join(_direction(o)))() if isinstance(o, tuple) else col_(o) for o in order]


def _direction(o: tuple) -> tuple[str, str]:
    way = o[1] if len(o) > 1 else "asc"
    return way, o[2] if len(o) > 2 else ("nulls_first" if way == "asc" else "nulls_last")


def _past(order: Sequence, after: Sequence) -> Column:
    """Rows that sort after the row whose keys are ``after``; null keys keep their place in the order."""
    cond, same = F.lit(False), F.lit(True)
    for o, value in zip(order, after, strict=True):
        if isinstance(o, Column):
            raise ValueError("a keyset page takes names or (name, direction, nulls), not Columns")
        o = o if isinstance(o, tuple) else (o,)
        (way, nulls), key = _direction(o), F.col(o[0])
        if value is None:
            past = key.isNotNull() if nulls == "nulls_first" else F.lit(False)
        else:
            past = F.coalesce(key < F.lit(value) if way == "desc" else key > F.lit(value), F.lit(nulls == "nulls_last"))
        cond, same = cond | (same & past), same & key.eqNullSafe(F.lit(value))
    return cond


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """one row per key, the first by ``order`` (PostgreSQL DISTINCT ON).

    ``row_number() == 1`` is planned as a WindowGroupLimit: every task keeps
    only its best row per key before the shuffle, so a hot key costs one row
    per task, not all its rows.
    """
    w = Window.partitionBy(*keys).orderBy(*_order_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def dedupe_first(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """keep the first row per key in input order (explicit ``seq``).

    Rows with a missing / empty key are dropped (the reference counts them as
    skipped).  Uses ``min_by(struct(row), seq)``: a partial aggregate, safe for
    hot keys.
    """
    present = None
    for k in keys:
        ok = F.coalesce(F.col(k).cast("string"), F.lit("")) != ""
        present = ok if present is None else (present & ok)
    cols = df.columns
    return (df.filter(present).groupBy(*keys)
            .agg(F.min_by(F.struct(*cols), F.col(seq)).alias("_r"))
            .select(*[F.col(f"_r.{c}").alias(c) for c in cols]))


def last_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """the last row per key by ``seq`` (a later row overwrites)."""
    present = None
    for k in keys:
        ok = F.coalesce(F.col(k).cast("string"), F.lit("")) != ""
        present = ok if present is None else (present & ok)
    cols = df.columns
    return (df.filter(present).groupBy(*keys)
            .agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_r"))
            .select(*[F.col(f"_r.{c}").alias(c) for c in cols]))


# Five ranking boards: (score column, ascending, extra filter)
BOARDS = {
    "hottest": ("intensity", False),
    "fiercest_owner": ("max_owner_score", False),
    "angriest_guest": ("review_score", False),
    "most_battles": ("owner_replies", False),
    "lowest_rating": ("google_score", True),
}


def ranking(df: DataFrame, board: str, limit: int | None = 30) -> DataFrame:
    """a ranking board over visible places.

    Primary score (NULLs dropped), then for the owner board the mean owner
    score, then case count desc, then place id."""
    score, ascending = BOARDS[board]
    src = df.filter(F.col(score).isNotNull())
    if board == "fiercest_owner":
        src = src.filter(F.col("has_ai") & (F.col(score) > 0))
    elif board in ("hottest", "angriest_guest"):
        src = src.filter(F.col("has_ai"))
    order = [F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()]
    if board == "fiercest_owner":
        order.append(F.col("owner_score").desc_nulls_last())
    order += [F.col("db_review_count").desc_nulls_last(), F.col("store_id").asc()]
    out = src.orderBy(*order)
    return out if limit is None else out.limit(max(1, int(limit)))


def rank_split(df: DataFrame, board: str, podium: int = 3, rest: int = 27) -> DataFrame:
    """top ``podium + rest`` of a board with rank and tier (podium/list).

    The board is cut to its top rows first; ranks are then numbered on those
    few rows only."""
    top = ranking(df, board, podium + rest)
    score, ascending = BOARDS[board]
    order = [(score, "asc" if ascending else "desc", "nulls_last")]
    if board == "fiercest_owner":
        order.append(("owner_score", "desc", "nulls_last"))
    order += [("db_review_count", "desc", "nulls_last"), ("store_id", "asc", "nulls_last", "str")]
    # number the (at most podium + rest) rows inside one sorted array: no
    # window over an unpartitioned frame
    cols = top.columns
    arr = top.agg(F.sort_array(F.collect_list(F.struct(sort_key(order).alias("k"),
                                                      F.struct(*cols).alias("r")))).alias("_a"))
    ranked = arr.select(F.posexplode("_a").alias("_pos", "_e")).select(
        *[F.col(f"_e.r.{c}").alias(c) for c in cols], (F.col("_pos") + 1).alias("rank"))
    return ranked.withColumn("tier", F.when(F.col("rank") <= podium, "podium").otherwise("list"))


def _backwards(order: Sequence) -> list[Column]:
    """Sort columns of the reversed order."""
    out = []
    for o in order:
        if isinstance(o, Column):
            raise ValueError("a clamped page takes names or (name, direction, nulls), not Columns")
        o = o if isinstance(o, tuple) else (o,)
        way, nulls = _direction(o)
        out.append(getattr(F.col(o[0]), f"{'asc' if way == 'desc' else 'desc'}_{'nulls_last' if nulls == 'nulls_first' else 'nulls_first'}")())
    return out


def page(df: DataFrame, order: Sequence, page_no: int = 1, size: int = K.PAGE_SIZE_MAX,
         max_size: int | None = K.PAGE_SIZE_MAX, after: Sequence | None = None, clamp_to_last: bool = False):
    """one page and the total row count.

    ``page_no`` and ``size`` count from 1; a size over ``max_size`` (none, if
    None) is cut to it with a warning.  With ``after`` (the sort values of the last row seen,
    None for null) the page is taken by keyset instead of offset, which stays
    cheap for deep pages.  With ``clamp_to_last`` a page past the end shows the
    last page: it is read from the end of the order, as the first rows of the
    reversed one, and as many of them as the last page has are kept.  Only rows
    of pages are held, the table is neither numbered nor copied.
    Returns ``(page DF, total DF)``.
    """
    if max_size is not None and size > max_size:
        warnings.warn(f"page size {size} cut to {max_size}", stacklevel=2)
        size = max_size
    size = max(1, int(size))
    page_no = max(1, int(page_no))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    cols = _order_cols(order)
    if after is not None:
        return df.filter(_past(order, after)).orderBy(*cols).limit(size), total
    here = df.orderBy(*cols).offset((page_no - 1) * size).limit(size)
    if not clamp_to_last:
        return here, total
    rows = total.scalar()
    last = df.orderBy(*_backwards(order)).limit(size)
    # the page asked for begins past the end: the last page has the rest of the division, or a full page
    some = F.when(rows % size == 0, F.lit(size)).otherwise(rows % size)
    row = F.struct(*df.columns)
    kept = last.agg(F.collect_list(row).alias("a")).select(F.inline(F.slice("a", F.lit(1), some.cast("int"))))
    past = kept.filter(rows <= F.lit((page_no - 1) * size))
    return here.unionByName(past).orderBy(*cols), total


def last_page(total: int, size: int) -> int:
    """The page number a request is clamped to (``page`` beyond the end)."""
    return max(1, -(-int(total) // max(1, int(size))))


def top_daily(reviews: DataFrame, analyses: DataFrame, now) -> DataFrame:
    """the one case scraped since yesterday's midnight with the highest
    score sum (ties: review id).  Its texts are those that were analysed, where
    the analyses hold them."""
    midnight = F.date_trunc("day", now_col(now)).cast("timestamp_ntz")
    since = midnight - F.make_dt_interval(F.lit(1))
    told = {"review_text": "review_text", "owner_reply": "owner_text"}
    texts = {name: F.col(c) for name, c in told.items() if c in analyses.columns}
    a = analyses.select("review_id", "review_score", "owner_score", "pr_reply", "review_summary", *[c.alias(name) for name, c in texts.items()])
    r = reviews.filter(F.col("scraped_at") >= since).select(
        "review_id", "place_id", *[c for c in told if c not in texts], "review_url", "scraped_at")
    j = a.join(r, "review_id", "inner")
    return (j.orderBy((F.col("review_score") + F.col("owner_score")).desc_nulls_last(),
                      F.col("review_id").asc()).limit(1))


def top_cases_per_place(reviews: DataFrame, analyses: DataFrame, k: int = 20) -> DataFrame:
    """F8: the ``k`` most intense scored cases of every place at once."""
    cases = scored_cases(reviews, analyses).withColumn(
        "intensity", (F.col("review_score") + F.col("owner_score")) / F.lit(2.0))
    w = Window.partitionBy("place_id").orderBy(F.col("intensity").desc_nulls_last(),
                                               F.col("published_at").desc_nulls_last(),
                                               F.col("review_id").asc())
    return (cases.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, int(k)))
            .select("review_id", "place_id", "review_text", "stars", "review_url", "published_at",
                    "likes_count", "owner_reply", F.col("review_score").alias("guest_score"), "owner_score",
                    "intensity", "rank"))


def reply_examples(places: DataFrame, reviews: DataFrame, analyses: DataFrame,
                   limit: int = 20) -> DataFrame:
    """most intense cases that already have a suggested reply."""
    from reviewops.operators.joins import in_city_col
    p = places.filter(~F.col("blocked") & in_city_col()).select("place_id", F.col("title").alias("store_name"))
    a = analyses.filter(sql_nonblank("pr_reply")).select(
        "review_id", "place_id", "pr_reply", F.col("review_score").alias("guest_score"), "owner_score")
    r = reviews.filter(F.col("stars") <= 2).select("review_id", "review_text", "owner_reply", "review_url")
    j = a.join(r, "review_id", "inner").join(p, "place_id", "inner")
    return (j.orderBy(F.greatest("guest_score", "owner_score").desc_nulls_last(), F.col("review_id").asc())
            .limit(max(1, int(limit))))


def latest_runs(log: DataFrame, n: int = 15) -> DataFrame:
    """newest ``n`` log rows with a short start time."""
    return (log.orderBy(F.col("id").desc_nulls_last()).limit(max(1, int(n)))
            .select("id", "pipeline", "status", "items_count", "run_id",
                    F.date_format("started_at", "MM-dd HH:mm").alias("started")))


def random_case(df: DataFrame, key: str, n: int = 1, seed: int = 7) -> DataFrame:
    """``n`` random rows, those with the smallest keyed hash of ``key``.

    The same seed gives the same rows however the table is partitioned, and
    samples of parts merge into the sample of the whole (each task keeps n rows)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(max(1, int(n)))
