"""Owner-reply recheck: due rows, batching inputs, state updates and the whole
run (C9, D12, I5; I4 is ``functions.scores.initial_recheck``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions.text import py_nonblank
from reviewops.functions.values import now_col
from reviewops.operators.ingest import IngestResult, ingest_delta
from reviewops.operators.joins import eligible
from reviewops.operators.merge import mark_skip, merge_upsert
from reviewops.operators.oplog import log_rows
from reviewops.operators.ordering import last_wins
from reviewops.sources.tables import stored


def due_rechecks(reviews: DataFrame, places: DataFrame, now) -> DataFrame:
    """Reviews whose next check is due at ``now`` on eligible places."""
    n = now_col(now)
    r = reviews.filter(F.col("owner_reply_recheck") & F.col("next_check_at").isNotNull()
                       & (F.col("next_check_at").cast("timestamp_ntz") <= n))
    return (r.join(eligible(places).select("place_id"), "place_id", "inner")
            .select("review_id", "place_id", "published_at", "owner_reply", "owner_reply_recheck",
                    "next_check_at"))


def due_by_place(due: DataFrame, eligible_ids: DataFrame) -> DataFrame:
    """Due reviews of eligible places, long form, with each place's due
    count.  The per-place list stays long (one row per review): a hot place
    is never gathered into one row or one task."""
    d = due.join(eligible_ids.select("place_id").distinct(), "place_id", "left_semi")
    counts = d.groupBy("place_id").agg(F.count(F.lit(1)).alias("due_count"))
    return d.select("place_id", "review_id", "published_at").join(counts, "place_id")


def advance_recheck(due: DataFrame, fresh: DataFrame, generic: DataFrame, now,
                    seq: str = "seq", after_days: int = K.RECHECK_AFTER_DAYS,
                    max_age_days: int = K.RECHECK_MAX_AGE_DAYS) -> DataFrame:
    """Next recheck state of each due review after a recheck fetch.

    (1) place flagged generic -> stop; (2) the fetch found a reply -> stop;
    (3) ``now`` strictly later than publication + 10 days -> stop; else look
    again in 2 days.  ``fresh`` holds raw items (``reviewId``,
    ``responseFromOwnerText``, ``seq``); a later item overwrites an earlier
    one (F3).  Missing publication time counts as ``now``.
    """
    n = now_col(now)
    latest = last_wins(fresh.select("reviewId", "responseFromOwnerText", seq), ["reviewId"], seq)
    f = latest.select(F.col("reviewId").alias("review_id"), F.col("responseFromOwnerText").alias("_reply"))
    g = generic.select("place_id").distinct().withColumn("_generic", F.lit(True))
    j = due.select("review_id", "place_id", "published_at").join(f, "review_id", "left").join(g, "place_id", "left")
    pub = F.coalesce(F.col("published_at").cast("timestamp_ntz"), n)
    stop = (F.coalesce(F.col("_generic"), F.lit(False)) | py_nonblank("_reply")
            | (n > pub + F.make_dt_interval(F.lit(max_age_days))))
    return j.select("review_id", (~stop).alias("owner_reply_recheck"), n.alias("owner_reply_recheck_at"),
                    F.when(~stop, n + F.make_dt_interval(F.lit(after_days))).alias("next_check_at"))


STATE = ("owner_reply_recheck", "owner_reply_recheck_at", "next_check_at")


def apply_recheck(reviews: DataFrame, updates: DataFrame) -> DataFrame:
    """Write I5's three columns into the review table (update on match only).

    One left join; of a review that ``updates`` repeats, the latest state counts.
    """
    new = updates.groupBy("review_id").agg(F.max(F.struct("owner_reply_recheck_at", "owner_reply_recheck", "next_check_at")).alias("_u"))
    j = reviews.join(new, "review_id", "left")
    return j.select(*[F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) if c in STATE else F.col(c)
                      for c in reviews.columns])


def recheck_ingest(raw: DataFrame, state: DataFrame, places: DataFrame, now, due: DataFrame | None = None, seq: str = "seq",
                   pipeline: str = "review_daily", run_id: str | None = None, landing: DataFrame | None = None,
                   templates=K.GENERIC_REPLY_TEMPLATES, detect_generic: bool = True) -> IngestResult:
    """Recheck run: ingest what was fetched for the due places (I8), advance
    the due reviews (I5), write their states back, log.

    ``due`` are the reviews the fetch was made for (None: all due at ``now``,
    C9).  Raw rows of other places are left out.  The states go over what the
    ingest itself set for a due review.  The log row's response tells the
    counters and ``recheck_rows_updated``.
    """
    due = due_rechecks(state, places, now) if due is None else due
    wanted = due.select(F.col("place_id").alias("placeId")).distinct()
    raw = raw.join(wanted, "placeId", "left_semi")
    d = ingest_delta(raw, now, None, seq, pipeline, run_id, templates, detect_generic)
    updates = stored(advance_recheck(due, raw, d.generic, now, seq), "recheck")
    merged = merge_upsert(state, d.review.select(*state.columns), ["review_id"], ["scraped_at"])
    source = d.source if landing is None else merge_upsert(landing, d.source, ["review_id"], ["scraped_at"])
    new_places, changed = mark_skip(places, d.generic)

    done = updates.join(state.select("review_id"), "review_id", "left_semi").agg(F.count(F.lit(1)).alias("recheck_rows_updated"))
    told = d.stats.unionByName(done, allowMissingColumns=True)
    told = told.agg(*[F.max(c).alias(c) for c in told.columns])
    n = now_col(now)
    log = log_rows(told, pipeline, "success", run_id=run_id, items=F.col("raw_count"), started=n, finished=n,
                   response=F.struct(*told.columns))
    return IngestResult(source, apply_recheck(merged, updates), new_places, changed, told, log)
