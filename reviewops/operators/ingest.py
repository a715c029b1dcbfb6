"""Composite ingest of a raw review batch (I8, I9) and its counters.

A batch is parsed, deduplicated and classified once and stored; all outputs
come from that frame.  ``ingest_delta`` gives what a batch adds, ``ingest_batch``
merges it into the tables as frames, and ``streaming.streams.stream_ingest``
commits it to stored tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions.values import now_col
from reviewops.operators.filters import KEPT_REASONS, review_reason
from reviewops.operators.merge import latest_per_key, mark_skip, merge_upsert
from reviewops.operators.oplog import log_rows
from reviewops.operators.quality import generic_reply
from reviewops.operators.setops import ingested_run_ids
from reviewops.sources.rows import review_row
from reviewops.sources.tables import stored

DROPPED_AT_SOURCE = ("missing_review_id", "missing_place_id", "not_low_star_review")


def classify_raw(raw: DataFrame, seq: str = "seq", templates=K.GENERIC_REPLY_TEMPLATES,
                 detect_generic: bool = True, batch: Sequence[str] = ()) -> DataFrame:
    """One row per review id (and ``batch`` columns), the first by ``seq``, with
    the first failing rule as ``reason`` and the number of raw rows it stands
    for as ``seen``.

    Raw rows without an id are kept as one row with reason ``missing_review_id``,
    so that the counters need no second look at the raw rows.
    ``detect_generic=False`` skips the similarity rule."""
    cols = raw.columns
    kept = (raw.groupBy(*batch, F.coalesce(F.col("reviewId"), F.lit("")).alias("_id"))
            .agg(F.min_by(F.struct(*cols), F.col(seq)).alias("_r"), F.count(F.lit(1)).alias("seen"))
            .select(*[F.col(f"_r.{c}").alias(c) for c in cols], "seen"))
    generic = None
    if detect_generic:
        kept = generic_reply(kept, "responseFromOwnerText", templates, out="_generic")
        generic = "_generic"
    reason = review_reason(ids=("reviewId", "placeId"), stars="stars", text="text",
                           reply="responseFromOwnerText", generic=generic)
    return kept.withColumn("reason", reason)


def etl_stats(classified: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Counters of a batch (or of each ``batch``) from ``classify_raw`` alone.

    ``skipped`` = dedupe + invalid + non-low-star + filtered; raw rows without
    an id count as dedupe-skipped."""
    r, present = F.col("reason"), F.col("reason") != "missing_review_id"
    c = classified.groupBy(*batch).agg(
        F.coalesce(F.sum("seen"), F.lit(0)).cast("long").alias("raw_count"),
        F.count_if(present).alias("_kept"),
        F.count_if(r == "missing_place_id").alias("invalid_skipped"),
        F.count_if(r == "not_low_star_review").alias("non_low_star_skipped"),
        F.count_if(r.isin("empty_review_text", "generic_pr_reply")).alias("filter_skipped"),
        F.count_if(~r.isin(*DROPPED_AT_SOURCE)).alias("source_count"),
        F.count_if(r.isin(*KEPT_REASONS)).alias("review_count"),
        F.countDistinct(F.when(r == "generic_pr_reply", F.col("placeId"))).alias("generic_pr_store_count"))
    c = c.withColumn("dedupe_skipped", F.col("raw_count") - F.col("_kept")).drop("_kept")
    return c.withColumn("skipped", F.col("dedupe_skipped") + F.col("invalid_skipped")
                        + F.col("non_low_star_skipped") + F.col("filter_skipped"))


@dataclass
class IngestResult:
    source: DataFrame    # raw-first landing rows (review_id, place_id, raw_json, scraped_at)
    review: DataFrame    # new review table version
    places: DataFrame    # new place table version (generic places flagged)
    changed: DataFrame   # place ids whose skip flag flipped
    stats: DataFrame     # E15 counters (one row; salvage: one per run)
    log: DataFrame       # execution-log row (salvage: one per run)


@dataclass
class IngestDelta:
    source: DataFrame    # landed raw rows of the batch, one per review id
    review: DataFrame    # review rows of the batch, one per review id
    generic: DataFrame   # place ids with a generic reply
    stats: DataFrame
    log: DataFrame


def ingest_delta(raw: DataFrame, now, allowed: DataFrame | None = None, seq: str = "seq",
                 pipeline: str = "review_initial", run_id: str | None = None,
                 templates=K.GENERIC_REPLY_TEMPLATES, detect_generic: bool = True) -> IngestDelta:
    """What a batch adds: allow-list -> dedupe -> classify (stored once) -> rows, counters, log row."""
    n = now_col(now)
    if allowed is not None:
        raw = raw.join(allowed.select(F.col("place_id").alias("placeId")).distinct(), "placeId", "left_semi")
    classified = stored(classify_raw(raw, seq, templates, detect_generic), "classified")
    stats = etl_stats(classified)
    log = log_rows(stats, pipeline, "success", run_id=run_id, items=F.col("raw_count"), started=n,
                   finished=n, response=F.struct(*stats.columns))
    return IngestDelta(landed(classified, n), kept_reviews(classified, n), generic_place_ids(classified), stats, log)


def landed(classified: DataFrame, now, keep: Sequence[str] = ()) -> DataFrame:
    rows = classified.filter(~F.col("reason").isin(*DROPPED_AT_SOURCE))
    return rows.select(F.col("reviewId").alias("review_id"), F.col("placeId").alias("place_id"), "raw_json", now.alias("scraped_at"), *keep)


def kept_reviews(classified: DataFrame, now, keep: Sequence[str] = ()) -> DataFrame:
    return review_row(classified.filter(F.col("reason").isin(*KEPT_REASONS)), now, keep)


def generic_place_ids(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("reason") == "generic_pr_reply").select(F.col("placeId").alias("place_id")).distinct()


def ingest_batch(raw: DataFrame, state: DataFrame, places: DataFrame, now, allowed: DataFrame | None = None,
                 seq: str = "seq", pipeline: str = "review_initial", run_id: str | None = None,
                 templates=K.GENERIC_REPLY_TEMPLATES, detect_generic: bool = True,
                 landing: DataFrame | None = None) -> IngestResult:
    """I8: allow-list -> dedupe -> validate -> classify -> raw upsert ->
    review upsert -> mark generic places -> stats -> log row.

    ``raw`` is parsed raw review JSON (``schemas.RAW_REVIEW`` fields, plus
    ``raw_json`` and ``seq``); ``state`` is the current review table and
    ``landing`` the current landed raw rows (None: none yet).
    """
    d = ingest_delta(raw, now, allowed, seq, pipeline, run_id, templates, detect_generic)
    source = d.source if landing is None else merge_upsert(landing, d.source, ["review_id"], ["scraped_at"])
    review = merge_upsert(state, d.review.select(*state.columns), ["review_id"], ["scraped_at"])
    new_places, changed = mark_skip(places, d.generic)
    return IngestResult(source, review, new_places, changed, d.stats, d.log)


def salvage_ingest(runs: DataFrame, raw: DataFrame, state: DataFrame, places: DataFrame, now,
                   seq: str = "seq", pipeline: str = "review_initial", log: DataFrame | None = None,
                   landing: DataFrame | None = None, order: Sequence[str] = ("finished_at",),
                   templates=K.GENERIC_REPLY_TEMPLATES, detect_generic: bool = True) -> IngestResult:
    """Ingest the items of finished runs, run after run (no allow-list).

    Only runs with status SUCCEEDED and a dataset id count, and none that
    ``log`` has as a success.  ``raw`` rows carry the ``dataset_id`` they came
    from.  Within a run the first item of a review id by ``seq`` counts; of
    several runs the last by ``order`` (those of its columns that ``runs``
    has), run id and dataset id, as if each had been ingested after the other.
    All runs are folded in one pass: a key per (run, review), then the last
    run of each review.  Counters and log have one row per run; the log rows
    say ``salvaged`` and carry run id (null where ``runs`` has none), dataset
    id and item count, so D11 leaves the runs out from then on.
    """
    n = now_col(now)
    ok = runs.filter((F.col("status") == "SUCCEEDED") & F.col("dataset_id").isNotNull() & (F.col("dataset_id") != ""))
    run = ok.select((F.col("run_id") if "run_id" in runs.columns else F.lit(None).cast("string")).alias("run_id"), "dataset_id",
                    F.struct(*[c for c in order if c in runs.columns], *[c for c in ("run_id", "dataset_id") if c in runs.columns]).alias("_turn"))
    run = run.groupBy("run_id", "dataset_id").agg(F.max("_turn").alias("_turn"))
    if log is not None:
        run = run.join(ingested_run_ids(log), "run_id", "left_anti")
    of = ["run_id", "dataset_id"]
    classified = stored(classify_raw(raw.drop("run_id", "_turn").join(run, "dataset_id"), seq, templates, detect_generic, of), "salvaged")

    last = lambda rows: latest_per_key(rows, ["review_id"], ["_turn"]).drop("_turn")
    fresh, found = last(kept_reviews(classified, n, ["_turn"])), last(landed(classified, n, ["_turn"]))
    review = merge_upsert(state, fresh.select(*state.columns), ["review_id"], ["scraped_at"])
    source = found if landing is None else merge_upsert(landing, found, ["review_id"], ["scraped_at"])
    new_places, changed = mark_skip(places, generic_place_ids(classified))
    stats = etl_stats(classified, of)
    # a run without items is done as well
    ran = run.alias("r").join(stats.select(F.col("run_id").alias("_run"), F.col("dataset_id").alias("_set"), F.col("raw_count").alias("items")),
                              F.col("_run").eqNullSafe(F.col("r.run_id")) & (F.col("_set") == F.col("r.dataset_id")), "left")
    ran = ran.select("run_id", "dataset_id", F.coalesce("items", F.lit(0)).alias("items"))
    done = log_rows(ran, pipeline, "success", run_id=F.col("run_id"), dataset_id=F.col("dataset_id"), items=F.col("items"),
                    started=n, finished=n, request=F.struct(F.lit(True).alias("salvaged"), "dataset_id"),
                    response=F.struct("dataset_id", F.col("items").alias("item_count"), F.lit("SUCCEEDED").alias("run_status")))
    return IngestResult(source, review, new_places, changed, stats, done)
