"""Pluggable batch scoring of (customer text, owner reply) pairs (K1, K3, K4).

The scorer is a user function ``pd.DataFrame -> pd.DataFrame`` called on
chunks of ``batch`` rows inside ``mapInPandas`` (Arrow batches, one Python
worker per task).  A failing chunk is isolated: its rows come back with
``status = 'failed: ...'`` and NULL scores, the rest of the job goes on, and
a rerun picks the failed rows up again through D9 (``resume_anti``).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewops import schemas as K
from reviewops.functions.text import sql_nonblank

SCORED = T.StructType(K.SCORER_OUTPUT.fields + [
    T.StructField("batch_id", T.StringType()), T.StructField("status", T.StringType())])

_OUT_COLS = [f.name for f in K.SCORER_OUTPUT.fields]


def score_pairs(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], batch: int = K.BATCH_SIZE,
                max_failures: int | None = None) -> DataFrame:
    """K1: score ``(review_id, place_id, review_text, owner_reply)`` rows.

    ``fn`` gets up to ``batch`` rows and returns one row per input id with the
    ``schemas.SCORER_OUTPUT`` columns.  ``max_failures`` (per task) turns
    isolation off beyond that many failed chunks by raising.
    """
    cols = ["review_id", "place_id", "review_text", "owner_reply"]

    def run(it):
        import zlib
        failures = 0
        for pdf in it:
            for start in range(0, len(pdf), batch):
                chunk = pdf.iloc[start:start + batch].reset_index(drop=True)
                ids = "|".join(map(str, chunk["review_id"]))
                batch_id = f"{zlib.crc32(ids.encode()):08x}-{len(chunk)}"
                try:
                    res = fn(chunk.copy())
                    res = res.reindex(columns=_OUT_COLS)
                    res["batch_id"] = batch_id
                    res["status"] = "SUCCESS"
                except Exception as exc:  # noqa: BLE001 - isolate the chunk
                    failures += 1
                    if max_failures is not None and failures > max_failures:
                        raise
                    res = pd.DataFrame({c: [None] * len(chunk) for c in _OUT_COLS})
                    res["review_id"] = chunk["review_id"].values
                    res["place_id"] = chunk["place_id"].values
                    res["batch_id"] = batch_id
                    res["status"] = f"failed: {type(exc).__name__}: {exc}"[:500]
                for c in ("review_score", "owner_score"):
                    res[c] = pd.to_numeric(res[c], errors="coerce").astype("Int32")
                yield res

    return df.select(*cols).mapInPandas(run, SCORED)


HOT_WORDS = ("不", "爛", "差", "!", "?", "never", "worst", "bad", "no")


def keyword_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in scorer for tests and the bench: scores from
    text length and a few loaded words; summaries are the first 30 chars."""
    def heat(text) -> int:
        t = str(text or "")
        return int(min(10, max(1, 1 + len(t) // 80 + sum(t.lower().count(w) for w in HOT_WORDS))))
    out = pd.DataFrame({
        "review_id": pdf["review_id"], "place_id": pdf["place_id"],
        "review_text": pdf["review_text"].fillna(""), "owner_text": pdf["owner_reply"].fillna(""),
    })
    out["review_summary"] = out["review_text"].str.slice(0, 30)
    out["owner_summary"] = out["owner_text"].str.slice(0, 30)
    out["review_score"] = [heat(t) for t in out["review_text"]]
    out["owner_score"] = [heat(t) for t in out["owner_text"]]
    tags = list(K.EMOTION_TAGS)
    out["review_sentiment"] = [tags[s % len(tags)] for s in out["review_score"]]
    out["owner_sentiment"] = [tags[s % len(tags)] for s in out["owner_score"]]
    out["pr_reply"] = "謝謝您的回饋"
    return out


def validate_scores(df: DataFrame, tags=K.EMOTION_TAGS, lo: int = 1, hi: int = 10, max_len: int = 30):
    """K3: scorer output contract -> ``(good, quarantine)``.

    Quarantine rows carry ``reason``: the first failed check in the order
    ids, tags, score range, summary length.
    """
    missing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    bad_score = lambda c: F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi)
    long_text = lambda c: F.coalesce(F.length(c), F.lit(0)) > max_len
    reason = (F.when(missing("review_id"), "missing_review_id")
              .when(missing("place_id"), "missing_place_id")
              .when(~F.coalesce(F.col("review_sentiment").isin(*tags), F.lit(False)), "bad_review_sentiment")
              .when(~F.coalesce(F.col("owner_sentiment").isin(*tags), F.lit(False)), "bad_owner_sentiment")
              .when(bad_score("review_score"), "review_score_out_of_range")
              .when(bad_score("owner_score"), "owner_score_out_of_range")
              .when(long_text("review_summary"), "review_summary_too_long")
              .when(long_text("owner_summary"), "owner_summary_too_long"))
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def score_batch_log(scored: DataFrame, batch: str = "batch_id") -> DataFrame:
    """K4: one log row per scorer batch: status, item count, ordered id list
    (at most one batch of ids), and token use when the scorer reports it."""
    aggs = [F.count(F.lit(1)).alias("items_count"), F.sort_array(F.collect_list("review_id")).alias("review_ids"),
            F.max("status").alias("status")]
    if "total_token" in scored.columns:
        aggs.append(F.sum("total_token").alias("total_token"))
    return scored.groupBy(batch).agg(*aggs)


def analysable(reviews: DataFrame) -> DataFrame:
    """Rows a scorer may see: a real owner reply (SQL blank test)."""
    return reviews.filter(sql_nonblank("owner_reply"))
