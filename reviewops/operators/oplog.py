"""Run log: append rows, current state per run, salvage candidates
(A5, D11, I6; D10, G2, F12, E18 live with their kinds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewops.functions.values import coalesce_truthy, now_col, safe_float, safe_timestamp
from reviewops.operators.ordering import distinct_on
from reviewops.operators.setops import ingested_run_ids


def _lit_or_col(x, typ: str) -> Column:
    if x is None:
        return F.lit(None).cast(typ)
    if isinstance(x, Column):
        return x.cast(typ)
    return F.lit(x).cast(typ)


def log_rows(df: DataFrame, pipeline, status, run_id=None, dataset_id=None, items=None, started=None,
             finished=None, request=None, response=None, error=None, retry=0, actor=None,
             id_col: str | None = None) -> DataFrame:
    """A5: one execution-log row per input row.

    Arguments are literals or Columns of ``df``; ``request`` / ``response``
    Columns of struct type are serialised to JSON text.  The id is a number:
    ``id_col``, or 63 random bits (a SERIAL has no scalable equivalent).
    """
    def js(x):
        if isinstance(x, Column):
            typ = df.select(x).schema[0].dataType
            nested = isinstance(typ, (T.StructType, T.MapType, T.ArrayType))
            return F.to_json(x) if nested else x.cast("string")
        return _lit_or_col(x, "string")
    return df.select(
        (F.col(id_col).cast("long") if id_col else F.xxhash64(F.expr("uuid()")).bitwiseAND(F.lit((1 << 63) - 1))).alias("id"),
        _lit_or_col(pipeline, "string").alias("pipeline"), _lit_or_col(status, "string").alias("status"),
        F.coalesce(_lit_or_col(items, "int"), F.lit(0)).alias("items_count"),
        _lit_or_col(run_id, "string").alias("run_id"), _lit_or_col(dataset_id, "string").alias("dataset_id"),
        _lit_or_col(actor, "string").alias("actor_name"),
        _lit_or_col(started, "timestamp_ntz").alias("started_at"),
        _lit_or_col(finished, "timestamp_ntz").alias("finished_at"),
        js(request).alias("request_json"), js(response).alias("response_json"),
        _lit_or_col(error, "string").alias("error_msg"),
        F.coalesce(_lit_or_col(retry, "int"), F.lit(0)).alias("retry_count"))


def close_run(log: DataFrame, updates: DataFrame, seq: str = "version") -> DataFrame:
    """Record status changes of runs as appended versions.

    ``updates`` rows carry ``id`` plus any of the log columns; they are
    appended with the next ``version`` of their run, so ``current_runs``
    sees the last state of each run.  The log itself is
    append-only, which keeps writers independent and survives retries.
    """
    base = log if seq in log.columns else log.withColumn(seq, F.lit(0))
    prev = distinct_on(base, ["id"], [F.col(seq).desc()])
    cols = [c for c in base.columns if c != seq]
    merged = updates.alias("u").join(prev.alias("p"), "id", "inner").select(
        "id", *[(F.coalesce(F.col(f"u.{c}"), F.col(f"p.{c}")) if c in updates.columns else F.col(f"p.{c}"))
                .alias(c) for c in cols if c != "id"], (F.col(f"p.{seq}") + 1).alias(seq))
    return base.unionByName(merged.select(*cols, seq))


def current_runs(log: DataFrame, seq: str = "version") -> DataFrame:
    """The latest version of every run id (F1 over the version)."""
    if seq not in log.columns:
        return log
    return distinct_on(log, ["id"], [F.col(seq).desc()]).drop(seq)


def salvageable_runs(runs: DataFrame, log: DataFrame, now, hours: float = 24.0,
                     include_ingested: bool = False) -> DataFrame:
    """Finished runs worth re-ingesting.

    SUCCEEDED, started at or after ``now - hours`` and (unless
    ``include_ingested``) not yet logged as a success.  Field spellings of
    the run listing (snake/camel) are both accepted (B13).
    """
    n = now_col(now)
    cutoff = n - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600.0))
    r = runs.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("run_id"), F.col("status").cast("string").alias("status"),
        safe_timestamp(coalesce_truthy(*[c for c in ("started_at", "startedAt") if c in runs.columns]))
        .alias("started_at"),
        coalesce_truthy(*[c for c in ("default_dataset_id", "defaultDatasetId") if c in runs.columns])
        .alias("dataset_id"),
        safe_float(coalesce_truthy(*[c for c in ("usage_total_usd", "usageTotalUsd") if c in runs.columns]),
                   0.0).alias("cost_usd"))
    r = r.filter((F.col("run_id") != "") & (F.col("status") == "SUCCEEDED")
                 & F.col("started_at").isNotNull() & (F.col("started_at") >= cutoff))
    if not include_ingested:
        r = r.join(ingested_run_ids(log), "run_id", "left_anti")
    return r


def salvage_cost(candidates: DataFrame) -> DataFrame:
    """Total cost already spent on the salvage candidates."""
    return candidates.agg(F.count(F.lit(1)).alias("runs"),
                          F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"))
