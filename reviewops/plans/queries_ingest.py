"""Queries: ingest of raw review batches.

The replies of some raw reviews are set to a template, so that the similarity
rule decides something; SQL meets it by equality, as no other reply comes near
a template.  The ``*_outputs`` queries show all output tables in one long form
(output, key, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.bindings import NOW
from reviewops.operators import joins as D
from reviewops.operators.ingest import classify_raw, etl_stats, ingest_batch, salvage_ingest
from reviewops.operators.recheck import recheck_ingest
from reviewops.plans.queries_streams import stream_view
from reviewops.plans.registry import query
from reviewops.plans.sqltext import py_nonblank, strip
from reviewops.sources.raw import parse_json_column
from reviewops.streaming import streams as J

TEMPLATE = K.GENERIC_REPLY_TEMPLATES[0]
TEMPLATED, WITH = r'"reply ([0-9]*[05])"', f'"{TEMPLATE}"'


def raw_reviews(ev: DataFrame) -> DataFrame:
    return parse_json_column(ev.withColumn("raw_json", F.regexp_replace("raw_json", TEMPLATED, WITH)), "raw_json", K.RAW_REVIEW, once=True)


def state(v) -> DataFrame:
    rv = v["rv"]
    return rv.select("review_id", "place_id", F.lit("unknown").alias("original_language"), "review_text",
                     "published_at", "review_url", F.lit(None).cast("string").alias("review_image_urls"),
                     "likes_count", F.col("stars").cast("double").alias("total_score"), "stars",
                     F.lit(None).cast("timestamp_ntz").alias("owner_reply_date"), "owner_reply", "scraped_at",
                     "owner_reply_recheck", F.lit(None).cast("timestamp_ntz").alias("owner_reply_recheck_at"),
                     "next_check_at")


def flags(v) -> DataFrame:
    return v["st"].select("place_id", "skip_review_fetch")


def landing(v) -> DataFrame:
    """Raw rows that were landed before: some are renewed by the batch."""
    return v["rv"].filter("likes_count < 3").select("review_id", "place_id", F.lit("{}").alias("raw_json"), F.col("published_at").alias("scraped_at"))


REVIEW = ("review_id", "place_id", "stars", "owner_reply_recheck", "next_check_at")
COUNTERS = ("raw_count", "invalid_skipped", "non_low_star_skipped", "filter_skipped", "source_count", "review_count",
            "generic_pr_store_count", "dedupe_skipped", "skipped")
TIME = "yyyy-MM-dd HH:mm:ss"


def outputs(source: DataFrame, review: DataFrame, places: DataFrame, changed: DataFrame, stats: DataFrame, log: DataFrame, of: str) -> DataFrame:
    """All output tables as (output, key, detail); ``of`` names what a row of stats is counted for."""
    def rows(name: str, df: DataFrame, key, *detail) -> DataFrame:
        said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("-")) for c in detail])
        return df.select(F.lit(name).alias("output"), key.alias("key"), said.alias("detail"))

    instant = lambda c: F.date_format(c, TIME)
    return reduce(DataFrame.unionByName, [
        rows("source", source, F.col("review_id"), "place_id", F.length("raw_json"), instant("scraped_at")),
        rows("review", review, F.col("review_id"), "place_id", "stars", "owner_reply_recheck", instant("next_check_at")),
        rows("place", places, F.col("place_id"), "skip_review_fetch"), rows("changed", changed, F.col("place_id")),
        rows("stats", stats, F.col(of) if of in stats.columns else F.lit(of), *COUNTERS),
        rows("log", log, F.coalesce("run_id", "pipeline"), "pipeline", "status", "items_count", "dataset_id", instant("finished_at"))])


def classified_sql(raw: str, batch: str = "") -> str:
    """CTE ``c``: the first raw row of each review id (and batch) of ``raw`` with its reason."""
    of = f"{batch}, " if batch else ""
    field = lambda name: f"json_extract_string(raw_json, '$.{name}')"
    reply = py_nonblank("reply")
    return f"""
  raw AS ({raw}),
  k AS (SELECT {of}{field('reviewId')} AS review_id, arg_min(raw_json, seq) AS raw_json FROM raw
        WHERE coalesce({field('reviewId')}, '') <> '' GROUP BY ALL),
  f AS (SELECT {of}review_id, raw_json, {field('placeId')} AS place_id, coalesce(TRY_CAST({field('stars')} AS INT), 0) AS stars,
          {field('text')} AS body, {field('responseFromOwnerText')} AS reply, CAST({field('publishedAtDate')} AS TIMESTAMP) AS published FROM k),
  c AS (SELECT *, CASE WHEN coalesce(place_id, '') = '' THEN 'missing_place_id' WHEN stars NOT IN (1, 2) THEN 'not_low_star_review'
          WHEN length({strip("coalesce(body, '')")}) < 2 THEN 'empty_review_text' WHEN NOT {reply} THEN 'needs_owner_recheck'
          WHEN reply = '{TEMPLATE}' THEN 'generic_pr_reply' ELSE 'ok' END AS reason,
          NOT ({reply} OR TIMESTAMP '{NOW}' > published + INTERVAL 10 DAY) AS owner_reply_recheck,
          CASE WHEN NOT ({reply} OR TIMESTAMP '{NOW}' > published + INTERVAL 10 DAY) THEN TIMESTAMP '{NOW}' + INTERVAL 2 DAY END AS next_check_at
        FROM f)"""


def stats_sql(batch: str = "") -> str:
    """CTE ``n``: the counters of ``c``, with the raw rows counted from ``raw``."""
    of, same = (f"{batch}, ", f"(SELECT count(*) FROM raw WHERE raw.{batch} = g.{batch})") if batch else ("", "(SELECT count(*) FROM raw)")
    keys = f"(SELECT DISTINCT {batch} FROM raw)" if batch else "(SELECT 1 AS one)"
    on = f"c.{batch} = g.{batch}" if batch else "true"
    return f"""
  n0 AS (SELECT {'g.' + batch + ', ' if batch else ''}any_value({same}) AS raw_count,
      count(reason) FILTER (reason = 'missing_place_id') AS invalid_skipped, count(reason) FILTER (reason = 'not_low_star_review') AS non_low_star_skipped,
      count(reason) FILTER (reason IN ('empty_review_text', 'generic_pr_reply')) AS filter_skipped,
      count(reason) FILTER (reason NOT IN ('missing_place_id', 'not_low_star_review')) AS source_count,
      count(reason) FILTER (reason IN ('ok', 'needs_owner_recheck')) AS review_count,
      count(DISTINCT CASE WHEN reason = 'generic_pr_reply' THEN place_id END) AS generic_pr_store_count, count(reason) AS kept
    FROM {keys} g LEFT JOIN c ON {on} {'GROUP BY g.' + batch if batch else ''}),
  n AS (SELECT * EXCLUDE (kept), raw_count - kept AS dedupe_skipped,
          raw_count - kept + invalid_skipped + non_low_star_skipped + filter_skipped AS skipped FROM n0)"""


REPLACED = f"SELECT seq, regexp_replace(raw_json, '{TEMPLATED}', '{WITH}') AS raw_json FROM ev"
ALLOWED = f"""SELECT * FROM ({REPLACED})
    WHERE json_extract_string(raw_json, '$.placeId') IN (SELECT place_id FROM st WHERE NOT blocked AND NOT skip_review_fetch)"""


def said(*parts: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '-')" for p in parts) + ")"


def outputs_sql(key: str, log: str) -> str:
    """The long form from ``c`` (one row per review by now), ``n`` and a log select."""
    instant = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    now = f"'{NOW}'"
    return f"""
  s AS (SELECT review_id, place_id, raw_json FROM last_source),
  w AS (SELECT review_id, place_id, stars, owner_reply_recheck, next_check_at FROM last_review),
  g AS (SELECT DISTINCT place_id FROM c WHERE reason = 'generic_pr_reply')
SELECT 'source' AS output, review_id AS key, {said("place_id", "length(raw_json)", now)} AS detail FROM s
UNION ALL SELECT 'source', review_id, {said("place_id", "2", instant("published_at"))} FROM rv WHERE likes_count < 3 AND review_id NOT IN (SELECT review_id FROM s)
UNION ALL SELECT 'review', review_id, {said("place_id", "stars", "owner_reply_recheck", instant("next_check_at"))} FROM w
UNION ALL SELECT 'review', review_id, {said("place_id", "stars", "owner_reply_recheck", instant("next_check_at"))} FROM rv WHERE review_id NOT IN (SELECT review_id FROM w)
UNION ALL SELECT 'place', place_id, {said("skip_review_fetch OR place_id IN (SELECT place_id FROM g)")} FROM st
UNION ALL SELECT 'changed', place_id, '' FROM st WHERE NOT skip_review_fetch AND place_id IN (SELECT place_id FROM g)
UNION ALL SELECT 'stats', {key}, {said(*COUNTERS)} FROM n
UNION ALL {log}"""


ONE_BATCH = f""", {classified_sql(ALLOWED)}, {stats_sql()},
  last_source AS (SELECT * FROM c WHERE reason NOT IN ('missing_place_id', 'not_low_star_review')),
  last_review AS (SELECT * FROM c WHERE reason IN ('ok', 'needs_owner_recheck'))"""
REVIEW_SQL = f"""
SELECT {', '.join(REVIEW)} FROM last_review
UNION ALL SELECT {', '.join(REVIEW)} FROM rv WHERE review_id NOT IN (SELECT review_id FROM last_review)"""
BATCH_LOG = f"SELECT 'log', 'review_initial', concat_ws('|', 'review_initial', 'success', raw_count, '-', '{NOW}') FROM n"


@query("etl_stats", f", {classified_sql(REPLACED)}, {stats_sql()} SELECT * FROM n", ("ev",))
def q_etl_stats(v):
    return etl_stats(classify_raw(raw_reviews(v["ev"])))


def batch_result(v):
    return ingest_batch(raw_reviews(v["ev"]), state(v), flags(v), NOW, allowed=D.eligible(v["st"]), landing=landing(v))


@query("ingest_batch", ONE_BATCH + REVIEW_SQL, ("ev", "st", "rv"))
def q_ingest_batch(v):
    return batch_result(v).review.select(*REVIEW)


@query("ingest_outputs", f"{ONE_BATCH}, {outputs_sql("'batch'", BATCH_LOG)}", ("ev", "st", "rv"))
def q_ingest_outputs(v):
    r = batch_result(v)
    return outputs(r.source, r.review, r.places, r.changed, r.stats, r.log, "batch")


RUNS_SQL = f"""
  run AS (SELECT concat('ds', k) AS dataset_id, concat('run', k) AS run_id, (k * 5) % 7 AS turn FROM range(7) t(k)
          WHERE k <> 3 AND concat('run', k) NOT IN (SELECT run_id FROM lg WHERE status = 'success' AND run_id IS NOT NULL)),
  {classified_sql(f"SELECT *, concat('ds', seq % 7) AS dataset_id FROM ({REPLACED}) WHERE dataset_id IN (SELECT dataset_id FROM run)", "dataset_id")},
  {stats_sql("dataset_id")},
  t AS (SELECT c.*, turn FROM c JOIN run USING (dataset_id)),
  last_source AS (SELECT * FROM t WHERE reason NOT IN ('missing_place_id', 'not_low_star_review') QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY turn DESC) = 1),
  last_review AS (SELECT * FROM t WHERE reason IN ('ok', 'needs_owner_recheck') QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY turn DESC) = 1)"""


def salvaged(v):
    """Seven runs with a seventh of the raw rows each; they finish in another order than their numbers, and one failed."""
    raw = raw_reviews(v["ev"]).withColumn("dataset_id", F.concat(F.lit("ds"), (F.col("seq") % 7).cast("string")))
    k = F.col("id")
    runs = v["ev"].sparkSession.range(7).select(
        F.concat(F.lit("ds"), k.cast("string")).alias("dataset_id"), F.concat(F.lit("run"), k.cast("string")).alias("run_id"),
        F.when(k != 3, "SUCCEEDED").otherwise("FAILED").alias("status"), F.timestamp_seconds((k * 5) % 7 * 3600).alias("finished_at"))
    return salvage_ingest(runs, raw, state(v), flags(v), NOW, log=v["lg"], landing=landing(v))


@query("salvage_ingest", f", {RUNS_SQL} SELECT run_id, n.* FROM n JOIN run USING (dataset_id)", ("ev", "lg"))
def q_salvage_ingest(v):
    return salvaged(v).stats


SALVAGE_LOG = f"""SELECT 'log', run_id, concat_ws('|', 'review_initial', 'success', coalesce(raw_count, 0), dataset_id, '{NOW}')
  FROM run LEFT JOIN n USING (dataset_id)"""


@query("salvage_outputs", f", {RUNS_SQL}, {outputs_sql('dataset_id', SALVAGE_LOG)}", ("ev", "lg", "st", "rv"))
def q_salvage_outputs(v):
    r = salvaged(v)
    return outputs(r.source, r.review, r.places, r.changed, r.stats, r.log, "dataset_id")


def streamed(v):
    """The raw reviews as a stream, committed to stored tables."""
    spark = v["st"].sparkSession
    raw = raw_reviews(stream_view(spark, "ev"))
    blocked = v["st"].select("place_id", "blocked")
    base = J.scratch(spark, "ingest")
    tables = J.ingest_tables(spark, f"{base}/tables", state(v), flags(v), buckets=8)
    tables.commit({"source": landing(v)})
    J.stream_ingest(raw, tables, f"{base}/ckpt", NOW, allowed=lambda places: D.eligible(places.join(blocked, "place_id"))).awaitTermination()
    return tables


@query("stream_ingest", ONE_BATCH + REVIEW_SQL, ("ev", "st", "rv"))
def q_stream_ingest(v):
    return streamed(v).read("review").select(*REVIEW)


@query("stream_ingest_outputs", f"{ONE_BATCH}, {outputs_sql("'batch'", BATCH_LOG)}", ("ev", "st", "rv"))
def q_stream_ingest_outputs(v):
    t = streamed(v)
    return outputs(*[t.read(x).drop("batch") for x in ("source", "review", "place", "changed", "stats", "log")], "batch")


RECHECK = f""", due AS (SELECT r.review_id, r.place_id, r.published_at FROM rv r JOIN st ON st.place_id = r.place_id
    WHERE NOT st.blocked AND NOT st.skip_review_fetch AND r.owner_reply_recheck AND r.next_check_at <= TIMESTAMP '{NOW}'),
  {classified_sql(f"SELECT * FROM ({REPLACED}) WHERE json_extract_string(raw_json, '$.placeId') IN (SELECT place_id FROM due)")}, {stats_sql()},
  last_review AS (SELECT * FROM c WHERE reason IN ('ok', 'needs_owner_recheck')),
  fresh AS (SELECT json_extract_string(raw_json, '$.reviewId') AS review_id,
      arg_max(coalesce(json_extract_string(raw_json, '$.responseFromOwnerText'), ''), seq) AS reply FROM raw GROUP BY 1),
  u AS (SELECT due.review_id, due.place_id IN (SELECT place_id FROM c WHERE reason = 'generic_pr_reply') OR {py_nonblank("coalesce(fresh.reply, '')")}
      OR TIMESTAMP '{NOW}' > coalesce(due.published_at, TIMESTAMP '{NOW}') + INTERVAL 10 DAY AS stop
    FROM due LEFT JOIN fresh ON fresh.review_id = due.review_id)"""
RECHECK_REVIEW = ("review_id", "place_id", "stars", "owner_reply_recheck", "owner_reply_recheck_at", "next_check_at")


def recheck_result(v):
    places = v["st"].select("place_id", "blocked", "skip_review_fetch")
    return recheck_ingest(raw_reviews(v["ev"]), state(v), places, NOW)


@query("recheck_ingest", f"""{RECHECK},
  t AS ({REVIEW_SQL})
SELECT t.review_id, t.place_id, t.stars, CASE WHEN u.stop IS NULL THEN t.owner_reply_recheck ELSE NOT u.stop END AS owner_reply_recheck,
  CASE WHEN u.stop IS NOT NULL THEN TIMESTAMP '{NOW}' END AS owner_reply_recheck_at,
  CASE WHEN u.stop IS NULL THEN t.next_check_at WHEN NOT u.stop THEN TIMESTAMP '{NOW}' + INTERVAL 2 DAY END AS next_check_at
FROM t LEFT JOIN u ON u.review_id = t.review_id""", ("ev", "st", "rv"))
def q_recheck_ingest(v):
    return recheck_result(v).review.select(*RECHECK_REVIEW)


@query("recheck_log", f"""{RECHECK}
SELECT 'review_daily' AS pipeline, 'success' AS status, CAST(raw_count AS INT) AS items_count, generic_pr_store_count, skipped,
  (SELECT count(*) FROM u) AS recheck_rows_updated FROM n""", ("ev", "st", "rv"))
def q_recheck_log(v):
    log = recheck_result(v).log
    told = lambda c: F.get_json_object("response_json", f"$.{c}").cast("long").alias(c)
    return log.select("pipeline", "status", F.col("items_count").cast("int").alias("items_count"), told("generic_pr_store_count"), told("skipped"),
                      told("recheck_rows_updated"))
