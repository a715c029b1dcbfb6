"""Queries: the streaming operators drained once with ``availableNow``.

Streams read the driver's parquet files as file streams; the test views are
applied to the streaming frames with the same SQL as the batch views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.bindings import SPARK_EV, VIEWS
from reviewops.plans.registry import query
from reviewops.sources.raw import parse_json_column
from reviewops.streaming import streams as J


def _sf_dir(spark) -> str:
    # the parquet folder the batch views were registered from
    path = spark.table("orders").inputFiles()[0]
    return path[:path.rindex("/orders.parquet")].replace("file://", "").replace("file:", "")


def stream_view(spark, name: str):
    sf = _sf_dir(spark)
    if name == "ev":
        J.table_stream(spark, sf, "orders").createOrReplaceTempView("orders_stream")
        return spark.sql(SPARK_EV.replace("FROM orders", "FROM orders_stream"))
    if name == "rv":
        J.table_stream(spark, sf, "orders").createOrReplaceTempView("orders_stream")
        return spark.sql(VIEWS["rv"].replace("FROM orders", "FROM orders_stream"))
    if name == "lg":
        J.table_stream(spark, sf, "events").createOrReplaceTempView("events_stream")
        return spark.sql(VIEWS["lg"].replace("FROM events", "FROM events_stream"))
    raise KeyError(name)


@query("stream_dedupe", """
SELECT DISTINCT json_extract_string(raw_json, '$.reviewId') AS reviewId, ts FROM ev
WHERE coalesce(json_extract_string(raw_json, '$.reviewId'), '') <> ''""", ("ev",))
def q_stream_dedupe(v):
    spark = v["st"].sparkSession
    raw = parse_json_column(stream_view(spark, "ev"), "raw_json", K.RAW_REVIEW)
    out = J.run_to_table(J.stream_dedupe(raw.select("reviewId", "ts"), ["reviewId"], "ts"), name="dedupe")
    return out.select("reviewId", "ts")


@query("stream_recheck")
def q_stream_recheck(v):
    spark = v["st"].sparkSession
    rv = stream_view(spark, "rv").select("review_id", "published_at", "owner_reply",
                                         F.col("scraped_at").alias("event_time"))
    return J.run_to_table(J.stream_recheck(rv), name="recheck")


@query("stream_daily_counts", """
SELECT date_trunc('day', published_at) AS day, count(*) AS cases, round(avg(CAST(stars AS DOUBLE)), 9) AS mean_value
FROM rv GROUP BY 1
HAVING date_trunc('day', published_at) + INTERVAL 1 DAY <= (SELECT max(published_at) FROM rv) - INTERVAL 2 DAY""",
       ("rv",))
def q_stream_daily_counts(v):
    spark = v["st"].sparkSession
    out = J.run_to_table(J.stream_daily_counts(stream_view(spark, "rv"), "published_at", "stars", "2 days"),
                         name="daily")
    return out.select("day", "cases", F.round("mean_value", 9).alias("mean_value"))


@query("stream_backlog", """
, cut AS (SELECT least(
    (SELECT max(started_at) FROM lg WHERE status = 'started' AND run_id IS NOT NULL),
    (SELECT max(started_at) FROM lg WHERE status = 'success' AND run_id IS NOT NULL))
    - INTERVAL 1 HOUR - INTERVAL 20 MINUTE AS c)
SELECT e.pipeline, e.run_id, e.started_at FROM lg e
WHERE e.status = 'started' AND e.run_id IS NOT NULL AND e.started_at <= (SELECT c FROM cut)
  AND NOT EXISTS (SELECT 1 FROM lg s WHERE s.status = 'success' AND s.run_id = e.run_id
                  AND s.started_at >= e.started_at AND s.started_at <= e.started_at + INTERVAL 1 HOUR)""", ("lg",))
def q_stream_backlog(v):
    spark = v["st"].sparkSession
    lg_a = stream_view(spark, "lg")
    lg_b = stream_view(spark, "lg")
    started = lg_a.filter((F.col("status") == "started") & F.col("run_id").isNotNull())
    success = lg_b.filter((F.col("status") == "success") & F.col("run_id").isNotNull())
    out = J.run_to_table(J.stream_backlog(started, success, "1 hour", "10 minutes"), name="backlog")
    # compare only starts whose match window is closed: the join's watermark
    # is the minimum over both inputs (Spark's default multi-watermark policy)
    lg = v["lg"].filter(F.col("run_id").isNotNull())
    cut = lg.agg(F.least(F.max(F.when(F.col("status") == "started", F.col("started_at"))),
                         F.max(F.when(F.col("status") == "success", F.col("started_at"))))
                 .alias("_last")).select((F.col("_last") - F.expr("INTERVAL 80 MINUTES")).alias("_cut"))
    # a scalar subquery: evaluated once, no join
    return out.filter(F.col("started_at") <= cut.scalar()).select("pipeline", "run_id", "started_at")
