"""Test views over the driver's parquet tables (FIXTURES.md part 2).

The SQL text is the single source for both engines: Spark builds the views
with it, and the DuckDB oracle queries prefix it as CTEs.  Only ``ev`` has a
Spark spelling of its own: the two-row duplication is a generator
(``LATERAL VIEW explode``) instead of a join with a literal table.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed clock for every operator that needs `now`.
NOW_SQL = "TIMESTAMP '1998-06-01 00:00:00'"
NOW = "1998-06-01 00:00:00"

VIEWS: dict[str, str] = {}

VIEWS["st"] = """
SELECT concat('P', c_custkey) AS place_id,
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_name END AS title,
  c_mktsegment AS category,
  concat(CASE WHEN c_custkey % 10 = 9 THEN '220台灣新北市' WHEN c_custkey % 2 = 0 THEN '100台灣臺北市' ELSE '台北市' END,
    CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN '中正區' WHEN 1 THEN '大安區' WHEN 2 THEN '信義區' WHEN 3 THEN '南港區'
      WHEN 4 THEN '士林區' WHEN 5 THEN '北投區' ELSE '' END, '測試路', c_custkey % 300, '號') AS address,
  concat('https://example.com/place/', c_custkey) AS store_url,
  CAST(2470 + c_custkey % 80 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
  CAST(12110 + c_custkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS lng,
  CAST(10 + c_custkey % 41 AS DOUBLE) / CAST(10 AS DOUBLE) AS google_score,
  CAST(c_custkey % 400 AS INT) AS reviews_count,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 23 AS INT) END AS one_star,
  CAST(c_custkey % 19 AS INT) AS two_star, CAST(c_custkey % 29 AS INT) AS three_star,
  CAST(c_custkey % 31 AS INT) AS four_star, CAST(c_custkey % 37 AS INT) AS five_star,
  c_custkey % 43 = 0 AS permanently_closed,
  CASE WHEN c_custkey % 47 = 0 THEN NULL ELSE c_custkey % 53 = 0 END AS temporarily_closed,
  c_custkey % 11 = 0 AS blocked, c_custkey % 13 = 0 AS skip_review_fetch
FROM customer
"""

VIEWS["rv"] = """
SELECT concat('R', o_orderkey) AS review_id, concat('P', o_custkey) AS place_id,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS stars,
  CASE WHEN o_orderkey % 41 = 0 THEN ' a ' ELSE concat('review text ', o_orderkey) END AS review_text,
  o_orderdate AS published_at, o_orderdate + INTERVAL 1 DAY AS scraped_at,
  concat('https://example.com/review/', o_orderkey) AS review_url,
  CAST(o_orderkey % 9 AS INT) AS likes_count,
  CASE o_orderstatus WHEN 'F' THEN concat('reply ', o_orderkey) WHEN 'P' THEN '  ' ELSE NULL END AS owner_reply,
  o_orderstatus <> 'F' AS owner_reply_recheck,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderdate + INTERVAL 3 DAY ELSE NULL END AS next_check_at
FROM orders
"""

VIEWS["ai"] = """
SELECT concat('R', g.l_orderkey) AS review_id, concat('P', o.o_custkey) AS place_id,
  1 + CAST(g.q AS INT) % 10 AS review_score, 1 + CAST(g.d AS INT) % 10 AS owner_score,
  CASE CAST(g.l_orderkey % 5 AS INT) WHEN 0 THEN '理性客觀 (A)' WHEN 1 THEN '高級反串 (B)' WHEN 2 THEN '暴躁老哥（C）'
    WHEN 3 THEN '無聊公關 (D)' ELSE '高情商幽默' END AS review_sentiment,
  CASE CAST(g.q AS INT) % 5 WHEN 0 THEN '理性客觀 (A)' WHEN 1 THEN '高級反串 (B)' WHEN 2 THEN '暴躁老哥（C）'
    WHEN 3 THEN '無聊公關 (D)' ELSE '' END AS owner_sentiment,
  concat('summary ', g.l_orderkey) AS review_summary, concat('owner summary ', g.l_orderkey) AS owner_summary,
  CASE CAST(g.l_orderkey % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE concat('suggested ', g.l_orderkey) END AS pr_reply
FROM (SELECT l_orderkey, floor(max(l_quantity)) AS q, round(max(l_discount) * 100) + count(*) AS d
      FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey) g
JOIN orders o ON o.o_orderkey = g.l_orderkey
"""

VIEWS["lg"] = """
SELECT event_id AS id,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'review_initial' WHEN 1 THEN 'review_daily' WHEN 2 THEN 'store' ELSE 'ai_analysis' END AS pipeline,
  CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('run', event_id % 3000) END AS run_id,
  CAST(event_id % 50 AS INT) AS items_count, user_id AS actor, ts AS started_at
FROM events
"""

_EV_BODY = """
SELECT o_orderkey * 2 + k AS seq, o_orderdate AS ts,
  concat('{', CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE concat('"reviewId":"R', o_orderkey, '",') END,
    '"placeId":"P', o_custkey, '","stars":', CASE WHEN o_orderkey % 37 = 0 THEN '"bad"' ELSE concat((o_orderkey + k) % 5 + 1) END,
    ',"publishedAtDate":"', CAST(o_orderdate AS DATE), 'T06:43:16.807Z","startedAt":"', CAST(o_orderdate AS DATE),
    '","location":{"lat":', o_orderkey % 90, '.5,"lng":', o_custkey % 180, '.25},"reviewImageUrls":',
    CASE WHEN o_orderkey % 3 = 0 THEN '[]' ELSE concat('["u', o_orderkey, '","","v"]') END,
    CASE WHEN o_orderkey % 2 = 0 THEN ',"originalLanguage":"","language":"zh-TW"' ELSE '' END,
    CASE WHEN o_orderstatus = 'F' THEN concat(',"responseFromOwnerText":"reply ', o_orderkey, '"') ELSE '' END,
    ',"text":"text ', o_orderkey, '"}') AS raw_json
FROM orders {dup}
WHERE k = 0 OR o_orderkey % 20 = 0
"""
VIEWS["ev"] = _EV_BODY.replace("{dup}", "CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) t")
SPARK_EV = _EV_BODY.replace("{dup}", "LATERAL VIEW explode(array(0, 1)) t AS k")

VIEWS["rp"] = """
SELECT concat('C', conv_id, '-', turn) AS review_id, concat('P', conv_id % 50) AS place_id, review_text, owner_reply
FROM (SELECT conv_id, turn, role, text AS review_text,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS owner_reply
      FROM conversations) c
WHERE role = 'user' AND next_role = 'assistant'
"""

VIEW_NAMES = ("st", "rv", "ai", "lg", "ev", "rp")


_REGISTERED: dict[tuple[int, str], dict[str, DataFrame]] = {}


def register_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Register the driver's parquet tables as temp views (read lazily).

    Re-registers only when the session's current views point elsewhere."""
    key = (id(spark), sf_dir)
    current = _REGISTERED.get(("current", id(spark)))  # type: ignore[arg-type]
    if key not in _REGISTERED or current != key:
        frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        _REGISTERED[key] = frames
        _REGISTERED[("current", id(spark))] = key  # type: ignore[index]
    return _REGISTERED[key]


def _materialise(spark: SparkSession, df: DataFrame, sf_dir: str, name: str, text: str = "") -> DataFrame:
    """Write a test view once as the stored table it stands for (parquet in
    the shared checkpoint folder) and read it back; later sessions reuse a
    complete copy.  Set REVIEWOPS_MATERIALISE=0 to keep views as plans."""
    import hashlib
    import os
    import uuid

    from reviewops.session import ensure_checkpoint_dir

    if os.environ.get("REVIEWOPS_MATERIALISE", "1") == "0":
        return df
    tag = hashlib.sha1((sf_dir + "\n" + text).encode()).hexdigest()[:12]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/views-{tag}/{name}"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        # write aside, then rename into place: a concurrent writer of the same
        # view never exposes a half-written folder to readers
        tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
        df.write.mode("overwrite").parquet(tmp)
        moved = not fs.exists(final) and fs.rename(jvm.org.apache.hadoop.fs.Path(tmp), final)
        if not moved and not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            return spark.read.parquet(tmp)      # our own complete copy
    return spark.read.parquet(path)


_LOCK = threading.RLock()


class _Views(dict):
    """Test views built on first access and kept per session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        with _LOCK:
            if name in self:
                return self[name]
            return self._build(name)

    def _build(self, name: str) -> DataFrame:
        register_tables(self.spark, self.sf_dir)
        if name == "dc":
            df = self.spark.table("documents")
        elif name == "pg":
            df = self.spark.table("pages")
        else:
            text = SPARK_EV if name == "ev" else VIEWS[name]
            df = _materialise(self.spark, self.spark.sql(text), self.sf_dir, name, text)
        self[name] = df
        return df


_VIEW_CACHE: dict[tuple[int, str], _Views] = {}


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All test views over ``sf_dir`` (lazy; each built once per session)."""
    register_tables(spark, sf_dir)
    key = (id(spark), sf_dir)
    if key not in _VIEW_CACHE:
        _VIEW_CACHE[key] = _Views(spark, sf_dir)
    return _VIEW_CACHE[key]


def oracle(sql: str, *needed: str) -> str:
    """Prefix an oracle query with the CTEs of the views it uses."""
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {ctes}\n{sql}" if needed else sql
