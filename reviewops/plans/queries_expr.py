"""Queries: scalar expressions, upserts and state, run log, scoring
(A5, D11, H*, I*, K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.bindings import NOW
from reviewops.functions import scores as S
from reviewops.functions import text as X
from reviewops.functions.similarity import gestalt_ratio
from reviewops.operators import filters as C
from reviewops.operators import joins as D
from reviewops.operators import merge as M
from reviewops.operators import oplog as L
from reviewops.operators import ordering as O
from reviewops.operators import scoring as SC
from reviewops.operators.batching import batch_members
from reviewops.operators.quality import generic_reply
from reviewops.operators.recheck import advance_recheck, due_rechecks
from reviewops.plans.queries_more import short_name_sql
from reviewops.plans.queries_sources import parsed_ev
from reviewops.plans.registry import query
from reviewops.plans.sqltext import PY_WS, district, py_nonblank, strip
from reviewops.sources.rows import review_row

# ------------------------------------------------------------ H expressions


@query("squash_ws", f"SELECT doc_id, length(regexp_replace(text, '{PY_WS}+', '', 'g')) AS n FROM documents")
def q_squash_ws(v):
    return v["dc"].select("doc_id", F.length(X.squash_ws("text")).alias("n"))


@query("gestalt_ratio")
def q_gestalt_ratio(v):
    return v["rp"].select("review_id", F.round(gestalt_ratio("review_text", "owner_reply"), 6).alias("ratio"))


@query("district", f"SELECT place_id, {district('address')} AS district FROM st", ("st",))
def q_district(v):
    return v["st"].select("place_id", X.district("address").alias("district"))


LONG_NAME = """CASE CAST(substr(place_id, 2) AS BIGINT) % 3 WHEN 0 THEN concat(coalesce(title, ''), '｜好吃的台北名店分店')
  WHEN 1 THEN concat(coalesce(title, ''), ' ', coalesce(title, '')) ELSE title END"""


@query("short_name", f"SELECT place_id, {short_name_sql(LONG_NAME)} AS display_name FROM st", ("st",))
def q_short_name(v):
    st = v["st"]
    name = F.expr(LONG_NAME)
    return st.select("place_id", X.short_name(name).alias("display_name"))


@query("truncate_text", f"""
SELECT doc_id, CASE WHEN length({strip("coalesce(text, '')")}) <= 190 THEN {strip("coalesce(text, '')")}
  ELSE concat(regexp_replace(substr({strip("coalesce(text, '')")}, 1, 190), '{PY_WS}+$', ''), '…') END AS excerpt
FROM documents""")
def q_truncate_text(v):
    return v["dc"].select("doc_id", X.truncate_text("text").alias("excerpt"))


def _tag_label_sql(x: str) -> str:
    label = strip(f"coalesce({x}, '')")
    for sep in ("（", "("):
        label = strip(f"split_part({label}, '{sep}', 1)")
    return label


@query("tag_label", f"SELECT review_id, {_tag_label_sql('review_sentiment')} AS label FROM ai", ("ai",))
def q_tag_label(v):
    return v["ai"].select("review_id", X.tag_label("review_sentiment").alias("label"))


@query("intensity", f"""
SELECT r.review_id, CASE WHEN {'{'}HAS{'}'} THEN (CAST(a.review_score AS DOUBLE) + a.owner_score) / 2.0 END AS intensity
FROM rv r LEFT JOIN ai a ON a.review_id = r.review_id""".replace(
    "{HAS}", "(coalesce(CAST(a.review_score AS DOUBLE), 0) > 0 OR coalesce(CAST(a.owner_score AS DOUBLE), 0) > 0 OR "
    + py_nonblank("a.review_sentiment") + " OR " + py_nonblank("a.owner_sentiment") + " OR "
    + py_nonblank("a.pr_reply") + ")"), ("rv", "ai"))
def q_intensity(v):
    j = v["rv"].select("review_id").join(v["ai"].drop("place_id"), "review_id", "left")
    has = S.has_scores("review_score", "owner_score", "review_sentiment", "owner_sentiment", "pr_reply")
    return j.select("review_id", S.intensity("review_score", "owner_score", has).alias("intensity"))


@query("fetch_limit", "SELECT place_id, coalesce(one_star, 0) + coalesce(two_star, 0) + 50 AS max_reviews FROM st",
       ("st",))
def q_fetch_limit(v):
    return v["st"].select("place_id", S.fetch_limit("one_star", "two_star").alias("max_reviews"))


@query("local_yesterday", """
SELECT review_id, strftime(CAST(scraped_at + INTERVAL 8 HOUR AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') AS start_date
FROM rv""", ("rv",))
def q_local_yesterday(v):
    return v["rv"].select("review_id", S.local_yesterday(F.col("scraped_at")).alias("start_date"))


URL_MIX = """CASE page_id % 5 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN upper(url)
  WHEN 2 THEN concat('  ', url, ' ') WHEN 3 THEN concat('javascript:', url) ELSE url END"""


@query("safe_url", f"""
SELECT page_id, CASE WHEN lower(regexp_extract({strip(URL_MIX)}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) IN ('http', 'https')
  THEN {strip(URL_MIX)} ELSE '' END AS url FROM pages""")
def q_safe_url(v):
    return v["pg"].select("page_id", X.safe_url(F.expr(URL_MIX)).alias("url"))


REASON = """CASE event_type WHEN 'view' THEN 'STOP' WHEN 'click' THEN 'MAX_TOKENS' WHEN 'signup' THEN 'SAFETY'
  WHEN 'error' THEN 'RECITATION' ELSE 'OTHER' END"""


def _finish_sql() -> str:
    parts = " ".join(f"WHEN '{code}' THEN '{msg}'" for code, msg in K.FINISH_MESSAGES.items())
    return f"CASE {REASON} {parts} ELSE concat({REASON}, '{K.FINISH_OTHER_SUFFIX}') END"


@query("finish_status", f"""
SELECT event_id, {_finish_sql()} AS status,
  concat('Exit_code:', CAST(event_id % 3 AS VARCHAR), chr(10), 'Message:', split_part(coalesce(props, ''), ':', 1)) AS message
FROM events""")
def q_finish_status(v):
    ev = v["pg"].sparkSession.table("events")
    return ev.select("event_id", X.finish_status(F.expr(REASON)).alias("status"),
                     X.status_message((F.col("event_id") % 3).cast("string"), "props", ":").alias("message"))


@query("daily_post_text", """
, t AS (SELECT a.review_id, concat('guest of ', a.review_id) AS review_text, concat('owner of ', a.review_id) AS owner_reply, a.review_score, a.owner_score, a.pr_reply, r.review_url
        FROM ai a JOIN rv r ON r.review_id = a.review_id WHERE r.scraped_at >= TIMESTAMP '1998-05-31 00:00:00'
        ORDER BY a.review_score + a.owner_score DESC, a.review_id LIMIT 1)
SELECT coalesce((SELECT concat('Today''s fiercest exchange', chr(10), 'Guest: 「', substr(coalesce(review_text, ''), 1, 100),
  '...」', chr(10), 'Owner: 「', substr(coalesce(owner_reply, ''), 1, 100), '...」', chr(10), 'Guest heat: ',
  CAST(review_score AS VARCHAR), chr(10), 'Owner heat: ', CAST(owner_score AS VARCHAR), chr(10),
  'Suggested reply: 「', substr(coalesce(pr_reply, ''), 1, 100), '...」', chr(10), coalesce(review_url, '')) FROM t),
  'No quarrel today.') AS text""", ("ai", "rv"))
def q_daily_post_text(v):
    ai = v["ai"].withColumns({"review_text": F.concat(F.lit("guest of "), "review_id"), "owner_text": F.concat(F.lit("owner of "), "review_id")})
    return X.daily_post_text(O.top_daily(v["rv"], ai, NOW))

# ------------------------------------------------------------ I upserts / state

RV_COLS = ["review_id", "place_id", "stars", "review_text", "owner_reply", "scraped_at"]


def fresh_reviews(v):
    p = C.valid_ids(parsed_ev(v), ("reviewId", "placeId"))
    return review_row(p, NOW, keep=("seq",))


@query("merge_upsert", f"""
, src AS (SELECT json_extract_string(raw_json, '$.reviewId') AS review_id,
    arg_max(json_extract_string(raw_json, '$.placeId'), seq) AS place_id,
    arg_max(coalesce(TRY_CAST(json_extract_string(raw_json, '$.stars') AS INT), 0), seq) AS stars,
    arg_max(coalesce(json_extract_string(raw_json, '$.text'), ''), seq) AS review_text,
    arg_max(json_extract_string(raw_json, '$.responseFromOwnerText'), seq) AS owner_reply,
    TIMESTAMP '{NOW}' AS scraped_at
  FROM ev WHERE coalesce(json_extract_string(raw_json, '$.reviewId'), '') <> ''
    AND coalesce(json_extract_string(raw_json, '$.placeId'), '') <> '' GROUP BY 1)
SELECT review_id, place_id, stars, review_text, owner_reply, scraped_at FROM rv
WHERE review_id NOT IN (SELECT review_id FROM src)
UNION ALL SELECT * FROM src""", ("rv", "ev"))
def q_merge_upsert(v):
    src = fresh_reviews(v)
    return M.merge_upsert(v["rv"].select(*RV_COLS), src.select(*RV_COLS, "seq"), ["review_id"], ["seq"])


@query("merge_columns", """
, src AS (SELECT place_id, upper(title) AS title, 'NEW' AS category, true AS blocked FROM st
          WHERE CAST(substr(place_id, 2) AS BIGINT) % 4 = 0
          UNION ALL SELECT concat('Q', substr(place_id, 2)), title, category, true FROM st
          WHERE CAST(substr(place_id, 2) AS BIGINT) % 97 = 0)
SELECT coalesce(t.place_id, s.place_id) AS place_id,
  CASE WHEN s.place_id IS NOT NULL THEN s.title ELSE t.title END AS title,
  CASE WHEN t.place_id IS NULL THEN s.category ELSE t.category END AS category,
  CASE WHEN s.place_id IS NOT NULL THEN false ELSE t.blocked END AS blocked
FROM (SELECT place_id, title, category, blocked FROM st) t FULL JOIN src s ON s.place_id = t.place_id""", ("st",))
def q_merge_columns(v):
    st = v["st"].select("place_id", "title", "category", "blocked")
    n = F.substring("place_id", 2, 20).cast("long")
    a = st.filter(n % 4 == 0).select("place_id", F.upper("title").alias("title"), F.lit("NEW").alias("category"),
                                     F.lit(True).alias("blocked"))
    b = st.filter(n % 97 == 0).select(F.concat(F.lit("Q"), F.substring("place_id", 2, 20)).alias("place_id"),
                                      "title", "category", F.lit(True).alias("blocked"))
    return M.merge_columns(st, a.unionByName(b), ["place_id"], ["title"], force={"blocked": False})


MARK_IDS = "SELECT DISTINCT place_id FROM rv WHERE stars = 5 AND likes_count = 8"


@query("mark_skip", f"""
SELECT place_id FROM st WHERE place_id IN ({MARK_IDS}) AND NOT coalesce(skip_review_fetch, false)""", ("st", "rv"))
def q_mark_skip(v):
    ids = v["rv"].filter((F.col("stars") == 5) & (F.col("likes_count") == 8)).select("place_id")
    _new, changed = M.mark_skip(v["st"], ids)
    return changed


@query("mark_skip_table", f"""
SELECT place_id, CASE WHEN place_id IN ({MARK_IDS}) THEN true ELSE skip_review_fetch END AS skip_review_fetch FROM st""",
       ("st", "rv"))
def q_mark_skip_table(v):
    ids = v["rv"].filter((F.col("stars") == 5) & (F.col("likes_count") == 8)).select("place_id")
    new, _changed = M.mark_skip(v["st"], ids)
    return new.select("place_id", "skip_review_fetch")


@query("initial_recheck", f"""
SELECT review_id,
  NOT ({py_nonblank('owner_reply')} OR TIMESTAMP '{NOW}' > published_at + INTERVAL 10 DAY) AS owner_reply_recheck,
  NULL::TIMESTAMP AS owner_reply_recheck_at,
  CASE WHEN NOT ({py_nonblank('owner_reply')} OR TIMESTAMP '{NOW}' > published_at + INTERVAL 10 DAY)
    THEN TIMESTAMP '{NOW}' + INTERVAL 2 DAY END AS next_check_at
FROM rv""", ("rv",))
def q_initial_recheck(v):
    s = S.initial_recheck("owner_reply", "published_at", NOW)
    return v["rv"].select("review_id", s["owner_reply_recheck"].alias("owner_reply_recheck"),
                          s["owner_reply_recheck_at"].alias("owner_reply_recheck_at"),
                          s["next_check_at"].alias("next_check_at"))


GENERIC_IDS = "SELECT DISTINCT place_id FROM rp"


@query("advance_recheck", f"""
, due AS (SELECT r.review_id, r.place_id, r.published_at FROM rv r JOIN st s ON s.place_id = r.place_id
          WHERE NOT s.blocked AND NOT s.skip_review_fetch AND r.owner_reply_recheck
            AND r.next_check_at IS NOT NULL AND r.next_check_at <= TIMESTAMP '{NOW}'),
  fr AS (SELECT json_extract_string(raw_json, '$.reviewId') AS review_id,
         arg_max(json_extract_string(raw_json, '$.responseFromOwnerText'), seq) AS reply FROM ev
         WHERE coalesce(json_extract_string(raw_json, '$.reviewId'), '') <> '' GROUP BY 1),
  j AS (SELECT due.review_id, (due.place_id IN ({GENERIC_IDS})) OR {py_nonblank('fr.reply')}
          OR TIMESTAMP '{NOW}' > coalesce(due.published_at, TIMESTAMP '{NOW}') + INTERVAL 10 DAY AS stop
        FROM due LEFT JOIN fr ON fr.review_id = due.review_id)
SELECT review_id, NOT stop AS owner_reply_recheck, TIMESTAMP '{NOW}' AS owner_reply_recheck_at,
  CASE WHEN NOT stop THEN TIMESTAMP '{NOW}' + INTERVAL 2 DAY END AS next_check_at FROM j""", ("rv", "st", "ev", "rp"))
def q_advance_recheck(v):
    due = due_rechecks(v["rv"], v["st"], NOW)
    return advance_recheck(due, parsed_ev(v), v["rp"].select("place_id"), NOW)


@query("close_run", """
SELECT l.id, coalesce(CASE WHEN l.status = 'running' THEN 'success' END, l.status) AS status,
  CASE WHEN l.status = 'running' THEN l.items_count + 1 ELSE l.items_count END AS items_count, l.run_id
FROM lg l""", ("lg",))
def q_close_run(v):
    lg = v["lg"].select("id", "status", "items_count", "run_id")
    upd = lg.filter(F.col("status") == "running").select("id", F.lit("success").alias("status"),
                                                          (F.col("items_count") + 1).alias("items_count"))
    return L.current_runs(L.close_run(lg, upd))


@query("flag_preserving_merge", """
, src AS (SELECT place_id, upper(title) AS title, false AS blocked FROM st WHERE CAST(substr(place_id, 2) AS BIGINT) % 3 = 0)
SELECT t.place_id, t.title, t.blocked FROM st t WHERE t.place_id NOT IN (SELECT place_id FROM src)
UNION ALL SELECT s.place_id, s.title, coalesce(t.blocked, s.blocked) AS blocked
FROM src s LEFT JOIN st t ON t.place_id = s.place_id""", ("st",))
def q_flag_preserving_merge(v):
    st = v["st"].select("place_id", "title", "blocked")
    src = st.filter(F.substring("place_id", 2, 20).cast("long") % 3 == 0).select(
        "place_id", F.upper("title").alias("title"), F.lit(False).alias("blocked"))
    return M.merge_upsert(st, src, ["place_id"], preserve=["blocked"])


# ------------------------------------------------------------ A5 / D11 run log


@query("append_log", """
SELECT id, pipeline, 'success' AS status, items_count, run_id,
  to_json({'actor': actor, 'items_count': items_count}) AS request_json, started_at, 0 AS retry_count FROM lg""",
       ("lg",))
def q_append_log(v):
    lg = v["lg"]
    out = L.log_rows(lg, F.col("pipeline"), "success", run_id=F.col("run_id"), items=F.col("items_count"),
                     started=F.col("started_at"), request=F.struct("actor", "items_count"), id_col="id")
    return out.select("id", "pipeline", "status", "items_count", "run_id", "request_json", "started_at",
                      "retry_count")


RUNS_SQL = """SELECT run_id AS id, CASE WHEN id % 3 = 0 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
  strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS startedAt, concat('ds', id) AS defaultDatasetId,
  items_count / 100.0 AS usageTotalUsd FROM lg WHERE pipeline = 'review_initial'"""


@query("salvageable_runs", f"""
, runs AS ({RUNS_SQL})
SELECT coalesce(id, '') AS run_id, status, CAST(startedAt AS TIMESTAMP) AS started_at, defaultDatasetId AS dataset_id,
  CAST(usageTotalUsd AS DOUBLE) AS cost_usd FROM runs
WHERE coalesce(id, '') <> '' AND status = 'SUCCEEDED'
  AND CAST(startedAt AS TIMESTAMP) >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 120 HOUR
  AND coalesce(id, '') NOT IN (SELECT run_id FROM lg WHERE status = 'success' AND run_id IS NOT NULL)""", ("lg",))
def q_salvageable_runs(v):
    lg = v["lg"]
    runs = lg.filter(F.col("pipeline") == "review_initial").select(
        F.col("run_id").alias("id"),
        F.when(F.col("id") % 3 == 0, "SUCCEEDED").otherwise("FAILED").alias("status"),
        F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startedAt"),
        F.concat(F.lit("ds"), F.col("id")).alias("defaultDatasetId"),
        (F.col("items_count") / 100.0).alias("usageTotalUsd"))
    return L.salvageable_runs(runs, lg, "2024-01-20 00:00:00", hours=120)

# ------------------------------------------------------------ K scoring


def rp_rows(v):
    return v["rp"].select("review_id", "place_id", "review_text",
                          "owner_reply")


def rp_templates(v):
    """FIXTURES: the replies under 200 characters of the six smallest review ids, minus 3 chars."""
    r = rp_rows(v)
    top = r.filter(F.length("owner_reply") < 200).orderBy("review_id").limit(6)
    return top.select(F.expr("substring(owner_reply, 1, length(owner_reply) - 3)").alias("template"))


@query("generic_reply")
def q_generic_reply(v):
    return generic_reply(rp_rows(v), "owner_reply", rp_templates(v)).select("review_id", "place_id", "is_generic")


@query("score_pairs")
def q_score_pairs(v):
    todo = D.resume_anti(v["rp"], v["ai"].select("review_id"))
    return SC.score_pairs(todo, SC.keyword_scorer, batch=50).select(
        "review_id", "place_id", "review_score", "owner_score", "status")


def _tags_sql():
    return "(" + ", ".join(f"'{t}'" for t in K.EMOTION_TAGS) + ")"


@query("validate_scores", f"""
SELECT review_id, CASE WHEN coalesce(review_id, '') = '' THEN 'missing_review_id'
  WHEN coalesce(place_id, '') = '' THEN 'missing_place_id'
  WHEN NOT coalesce(review_sentiment IN {_tags_sql()}, false) THEN 'bad_review_sentiment'
  WHEN NOT coalesce(owner_sentiment IN {_tags_sql()}, false) THEN 'bad_owner_sentiment'
  WHEN review_score IS NULL OR review_score < 1 OR review_score > 10 THEN 'review_score_out_of_range'
  WHEN owner_score IS NULL OR owner_score < 1 OR owner_score > 10 THEN 'owner_score_out_of_range'
  WHEN coalesce(length(review_summary), 0) > 30 THEN 'review_summary_too_long'
  WHEN coalesce(length(owner_summary), 0) > 30 THEN 'owner_summary_too_long' END AS reason
FROM ai""", ("ai",))
def q_validate_scores(v):
    good, bad = SC.validate_scores(v["ai"])
    return good.select("review_id", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("review_id", "reason"))


@query("score_batch_log", """
SELECT CAST(floor((rn - 1) / 50) AS BIGINT) AS batch_id, count(*) AS items_count,
  list(review_id ORDER BY review_id) AS review_ids, 'SUCCESS' AS status
FROM (SELECT review_id, row_number() OVER (ORDER BY review_id) AS rn FROM ai) t GROUP BY 1""", ("ai",))
def q_score_batch_log(v):
    b = batch_members(v["ai"].select("review_id"), ["review_id"], 50)
    return SC.score_batch_log(b.withColumn("status", F.lit("SUCCESS")).withColumnRenamed("batch_index", "batch_id"))
