"""The operators applied to their whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewops.llm import chat, decontam, divergence, html_main, jaccard_join, langid, license_scan, mix, pitman_yor, secret_scan, spelling, topk, urlfilter
from reviewops.llm.common import table
from reviewops.session import apply_defaults, ensure_checkpoint_dir


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_main.main_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    log = chat.replay_log(stored.unionByName(added))
    return chat.digests(chat.render(chat.fold_log(log)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "words")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    out = langid.predict(docs, model).withColumn("held_out", langid.held_out())
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score(docs, pitman_yor.train(docs.filter(~pitman_yor.held_out())))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def _ready(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        ensure_checkpoint_dir(spark)
        return build(spark, sf_dir)
    run.__name__ = build.__name__
    return run


def queries() -> dict:
    return {f.__name__: _ready(f) for f in (op1_html_main_text, op2_decontaminate, op3_mix_sources, op4_chat_format, op5_url_filter,
                                            op6_secret_scan, op7_license_scan, op8_jaccard_join, op9_language_id, op10_topk_search, op11_source_divergence,
                                            op12_lm_scoring, op13_spelling_variants)}


_WORDS = r"[^\x20\x09-\x0D]+"

OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':'
           || CAST(row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS VARCHAR)), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3.0 * source_size / w AS ratio,
         (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / w, source ASC NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 3.0 * source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s),
l AS (SELECT min_by(share, ratio) FILTER (ratio > share) AS level FROM r),
t AS (
  SELECT source, source_size,
         CAST(CASE WHEN level IS NULL THEN 3.0 * source_size ELSE least(3.0 * source_size, level * w) END AS DOUBLE) AS target
  FROM r, l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
         CASE WHEN p.whole >= 3 THEN 0 ELSE p.target - p.whole * p.source_size END AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c"""

_CONTROL = r"([<\[])(\\*)((?:\|\w+\||/?s|<?/?SYS>)>|/?INST\])"

OP4_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(length('<|im_start|>' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '{_CONTROL}', '\1\2\\\3', 'g')
             || chr(10) || regexp_replace(text, '{_CONTROL}', '\1\2\\\3', 'g') || '<|im_end|>' || chr(10))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g"""


def _op6_sql() -> str:
    """Per rule the matches and the gaps between them give the places."""
    per_rule = []
    for rank, r in enumerate(secret_scan.RULES):
        regex = r.regex.replace("'", "''")
        per_rule.append(f"""
  SELECT rid, {rank} AS rank, '{r.kind}' AS kind, upto - len(whole) AS start, upto AS stop, least FROM (
    SELECT rid, whole, least, sum(len(gap) + len(whole)) OVER (PARTITION BY rid ORDER BY i) AS upto FROM (
      SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS whole, unnest(g[1:len(w)]) AS gap,
             unnest([len(x) >= {r.least} for x in p]) AS least
      FROM (SELECT rid, regexp_extract_all(body, '{regex}') AS w, regexp_extract_all(body, '{regex}', {r.group}) AS p,
                   string_split_regex(body, '{regex}') AS g FROM d WHERE regexp_matches(body, '{regex}'))))
  WHERE least""")
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
s AS ({' UNION ALL '.join(per_rule)}),
a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(CASE WHEN kind IN ({base}) THEN kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) END, ',' ORDER BY start, rank) AS base,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(body, '{_TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
g AS (
  SELECT o.lang, o.source, coalesce(s.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN s ON o.lang = s.lang AND o.source = s.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p,
         1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
m AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL, "op3_mix_sources": OP3_SQL, "op4_chat_format": OP4_SQL, "op6_secret_scan": _op6_sql(), "op10_topk_search": OP10_SQL}
