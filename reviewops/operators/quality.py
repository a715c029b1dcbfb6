"""K2: generic (template-like) owner replies.

Only distinct whitespace-free replies are scored, each against the few
templates; a Column-side length bound removes pairs that cannot reach the
threshold (``ratio = 2M/(la+lb) <= 2*min(la,lb)/(la+lb)``) before any Python
runs, and the survivors go through an Arrow-batched UDF that decides
``ratio >= t`` from difflib's cheap upper bounds first.  The bound is
exact: it never drops a pair that could match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions.similarity import similar
from reviewops.functions.text import py_strip, squash_ws


def template_frame(spark, templates) -> DataFrame:
    """Templates as a DataFrame with column ``template`` (a list is made into
    a literal array on the executors; a DataFrame is used as it is)."""
    if isinstance(templates, DataFrame):
        return templates.select(F.col(templates.columns[0]).alias("template"))
    return spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in templates])).alias("template"))


def generic_reply(df: DataFrame, reply: str = "owner_reply", templates=K.GENERIC_REPLY_TEMPLATES,
                  t: float = K.SIMILARITY_THRESHOLD, out: str = "is_generic",
                  max_templates: int = 10_000) -> DataFrame:
    """Flag rows whose reply is at least ``t`` similar to any template.

    ``templates`` is broadcast; its size is checked against ``max_templates``.
    """
    spark = df.sparkSession
    tpl = template_frame(spark, templates).select(
        "template", F.length(squash_ws(py_strip("template"))).alias("_lb")).filter(F.col("_lb") > 0)
    if not isinstance(templates, DataFrame) and len(templates) > max_templates:
        raise ValueError(f"more than {max_templates} templates; pass a smaller template set")
    if isinstance(templates, DataFrame):
        n = tpl.limit(max_templates + 1).count()
        if n > max_templates:
            raise ValueError(f"more than {max_templates} templates; pass a smaller template set")
    key = squash_ws(py_strip(F.coalesce(F.col(reply), F.lit(""))))
    keyed = df.withColumn("_rkey", key)
    distinct = keyed.select("_rkey").filter(F.length("_rkey") > 0).distinct() \
        .withColumn("_la", F.length("_rkey"))
    # a non-equi join against the broadcast template set (bounded, checked
    # above): each distinct reply meets only the templates it could match
    pairs = distinct.join(F.broadcast(tpl),
                          F.lit(2.0) * F.least("_la", "_lb") / (F.col("_la") + F.col("_lb")) >= t)
    # Python similarity is CPU-bound: spread the (small) pair set over the
    # shuffle partitions so AQE does not coalesce it into a single task
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(n, "_rkey")
    hits = (pairs.filter(similar("_rkey", "template", t)).select("_rkey").distinct()
            .withColumn(out, F.lit(True)))
    # rows without a reply share one empty key: they never meet the join
    told, blank = keyed.filter(F.length("_rkey") > 0), keyed.filter(F.length("_rkey") == 0)
    flagged = told.join(hits, "_rkey", "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))
    return flagged.drop("_rkey").unionByName(blank.drop("_rkey").withColumn(out, F.lit(False)))


def generic_places(flagged: DataFrame, out: str = "is_generic", key: str = "place_id") -> DataFrame:
    """One generic reply flags its whole place."""
    return flagged.filter(F.col(out)).select(key).distinct()
