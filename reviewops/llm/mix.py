"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash of its id, its text and a repeat number.  Per source a budget of words is
met by one threshold: all documents hashed below it are taken.  The threshold
is found from a histogram of words by hash bucket (10 bits), and only the
bucket where the budget ends is looked into again with the next 10 bits, until
the hash is used up.  No rows are sorted, and thresholds of a smaller budget
are nested in those of a larger one.

Null sources are a source of their own and come last; null texts have size 0.
Rows with the same id, source and text are counted and dealt out again with
numbers 0, 1, ..., so each of them is taken or left by itself whatever share of
a source one id holds.  Empty tables give empty results.  Only the columns named in the signature are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewops.llm.common import text_of, word_count, written

BITS, LEVELS = 10, 6
#: A source's rows are dealt over this many join keys, so a hot source is no hot task.
SALTS = 64
#: Equal rows are dealt out again in blocks of this many.
BLOCK = 4096


def unit_hash(doc_id: Column, text_md5: Column, number: Column, salt: str) -> Column:
    """60 bits of md5 over salt, id, the text's md5 and the repeat number, as a long."""
    key = F.concat_ws(":", F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("null")), text_md5, number.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def numbered(rows: DataFrame, salt: str) -> DataFrame:
    """doc_id, source, size, hash for each row of (doc_id, source, size, text_md5); equal rows get numbers of their own.

    Equal rows are counted, so a row that holds a third of the table is one
    row per task in the shuffle, and are spread again by blocks of numbers.
    """
    same = written(rows.groupBy("doc_id", "source", "size", "text_md5").agg(F.count("*").alias("n")), "same")
    once = same.filter("n = 1").withColumn("number", F.lit(0).cast("long")).drop("n")
    more = (same.filter("n > 1").withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK})")))
            .repartition(F.col("text_md5"), F.col("block"))
            .withColumn("number", F.explode(F.expr(f"sequence(block * {BLOCK}, least(n, (block + 1) * {BLOCK}) - 1)"))).drop("n", "block"))
    return once.unionByName(more).select("doc_id", "source", "size", unit_hash(F.col("doc_id"), F.col("text_md5"), F.col("number"), salt).alias("hash"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> adds ``target`` (double).

    Weights go to the sources in code point order, null last, and repeat.  The
    targets share the sum of all sizes; none exceeds ``cap`` times its source.
    A source is at its cap exactly if its cap per weight is at most the common
    level, so one pass over the sources ordered by cap per weight finds the
    level.  The table has one row per source, an aggregate of the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % n + 1)
    level = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = (sizes.withColumn("_w", w)
              .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
              .withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
              .withColumn("_share", F.col("_left") / F.sum("_w").over(after)))
    # the first source (in cap-per-weight order) whose cap is above its share sets the level of all later ones
    first = F.min(F.when(F.col("_cap") > F.col("_share") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_share"))))
    ranked = ranked.withColumn("_level", first.over(whole)["_share"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, salt: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, plus ``hash``.

    A target of q whole sizes plus a rest takes each document q times, and
    those under the threshold of the rest once more.  ``copies`` is at most
    ``cap``, ``taken`` = copies * size.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       word_count(text_of(text)).alias("size"), F.md5(text_of(text)).alias("text_md5"))
    base = written(numbered(rows, salt), "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    size = F.col("source_size").cast("double")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    plan = written(source_targets(sizes, weights, cap).withColumn("whole", whole)
                   .withColumn("rest", F.when(F.col("whole") >= cap, 0.0).otherwise(F.col("target") - F.col("whole") * size)), "plan")
    return _decide(base, written(plan.join(thresholds(base, plan), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "cut"))


def _salted(plan: DataFrame) -> DataFrame:
    return plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _on_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join rows with the per-source table; a source's rows are dealt over SALTS keys."""
    side = _salted(plan.withColumnRenamed("source", "_src"))
    on = rows["source"].eqNullSafe(side["_src"]) & (F.pmod(rows["hash"], F.lit(SALTS)) == side["_salt"])
    return rows.join(side, on).drop("_src", "_salt")


def thresholds(base: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, rest) -> (_s, cut): documents with hash < cut fit into the rest.

    Level 1 sums words by source and the first 10 bits; the running sum inside
    a source (at most 1024 rows) gives the boundary bucket.  The next level
    reads only that bucket's documents, about 1/1024 of the level before.
    """
    rows, known = base.filter("size > 0").select("source", "size", "hash"), plan.filter("rest > 0").select("source", F.col("rest"))
    known = known.withColumn("prefix", F.lit(0).cast("long"))
    done = None
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = _on_source(rows, known).filter(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        if level:
            inside = written(inside, "bucket") if level == 1 else inside
            rows = inside.select("source", "size", "hash")
        bucket = F.shiftright(F.col("hash"), shift)
        hist = (inside.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("words")))
        run = F.sum("words").over(Window.partitionBy("source", "rest").orderBy("bucket"))
        over = hist.withColumn("_run", run).filter(F.col("_run") > F.col("rest"))
        edge = over.groupBy("source", "rest").agg(F.min(F.struct("bucket", (F.col("_run") - F.col("words")).alias("below"))).alias("e"))
        edge = written(edge.select("source", "rest", F.col("e.bucket").alias("prefix"), F.col("e.below").alias("below")), "edge")
        known = edge.select("source", (F.col("rest") - F.col("below")).alias("rest"), "prefix")
        done = edge
    # the last level's bucket is one hash value: it and all above stay out; sources whose rest exceeds
    # everything (rounding) have no edge and take all
    return done.select(F.col("source").alias("_s"), F.col("prefix").alias("cut"))


def _decide(base: DataFrame, plan: DataFrame) -> DataFrame:
    joined = _on_source(base, plan.select("source", "source_size", "target", "whole", "rest", "cut"))
    extra = F.when((F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("hash") < F.col("cut"))), 1).otherwise(0)
    copies = (F.col("whole") + extra).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).cast("long").alias("taken"), "hash")
