"""Ordered fixed-size batches without a single-partition window.

A global ``row_number() OVER (ORDER BY ...)`` moves every row into one task.
Instead: range-partition by the order, tag each row with its partition and
its position inside the partition, store the key columns with these two
numbers, count rows per partition, turn the counts into offsets by running
sums in blocks, and add them back.  Index = offset + position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions.text import col_
from reviewops.sources.tables import stored

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position
#: Counts that one running sum goes over.
_BLOCK = 1024


def running_offsets(counts: DataFrame, n: int) -> DataFrame:
    """(_part, _off) for (_part, _n): rows before each of at most ``n`` partitions.

    Sums run over blocks of counts and, the same way, over the blocks' totals,
    so the work is linear and no task sees more than a block.
    """
    blocks = counts.withColumn("_block", F.floor(F.col("_part") / _BLOCK).cast("long"))
    before = Window.partitionBy("_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
    if n <= _BLOCK:
        return inside.select("_part", "_off")
    totals = blocks.groupBy("_block").agg(F.sum("_n").alias("_n"))
    above = running_offsets(totals.select(F.col("_block").alias("_part"), "_n"), -(-n // _BLOCK)).select(F.col("_part").alias("_block"), F.col("_off").alias("_up"))
    return inside.join(above, "_block").select("_part", (F.col("_off") + F.col("_up")).alias("_off"))


def global_index(df: DataFrame, order: Sequence, partitions: int | None = None,
                 out: str = "row_index", keep: Sequence[str] | None = None) -> DataFrame:
    """0-based position of every row under ``order`` (a total order).

    Only the columns ``keep`` (all, if None) are sorted, stored and returned.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [col_(o) for o in order]
    tagged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .select(*(df.columns if keep is None else keep), F.monotonically_increasing_id().alias("_mid"))
              .withColumn("_part", F.shiftright("_mid", _POS_BITS))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
              .drop("_mid"))
    # partition ids and positions are computed once and stored in the shared
    # folder, so the two uses below agree and a lost executor renumbers nothing
    tagged = stored(tagged, "numbered")
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    return (tagged.join(running_offsets(counts, n), "_part")
            .withColumn(out, F.col("_off") + F.col("_pos")).drop("_part", "_pos", "_off"))


def batches(df: DataFrame, order: Sequence, size: int = K.BATCH_SIZE, key: str = "place_id",
            agg: dict | None = None, partitions: int | None = None, of: Sequence[str] | None = None) -> DataFrame:
    """consecutive chunks of ``size`` rows in ``order``.

    One row per batch: ``batch_index``, the ordered key list (at most
    ``size`` entries) and optional aggregates ``{name: Column}`` such as the
    chunk's ``max`` fetch limit, over the columns ``of`` (any, if None).  Only
    the key and these columns are numbered and stored.
    """
    if size <= 0:
        raise ValueError("batch size must be > 0")
    keep = [key] if not agg else None if of is None else list(dict.fromkeys([key, *of]))
    idx = global_index(df, order, partitions, keep=keep)
    aggs = [F.sort_array(F.collect_list(F.struct(F.col("row_index").alias("i"), F.col(key).alias("k"))))
            .alias("_items")]
    aggs += [c.alias(name) for name, c in (agg or {}).items()]
    g = idx.groupBy(F.floor(F.col("row_index") / size).cast("long").alias("batch_index")).agg(*aggs)
    return g.select("batch_index", F.col("_items.k").alias(f"{key}s"),
                    *[name for name in (agg or {})])


def batch_members(df: DataFrame, order: Sequence, size: int = K.BATCH_SIZE,
                  partitions: int | None = None) -> DataFrame:
    """Long form of F10: every row with its ``batch_index``."""
    idx = global_index(df, order, partitions)
    return idx.withColumn("batch_index", F.floor(F.col("row_index") / size).cast("long"))


def recheck_batches(due: DataFrame, eligible_ids: DataFrame, size: int = K.BATCH_SIZE):
    """chunk the due, eligible places by id and carry their due reviews.

    Returns ``(batches, due_reviews)``: one row per batch with its place ids,
    and the due reviews in long form tagged with their batch index.
    """
    from reviewops.operators.recheck import due_by_place
    d = due_by_place(due, eligible_ids)
    places = d.select("place_id").distinct()
    b = batch_members(places, ["place_id"], size)
    batch_rows = b.groupBy("batch_index").agg(
        F.sort_array(F.collect_list("place_id")).alias("place_ids"))
    reviews = d.join(b.select("place_id", "batch_index"), "place_id")
    return batch_rows, reviews
