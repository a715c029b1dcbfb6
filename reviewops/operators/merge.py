"""Upserts as new DataFrame versions.

Parquet has no row-level update, so a merge is a pure function
``(target, source) -> new target``: the caller writes the result to a new
version directory and switches to it (never overwrite a path being read).
Everything is key-partitioned joins and anti-joins; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(source: DataFrame, keys: Sequence[str], order: Sequence[str] | None) -> DataFrame:
    """One source row per key: the last by ``order`` (``max_by`` over a struct,
    a partial aggregate) or any row when no order is given."""
    if not order:
        return source.dropDuplicates(list(keys))
    cols = source.columns
    return (source.groupBy(*keys)
            .agg(F.max_by(F.struct(*cols), F.struct(*[F.col(o) for o in order])).alias("_r"))
            .select(*[F.col(f"_r.{c}").alias(c) for c in cols]))


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
                 order: Sequence[str] | None = None, preserve: Sequence[str] = ()) -> DataFrame:
    """Insert new keys, replace all columns of existing ones.

    Duplicate keys in ``source`` resolve to the last row by ``order``.
    ``preserve`` lists columns whose target value survives a replace (I7,
    e.g. manual flags); the default keeps none, as the reference does.
    One full outer join on the key: the source is evaluated once and each
    side is shuffled once.  Idempotent: ``merge(merge(t, s), s) == merge(t, s)``.
    """
    src = latest_per_key(source, keys, order).select(*target.columns)
    s = src.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in target.columns if c not in keys],
                   F.lit(True).alias("_in_s"))
    j = target.join(s, list(keys), "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in preserve:
            out.append(F.when(F.col("_in_s").isNull(), F.col(c))
                       .otherwise(F.coalesce(F.col(c), F.col(f"_s_{c}"))).alias(c))
        else:
            out.append(F.when(F.col("_in_s").isNull(), F.col(c)).otherwise(F.col(f"_s_{c}")).alias(c))
    return j.select(*out)


def merge_columns(target: DataFrame, source: DataFrame, keys: Sequence[str],
                  update: Sequence[str], force: dict | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """On match update only ``update`` columns (plus forced values); new
    keys are inserted with the source's columns and the forced values.  A key
    that the source repeats counts once, the last by ``order``."""
    force = force or {}
    s = latest_per_key(source, keys, order).select(*keys, *[F.col(c).alias(f"_s_{c}") for c in target.columns if c not in keys],
                      F.lit(True).alias("_in_s"))
    t = target.withColumn("_in_t", F.lit(True))
    j = t.join(s, list(keys), "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        src_c = F.col(f"_s_{c}")
        if c in force:
            val = F.when(F.col("_in_s").isNotNull(), F.lit(force[c])).otherwise(F.col(c))
        elif c in update:
            val = F.when(F.col("_in_s").isNotNull(), src_c).otherwise(F.col(c))
        else:
            val = F.when(F.col("_in_t").isNull(), src_c).otherwise(F.col(c))
        out.append(val.alias(c))
    return j.select(*out)


def mark_skip(places: DataFrame, ids: DataFrame, key: str = "place_id", flag: str = "skip_review_fetch"):
    """Set ``flag`` for the keys in ``ids``.

    Returns ``(new places, changed)`` where ``changed`` holds the keys whose
    flag actually flipped (the count is ``changed.count()`` when needed).
    """
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    j = places.join(hit, key, "left")
    new = j.select(*[F.when(F.col("_hit"), F.lit(True)).otherwise(F.col(c)).alias(c) if c == flag
                     else F.col(c) for c in places.columns])
    changed = j.filter(F.col("_hit") & ~F.coalesce(F.col(flag), F.lit(False))).select(key)
    return new, changed
