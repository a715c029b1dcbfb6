"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops.operators.ordering import dedupe_first


def table_counts(tables: dict) -> DataFrame:
    """G1: (table, rows) for each named DataFrame, by UNION ALL of counts."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def ingested_run_ids(log: DataFrame) -> DataFrame:
    """Distinct run ids of successful runs."""
    return (log.filter((F.col("status") == "success") & F.col("run_id").isNotNull())
            .select("run_id").distinct())


def ordered_union_ids(explicit: DataFrame, found: DataFrame, col: str = "run_id") -> DataFrame:
    """Explicit ids then discovered ids, de-duplicated, first position kept.

    Each input carries an order column ``pos``; explicit ids come first."""
    e = explicit.select(col, F.lit(0).alias("_src"), "pos")
    f = found.select(col, F.lit(1).alias("_src"), "pos")
    both = e.unionByName(f).withColumn("_seq", F.struct("_src", "pos"))
    return dedupe_first(both, [col], "_seq").select(col, "_src", "pos")


def missing_ids(needed: DataFrame, existing: DataFrame, col: str = "place_id") -> DataFrame:
    """Distinct needed ids that do not exist (anti join)."""
    return (needed.select(col).filter(F.col(col).isNotNull()).distinct()
            .join(existing.select(col), col, "left_anti"))
