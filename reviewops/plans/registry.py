"""A small registry: query key -> (Spark builder, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reviewops.bindings import oracle, views
from reviewops.session import apply_defaults, ensure_checkpoint_dir


@dataclass
class Entry:
    key: str
    build: Callable[[dict], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(v) -> DataFrame`` (``v`` = the test views) under ``key``.

    ``sql`` is the DuckDB oracle body; ``uses`` names the views it needs as CTEs.
    """
    def wrap(fn):
        REGISTRY[key] = Entry(key, fn, None if sql is None else oracle(sql, *uses))
        return fn
    return wrap


def runner(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)          # UTC session zone, AQE, skew join
        ensure_checkpoint_dir(spark)
        return REGISTRY[key].build(views(spark, sf_dir))
    run.__name__ = key
    return run
