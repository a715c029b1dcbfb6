"""Import every query module so the registry is complete."""

from reviewops.plans import (queries_board, queries_expr, queries_ingest, queries_more,  # noqa: F401
                             queries_ops, queries_sources, queries_streams)
from reviewops.plans.registry import REGISTRY, runner


def queries():
    return {k: runner(k) for k in REGISTRY}


def oracle_sql():
    return {k: e.sql for k, e in REGISTRY.items() if e.sql is not None}
