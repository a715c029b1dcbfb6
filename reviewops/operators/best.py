"""E4 ``best_by``: the first value of a group under an explicit order.

PostgreSQL spells it ``(ARRAY_AGG(x ORDER BY ...) FILTER (WHERE p))[1]``; a
window sort would rank every row of a group in one task.  Here it is a
``min_by`` over a struct sort key, which Spark evaluates as a partial
(map-side) aggregate: each task keeps one candidate per group and the shuffle
carries one row per group and task, however hot a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewops.functions.text import col_

# An order term: (column, "asc"|"desc"[, "nulls_first"|"nulls_last"][, kind])
# kind: "num" (numbers, booleans), "ts" (timestamps), "str" (ascending only).
# Default NULL placement is PostgreSQL's: last for ASC, first for DESC.


def _term(spec) -> tuple[Column, bool, bool, str]:
    if isinstance(spec, (str, Column)):
        spec = (spec, "asc")
    c, direction, *rest = spec
    desc = direction.lower() == "desc"
    nulls_last = not desc
    kind = "num"
    for r in rest:
        if r in ("nulls_first", "nulls_last"):
            nulls_last = r == "nulls_last"
        else:
            kind = r
    return col_(c), desc, nulls_last, kind


def sort_key(order: Sequence) -> Column:
    """A struct whose natural (ascending) order is ``order``."""
    fields = []
    for i, spec in enumerate(order):
        c, desc, nulls_last, kind = _term(spec)
        flag = c.isNull() if nulls_last else c.isNotNull()
        if kind == "ts":
            v = F.unix_micros(c.cast("timestamp"))
        elif kind == "str":
            if desc:
                raise ValueError("descending text order is not supported in best_by")
            v = c
        elif kind == "bool":
            v = c.cast("int")
        else:
            v = c.cast("double")
        if desc:
            v = -v
        fields += [flag.cast("int").alias(f"n{i}"), v.alias(f"v{i}")]
    return F.struct(*fields)


def best_by(value, order: Sequence, where=None, tie=None) -> Column:
    """Aggregate: ``value`` of the first row by ``order`` among rows with ``where``.

    ``tie`` (a column, ascending) makes the choice deterministic when the
    order is not total.
    """
    terms = list(order) + ([(tie, "asc", "nulls_last", "str")] if tie is not None else [])
    key = sort_key(terms)
    if where is not None:
        key = F.when(col_(where), key)
    return F.min_by(col_(value), key)
