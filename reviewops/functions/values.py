"""Value cleaning expressions: safe casts, truthy coalesce, lists, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewops.functions.text import col_

__all__ = [
    "safe_int", "safe_float", "safe_timestamp", "coalesce_truthy", "list_to_json_text",
    "join_list", "business_status", "fill_defaults", "guarded_ratio", "first_named_field",
    "as_ntz", "now_col",
]


def _as_text(c: Column) -> Column:
    return c.cast("string")


def safe_int(c, default: int | None = 0, numbers: bool = False) -> Column:
    """B2: ``int(x)`` or ``default``.

    Text must be a whole number ('3.7' is invalid, as for Python's ``int``).
    With ``numbers=True`` a numeric value is truncated toward zero instead
    (``int(3.7) == 3``); use it for columns that hold JSON numbers.
    """
    text = F.trim(_as_text(col_(c)))
    value = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    if numbers:
        value = F.coalesce(value, F.when(text.try_cast("double").isNotNull(),
                                  text.try_cast("double").try_cast("int")))
    return F.coalesce(value, F.lit(default).cast("int")) if default is not None else value


def safe_float(c, default: float | None = 0.0) -> Column:
    """B2: ``float(x)`` or ``default``."""
    v = F.trim(_as_text(col_(c))).try_cast("double")
    return F.coalesce(v, F.lit(default).cast("double")) if default is not None else v


def as_ntz(c) -> Column:
    """An instant as UTC wall-clock ``timestamp_ntz`` (session zone is UTC)."""
    return col_(c).cast("timestamp_ntz")


def now_col(now) -> Column:
    """``now`` parameter (datetime, string or Column) as ``timestamp_ntz``."""
    if isinstance(now, Column):
        return now.cast("timestamp_ntz")
    if isinstance(now, str):
        return F.lit(now).cast("timestamp_ntz")
    return F.lit(now).cast("timestamp_ntz")


#: A full date, and if a time follows, at least its hours and minutes.  Years,
#: months or times alone are no instants (a time alone would read the clock).
ISO_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?\s?(Z|z|UTC|[+-]\d{2}(:?\d{2})?)?)?$"


def safe_timestamp(c) -> Column:
    """ISO-8601 text ('Z', offset, or naive = UTC) -> UTC instant, else NULL."""
    text = F.trim(_as_text(col_(c)))
    parsed = F.try_to_timestamp(F.when(text.rlike(ISO_TIMESTAMP), text))
    return parsed.cast("timestamp_ntz")


def coalesce_truthy(*cols, default=None) -> Column:
    """First value that is neither NULL nor '' (Python ``a or b or d``)."""
    parts = [F.nullif(col_(c).cast("string"), F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def list_to_json_text(c) -> Column:
    """List -> JSON text of its truthy items, '[]' / '' / NULL -> NULL.

    The text uses ', ' between items, like Python's ``json.dumps``.
    """
    arr = F.filter(col_(c), lambda x: x.isNotNull() & (x != ""))
    items = F.transform(arr, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))
    text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return F.when(F.size(arr) > 0, text)


def join_list(c, sep: str = ",") -> Column:
    """Array -> 'a,b,c'; NULL -> ''."""
    return F.coalesce(F.array_join(col_(c), sep), F.lit(""))


def business_status(permanently_closed, temporarily_closed) -> Column:
    """CLOSED when either flag is true (NULL counts as false), else OPEN."""
    closed = F.coalesce(col_(permanently_closed), F.lit(False)) | \
        F.coalesce(col_(temporarily_closed), F.lit(False))
    return F.when(closed, F.lit("CLOSED")).otherwise(F.lit("OPEN"))


def fill_defaults(df: DataFrame, values: dict) -> DataFrame:
    """NULL -> default per column (``na.fill`` with a per-column dict)."""
    return df.na.fill(values)


def guarded_ratio(num, den, scale: float = 1.0) -> Column:
    """``num / den * scale`` when ``den > 0``, else 0.0."""
    n, d = col_(num).cast("double"), col_(den).cast("double")
    return F.when(F.coalesce(d, F.lit(0.0)) > 0,
                  F.coalesce(n, F.lit(0.0)) / d * F.lit(float(scale))).otherwise(F.lit(0.0))


def first_named_field(df: DataFrame, names, default=None) -> Column:
    """First truthy value among differently spelled fields that exist."""
    present = [n for n in names if n in df.columns or _nested_exists(df.schema, n)]
    if not present:
        return F.lit(default)
    return coalesce_truthy(*present, default=default)


def _nested_exists(schema: T.StructType, path: str) -> bool:
    node = schema
    for part in path.split("."):
        if not isinstance(node, T.StructType) or part not in node.names:
            return False
        node = node[part].dataType
    return True
