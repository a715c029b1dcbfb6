"""H2: Ratcliff/Obershelp similarity as an Arrow-batched pandas UDF.

This is the one scalar the JVM has no built-in for.  It runs on Arrow batches
(never row-at-a-time) and only on rows that survive cheap Column prefilters
(see ``reviewops.operators.quality.generic_reply``).
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewops.functions.text import col_

_WS = re.compile(r"\s+")


def ratio(left: str | None, right: str | None, autojunk: bool = True) -> float:
    """Similarity of two texts with whitespace removed; empty side -> 0.0."""
    a = _WS.sub("", (left or "").strip())
    b = _WS.sub("", (right or "").strip())
    if not a or not b:
        return 0.0
    return difflib.SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


@F.pandas_udf(T.DoubleType())
def _ratio_junk(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([ratio(a, b, True) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _ratio_nojunk(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([ratio(a, b, False) for a, b in zip(left, right)], dtype="float64")


def gestalt_ratio(left, right, autojunk: bool = True) -> Column:
    """H2: ``2*M/T`` in [0, 1]; argument order matters (as in difflib)."""
    fn = _ratio_junk if autojunk else _ratio_nojunk
    return fn(col_(left).cast("string"), col_(right).cast("string"))


def similar_at_least(left: str | None, right: str | None, t: float, autojunk: bool = True) -> bool:
    """``ratio(left, right) >= t``, deciding from difflib's cheap upper bounds
    (``real_quick_ratio``, ``quick_ratio``) before the full match."""
    a = _WS.sub("", (left or "").strip())
    b = _WS.sub("", (right or "").strip())
    if not a or not b:
        return 0.0 >= t
    m = difflib.SequenceMatcher(None, a, b, autojunk=autojunk)
    if m.real_quick_ratio() < t or m.quick_ratio() < t:
        return False
    return m.ratio() >= t


@F.pandas_udf(T.BooleanType())
def _similar_junk(left: pd.Series, right: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([similar_at_least(a, b, float(x), True) for a, b, x in zip(left, right, t)], dtype=bool)


_similar_pinned = _similar_junk.asNondeterministic()


def similar(left, right, t: float) -> Column:
    """Boolean ``gestalt_ratio(left, right) >= t`` (exact, bound-pruned).

    The function is pure, but it is flagged non-deterministic so the optimizer
    keeps it where it is written (after the caller's repartition) instead of
    pushing the filter below the shuffle into fewer tasks.
    """
    return _similar_pinned(col_(left).cast("string"), col_(right).cast("string"), F.lit(float(t)))
