"""Text expressions: blank tests, whitespace, district, display names, URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewops import schemas as K

__all__ = [
    "col_", "py_strip", "sql_nonblank", "py_nonblank", "raw_nonblank", "blank_test",
    "squash_ws", "district", "short_name", "truncate_text", "tag_label", "safe_url",
    "finish_status", "before_marker", "status_message",
]

# Unicode whitespace as Python's str.isspace() sees it (Java's (?U)\s lacks
# the four information separators U+001C..U+001F).
_WS = r"[\s\x{1c}-\x{1f}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(col_(c), rf"(?U)^{_WS}+|{_WS}+$", "")


def sql_nonblank(c) -> Column:
    """SQL-layer test ``x IS NOT NULL AND LENGTH(TRIM(x)) > 0`` (spaces only)."""
    c = col_(c)
    return c.isNotNull() & (F.length(F.trim(c)) > 0)


def py_nonblank(c) -> Column:
    """Python-layer test ``bool(str(x or '').strip())`` (all whitespace)."""
    return F.coalesce(F.length(py_strip(c)) > 0, F.lit(False))


def raw_nonblank(c) -> Column:
    """Selection-layer test ``x IS NOT NULL AND x <> ''`` (no trimming)."""
    c = col_(c)
    return c.isNotNull() & (c != F.lit(""))


def blank_test(c, mode: str = "sql") -> Column:
    return {"sql": sql_nonblank, "py": py_nonblank, "raw": raw_nonblank}[mode](c)


def squash_ws(c) -> Column:
    """H1: remove every whitespace character."""
    return F.regexp_replace(col_(c), rf"(?U){_WS}+", "")


def district(c, unknown: str = K.UNKNOWN_DISTRICT, pattern: str = K.DISTRICT_PATTERN) -> Column:
    """H3: first district after the city name, else the unknown label."""
    found = F.regexp_extract(F.coalesce(col_(c), F.lit("")), pattern, 1)
    return F.when(found == "", F.lit(unknown)).otherwise(found)


def short_name(c, limit: int = K.DISPLAY_NAME_LIMIT,
               separators=K.DISPLAY_NAME_SEPARATORS) -> Column:
    """H4: display name no longer than ``limit``.

    Long names are cut before each separator in turn; if that still does not
    fit, the first ``limit`` characters plus an ellipsis are shown.
    """
    text = py_strip(F.coalesce(col_(c), F.lit("")))
    cand = text
    for sep in separators:
        cand = py_strip(F.substring_index(cand, sep, 1))
    fallback = F.concat(F.regexp_replace(F.substring(text, 1, limit), rf"(?U){_WS}+$", ""),
                        F.lit(K.ELLIPSIS))
    return (F.when(F.length(text) <= limit, text)
            .when((F.length(cand) > 0) & (F.length(cand) <= limit), cand)
            .otherwise(fallback))


def truncate_text(c, limit: int = K.TRUNCATE_LIMIT) -> Column:
    """H5: strip; longer than ``limit`` -> cut, right-strip, add ellipsis."""
    text = py_strip(F.coalesce(col_(c), F.lit("")))
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit), rf"(?U){_WS}+$", ""),
                   F.lit(K.ELLIPSIS))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def tag_label(c) -> Column:
    """H6: text before the first full- or half-width opening parenthesis."""
    label = py_strip(F.coalesce(col_(c), F.lit("")))
    for sep in ("（", "("):
        label = py_strip(F.substring_index(label, sep, 1))
    return label


def safe_url(c) -> Column:
    """Keep http/https URLs (scheme case-insensitive), else ''."""
    text = py_strip(F.coalesce(col_(c), F.lit("")))
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.when(scheme.isin("http", "https"), text).otherwise(F.lit(""))


def finish_status(reason) -> Column:
    """Scorer finish reason -> status message."""
    r = col_(reason)
    expr = None
    for code, msg in K.FINISH_MESSAGES.items():
        expr = (F.when(r == code, F.lit(msg)) if expr is None
                else expr.when(r == code, F.lit(msg)))
    return expr.otherwise(F.concat(F.coalesce(r.cast("string"), F.lit("None")),
                                   F.lit(K.FINISH_OTHER_SUFFIX)))


def before_marker(c, marker: str = K.STATUS_MESSAGE_MARKER) -> Column:
    """Text before the first ``marker`` (whole text when absent; NULL -> '')."""
    return F.substring_index(F.coalesce(col_(c), F.lit("")), marker, 1)


def status_message(exit_code, message, marker: str = K.STATUS_MESSAGE_MARKER) -> Column:
    """Run status text: exit code line plus the message cut at ``marker``."""
    return F.concat(F.lit("Exit_code:"), F.coalesce(col_(exit_code).cast("string"), F.lit("None")),
                    F.lit("\nMessage:"), before_marker(message, marker))


POST_TEMPLATE = ("Today's fiercest exchange\nGuest: 「{review}...」\nOwner: 「{owner}...」\n"
                 "Guest heat: {guest}\nOwner heat: {owner_score}\nSuggested reply: 「{reply}...」\n{url}")
POST_FALLBACK = "No quarrel today."


def daily_post_text(top: DataFrame, template: str = POST_TEMPLATE, fallback: str = POST_FALLBACK) -> DataFrame:
    """The daily post from F7's single row; the fallback text when there
    is no case.  Excerpts keep the first 100 characters."""
    spark = top.sparkSession
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, 100)
    parts = template.replace("{review}", "%1$s").replace("{owner}", "%2$s").replace("{guest}", "%3$s") \
        .replace("{owner_score}", "%4$s").replace("{reply}", "%5$s").replace("{url}", "%6$s")
    text = F.format_string(parts, cut("review_text"), cut("owner_reply"), F.col("review_score").cast("string"),
                           F.col("owner_score").cast("string"), cut("pr_reply"), F.coalesce("review_url", F.lit("")))
    # the case (priority 1) or the fallback row (priority 0): no join needed
    case = top.select(text.alias("text"), F.lit(1).alias("_prio"))
    fallback_row = spark.range(1).select(F.lit(fallback).alias("text"), F.lit(0).alias("_prio"))
    return case.unionByName(fallback_row).agg(F.max_by("text", "_prio").alias("text"))
