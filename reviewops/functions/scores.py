"""Score expressions: has-scores test, intensity, heuristic, recheck state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewops import schemas as K
from reviewops.functions.text import col_, py_nonblank
from reviewops.functions.values import now_col

__all__ = ["has_scores", "intensity", "heuristic_intensity", "fetch_limit",
           "local_yesterday", "initial_recheck"]


def has_scores(score_a, score_b, tag_a, tag_b, reply) -> Column:
    """Any real scorer output: a score > 0 or a non-blank tag / reply."""
    pos = lambda c: F.coalesce(col_(c).cast("double"), F.lit(0.0)) > 0
    return (pos(score_a) | pos(score_b) | py_nonblank(tag_a) | py_nonblank(tag_b)
            | py_nonblank(reply))


def intensity(score_a, score_b, has=None) -> Column:
    """H8: ``(a + b) / 2``; NULL without scores or when either side is NULL."""
    a, b = col_(score_a).cast("double"), col_(score_b).cast("double")
    value = (a + b) / F.lit(2.0)
    return value if has is None else F.when(col_(has), value)


def heuristic_intensity(score_a, score_b, stars, reply,
                        hostile=K.HOSTILE_WORDS, placeholder: str = K.NO_OWNER_REPLY) -> Column:
    """H9: chart intensity from scores, else from stars and the owner reply.

    Rounded half-even to one decimal, as Python's ``round`` does.
    """
    a = F.coalesce(col_(score_a).cast("double"), F.lit(0.0))
    b = F.coalesce(col_(score_b).cast("double"), F.lit(0.0))
    top = F.greatest(a, b)
    scaled = F.when(top > 10, top / 10).otherwise(top)
    from_scores = F.bround(F.greatest(F.lit(1.0), F.least(scaled, F.lit(10.0))), 1)
    s = col_(stars).cast("double")
    s = F.when(F.coalesce(s, F.lit(0.0)) == 0, F.lit(3.0)).otherwise(s)
    base = F.greatest(F.lit(1.0), F.least(F.lit(10.0), (F.lit(6.0) - s) * 1.6 + 1.0))
    text = F.coalesce(col_(reply).cast("string"), F.lit(""))
    is_hostile = None
    for w in hostile:
        hit = F.instr(text, w) > 0
        is_hostile = hit if is_hostile is None else (is_hostile | hit)
    bumped = (F.when(is_hostile, F.least(F.lit(10.0), base + 2.5))
              .when((text != "") & (text != placeholder), F.least(F.lit(10.0), base + 1.0))
              .otherwise(base))
    return F.when(top > 0, from_scores).otherwise(F.bround(bumped, 1))


def fetch_limit(one_star, two_star, buffer: int = K.FETCH_BUFFER) -> Column:
    """Reviews to request on first fetch: 1-star + 2-star + buffer."""
    return (F.coalesce(col_(one_star).cast("int"), F.lit(0))
            + F.coalesce(col_(two_star).cast("int"), F.lit(0)) + F.lit(buffer))


def local_yesterday(now, tz: str = "Asia/Taipei") -> Column:
    """The day before ``now`` in zone ``tz`` as an ISO date string."""
    local = F.from_utc_timestamp(now_col(now).cast("timestamp"), tz)
    return F.date_format(F.date_sub(F.to_date(local), 1), "yyyy-MM-dd")


def initial_recheck(reply, published, now, is_recheck: bool = False,
                    after_days: int = K.RECHECK_AFTER_DAYS,
                    max_age_days: int = K.RECHECK_MAX_AGE_DAYS) -> Column:
    """I4: (owner_reply_recheck, owner_reply_recheck_at, next_check_at).

    A reply ends the recheck; so does ``now`` being strictly later than
    publication + ``max_age_days``; otherwise look again ``after_days`` later.
    A missing publication time counts as ``now``.
    """
    n = now_col(now)
    pub = F.coalesce(col_(published).cast("timestamp_ntz"), n)
    at = n if is_recheck else F.lit(None).cast("timestamp_ntz")
    stop = py_nonblank(reply) | (n > pub + F.make_dt_interval(F.lit(max_age_days)))
    return F.struct(
        (~stop).alias("owner_reply_recheck"),
        at.alias("owner_reply_recheck_at"),
        F.when(~stop, n + F.make_dt_interval(F.lit(after_days))).alias("next_check_at"),
    )
