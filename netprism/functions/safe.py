"""Null/NaN/Infinity-safe column arithmetic.

Spark runs with ANSI mode on by default: ``x / 0`` raises.  pandas gives
+-inf or NaN.  The helpers below give the pandas value where the reference
relies on it and a null where a missing value is meant, without leaving the
JVM (all are plain Catalyst expressions, so they stay in whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c) -> Column:
    """True for null, NaN (doubles only) - pandas ``isnull``."""
    c = col(c)
    return c.isNull() | F.isnan(c)


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite_or_null(c) -> Column:
    """null for null, NaN and +-Infinity."""
    c = col(c)
    return F.when(~F.isnan(c) & ~c.isin(INF, -INF), c)


def pandas_div(num, den) -> Column:
    """Float division with pandas semantics: x/0 -> +-inf, 0/0 -> NaN, null -> null.

    IEEE division of doubles gives exactly these values; ``try_divide`` would
    give null instead, so the division is done on doubles with ANSI off for
    this expression only through a ``when`` guard.
    """
    n = col(num).cast("double")
    d = col(den).cast("double")
    return (F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
            .when(d != 0, n / d)
            .when(n > 0, F.lit(INF))
            .when(n < 0, F.lit(-INF))
            .when(n == 0, F.lit(float("nan"))))


def null_div(num, den) -> Column:
    """Division that gives null on a zero divisor (SQL NULLIF semantics)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def r6(c, digits: int = 6) -> Column:
    """Round a double for comparisons with another engine."""
    return F.round(col(c).cast("double"), digits)


BROADCAST_ROW_LIMIT = 1_000_000


def bounded_broadcast(df, limit: int = BROADCAST_ROW_LIMIT):
    """Broadcast hint only when the side is proven small: its row count (one
    cheap aggregate of an already small per-class / per-key table) is checked
    first; above ``limit`` the join is left to the planner (sort-merge, AQE)."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= limit else df


def null_safe_join(left, right, on, how: str = "inner"):
    """Equi-join on the columns ``on`` in which a null key meets a null key.
    The right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in on})
    cond = None
    for c in on:
        same = left[c].eqNullSafe(renamed[f"__right_{c}"])
        cond = same if cond is None else cond & same
    return left.join(renamed, cond, how).drop(*[f"__right_{c}" for c in on])
