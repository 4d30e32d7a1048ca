"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coalesce0(x, dtype: str = "bigint") -> Column:
    """NULL sums/counts of empty groups become 0 (BIGINT by default)."""
    return F.coalesce(_c(x).cast(dtype), F.lit(0).cast(dtype))


def elapsed_days(start, end) -> Column:
    """Whole elapsed days between two instants (the day field of end - start).

    Calendar-day difference (``datediff``) would count 2 for a 47-hour gap
    that crosses two midnights; the interval day field counts 1.
    """
    return F.timestamp_diff("DAY", _c(start), _c(end)).cast("int")


def round_ratio_half_up(num, den, scale: int = 2) -> Column:
    """``round(num / den, scale)`` rounding halves away from zero, as DOUBLE.

    Exact for integer inputs: the rounding is done in integer arithmetic,
    so no binary-fraction error can move a value across a half.
    ``den == 0`` gives NULL.
    """
    n, d = _c(num).cast("decimal(38,0)"), _c(den).cast("decimal(38,0)")
    unit = 10**scale
    q = F.floor((F.abs(n) * (2 * unit) + F.abs(d)) / (F.abs(d) * 2))
    signed = F.when((n < 0) != (d < 0), -q).otherwise(q)
    return F.when(d == 0, F.lit(None)).otherwise(signed.cast("double") / F.lit(float(unit)))


def day_text(x) -> Column:
    """``date::text``: ISO ``yyyy-MM-dd``."""
    return F.date_format(_c(x), "yyyy-MM-dd")


def title_matches(query: str, col: str = "title") -> Column:
    """Case-insensitive substring match; ``%`` and ``_`` in ``query`` stay
    wildcards, as in the reference's unescaped ILIKE pattern."""
    return F.col(col).ilike(f"%{query}%")


def tag_contains(tag: str, col: str = "tags") -> Column:
    """Array containment of one exact tag; a NULL element never matches."""
    return F.coalesce(F.array_contains(F.col(col), F.lit(tag)), F.lit(False))
