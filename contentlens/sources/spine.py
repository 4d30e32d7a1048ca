"""The calendar-day spine (inclusive: ``days + 1`` rows)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_of_literal(as_of: dt.datetime | str):
    """A TIMESTAMP_NTZ literal column for the reporting instant."""
    if isinstance(as_of, dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp_ntz(F.lit(str(as_of)))


def date_spine(spark: SparkSession, as_of, days: int) -> DataFrame:
    """One row per calendar day ``date(as_of) - days .. date(as_of)``.

    The spine is built from a one-row range and a generator, so its size is
    exactly ``days + 1`` rows whatever the data size.
    """
    end = F.to_date(as_of_literal(as_of))
    return spark.range(1).select(
        F.explode(F.sequence(F.date_sub(end, int(days)), end)).alias("date")
    )
