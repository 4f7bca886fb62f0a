"""Scalar functions that requests use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillon.errors import QueryError
from quillon.model import GRANULARITIES


def truncated(column: Column, granularity: str | None, timezone: str | None = None) -> Column:
    """A time column in a zone, cut to a granularity (weeks start on Monday), as timestamp without zone.

    Times without a zone are UTC. The session's zone has no part in it, so neither have its
    days that lack an hour or have one twice. Without a granularity and zone the column stays as it is.
    """
    if timezone and timezone.upper() != "UTC":
        column = F.convert_timezone(F.lit("UTC"), F.lit(timezone), column.cast("timestamp_ntz"))
    if granularity is None:
        return column
    if granularity not in GRANULARITIES:
        raise QueryError(f"'{granularity}' is not one of {', '.join(GRANULARITIES)}")
    if granularity in ("hour", "minute", "second"):
        time, zero = column.cast("timestamp_ntz"), F.lit(0)
        second = F.extract(F.lit("SECOND"), time)
        over = F.make_dt_interval(zero, zero, F.minute(time) if granularity == "hour" else zero, second % 1 if granularity == "second" else second)
        return (time - over).cast("timestamp_ntz")
    day = column.cast("date")
    return (day if granularity == "day" else F.trunc(day, granularity)).cast("timestamp_ntz")
