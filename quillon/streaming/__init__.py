"""Requests over streams: tumbling windows with late data, as an extension of time dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Window lengths for the granularities that have a fixed length.
WINDOWS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days"}
#: Windows count from 1970-01-01, a Thursday; weeks start on Monday.
_WEEK_START = "4 days"


def windowed(df: DataFrame, time_col: str, granularity: str, late: str, dims: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """Aggregates of a stream (or a table) by window start and dimensions.

    Rows later than `late` behind the newest are dropped and their windows closed, so the state
    holds open windows only.
    """
    if granularity not in WINDOWS:
        raise ValueError(f"'{granularity}' has no fixed length; use one of {', '.join(WINDOWS)}")
    start = (WINDOWS[granularity], WINDOWS[granularity], _WEEK_START) if granularity == "week" else (WINDOWS[granularity],)
    by = [F.window(time_col, *start).alias("__window"), *[c.alias(n) for n, c in dims.items()]]
    out = df.withWatermark(time_col, late).groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(F.col("__window.start").alias(f"{time_col}__{granularity}"), *dims, *measures)
