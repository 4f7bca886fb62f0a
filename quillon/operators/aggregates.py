"""Measures as aggregate SQL over the rows of their own view."""

from __future__ import annotations

from quillon.errors import PlanError
from quillon.model import RAW_TYPES, Measure

_CALLS = {
    "sum": "SUM({})", "average": "AVG({})", "min": "MIN({})", "max": "MAX({})", "count_distinct": "COUNT(DISTINCT {})",
    "count_distinct_approx": "approx_count_distinct({})", "median": "median({})", "count": "COUNT({})",
}


def row_input(measure: Measure, expr: str | None, filters: list[str]) -> str:
    """What one row gives to the aggregate; rows that fail a filter give null."""
    value = expr or "1"
    if value.strip() == "*":
        value = "1"
    return f"CASE WHEN {' AND '.join(f'({f})' for f in filters)} THEN {value} END" if filters else value


def call(measure: Measure, expr: str | None, filters: list[str]) -> str:
    """The aggregate of a measure with its expression and filters resolved."""
    if measure.type in RAW_TYPES:
        if filters:
            raise PlanError(f"measure '{measure.name}' aggregates in its own expression and cannot have filters")
        if not expr:
            raise PlanError(f"measure '{measure.name}' needs an expression")
        return f"({expr})"
    out = _CALLS[measure.type].format(row_input(measure, expr, filters))
    return f"COALESCE({out}, 0)" if measure.type == "sum" and filters else out


def on_nothing(measure: Measure) -> int | None:
    """The value over no rows."""
    zero = measure.type.startswith("count") or measure.type == "sum" and measure.filters
    return 0 if zero else None
