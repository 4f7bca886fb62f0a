"""Rolling measures: windows over aggregated rows, built from partial aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.errors import PlanError
from quillon.model import Measure
from quillon.operators import ordered

#: Aggregates whose partial results roll up exactly.
ADDITIVE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _rows(text: str | None, default: int, sign: int, unbounded: int) -> int:
    if text is None:
        return default
    text = text.strip().lower()
    if text == "unbounded":
        return unbounded
    if text == "current row":
        return 0
    got = re.match(r"(\d+)\b", text)
    if not got:
        raise PlanError(f"'{text}' is not a rolling window bound")
    return sign * int(got[1])


def bounds(measure: Measure) -> tuple[int, int]:
    """Rows from `trailing` (default: all before) to `leading` (default: this one); a unit after the number has no effect."""
    w = measure.rolling_window
    return _rows(w.trailing, Window.unboundedPreceding, -1, Window.unboundedPreceding), _rows(w.leading, 0, 1, Window.unboundedFollowing)


def checked(measure: Measure) -> None:
    """An error for types whose partial results do not roll up."""
    if measure.type != "average" and measure.type not in ADDITIVE:
        raise PlanError(f"a rolling window over '{measure.type}' ({measure.name}) has no exact partial results")


def _value(measure: Measure, parts: dict[str, Column]) -> Column:
    """The rolling value from rolled partial columns: `value`, or `sum` and `n` of an average."""
    if measure.type == "average":
        return parts["sum"] / F.nullif(parts["n"].cast("double"), F.lit(0.0))
    return F.coalesce(parts["value"], F.lit(0)) if measure.type == "sum" and measure.filters else parts["value"]


def rolled(df: DataFrame, measures: dict[str, Measure], order: tuple[str, ...], periods: bool) -> DataFrame:
    """`df` with rolling values by name in order of time and the other dimensions, nulls first.

    Partial columns are <name>__value, or <name>__sum and <name>__n. periods: the time column holds days or
    longer; alone with it, rows are as few as the days of a calendar and one window may hold them
    all. Otherwise frames run in chunks, and what lies beyond a chunk comes from a row for each chunk.
    """
    parts = {name: {k: F.sum if m.type == "average" else ADDITIVE[m.type] for k in (("sum", "n") if m.type == "average" else ("value",))} for name, m in measures.items()}
    frames = {name: bounds(m) for name, m in measures.items()}
    if periods and len(order) == 1:
        window = Window.orderBy(F.col(order[0]).asc_nulls_first())
        return df.withColumns({name: _value(m, {k: call(f"{name}__{k}").over(window.rowsBetween(*frames[name])) for k, call in parts[name].items()}) for name, m in measures.items()})
    rows = ordered.numbered(df, order[0], order[1:], periods)
    columns = [(name, k, call) for name, calls in parts.items() for k, call in calls.items()]
    beyond = rows.groupBy(F.floor((F.col(ordered.NUMBER) - 1) / ordered.CHUNK).alias("__of")).agg(*[call(f"{name}__{k}").alias(f"__{name}__{k}") for name, k, call in columns])
    # Aggregates of all chunks before, or after, for frames without an end on that side.
    far = {}
    for name, k, call in columns:
        for side, (first, last), open_ in (("before", (Window.unboundedPreceding, -1), frames[name][0] == Window.unboundedPreceding), ("after", (1, Window.unboundedFollowing), frames[name][1] == Window.unboundedFollowing)):
            if open_:
                far[f"__{side}__{name}__{k}"] = call(f"__{name}__{k}").over(Window.orderBy("__of").rowsBetween(first, last))
    reach = [max([0, *(abs(f[i]) for f in frames.values() if f[i] not in (Window.unboundedPreceding, Window.unboundedFollowing) and (f[i] < 0) == (i == 0))]) for i in (0, 1)]
    made = ordered.Chunks.of(rows, *reach).rows
    if far:
        made = made.join(beyond.select("__of", *[c.alias(n) for n, c in far.items()]), F.col(ordered.AT) == F.col("__of"), "left")
    window, values = ordered.Chunks.window(), {}
    for name, measure in measures.items():
        meet = {"min": F.least, "max": F.greatest}.get(measure.type, lambda a, b: F.coalesce(a + b, a, b))
        start, end = frames[name]
        # Without an end on a side, copies from there are part of what lies beyond.
        use = (F.col(ordered.HOME) <= 0 if start == Window.unboundedPreceding else F.lit(True)) & (F.col(ordered.HOME) >= 0 if end == Window.unboundedFollowing else F.lit(True))
        got = {}
        for k, call in parts[name].items():
            got[k] = call(F.when(use, F.col(f"{name}__{k}"))).over(window.rowsBetween(start, end))
            for side in ("before", "after"):
                if f"__{side}__{name}__{k}" in far:
                    got[k] = meet(got[k], F.col(f"__{side}__{name}__{k}"))
        values[name] = _value(measure, got)
    return ordered.Chunks.finished(made.withColumns(values)).drop("__of", *far)
