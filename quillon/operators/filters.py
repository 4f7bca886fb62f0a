"""Request filters as Spark columns over dimensions and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quillon.errors import QueryError
from quillon.request import Filter, check

_COMPARE = {
    "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__,
    "beforeDate": Column.__lt__, "beforeOrOnDate": Column.__le__, "afterDate": Column.__gt__, "afterOrOnDate": Column.__ge__,
}
_LIKE = {"contains": "%{}%", "startsWith": "{}%", "endsWith": "%{}"}


def literal(value: str, kind: str, member: str) -> Column:
    """A filter value in the dimension's type; text that is none of it is an error of the request."""
    try:
        if kind in ("number", "measure"):
            try:
                return F.lit(int(value))
            except ValueError:
                return F.lit(float(value))
        if kind == "boolean":
            return F.lit({"true": True, "1": True, "t": True, "yes": True, "false": False, "0": False, "f": False, "no": False}[value.lower()])
    except (ValueError, KeyError):
        raise QueryError(f"'{value}' is not a {kind} for {member}") from None
    if kind in ("date", "datetime"):
        import datetime

        try:
            when = datetime.datetime.fromisoformat(value)
        except ValueError:
            raise QueryError(f"'{value}' is not a date for {member}") from None
        if kind == "date" and when.time() == datetime.time.min:
            return F.lit(when.date())
        return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def _pattern(shape: str, value: str) -> str:
    """% and _ of a value stay wildcards; a backslash is itself."""
    return shape.format(value.replace("\\", "\\\\"))


def leaf(f: Filter, column: Column, kind: str) -> Column:
    check(f)
    op = f.operator
    if op == "set":
        return column.isNotNull()
    if op == "notSet":
        return column.isNull()
    if op.removeprefix("not")[:1].isupper() and op.startswith("not") and (plain := op[3].lower() + op[4:]) in _LIKE:
        return reduce(Column.__and__, [~column.like(_pattern(_LIKE[plain], v)) for v in f.values])
    if op in _LIKE:
        return reduce(Column.__or__, [column.like(_pattern(_LIKE[op], v)) for v in f.values])
    values = [literal(v, kind, f.member) for v in f.values]
    if op == "equals":
        return column == values[0] if len(values) == 1 else column.isin(*values)
    if op == "notEquals":
        return column != values[0] if len(values) == 1 else ~column.isin(*values)
    if op in _COMPARE:
        return _COMPARE[op](column, values[0])
    if op == "inDateRange":
        return (column >= values[0]) & (column <= values[1])
    if op == "notInDateRange":
        return (column < values[0]) | (column > values[1])
    if op == "onTheDate":
        day = values[0].cast("date")
        first, after = day.cast("timestamp_ntz"), F.date_add(day, 1).cast("timestamp_ntz")
        return (column >= first) & (column < after) if kind != "date" else column == day
    raise QueryError(f"unknown filter operator '{op}'")


def tree(f: Filter, column_of, kind_of) -> Column | None:
    """A filter with its groups; None for a group without parts."""
    if not f.is_group:
        return leaf(f, column_of(f.member), kind_of(f.member))
    parts = [p for p in (tree(x, column_of, kind_of) for x in f.parts) if p is not None]
    if not parts:
        return None
    return reduce(Column.__or__ if f.any_of else Column.__and__, parts)
