"""What is asked: members, filters, order, from a dict, JSON or command-line flags."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from quillon.errors import QueryError, SchemaError

#: Operators by what they take: no value, one, two, or any number of them.
NO_VALUE = ("set", "notSet")
ONE_VALUE = ("gt", "gte", "lt", "lte", "beforeDate", "beforeOrOnDate", "afterDate", "afterOrOnDate", "onTheDate")
TWO_VALUES = ("inDateRange", "notInDateRange")
MANY_VALUES = ("equals", "notEquals", "contains", "notContains", "startsWith", "notStartsWith", "endsWith", "notEndsWith")
OPERATORS = (*MANY_VALUES, *ONE_VALUE, *NO_VALUE, *TWO_VALUES)
#: Spellings of topic default filters.
DEFAULT_FILTERS = {
    "eq": "equals", "neq": "notEquals", "in": "equals", "not_in": "notEquals", "gt": "gt", "gte": "gte", "lt": "lt", "lte": "lte",
    "in_date_range": "inDateRange", "not_in_date_range": "notInDateRange",
}


@dataclass(frozen=True)
class Filter:
    """A leaf (member, operator, values) or a group (all or any of its parts)."""

    member: str = ""
    operator: str = ""
    values: tuple[str, ...] = ()
    parts: tuple[Filter, ...] = ()
    any_of: bool = False

    @property
    def is_group(self) -> bool:
        return not self.member

    def leaves(self) -> Iterator[Filter]:
        if self.is_group:
            for part in self.parts:
                yield from part.leaves()
        else:
            yield self


@dataclass(frozen=True)
class TimeDimension:
    dimension: str
    granularity: str | None = None
    date_range: Any = None

    @property
    def member(self) -> str:
        return f"{self.dimension}.{self.granularity}" if self.granularity else self.dimension


@dataclass(frozen=True)
class Order:
    id: str
    desc: bool = False


@dataclass(frozen=True)
class QueryRequest:
    measures: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    segments: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    time_dimensions: tuple[TimeDimension, ...] = ()
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    timezone: str | None = None
    ungrouped: bool = False
    through: tuple[str, ...] = ()
    motif: str | None = None
    motif_params: dict[str, Any] = field(default_factory=dict)


def alias(member: str) -> str:
    return member.replace(".", "__")


def split(member: str) -> tuple[str, str]:
    parts = member.split(".")
    if len(parts) != 2 or not all(parts):
        raise QueryError(f"'{member}' is not view.member")
    return parts[0], parts[1]


def parse_filter(raw: Any) -> Filter:
    if not isinstance(raw, dict):
        raise SchemaError(f"not a filter: {raw!r}")
    for key in ("and", "or"):
        if key in raw:
            return Filter(parts=tuple(map(parse_filter, raw[key] or ())), any_of=key == "or")
    if "member" not in raw or "operator" not in raw:
        raise SchemaError(f"a filter needs member and operator: {raw!r}")
    if raw["operator"] not in OPERATORS:
        raise SchemaError(f"unknown filter operator '{raw['operator']}'")
    values = raw.get("values")
    values = [] if values is None else values if isinstance(values, list | tuple) else [values]
    made = Filter(raw["member"], raw["operator"], tuple(_text(v) for v in values))
    check(made)
    return made


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def check(leaf: Filter) -> None:
    n, op = len(leaf.values), leaf.operator
    if op in TWO_VALUES and n != 2 or op in ONE_VALUE and n < 1 or op in MANY_VALUES and n < 1:
        raise QueryError(f"filter '{op}' on {leaf.member} has {n} values")


def parse(raw: Any) -> QueryRequest:
    """A request from a dict or JSON text; unknown keys are ignored."""
    if isinstance(raw, QueryRequest):
        return raw
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise SchemaError(f"not JSON: {e}") from e
    if not isinstance(raw, dict):
        raise SchemaError("a query is an object")
    return QueryRequest(
        tuple(raw.get("measures") or ()),
        tuple(raw.get("dimensions") or ()),
        tuple(raw.get("segments") or ()),
        tuple(map(parse_filter, raw.get("filters") or ())),
        tuple(TimeDimension(t["dimension"], t.get("granularity"), t.get("date_range")) for t in raw.get("time_dimensions") or ()),
        tuple(Order(o["id"], bool(o.get("desc"))) for o in raw.get("order") or ()),
        raw.get("limit"),
        raw.get("offset"),
        raw.get("timezone"),
        bool(raw.get("ungrouped")),
        tuple(raw.get("through") or ()),
        raw.get("motif"),
        dict(raw.get("motif_params") or {}),
    )


def filter_flag(text: str) -> Filter:
    """member:operator:v1,v2 of the command line."""
    parts = text.split(":", 2)
    if len(parts) < 2:
        raise QueryError(f"'{text}' is not member:operator:values")
    raw = {"member": parts[0], "operator": parts[1], "values": parts[2].split(",") if len(parts) == 3 else []}
    return parse_filter(raw)


def order_flag(text: str) -> Order:
    """member, member:asc or member:desc of the command line."""
    name, colon, way = text.rpartition(":")
    if not colon:
        return Order(text)
    if way not in ("asc", "desc"):
        raise QueryError(f"'{way}' is not asc or desc")
    return Order(name, way == "desc")


def motif_param_flag(text: str) -> tuple[str, Any]:
    """key=value of the command line; numbers become numbers."""
    key, equals, value = text.partition("=")
    if not equals or not key:
        raise QueryError(f"'{text}' is not key=value")
    for kind in (int, float):
        try:
            return key, kind(value)
        except ValueError:
            continue
    return key, value


def default_filter(raw: dict) -> Filter:
    """A topic's default filter as a request's."""
    op = raw.get("op") or raw.get("operator")
    if op not in DEFAULT_FILTERS:
        raise QueryError(f"unknown default filter operator '{op}'")
    values = raw.get("values", raw.get("value"))
    return parse_filter({"member": raw.get("field") or raw.get("member"), "operator": DEFAULT_FILTERS[op], "values": values})
