"""The semantic model: views of tables, and what may be asked of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

DIMENSION_TYPES = ("string", "number", "date", "datetime", "boolean", "geo")
MEASURE_TYPES = ("count", "sum", "average", "min", "max", "count_distinct", "count_distinct_approx", "median", "custom", "number")
#: Measures whose expression already aggregates.
RAW_TYPES = ("custom", "number")
GRANULARITIES = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
PARAM_TYPES = ("measure", "dimension", "number", "string", "enum")


@dataclass(frozen=True)
class Entity:
    """A join key: `primary` where the view is the entity, `foreign` where it points to one."""

    name: str
    type: str = "primary"
    keys: tuple[str, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class Dimension:
    name: str
    type: str
    expr: str
    description: str | None = None
    sub_query: bool = False
    primary_key: bool = False
    samples: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()
    meta: Any = None


@dataclass(frozen=True)
class RollingWindow:
    """Frame over aggregated rows; `offset` is kept but has no effect."""

    trailing: str | None = None
    leading: str | None = None
    offset: str | None = None


@dataclass(frozen=True)
class Measure:
    name: str
    type: str
    expr: str | None = None
    description: str | None = None
    filters: tuple[str, ...] = ()
    rolling_window: RollingWindow | None = None
    samples: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()
    meta: Any = None


@dataclass(frozen=True)
class Segment:
    name: str
    expr: str
    description: str | None = None


@dataclass(frozen=True)
class View:
    """One relation, a table or a SQL text, with its vocabulary."""

    name: str
    description: str = ""
    table: str | None = None
    sql: str | None = None
    datasource: str | None = None
    dialect: str | None = None
    entities: tuple[Entity, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    measures: tuple[Measure, ...] = ()
    segments: tuple[Segment, ...] = ()
    meta: Any = None

    def dimension(self, name: str) -> Dimension | None:
        return next((d for d in self.dimensions if d.name == name), None)

    def measure(self, name: str) -> Measure | None:
        return next((m for m in self.measures if m.name == name), None)

    def segment(self, name: str) -> Segment | None:
        return next((s for s in self.segments if s.name == name), None)

    def primary_keys(self) -> tuple[str, ...]:
        return next((e.keys for e in self.entities if e.type == "primary"), ())


@dataclass(frozen=True)
class Topic:
    """Views that belong together; base_view, retrieval and default_filters are descriptive unless asked for."""

    name: str
    views: tuple[str, ...] = ()
    description: str = ""
    base_view: str | None = None
    retrieval: Any = None
    default_filters: tuple[dict, ...] = ()


@dataclass(frozen=True)
class MotifParam:
    type: str
    constraints: tuple[str, ...] = ()
    default: Any = None
    values: tuple[Any, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class Motif:
    """Columns added to an aggregated result; `{{ param }}` in their expressions are bound to its columns."""

    name: str
    description: str = ""
    params: dict[str, MotifParam] = field(default_factory=dict)
    outputs: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class SavedStep:
    name: str
    query: dict
    description: str = ""


@dataclass(frozen=True)
class SavedQuery:
    name: str
    steps: tuple[SavedStep, ...]
    description: str = ""
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Layer:
    """Everything a project declares."""

    views: tuple[View, ...]
    topics: tuple[Topic, ...] = ()
    motifs: tuple[Motif, ...] = ()
    saved_queries: tuple[SavedQuery, ...] = ()
    variables: dict[str, str] = field(default_factory=dict)

    def view(self, name: str) -> View | None:
        return next((v for v in self.views if v.name == name), None)
