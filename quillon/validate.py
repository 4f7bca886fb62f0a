"""Checks of a layer; all failures are reported together."""

from __future__ import annotations

from collections import Counter

from quillon.errors import SchemaError
from quillon.model import RAW_TYPES, Layer
from quillon.plans import refs


def _twice(names: list[str]) -> list[str]:
    return sorted(n for n, c in Counter(names).items() if c > 1)


def problems(layer: Layer) -> list[str]:
    out = [f"view '{n}' is declared twice" for n in _twice([v.name for v in layer.views])]
    names = {v.name for v in layer.views}
    entities = {e.name for v in layer.views for e in v.entities}
    for v in layer.views:
        if bool(v.table) == bool(v.sql):
            out.append(f"view '{v.name}' needs either table or sql")
        out += [f"dimension '{v.name}.{n}' is declared twice" for n in _twice([d.name for d in v.dimensions])]
        out += [f"measure '{v.name}.{n}' is declared twice" for n in _twice([m.name for m in v.measures])]
        out += [f"dimension '{v.name}.{d.name}' has no expression" for d in v.dimensions if not d.expr.strip()]
        for m in v.measures:
            if m.type != "count" and not (m.expr or "").strip():
                out.append(f"measure '{v.name}.{m.name}' of type {m.type} needs an expression")
            if m.type in RAW_TYPES and m.filters:
                out.append(f"measure '{v.name}.{m.name}' aggregates in its own expression and cannot have filters")
            for first, second in refs.names(m.expr or ""):
                if second and first not in {*names, *entities, "variables", "TABLE"}:
                    out.append(f"measure '{v.name}.{m.name}' refers to '{first}', which is no view or entity")
        for e in v.entities:
            if not e.keys:
                out.append(f"entity '{e.name}' of view '{v.name}' has no key")
            out += [f"key '{k}' of entity '{e.name}' is no dimension of view '{v.name}'" for k in e.keys if v.dimension(k) is None]
    for m in layer.motifs:
        if not m.outputs:
            out.append(f"motif '{m.name}' has no outputs")
        for name, text in m.outputs:
            unknown = [a for a, b in refs.names(text) if b or a not in {*m.params, "dimensions"}]
            out += [f"output '{name}' of motif '{m.name}' uses unknown parameter '{a}'" for a in unknown]
        out += [f"parameter '{k}' of motif '{m.name}' is an enum without values" for k, p in m.params.items() if p.type == "enum" and not p.values]
    out += [f"motif '{n}' is declared twice" for n in _twice([m.name for m in layer.motifs])]
    for s in layer.saved_queries:
        if not s.steps:
            out.append(f"saved query '{s.name}' has no steps")
        out += [f"step '{n}' of saved query '{s.name}' is declared twice" for n in _twice([x.name for x in s.steps])]
    for t in layer.topics:
        out += [f"topic '{t.name}' names unknown view '{n}'" for n in t.views if n not in names]
    return out


def warnings(layer: Layer) -> list[str]:
    """Foreign entities that no view owns."""
    owned = {e.name for v in layer.views for e in v.entities if e.type == "primary"}
    return [f"entity '{e.name}' of view '{v.name}' has no primary view" for v in layer.views for e in v.entities if e.type == "foreign" and e.name not in owned]


def check(layer: Layer) -> None:
    if found := problems(layer):
        raise SchemaError("\n".join(found))
