"""YAML to the semantic model."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path
from typing import Any

import yaml

from quillon import model as m
from quillon.errors import SchemaError

KINDS = {"view": "views", "topic": "topics", "motif": "motifs", "query": "queries"}
_SPELLINGS = {"avg": "average", "time": "datetime", "timestamp": "datetime"}


def _need(item: Any, key: str, what: str) -> Any:
    if not isinstance(item, dict) or item.get(key) in (None, ""):
        raise SchemaError(f"{what} needs '{key}': {item!r}")
    return item[key]


def _tuple(value: Any) -> tuple:
    return tuple(value) if isinstance(value, list | tuple) else () if value is None else (value,)


def _typed(value: str, known: Iterable[str], what: str) -> str:
    value = _SPELLINGS.get(value, value)
    if value not in known:
        raise SchemaError(f"unknown {what} type '{value}'")
    return value


def entity(item: dict) -> m.Entity:
    keys = _tuple(item.get("keys")) or _tuple(item.get("key"))
    return m.Entity(_need(item, "name", "entity"), _typed(item.get("type") or "primary", ("primary", "foreign"), "entity"), tuple(map(str, keys)), item.get("description"))


def dimension(item: dict) -> m.Dimension:
    name = _need(item, "name", "dimension")
    return m.Dimension(
        name,
        _typed(_need(item, "type", f"dimension '{name}'"), m.DIMENSION_TYPES, "dimension"),
        str(_need(item, "expr", f"dimension '{name}'")),
        item.get("description"),
        bool(item.get("sub_query")),
        bool(item.get("primary_key")),
        tuple(map(str, _tuple(item.get("samples")))),
        tuple(map(str, _tuple(item.get("synonyms")))),
        item.get("meta"),
    )


def measure(item: dict) -> m.Measure:
    name, window = _need(item, "name", "measure"), item.get("rolling_window")
    if window is not None:
        window = m.RollingWindow(*(None if window.get(k) is None else str(window[k]) for k in ("trailing", "leading", "offset")))
    filters = tuple(str(_need(f, "expr", f"filter of measure '{name}'")) if isinstance(f, dict) else str(f) for f in _tuple(item.get("filters")))
    return m.Measure(
        name,
        _typed(_need(item, "type", f"measure '{name}'"), m.MEASURE_TYPES, "measure"),
        None if item.get("expr") is None else str(item["expr"]),
        item.get("description"),
        filters,
        window,
        tuple(map(str, _tuple(item.get("samples")))),
        tuple(map(str, _tuple(item.get("synonyms")))),
        item.get("meta"),
    )


class Globals:
    """Definitions that views inherit by `inherits_from: globals.semantics.<kind>.<name>`."""

    def __init__(self, text: str | None = None) -> None:
        raw = (yaml.safe_load(text) if text else None) or {}
        raw = raw.get("semantics", raw)
        self.items = {kind: self._named(raw.get(kind)) for kind in ("entities", "dimensions", "measures")}

    @staticmethod
    def _named(items: Any) -> dict[str, dict]:
        if isinstance(items, dict):
            return {k: {"name": k} | (v or {}) for k, v in items.items()}
        out = {}
        for item in items or ():
            # A list entry may carry its name as a key without a value.
            name = item.get("name") or next((k for k, v in item.items() if v is None), None)
            if name is None:
                raise SchemaError(f"a global definition needs a name: {item!r}")
            out[name] = {k: v for k, v in item.items() if v is not None or k != name} | {"name": name}
        return out

    def resolve(self, item: Any, kind: str) -> dict:
        if not isinstance(item, dict) or "inherits_from" not in item:
            return item
        path = str(item["inherits_from"]).split(".")
        name = path[-1]
        if path[:-1] != ["globals", "semantics", kind] or name not in self.items[kind]:
            raise SchemaError(f"'{item['inherits_from']}' is not among the global {kind}")
        found = self.items[kind][name]
        own = {k: v for k, v in item.items() if k != "inherits_from"}
        if kind == "entities":
            return found | own
        # A full definition beside inherits_from wins; a bare name takes the global's name and all.
        return own if {"type", "expr"} <= own.keys() else found


def view(text: str, shared: Globals | None = None) -> m.View:
    raw, shared = yaml.safe_load(text), shared or Globals()
    name = _need(raw, "name", "view")
    return m.View(
        name,
        raw.get("description") or "",
        raw.get("table"),
        raw.get("sql"),
        raw.get("datasource"),
        raw.get("dialect"),
        tuple(entity(shared.resolve(x, "entities")) for x in raw.get("entities") or ()),
        tuple(dimension(shared.resolve(x, "dimensions")) for x in raw.get("dimensions") or ()),
        tuple(measure(shared.resolve(x, "measures")) for x in raw.get("measures") or ()),
        tuple(m.Segment(_need(x, "name", "segment"), str(_need(x, "expr", "segment")), x.get("description")) for x in raw.get("segments") or ()),
        raw.get("meta"),
    )


def topic(text: str) -> m.Topic:
    raw = yaml.safe_load(text)
    return m.Topic(_need(raw, "name", "topic"), _tuple(raw.get("views")), raw.get("description") or "", raw.get("base_view"), raw.get("retrieval"), _tuple(raw.get("default_filters")))


def motif(text: str) -> m.Motif:
    raw = yaml.safe_load(text)
    params = {
        k: m.MotifParam(_typed(_need(p, "type", f"param '{k}'"), m.PARAM_TYPES, "param"), _tuple(p.get("constraints")), p.get("default"), _tuple(p.get("values")), p.get("description"))
        for k, p in (raw.get("params") or {}).items()
    }
    outputs = tuple((_need(o, "name", "output"), str(_need(o, "expr", "output"))) for o in raw.get("outputs") or raw.get("adds") or ())
    return m.Motif(_need(raw, "name", "motif"), raw.get("description") or "", params, outputs)


def saved_query(text: str) -> m.SavedQuery:
    raw = yaml.safe_load(text)
    name, steps = _need(raw, "name", "saved query"), raw.get("steps")
    if steps:
        made = tuple(m.SavedStep(_need(s, "name", "step"), s.get("query") or {}, s.get("description") or "") for s in steps)
    else:
        made = (m.SavedStep(name, raw["query"], raw.get("description") or ""),) if raw.get("query") else ()
    return m.SavedQuery(name, made, raw.get("description") or "", raw.get("params") or {})


def _texts(base: Path, kind: str) -> list[str]:
    folder = base / KINDS[kind]
    return [p.read_text(encoding="utf-8") for p in sorted((folder if folder.is_dir() else base).rglob(f"*.{kind}.yml"))]


def layer(views: Iterable[str], topics: Iterable[str] = (), motifs: Iterable[str] = (), queries: Iterable[str] = (), globals_text: str | None = None, variables: dict | None = None) -> m.Layer:
    """A layer from YAML texts."""
    try:
        shared = Globals(globals_text)
        return m.Layer(
            tuple(view(t, shared) for t in views), tuple(map(topic, topics)), tuple(map(motif, motifs)), tuple(map(saved_query, queries)), dict(variables or {})
        )
    except yaml.YAMLError as e:
        raise SchemaError(f"not YAML: {e}") from e


def project(folder: str | Path, variables: dict | None = None) -> m.Layer:
    """A layer from *.view.yml, *.topic.yml, *.motif.yml and *.query.yml below a folder."""
    base = Path(folder)
    shared = next((p.read_text(encoding="utf-8") for p in (base / "globals.yml", base / "globals.yaml") if p.exists()), None)
    views = _texts(base, "view")
    if not views:
        raise SchemaError(f"no *.view.yml below {base}")
    return layer(views, _texts(base, "topic"), _texts(base, "motif"), _texts(base, "query"), shared, variables)


def find_project(start: str | Path) -> Path | None:
    """The nearest folder upwards that has a config.yml."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / "config.yml").exists()), None)
