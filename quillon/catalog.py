"""Flat lists of what a layer declares, for discovery."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillon.model import Layer, View
from quillon.operators import motifs

_FIELDS = "kind string, path string, name string, type string, description string, view string, expr string"


def entries(layer: Layer) -> list[dict[str, Any]]:
    """A dict for each view, member, entity, topic, motif and saved query."""
    out = []

    def add(kind: str, path: str, name: str, type_: str | None = None, description: str | None = None, view: str | None = None, expr: str | None = None) -> None:
        out.append({"kind": kind, "path": path, "name": name, "type": type_, "description": description, "view": view, "expr": expr})

    for v in layer.views:
        add("view", v.name, v.name, "sql" if v.sql else "table", v.description, v.name, v.sql or v.table)
        for kind, items in (("dimension", v.dimensions), ("measure", v.measures)):
            for x in items:
                add(kind, f"{v.name}.{x.name}", x.name, x.type, x.description, v.name, x.expr)
        for s in v.segments:
            add("segment", f"{v.name}.{s.name}", s.name, None, s.description, v.name, s.expr)
        for e in v.entities:
            add("entity", f"{v.name}.{e.name}", e.name, e.type, e.description, v.name, ", ".join(e.keys))
    for t in layer.topics:
        add("topic", t.name, t.name, None, t.description)
    for name, b in motifs.BUILTINS.items():
        add("motif", name, name, "builtin", b.description)
    for m in layer.motifs:
        add("motif", m.name, m.name, "custom", m.description)
    for q in layer.saved_queries:
        add("saved_query", q.name, q.name, None, q.description)
    return out


def table(spark: SparkSession, layer: Layer) -> DataFrame:
    return spark.createDataFrame(entries(layer), _FIELDS)


def inspect_view(v: View) -> dict[str, Any]:
    """A view's vocabulary."""
    return {
        "name": v.name,
        "description": v.description,
        "table": v.table,
        "sql": v.sql,
        "entities": [{"name": e.name, "type": e.type, "keys": list(e.keys)} for e in v.entities],
        "dimensions": [{"name": d.name, "type": d.type, "expr": d.expr, "description": d.description, "synonyms": list(d.synonyms), "samples": list(d.samples)} for d in v.dimensions],
        "measures": [{"name": m.name, "type": m.type, "expr": m.expr, "description": m.description, "filters": list(m.filters)} for m in v.measures],
        "segments": [{"name": s.name, "expr": s.expr, "description": s.description} for s in v.segments],
    }


def inspect_motifs(layer: Layer) -> list[dict[str, Any]]:
    """Builtin and custom motifs with parameters and outputs."""
    show = lambda p: {"type": p.type, "constraints": list(p.constraints), "default": p.default, "values": list(p.values)}
    out = [
        {"name": n, "kind": "builtin", "description": b.description, "params": {k: show(p) for k, p in b.params().items()}, "outputs": list(b.outputs)}
        for n, b in motifs.BUILTINS.items()
    ]
    return out + [
        {"name": m.name, "kind": "custom", "description": m.description, "params": {k: show(p) for k, p in m.params.items()}, "outputs": [n for n, _ in m.outputs]}
        for m in layer.motifs
    ]


def inspect_queries(layer: Layer) -> list[dict[str, Any]]:
    return [
        {"name": q.name, "description": q.description, "params": q.params, "steps": [{"name": s.name, "description": s.description, "query": s.query} for s in q.steps]}
        for q in layer.saved_queries
    ]
