"""The library in three calls over YAML and JSON texts."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillon import catalog, loader
from quillon import validate as checks
from quillon.engine import SemanticEngine
from quillon.errors import SchemaError
from quillon.model import Layer


def _layer(views: Iterable[str], topics: Iterable[str], motifs: Iterable[str], queries: Iterable[str], globals_text: str | None) -> Layer:
    return loader.layer(views, topics, motifs, queries, globals_text)


def compile(  # noqa: A001
    spark: SparkSession,
    views: Iterable[str],
    query: Any,
    tables: dict[str, DataFrame | str] | None = None,
    topics: Iterable[str] = (),
    motifs: Iterable[str] = (),
    queries: Iterable[str] = (),
    globals_text: str | None = None,
) -> dict[str, Any]:
    """{frame, plan, columns}: the DataFrame of a request, its physical plan as text, its columns."""
    engine = SemanticEngine(_layer(views, topics, motifs, queries, globals_text), spark, tables)
    return {"frame": engine.query(query), "plan": engine.explain(query), "columns": [c.__dict__ for c in engine.columns(query)]}


def validate(views: Iterable[str], topics: Iterable[str] = (), motifs: Iterable[str] = (), queries: Iterable[str] = (), globals_text: str | None = None) -> list[str]:
    """What is wrong with a layer; nothing where it is sound."""
    try:
        return checks.problems(_layer(views, topics, motifs, queries, globals_text))
    except SchemaError as e:
        return [str(e)]


def catalog_list(views: Iterable[str], topics: Iterable[str] = (), motifs: Iterable[str] = (), queries: Iterable[str] = (), globals_text: str | None = None) -> list[dict[str, Any]]:
    """A layer's members as flat entries."""
    return catalog.entries(_layer(views, topics, motifs, queries, globals_text))
