"""Results for programs: status, columns, some rows, the number of rows."""

from __future__ import annotations

import datetime
import decimal
import math
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from quillon import request
from quillon.engine import SemanticEngine
from quillon.errors import SemanticError

ROWS = 50


def cell(value: Any) -> Any:
    """A value as JSON has it."""
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, datetime.datetime | datetime.date | datetime.time):
        return value.isoformat()
    if isinstance(value, bytes | bytearray):
        return f"<blob {len(value)} bytes>"
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, list | tuple):
        return [cell(v) for v in value]
    if isinstance(value, dict):
        return {str(k): cell(v) for k, v in value.items()}
    return value


def _rows(df: DataFrame, rows: int) -> tuple[list[dict], int]:
    """The first rows and how many there are, from one pass where they are few."""
    head = df.take(rows + 1)
    total = len(head) if len(head) <= rows else df.agg(F.count("*")).first()[0]
    return [{k: cell(v) for k, v in r.asDict(recursive=True).items()} for r in head[:rows]], total


def failure(error: Exception, status: str | None = None) -> dict:
    return {"status": status or getattr(error, "status", "execution_error"), "error": str(error).strip()}


def run(engine: SemanticEngine, query: Any, rows: int = ROWS) -> dict:
    """A request to its envelope; failures become statuses."""
    try:
        q = request.parse(query)
        df, columns = engine.query(q), engine.columns(q)
        plan = engine.explain(df)
    except SemanticError as e:
        return failure(e)
    except PySparkException as e:
        return failure(e, "execution_error")
    try:
        data, total = _rows(df, rows)
    except PySparkException as e:
        return failure(e, "execution_error")
    return {
        "status": "success",
        "plan": plan,
        "columns": [{"member": c.member, "alias": c.alias, "kind": c.kind} for c in columns],
        "data": data,
        "row_count": total,
        "views_used": engine.views_used(q),
    }


def saved(engine: SemanticEngine, name: str, rows: int = ROWS) -> dict:
    """Every step of a saved query, each by itself; a failing step does not stop the rest."""
    found = next((s for s in engine.layer.saved_queries if s.name == name), None)
    if found is None:
        return {"query": name, "status": "parse_error", "error": f"unknown saved query '{name}'"}
    return {"query": name, "steps": [{"step": s.name, "description": s.description, "result": run(engine, s.query, rows)} for s in found.steps]}
