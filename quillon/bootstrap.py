"""View files drafted from physical tables."""

from __future__ import annotations

import re
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, types as T

from quillon.sources.introspect import semantic_type

SYSTEM_SCHEMAS = frozenset({"information_schema", "pg_catalog", "sys", "system", "mysql", "performance_schema"})


def snake(name: str) -> str:
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", name)).strip("_").lower()


def view(table: str, df: DataFrame) -> dict:
    """A view with a dimension per column, a count, and sum and average of numbers; unnamed columns (columnN) go."""
    dimensions, measures = [], [{"name": "count", "type": "count"}]
    for f in df.schema:
        name = snake(f.name)
        if re.fullmatch(r"column_?\d+", name) or isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            continue
        expr = f.name if re.fullmatch(r"\w+", f.name) else f"`{f.name}`"
        kind = semantic_type(f.dataType)
        dimensions.append({"name": name, "type": kind, "expr": expr})
        if kind == "number":
            measures += [{"name": f"total_{name}", "type": "sum", "expr": expr}, {"name": f"avg_{name}", "type": "average", "expr": expr}]
    return {"name": snake(table.split(".")[-1]), "description": f"Rows of {table}", "table": table, "dimensions": dimensions, "measures": measures}


def write(folder: str | Path, tables: dict[str, DataFrame]) -> list[Path]:
    """One *.view.yml for each table outside system schemas."""
    out = []
    base = Path(folder) / "views"
    base.mkdir(parents=True, exist_ok=True)
    for name, df in sorted(tables.items()):
        if name.split(".")[0].lower() in SYSTEM_SCHEMAS:
            continue
        made = view(name, df)
        path = base / f"{made['name']}.view.yml"
        path.write_text(yaml.safe_dump(made, sort_keys=False, allow_unicode=True), encoding="utf-8")
        out.append(path)
    return out
