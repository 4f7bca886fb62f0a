"""Profiles of dimensions: one aggregation for all statistics, one more for the values of each text dimension."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from quillon.engine import SemanticEngine
from quillon.envelope import cell
from quillon.errors import QueryError
from quillon.model import Dimension

FEW, FEW_LIMIT, TOP = 100, 200, 20
_TEXT, _TIME = ("string", "geo"), ("date", "datetime")


def _stats(d: Dimension) -> list:
    c, n = F.col(f"`{d.name}`"), d.name
    out = [F.count("*").alias(f"{n}|count"), F.count_if(c.isNull()).alias(f"{n}|null_count")]
    if d.type in _TEXT:
        out.append(F.count_distinct(c).alias(f"{n}|cardinality"))
    elif d.type == "number":
        x = c.cast("double")
        out += [F.count_distinct(c).alias(f"{n}|cardinality"), F.min(c).alias(f"{n}|min"), F.max(c).alias(f"{n}|max"), F.avg(x).alias(f"{n}|mean")]
    elif d.type in _TIME:
        out += [F.min(c).alias(f"{n}|min"), F.max(c).alias(f"{n}|max")]
    else:
        out += [F.count_if(c).alias(f"{n}|true_count"), F.count_if(~c).alias(f"{n}|false_count")]
    return out


def _dimensions(engine: SemanticEngine, target: str) -> tuple[str, list[Dimension]]:
    name, _, dim = target.partition(".")
    view = engine.view(name)
    if view is None:
        raise QueryError(f"unknown view '{name}'")
    found = [view.dimension(dim)] if dim else [d for d in view.dimensions if not d.sub_query]
    if found == [None]:
        raise QueryError(f"unknown dimension '{target}'")
    if found and found[0].sub_query:
        raise QueryError(f"'{target}' is a subquery dimension and has no profile")
    return name, found


def rows(engine: SemanticEngine, view: str, dims: list[Dimension]) -> DataFrame:
    df = engine.query({"dimensions": [f"{view}.{d.name}" for d in dims]})
    return df.select(*[F.col(f"{view}__{d.name}").alias(d.name) for d in dims])


def statistics(engine: SemanticEngine, target: str) -> DataFrame:
    """One row with all statistics of all dimensions, named dimension|statistic."""
    name, dims = _dimensions(engine, target)
    return rows(engine, name, dims).agg(*[c for d in dims for c in _stats(d)])


def values(engine: SemanticEngine, target: str, limit: int) -> DataFrame:
    """value, frequency: the most frequent first, ties by value."""
    name, (d, *_) = _dimensions(engine, target)
    c = F.col(d.name).alias("value")
    df = rows(engine, name, [d]).where(F.col(d.name).isNotNull()).groupBy(c).agg(F.count("*").alias("frequency"))
    return df.orderBy(F.desc("frequency"), F.asc("value")).limit(limit)


def profile(engine: SemanticEngine, target: str) -> dict | list[dict]:
    """A profile of `view.dimension`, or a list of those of all dimensions of `view`."""
    name, dims = _dimensions(engine, target)
    got = statistics(engine, target).first().asDict()
    out = []
    for d in dims:
        entry: dict[str, Any] = {"dimension": f"{name}.{d.name}", "type": d.type}
        entry |= {k.split("|")[1]: cell(v) for k, v in got.items() if k.split("|")[0] == d.name}
        if d.type in _TEXT:
            few = entry["cardinality"] <= FEW
            entry["values"] = [{"value": r.value, "frequency": r.frequency} for r in values(engine, f"{name}.{d.name}", FEW_LIMIT if few else TOP).collect()]
            entry["values_complete"] = few
        out.append(entry)
    return out[0] if "." in target else out
