"""The engine: a layer and a session, from requests to DataFrames."""

from __future__ import annotations

import re
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillon import loader, request, validate
from quillon.errors import PlanError
from quillon.model import Layer, View
from quillon.plans import refs
from quillon.plans.planner import ColumnMeta, Planner
from quillon.sources import Source


class SemanticEngine:
    """Compiles and runs requests over a validated layer.

    `tables` maps table names to DataFrames or files; other names are tables of the session.
    `sources` maps datasource names to connections. `today` fixes relative date ranges.
    """

    def __init__(
        self, layer: Layer, spark: SparkSession, tables: dict[str, DataFrame | str] | None = None, sources: dict[str, Source] | None = None, today: date | None = None
    ) -> None:
        validate.check(layer)
        self.layer, self.spark, self.tables, self.sources, self.today = layer, spark, dict(tables or {}), dict(sources or {}), today

    @classmethod
    def load(cls, folder: str | Path, spark: SparkSession, **options: Any) -> SemanticEngine:
        return cls(loader.project(folder), spark, **options)

    @property
    def views(self) -> tuple[View, ...]:
        return self.layer.views

    def view(self, name: str) -> View | None:
        return self.layer.view(name)

    def relation(self, view: View) -> DataFrame:
        """The rows behind a view."""
        source = self.sources.get(view.datasource or "")
        if view.sql:
            if source:
                return source.query(self.spark, view.sql)
            text = refs.backticked(view.sql)
            for name in self.tables:
                if re.search(rf"\b{re.escape(name)}\b", text):
                    self._table(name).createOrReplaceTempView(name)
            return self.spark.sql(text)
        if view.table in self.tables:
            return self._table(view.table)
        if source:
            return source.table(self.spark, view.table)
        return self.spark.table(refs.table_name(view.table))

    def _table(self, name: str) -> DataFrame:
        """A given table; files are listed once, so a new engine sees new files."""
        got = self.tables[name]
        if isinstance(got, str):
            got = self.tables[name] = self.spark.read.parquet(got)
        return got

    def planner(self) -> Planner:
        return Planner(self.layer, self.relation, self.today)

    def _one_source(self, names: set[str]) -> None:
        found = {v.datasource for v in self.layer.views if v.name in names and v.datasource}
        if len(found) > 1:
            raise PlanError(f"a query cannot span datasources: {', '.join(sorted(found))}")

    def columns(self, query: Any) -> list[ColumnMeta]:
        return self.planner().columns(request.parse(query))

    def query(self, query: Any) -> DataFrame:
        """The result of a request as a DataFrame; nothing runs until it is read."""
        q = request.parse(query)
        self._one_source(set(self.views_used(q)))
        read: set[str] = set()  # views on join paths and in cross references come up while planning

        def relation(view: View) -> DataFrame:
            read.add(view.name)
            self._one_source(read)
            return self.relation(view)

        return Planner(self.layer, relation, self.today).plan(q)

    def views_used(self, query: Any) -> list[str]:
        q = request.parse(query)
        members = [*q.measures, *q.dimensions, *(t.dimension for t in q.time_dimensions), *q.segments]
        members += [leaf.member for f in q.filters for leaf in f.leaves()]
        return sorted({m.split(".")[0] for m in members})

    def explain(self, query: Any, mode: str = "formatted") -> str:
        """The physical plan of a request, or of the DataFrame made of it, as text."""
        df = query if isinstance(query, DataFrame) else self.query(query)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def with_topic_filters(self, query: Any, topic: str) -> DataFrame:
        """A request with the default filters of a topic, which otherwise only describe it."""
        q = request.parse(query)
        found = next((t for t in self.layer.topics if t.name == topic), None)
        if found is None:
            raise PlanError(f"unknown topic '{topic}'")
        more = tuple(map(request.default_filter, found.default_filters))
        return self.query(request.QueryRequest(**{**q.__dict__, "filters": (*q.filters, *more)}))
