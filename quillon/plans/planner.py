"""Plans requests as DataFrames.

Every expression is evaluated inside its own view before any join, so names never clash.
Measures are grouped by the view that owns them and each group starts from that view, so a
join never drops or repeats its rows unnoticed: where a path fans out, rows are made distinct
by dimension values and row identity before they are aggregated. Groups meet by a union that a
last aggregation collapses, which also brings null dimension values together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillon import dates
from quillon.errors import PlanError, QueryError
from quillon.functions import truncated
from quillon.model import RAW_TYPES, Dimension, Layer, Measure, View
from quillon.operators import aggregates, filters, motifs, rolling
from quillon.plans import refs
from quillon.plans.graph import Edge, JoinGraph
from quillon.request import Filter, QueryRequest, alias, split

ROW_ID = "__row"
#: A fan-out join has a task for every PART bytes of the files behind its many side, PARTS tasks at most unless the
#: session asks for more. Its tasks sort both sides and hold their distinct rows, some 500 bytes a row.
PART, PARTS = 4 << 20, 4096
#: Sources without statistics say that they hold exabytes.
UNKNOWN = 1 << 50


@dataclass(frozen=True)
class ColumnMeta:
    """A result column: its member path, its name, and dimension, time_dimension, measure or motif."""

    member: str
    alias: str
    kind: str


class Planner:
    """One request at a time over a layer; `relation` gives a view's rows."""

    def __init__(self, layer: Layer, relation: Callable[[View], DataFrame], today: date | None = None) -> None:
        self.layer, self.relation, self.today = layer, relation, today
        self.views = {v.name: v for v in layer.views}
        self.graph = JoinGraph(layer)
        self.owners = {e.name: v.name for v in reversed(layer.views) for e in v.entities if e.type == "primary"}
        self._bases: dict[str, DataFrame] = {}

    # ---- members -------------------------------------------------------------------------

    def view(self, name: str) -> View:
        if name not in self.views:
            raise QueryError(f"unknown view '{name}'")
        return self.views[name]

    def dimension(self, member: str) -> tuple[View, Dimension]:
        v, name = split(member)
        got = self.view(v).dimension(name)
        if got is None:
            raise QueryError(f"unknown dimension '{member}'")
        return self.view(v), got

    def measure(self, member: str) -> tuple[View, Measure]:
        v, name = split(member)
        got = self.view(v).measure(name)
        if got is None:
            raise QueryError(f"unknown measure '{member}'")
        return self.view(v), got

    def kind(self, member: str) -> str:
        """measure, or the type of the dimension."""
        v, name = split(member)
        if self.view(v).measure(name) is not None:
            return "measure"
        return self.dimension(member)[1].type

    # ---- expressions inside one view -----------------------------------------------------

    def row_sql(self, view: View, text: str, seen: tuple[str, ...] = ()) -> str:
        """Row-level SQL over the view's own rows (and the columns that base() adds)."""

        def value(first: str, second: str | None) -> str:
            if first == "variables" and second:
                if second not in self.layer.variables:
                    raise PlanError(f"variable '{second}' has no value")
                return str(self.layer.variables[second])
            if first == "TABLE" and not second:
                return refs.quoted(view.name)
            if second is None or first == view.name:
                dim = view.dimension(second or first)
                if dim is None:
                    raise QueryError(f"'{{{{{first}{'.' + second if second else ''}}}}}' names nothing in view '{view.name}'")
                return f"({self.dimension_sql(view, dim, seen)})"
            target = self.views.get(first) or self.views.get(self.owners.get(first, ""))
            if target is None:
                raise QueryError(f"'{first}' in an expression of '{view.name}' is no view or entity")
            if target.name == view.name:
                return self.dimension_sql(view, view.dimension(second), seen) if view.dimension(second) else refs.quoted(second)
            return refs.quoted(self._foreign(target, first, second))

        return refs.backticked(refs.substitute(text, value))

    @staticmethod
    def _foreign(target: View, first: str, second: str) -> str:
        """Name that base() gives to a column of another view. A view reference means its dimension, an entity its column."""
        kind = "dim" if first == target.name else "raw"
        return f"__ref__{kind}__{target.name}__{second}"

    def dimension_sql(self, view: View, dim: Dimension, seen: tuple[str, ...] = ()) -> str:
        path = f"{view.name}.{dim.name}"
        if path in seen:
            raise PlanError(f"expressions refer to each other in a circle: {' -> '.join((*seen, path))}")
        if dim.sub_query:
            return refs.quoted(f"__sub__{dim.name}")
        text = dim.expr
        if text.strip() == dim.name:
            return refs.quoted(text.strip())
        return self.row_sql(view, text, (*seen, path))

    def key_sql(self, view: View, key: str) -> str:
        dim = view.dimension(key)
        return self.dimension_sql(view, dim) if dim else refs.quoted(key)

    def _texts(self, view: View) -> list[str]:
        out = [d.expr for d in view.dimensions if not d.sub_query] + [s.expr for s in view.segments]
        for measure in view.measures:
            out += [*measure.filters, *([measure.expr] if measure.expr and measure.type not in RAW_TYPES else [])]
            if measure.expr and measure.type in RAW_TYPES:
                out.append(measure.expr)
        return out

    def base(self, view: View) -> DataFrame:
        """The view's rows, a row id, what its expressions take from other views, and subquery dimensions.

        Columns that a request does not use are pruned by the optimizer, joins included where
        they cannot change the rows.
        """
        if view.name in self._bases:
            return self._bases[view.name]
        self._bases[view.name] = self.relation(view)  # for views that refer to each other
        df = self.relation(view).alias(view.name)
        wanted: dict[str, set[tuple[str, str]]] = {}
        for text in self._used_texts(view):
            for first, second in refs.names(text):
                target = self.views.get(first) or self.views.get(self.owners.get(first, ""))
                if second and first != "variables" and target and target.name != view.name and not target.measure(second):
                    wanted.setdefault(target.name, set()).add((first, second))
        for name in sorted(wanted):
            df = self._with_refs(view, df, name, wanted[name])
        for dim in view.dimensions:
            if dim.sub_query and dim.name in self._used_subqueries.get(view.name, set()):
                df = self._with_subquery(view, df, dim)
        self._bases[view.name] = df
        return df

    def _with_refs(self, view: View, df: DataFrame, name: str, pairs: set[tuple[str, str]]) -> DataFrame:
        target = self.view(name)
        path = self.graph.paths(view.name).get(name)
        if not path or any(e.many for e in path):
            raise PlanError(f"expressions of '{view.name}' refer to '{name}', which no many-to-one path reaches")
        inner = self.relation(target).alias(name)
        columns = [F.expr(self.dimension_sql(target, target.dimension(s)) if f == name and target.dimension(s) else refs.quoted(s)).alias(self._foreign(target, f, s)) for f, s in sorted(pairs)]
        # Walk the path from its end, so that one table keyed for `view` remains.
        right, columns_at = inner, columns
        for i in range(len(path) - 1, -1, -1):
            e, end = path[i], self.view(path[i].right)
            keys = [F.expr(self.key_sql(end, b)).alias(f"__key{n}") for n, (_, b) in enumerate(e.keys)]
            right = right.select(*keys, *columns_at)
            start = self.view(e.left)
            left = df if i == 0 else self.relation(start).alias(start.name)
            mine = [F.expr(self.key_sql(start, a)).alias(f"__own{n}") for n, (a, _) in enumerate(e.keys)]
            left = left.withColumns({f"__own{n}": c for n, c in enumerate(mine)})
            on = reduce(Column.__and__, [F.col(f"__own{n}") == F.col(f"__key{n}") for n in range(len(e.keys))])
            right = left.join(right, on, "left").drop(*[f"__own{n}" for n in range(len(e.keys))], *[f"__key{n}" for n in range(len(e.keys))]).alias(start.name)
            columns_at = [F.col(refs.quoted(self._foreign(target, f, s))) for f, s in sorted(pairs)]
        return right

    def _with_subquery(self, view: View, df: DataFrame, dim: Dimension) -> DataFrame:
        """An aggregate of a neighbouring view, computed once per key and joined."""
        text = dim.expr.strip()
        member = ".".join(refs.names(text)[0]) if refs.names(text) else text
        target, measure = self.measure(member)
        edge = next((e for e in self.graph.edges[view.name] if e.right == target.name), None)
        if edge is None:
            raise PlanError(f"subquery dimension '{view.name}.{dim.name}' needs an entity shared with '{target.name}'")
        keys = [F.expr(self.key_sql(target, b)).alias(f"__key{n}") for n, (_, b) in enumerate(edge.keys)]
        rows = self.base(target).withColumns({f"__key{n}": k for n, k in enumerate(keys)})
        value = F.expr(self.aggregate_sql(target, measure)).alias(f"__sub__{dim.name}")
        inner = rows.groupBy(*[f"__key{n}" for n in range(len(keys))]).agg(value)
        df = df.withColumns({f"__own{n}": F.expr(self.key_sql(view, a)) for n, (a, _) in enumerate(edge.keys)})
        on = reduce(Column.__and__, [F.col(f"__own{n}") == F.col(f"__key{n}") for n in range(len(keys))])
        df = df.join(inner, on, "left").drop(*[f"__{k}{n}" for k in ("own", "key") for n in range(len(keys))])
        zero = aggregates.on_nothing(measure)
        if zero is not None:
            df = df.withColumn(f"__sub__{dim.name}", F.coalesce(f"__sub__{dim.name}", F.lit(zero)))
        return df.alias(view.name)

    # ---- measures ------------------------------------------------------------------------

    def measure_refs(self, view: View, measure: Measure) -> list[str]:
        """Members of measures that an expression names, in order."""
        out = []
        for first, second in refs.names(measure.expr or ""):
            target = self.views.get(first) or self.views.get(self.owners.get(first, ""))
            name = second or first
            target = target if second else view
            if target is not None and target.measure(name) is not None and not (target is view and view.dimension(name)):
                out.append(f"{target.name}.{name}")
        return out

    def crosses(self, view: View, measure: Measure, seen: tuple[str, ...] = ()) -> bool:
        """Whether a measure is composed of another view's measures."""
        path = f"{view.name}.{measure.name}"
        if path in seen:
            raise PlanError(f"measures refer to each other in a circle: {' -> '.join((*seen, path))}")
        for member in self.measure_refs(view, measure):
            v, m = self.measure(member)
            if v.name != view.name or self.crosses(v, m, (*seen, path)):
                return True
        return False

    def aggregate_sql(self, view: View, measure: Measure, seen: tuple[str, ...] = ()) -> str:
        """Aggregate SQL over base(view); measures it refers to are those of the same view."""
        path = f"{view.name}.{measure.name}"
        if path in seen:
            raise PlanError(f"measures refer to each other in a circle: {' -> '.join((*seen, path))}")
        text = measure.expr
        own = set(self.measure_refs(view, measure))

        def value(first: str, second: str | None) -> str:
            if f"{first if second else view.name}.{second or first}" in own or f"{self.owners.get(first)}.{second}" in own:
                target = view.measure(second or first)
                return f"({self.aggregate_sql(view, target, (*seen, path))})"
            return "{{" + (f"{first}.{second}" if second else first) + "}}"

        expr = self.row_sql(view, refs.substitute(text, value)) if text and text.strip() != "*" else None
        return aggregates.call(measure, expr, [self.row_sql(view, f) for f in measure.filters])

    def leaves(self, member: str) -> list[str]:
        """Measures to compute in groups for a measure: itself, or the parts of one that crosses views."""
        view, measure = self.measure(member)
        if not self.crosses(view, measure):
            return [member]
        if measure.type not in RAW_TYPES:
            raise PlanError(f"measure '{member}' aggregates measures of another view; compose them in a 'number' measure")
        return [leaf for m in self.measure_refs(view, measure) for leaf in self.leaves(m)]

    def final(self, member: str) -> Column:
        """A measure over the columns of its leaves."""
        view, measure = self.measure(member)
        if not self.crosses(view, measure):
            return F.col(refs.quoted(alias(member)))

        def text(v: View, m: Measure) -> str:
            def value(first: str, second: str | None) -> str:
                target = self.views.get(first) or self.views.get(self.owners.get(first, "")) if second else v
                inner = target.measure(second or first) if target else None
                if inner is None:
                    raise PlanError(f"'{v.name}.{m.name}' mixes measures of several views with columns")
                path = f"{target.name}.{inner.name}"
                return f"({text(target, inner)})" if self.crosses(target, inner) else refs.quoted(alias(path))

            return refs.backticked(refs.substitute(m.expr or "", value))

        return F.expr(text(view, measure))

    # ---- one request ---------------------------------------------------------------------

    def columns(self, q: QueryRequest) -> list[ColumnMeta]:
        """Result columns in order, checked against the model."""
        out = [ColumnMeta(d, alias(d), "dimension") for d in q.dimensions if self.dimension(d)]
        out += [ColumnMeta(t.member, alias(t.member), "time_dimension") for t in q.time_dimensions if self.dimension(t.dimension)]
        out += [ColumnMeta(m, alias(m), "measure") for m in q.measures if self.measure(m)]
        if not out:
            raise QueryError("a query needs a measure or a dimension")
        for s in q.segments:
            v, name = split(s)
            if self.view(v).segment(name) is None:
                raise QueryError(f"unknown segment '{s}'")
        for f in q.filters:
            for leaf in f.leaves():
                self.kind(leaf.member)
        if q.motif:
            custom = self.custom_motif(q.motif)
            out += [ColumnMeta(f"__motif.{n}", n, "motif") for n in motifs.outputs(q.motif, custom)]
        return out

    def custom_motif(self, name: str):
        return next((m for m in self.layer.motifs if m.name == name), None)

    def _used_texts(self, view: View) -> list[str]:
        return [t for t in self._texts(view) if t in self._needed_texts.get(view.name, ())]

    def _need_member(self, view: View, text: str) -> None:
        """Notes an expression that the request uses, and all that it refers to in its view."""
        needed = self._needed_texts.setdefault(view.name, set())
        if text in needed:
            return
        needed.add(text)
        for first, second in refs.names(text):
            target = view if second is None or first in ("TABLE", view.name) else self.views.get(first) or self.views.get(self.owners.get(first, ""))
            if target is None:
                continue
            name = second or first
            if (dim := target.dimension(name)) is not None:
                self._need_dimension(target, dim)
            elif (measure := target.measure(name)) is not None:
                self._need_measure(target, measure)

    def _need_dimension(self, view: View, dim: Dimension) -> None:
        if not dim.sub_query:
            self._need_member(view, dim.expr)
            return
        subs = self._used_subqueries.setdefault(view.name, set())
        if dim.name in subs:
            return
        subs.add(dim.name)
        text = dim.expr.strip()
        target, measure = self.measure(".".join(refs.names(text)[0]) if refs.names(text) else text)
        self._need_measure(target, measure)

    def _need_measure(self, view: View, measure: Measure) -> None:
        for text in (measure.expr, *measure.filters):
            if text:
                self._need_member(view, text)

    def plan(self, q: QueryRequest) -> DataFrame:
        metas = self.columns(q)
        self._needed_texts: dict[str, set[str]] = {}
        self._used_subqueries: dict[str, set[str]] = {}
        self._bases = {}
        row_filters, group_filters = self._routed(q)
        members = {*q.dimensions, *(t.dimension for t in q.time_dimensions), *(leaf.member for f in row_filters for leaf in f.leaves())}
        for member in sorted(members):
            self._need_dimension(*self.dimension(member))
        for s in q.segments:
            v, name = split(s)
            self._need_member(self.view(v), self.view(v).segment(name).expr)
        asked = list(dict.fromkeys([*q.measures, *(leaf.member for f in group_filters for leaf in f.leaves() if self.kind(leaf.member) == "measure")]))
        for member in asked:
            self._need_measure(*self.measure(member))
        for name in list(self._needed_texts):
            for e in self.view(name).entities:
                for key in e.keys:
                    if (dim := self.view(name).dimension(key)) is not None:
                        self._need_dimension(self.view(name), dim)

        dims = [alias(m.member) for m in metas if m.kind in ("dimension", "time_dimension")]
        context = _Context(self, q, sorted(members), row_filters, dims)
        if q.ungrouped:
            if group_filters:
                raise PlanError("an ungrouped query has no aggregates to filter")
            df = context.ungrouped()
        elif asked:
            df = context.grouped(asked, group_filters)
        else:
            df = context.rows_without_measures()
        if q.motif:
            cols = motifs.Columns(q.measures, q.dimensions, tuple(t.member for t in q.time_dimensions))
            df = motifs.apply(df.select(*[m.alias for m in metas if m.kind != "motif"]), q.motif, self.custom_motif(q.motif), q.motif_params, cols)
        return self._finished(df, q, metas)

    def _routed(self, q: QueryRequest) -> tuple[list[Filter], list[Filter]]:
        """Filters on rows, and filters on aggregated rows."""
        rows, groups, todo = [], [], list(q.filters)
        selected = set(q.dimensions)
        while todo:
            f = todo.pop(0)
            kinds = {self.kind(leaf.member) == "measure" for leaf in f.leaves()}
            if not kinds:
                continue
            if kinds == {False}:
                rows.append(f)
            elif kinds == {True}:
                groups.append(f)
            elif f.is_group and not f.any_of:
                todo.extend(f.parts)
            elif all(self.kind(leaf.member) == "measure" or leaf.member in selected for leaf in f.leaves()):
                groups.append(f)
            else:
                raise PlanError("an 'or' of measures and dimensions needs its dimensions in the query")
        return rows, groups

    @staticmethod
    def _finished(df: DataFrame, q: QueryRequest, metas: list[ColumnMeta]) -> DataFrame:
        """Sort, offset, limit, and the columns in their order."""
        if q.order:
            known = {m.member: m.alias for m in metas} | {m.alias: m.alias for m in metas}
            for m in metas:
                if m.kind == "time_dimension":
                    known.setdefault(".".join(m.member.split(".")[:2]), m.alias)
            keys = []
            for o in q.order:
                if o.id not in known:
                    raise QueryError(f"order by '{o.id}', which the query does not select")
                c = F.col(refs.quoted(known[o.id]))
                keys.append(c.desc_nulls_last() if o.desc else c.asc_nulls_last())
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*[refs.quoted(m.alias) for m in metas])


class _Context:
    """Rows and aggregates of one request."""

    def __init__(self, planner: Planner, q: QueryRequest, members: list[str], row_filters: list[Filter], dims: list[str]) -> None:
        self.p, self.q, self.members, self.row_filters, self.dims = planner, q, members, row_filters, dims
        self.views = {split(m)[0] for m in members} | {split(s)[0] for s in q.segments}

    # ---- joined rows ---------------------------------------------------------------------

    def _slice(self, view: View, edges: list[Edge], root: bool) -> DataFrame:
        """A view's rows with its part of the request evaluated: dimensions, segments, join keys."""
        p, df = self.p, self.p.base(view)
        made = {}
        for member in self.members:
            v, name = split(member)
            if v == view.name:
                made[f"__d__{alias(member)}"] = F.expr(p.dimension_sql(view, view.dimension(name)))
        for s in self.q.segments:
            v, name = split(s)
            if v == view.name:
                made[f"__s__{alias(s)}"] = F.expr(p.row_sql(view, view.segment(name).expr))
        for e in edges:
            for side, keys in ((e.left, [a for a, _ in e.keys]), (e.right, [b for _, b in e.keys])):
                if side == view.name:
                    for key in keys:
                        made[f"__k__{view.name}__{key}"] = F.expr(p.key_sql(view, key))
        if root:
            return df.withColumns(made).alias(view.name)
        return df.select(*[c.alias(n) for n, c in made.items()])

    def joined(self, root: View) -> tuple[DataFrame, bool]:
        """Rows of `root` with everything the request needs beside them, filtered; and whether paths fan out."""
        p, q = self.p, self.q
        edges = p.graph.tree(root.name, self.views, q.through)
        fans = any(e.many for e in edges)
        df = self._slice(root, edges, True)
        if fans and not self._identity(root):
            df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
        for e in edges:
            right = self._slice(p.view(e.right), edges, False)
            on = reduce(Column.__and__, [F.col(f"__k__{e.left}__{a}") == F.col(f"__k__{e.right}__{b}") for a, b in e.keys])
            if e.many:
                df, right = self._spread(df, right, e)
            df = df.join(right, on, "left")
        column = lambda member: F.col(refs.quoted(f"__d__{alias(member)}"))
        for f in self.row_filters:
            made = filters.tree(f, column, p.kind)
            if made is not None:
                df = df.where(made)
        for s in q.segments:
            df = df.where(F.col(refs.quoted(f"__s__{alias(s)}")))
        for t in q.time_dimensions:
            bounds = dates.resolve(t.date_range, p.today)
            if bounds:
                kind = p.dimension(t.dimension)[1].type
                low, high = (filters.literal(b, kind, t.dimension) for b in bounds)
                df = df.where((column(t.dimension) >= low) & (column(t.dimension) <= high))
        shown = {alias(d): column(d) for d in q.dimensions}
        shown |= {alias(t.member): truncated(column(t.dimension), t.granularity, q.timezone) for t in q.time_dimensions}
        return df.withColumns(shown) if shown else df, fans

    @staticmethod
    def _spread(left: DataFrame, right: DataFrame, e: Edge) -> tuple[DataFrame, DataFrame]:
        """Both sides of a fan-out join in enough parts; adaptive execution, which sees compressed bytes, would merge them.

        The left side keeps the parts that it has where the session's number will do. Small right sides are broadcast.
        """
        plan, state = right._jdf.queryExecution().optimizedPlan(), right.sparkSession._jsparkSession.sessionState()
        leaves = plan.collectLeaves()
        size = sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))
        if size <= PART or plan.stats().sizeInBytes() <= state.conf().autoBroadcastJoinThreshold():
            return left, right
        session = state.conf().numShufflePartitions()
        parts = session if size >= UNKNOWN else max(session, min(-(-size // PART), PARTS))
        if parts > session:
            left = left.repartition(parts, *[f"__k__{e.left}__{a}" for a, _ in e.keys])
        return left, right.repartition(parts, *[f"__k__{e.right}__{b}" for _, b in e.keys])

    def _identity(self, view: View) -> list[str]:
        """Columns that tell the view's rows apart, where it declares its key."""
        return [self.p.key_sql(view, k) for k in view.primary_keys()]

    # ---- grouped -------------------------------------------------------------------------

    def _group(self, root: View, members: list[str]) -> DataFrame:
        p = self.p
        df, fans = self.joined(root)
        if fans:
            # A row counts once for each tuple of dimension values, however often the joins repeat it.
            # Keys that a join has are taken as they are, so that Spark sees where it has put them.
            keys = {f"__id{n}": f"__k__{root.name}__{key}" for n, key in enumerate(root.primary_keys())}
            made = {n: F.expr(sql) for (n, key), sql in zip(keys.items(), self._identity(root), strict=True) if key not in df.columns}
            df = df.withColumns(made)
            names = [n if n in made else key for n, key in keys.items()] or [ROW_ID]
            df = df.dropDuplicates([*self.dims, *names]).alias(root.name)
        columns = []
        for member in members:
            view, measure = p.measure(member)
            if measure.rolling_window is None:
                columns.append(F.expr(p.aggregate_sql(view, measure)).alias(alias(member)))
                continue
            expr = p.row_sql(view, measure.expr) if measure.expr and measure.expr.strip() != "*" else None
            x = aggregates.row_input(measure, expr, [p.row_sql(view, f) for f in measure.filters])
            if measure.type == "average":
                columns += [F.expr(f"SUM({x})").alias(f"{alias(member)}__sum"), F.expr(f"COUNT({x})").alias(f"{alias(member)}__n")]
            elif measure.type in rolling.ADDITIVE:
                call = {"sum": "SUM", "count": "COUNT", "min": "MIN", "max": "MAX"}[measure.type]
                columns.append(F.expr(f"{call}({x})").alias(f"{alias(member)}__value"))
            else:
                rolling.checked(measure)
        return df.groupBy(*[refs.quoted(d) for d in self.dims]).agg(*columns)

    def grouped(self, asked: list[str], group_filters: list[Filter]) -> DataFrame:
        p = self.p
        by_view: dict[str, list[str]] = {}
        for member in dict.fromkeys(leaf for m in asked for leaf in p.leaves(m)):
            by_view.setdefault(split(member)[0], []).append(member)
        groups = [self._group(p.view(name), members) for name, members in by_view.items()]
        df = groups[0]
        if len(groups) > 1:
            every = [c for g in groups for c in g.columns if c not in self.dims]
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
            df = df.groupBy(*[refs.quoted(d) for d in self.dims]).agg(*[F.max(refs.quoted(c)).alias(c) for c in every])
        if rolled := [m for m in asked if p.measure(m)[1].rolling_window is not None]:
            order = self._order()
            times = {alias(t.member): t.granularity for t in self.q.time_dimensions}
            measures = {alias(member): p.measure(member)[1] for member in rolled}
            df = rolling.rolled(df, measures, order, times.get(order[0]) in motifs.PERIODS)
        composed = {alias(m): p.final(m) for m in asked if p.crosses(*p.measure(m))}
        if composed:
            df = df.withColumns(composed)
        for f in group_filters:
            made = filters.tree(f, lambda member: F.col(refs.quoted(alias(member))), p.kind)
            if made is not None:
                df = df.where(made)
        return df

    def _order(self) -> tuple[str, ...]:
        """Order of rolling windows: the time dimension, then the rest to break ties."""
        times = [alias(t.member) for t in self.q.time_dimensions]
        times += [alias(d) for d in self.q.dimensions if self.p.dimension(d)[1].type in ("date", "datetime")]
        if not times:
            raise PlanError("a rolling measure needs a time dimension in the query")
        return (times[0], *[d for d in self.dims if d != times[0]])

    # ---- rows ----------------------------------------------------------------------------

    def rows_without_measures(self) -> DataFrame:
        weight: dict[str, int] = {}
        for member in (*self.q.dimensions, *(t.dimension for t in self.q.time_dimensions)):
            weight[split(member)[0]] = weight.get(split(member)[0], 0) + 1
        root = self.p.graph.root_for(self.views, weight, self.q.through)
        return self.joined(self.p.view(root))[0]

    def ungrouped(self) -> DataFrame:
        """Rows with the inputs of measures in place of their aggregates."""
        p, q = self.p, self.q
        owners = {split(m)[0] for m in q.measures}
        if len(owners) > 1:
            raise PlanError("an ungrouped query takes measures of one view")
        if not owners:
            return self.rows_without_measures()
        root = p.view(owners.pop())
        df = self.joined(root)[0]
        columns = {}
        for member in q.measures:
            _, measure = p.measure(member)
            if measure.type in RAW_TYPES:
                raise PlanError(f"measure '{member}' aggregates in its own expression; it has no value for a row")
            expr = p.row_sql(root, measure.expr) if measure.expr and measure.expr.strip() != "*" else None
            columns[alias(member)] = F.expr(aggregates.row_input(measure, expr, [p.row_sql(root, f) for f in measure.filters]))
        return df.withColumns(columns)
