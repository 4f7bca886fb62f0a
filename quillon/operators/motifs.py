"""Motifs: analytic columns added to an aggregated result."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from quillon.errors import QueryError
from quillon.model import Motif, MotifParam
from quillon.operators import ordered
from quillon.plans.refs import backticked, names, quoted, substitute
from quillon.request import alias

#: Alias of the aggregated rows inside motif expressions.
BASE = "b"
#: Granularities of which a calendar has few.
PERIODS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Bound:
    """Columns of the result that a motif works on; `ties` make an order by time a total one.

    periods: the time column holds days or longer; alone with it, rows are as few as the days of a
    calendar and one window may hold them all. Otherwise rows may be as many as the data has, and no task sees all.
    """

    measure: str
    time: str | None
    ties: tuple[str, ...]
    values: dict[str, Any]
    periods: bool = False

    @property
    def few(self) -> bool:
        return self.periods and not self.ties

    def by_time(self) -> WindowSpec:
        return Window.orderBy(F.col(self.time).asc_nulls_first())

    def framed(self, df: DataFrame, before: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
        """`df` with windows that reach `before` rows back in the order of time."""
        if self.few:
            return df.withColumns(columns(self.by_time()))
        rows = ordered.Chunks.of(ordered.numbered(df, self.time, self.ties, self.periods), before).rows
        return ordered.Chunks.finished(rows.withColumns(columns(ordered.Chunks.window())))


def _change(df: DataFrame, b: Bound) -> DataFrame:
    df = b.framed(df, 1, lambda w: {"previous_value": F.lag(b.measure, 1).over(w)})
    before, now = F.col("previous_value"), F.col(b.measure)
    return df.withColumn("growth_rate", F.when(before.isNotNull() & (before != 0), (now - before).cast("double") / F.abs(before).cast("double")))


def _anomaly(df: DataFrame, b: Bound) -> DataFrame:
    x, mean, sd, z = F.col(b.measure), F.col("mean_value"), F.col("stddev_value"), F.col("z_score")
    df = ordered.with_totals(df, {"mean_value": F.avg(x.cast("double")), "stddev_value": F.stddev_pop(x.cast("double"))})
    df = df.withColumn("z_score", F.when(sd > 0, (x - mean) / sd).otherwise(F.lit(0.0)))
    return df.withColumn("is_anomaly", F.when((sd > 0) & (F.abs(z) > float(b.values["threshold"])), 1).otherwise(0))


def _contribution(df: DataFrame, b: Bound) -> DataFrame:
    df = ordered.with_totals(df, {"total": F.sum(b.measure)})
    return df.withColumn("share", F.col(b.measure).cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0)))


def _trend(df: DataFrame, b: Bound) -> DataFrame:
    if b.few:
        df = df.withColumn("row_n", F.row_number().over(b.by_time()).cast("long"))
    else:
        df = ordered.numbered(df, b.time, b.ties, b.periods).withColumn("row_n", F.col(ordered.NUMBER).cast("long")).drop(ordered.NUMBER)
    x, n = F.col(b.measure).cast("double"), F.col("row_n").cast("double")
    df = ordered.with_totals(df, {"slope": F.regr_slope(x, n), "intercept": F.regr_intercept(x, n)})
    return df.withColumn("trend_value", F.col("intercept") + F.col("slope") * n)


def _moving(df: DataFrame, b: Bound) -> DataFrame:
    reach = int(b.values["window"])
    return b.framed(df, reach, lambda w: {"moving_avg": F.avg(F.col(b.measure).cast("double")).over(w.rowsBetween(-reach, 0))})


def _rank(df: DataFrame, b: Bound) -> DataFrame:
    return ordered.ranked(df, b.measure, "rank")


def _percent(df: DataFrame, b: Bound) -> DataFrame:
    df = ordered.with_totals(df, {"__total": F.sum(b.measure)})
    total = F.nullif(F.col("__total").cast("double"), F.lit(0.0))
    return df.withColumn("percent_of_total", F.lit(100.0) * F.col(b.measure).cast("double") / total).drop("__total")


def _cumulative(df: DataFrame, b: Bound) -> DataFrame:
    if b.few:
        return df.withColumn("cumulative_value", F.sum(b.measure).over(b.by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return ordered.running_sum(ordered.numbered(df, b.time, b.ties, b.periods), b.measure, "cumulative_value")


@dataclass(frozen=True)
class Builtin:
    description: str
    added: Callable[[DataFrame, Bound], DataFrame]
    outputs: tuple[str, ...]
    needs_time: bool
    defaults: tuple[tuple[str, float], ...] = ()

    def params(self) -> dict[str, MotifParam]:
        out = {"measure": MotifParam("measure", ("numeric",))}
        if self.needs_time:
            out["time"] = MotifParam("dimension", ("temporal",))
        return out | {k: MotifParam("number", default=v) for k, v in self.defaults}


_CHANGE = ("previous_value", "growth_rate")
BUILTINS: dict[str, Builtin] = {
    **{
        name: Builtin(f"Change against the row before, for {unit} rows", _change, _CHANGE, True)
        for name, unit in (("yoy", "yearly"), ("qoq", "quarterly"), ("mom", "monthly"), ("wow", "weekly"), ("dod", "daily"))
    },
    "anomaly": Builtin("Rows far from the mean in standard deviations", _anomaly, ("mean_value", "stddev_value", "z_score", "is_anomaly"), False, (("threshold", 2),)),
    "contribution": Builtin("Share of the total", _contribution, ("total", "share"), False),
    "trend": Builtin("Least-squares line over time", _trend, ("row_n", "slope", "intercept", "trend_value"), True),
    "moving_average": Builtin("Mean of a row and those before it", _moving, ("moving_avg",), True, (("window", 6),)),
    "rank": Builtin("Rank from the highest value", _rank, ("rank",), False),
    "percent_of_total": Builtin("Percentage of the total", _percent, ("percent_of_total",), False),
    "cumulative": Builtin("Running total over time", _cumulative, ("cumulative_value",), True),
}


def _literal(name: str, value: Any) -> Any:
    """A literal parameter that can stand in an expression."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int | float):
        return value
    if isinstance(value, str) and re.fullmatch(r"[\w.]+", value):
        return value
    raise QueryError(f"unsafe value for motif parameter '{name}': {value!r}")


@dataclass(frozen=True)
class Columns:
    """Members of the result by kind, in order."""

    measures: tuple[str, ...]
    dimensions: tuple[str, ...]
    times: tuple[str, ...]


def _pick(name: str, given: dict[str, Any], options: tuple[str, ...], what: str) -> str:
    if name in given:
        if given[name] not in options:
            raise QueryError(f"motif parameter '{name}' names '{given[name]}', which is no {what} of the query")
        return given[name]
    if not options:
        raise QueryError(f"the motif needs a {what} in the query")
    if len(options) > 1:
        raise QueryError(f"the query has several columns for '{name}'; set motif_params.{name} to one of {', '.join(options)}")
    return options[0]


def bind(params: dict[str, MotifParam], given: dict[str, Any], cols: Columns) -> dict[str, Any]:
    """A value for each parameter: member paths for columns, literals for the rest."""
    out: dict[str, Any] = {}
    for name, p in params.items():
        if p.type == "measure":
            out[name] = _pick(name, given, cols.measures, "measure")
        elif p.type == "dimension" and "temporal" in p.constraints:
            times = tuple(cols.times)
            if name in given:  # a truncated member goes by its plain path too
                found = [t for t in times if given[name] in (t, ".".join(t.split(".")[:2]))]
                out[name] = _pick(name, {name: found[0] if found else given[name]}, times, "time dimension")
            else:
                out[name] = _pick(name, given, times, "time dimension")
        elif p.type == "dimension":
            every = (*cols.dimensions, *cols.times)
            out[name] = [_pick(name, given, every, "dimension")] if name in given else list(every)
        else:
            value = given.get(name, p.default)
            if value is None:
                raise QueryError(f"motif parameter '{name}' has no value")
            if p.type == "enum" and p.values and value not in p.values:
                raise QueryError(f"'{value}' is not one of {', '.join(map(str, p.values))}")
            out[name] = _literal(name, value)
    for name, value in given.items():
        if name not in params:
            out[name] = _literal(name, value)
    return out


def outputs(name: str, custom: Motif | None) -> tuple[str, ...]:
    if custom:
        return tuple(n for n, _ in custom.outputs)
    if name not in BUILTINS:
        raise QueryError(f"unknown motif '{name}'")
    return BUILTINS[name].outputs


def apply(df: DataFrame, name: str, custom: Motif | None, given: dict[str, Any], cols: Columns) -> DataFrame:
    """The result with the motif's columns, which may use those before them.

    Built-in motifs hold for results of any size; windows of custom ones run as they are written.
    """
    if not cols.measures:
        raise QueryError(f"motif '{name}' needs a measure in the query")
    if custom is None:
        if name not in BUILTINS:
            raise QueryError(f"unknown motif '{name}'")
        builtin = BUILTINS[name]
        values = bind(builtin.params(), given, cols)
        time = alias(values["time"]) if builtin.needs_time else None
        ties = tuple(a for a in map(alias, (*cols.dimensions, *cols.times)) if a != time)
        periods = builtin.needs_time and values["time"].split(".")[2:] in [[g] for g in PERIODS]
        return builtin.added(df, Bound(alias(values["measure"]), time, ties, values, periods))
    values = bind(custom.params, given, cols)

    def column(member: str) -> str:
        return f"{BASE}.{quoted(alias(member))}"

    members = {*cols.measures, *cols.dimensions, *cols.times}

    def value(first: str, second: str | None) -> str:
        if first == "dimensions" and not second:
            return ", ".join(map(column, (*cols.dimensions, *cols.times)))
        got = values[first]
        if isinstance(got, list):
            return ", ".join(map(column, got))
        return column(got) if got in members and first in custom.params and custom.params[first].type in ("measure", "dimension") else str(got)

    for output, text in custom.outputs:
        unknown = sorted({a for a, b in names(text) if b or a != "dimensions" and a not in values})
        if unknown:
            raise QueryError(f"motif '{name}' has no value for {', '.join(unknown)}")
        df = df.alias(BASE).withColumn(output, F.expr(backticked(substitute(text, value))))
    return df
