"""The engine's own query set over the test tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import lru_cache
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon import bootstrap, catalog, cli, envelope, loader, profile
from quillon.engine import SemanticEngine
from quillon.sources import Connections, introspect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
MODEL = Path(__file__).parent / "tpch_model"


@lru_cache(maxsize=1)
def model():
    return loader.project(MODEL, {"big": "400000"})


#: The day that relative date ranges count from here.
TODAY = date(1998, 5, 17)


def engine(spark: SparkSession, sf_dir: str) -> SemanticEngine:
    return SemanticEngine(model(), spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES}, today=TODAY)


QUERIES: dict[str, tuple[Any, str]] = {}


def _q(name: str, sql: str, **request: Any) -> None:
    QUERIES[name] = (request, sql)


def _f(member: str, operator: str, *values: str) -> dict:
    return {"member": member, "operator": operator, "values": list(values)}


def _t(dimension: str, granularity: str | None = None, date_range: Any = None) -> dict:
    return {"dimension": dimension, "granularity": granularity, "date_range": date_range}


# ---- scans and projections ---------------------------------------------------------------
_q("scan_project", "SELECT c_name AS customer__name, c_mktsegment AS customer__segment FROM customer", dimensions=["customer.name", "customer.segment"])
_q("sql_view", "WITH f AS (SELECT o_custkey, COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders GROUP BY 1) SELECT n > 1 AS customer_facts__is_repeat, COUNT(*) AS customer_facts__count, ROUND(SUM(s), 2) AS customer_facts__spent FROM f GROUP BY 1",
   dimensions=["customer_facts.is_repeat"], measures=["customer_facts.count", "customer_facts.spent"])
_q("calc_dimension", "SELECT CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END AS part__size_class, COUNT(*) AS part__count FROM part GROUP BY 1",
   dimensions=["part.size_class"], measures=["part.count"])
_q("dims_only", "SELECT o_orderstatus AS orders__status, c_mktsegment AS customer__segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey", dimensions=["orders.status", "customer.segment"])
_q("ungrouped_rows", "SELECT o_orderkey AS orders__order_id, o_totalprice AS orders__revenue, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS orders__urgent_count FROM orders",
   dimensions=["orders.order_id"], measures=["orders.revenue", "orders.urgent_count"], ungrouped=True)
_q("subquery_dimension", "SELECT c_custkey AS customer__customer_id, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS customer__order_count, ROUND(COALESCE((SELECT SUM(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN o_totalprice END) FROM orders WHERE o_custkey = c_custkey), 0), 2) AS customer__urgent_total FROM customer",
   dimensions=["customer.customer_id", "customer.order_count", "customer.urgent_total"])
_q("entity_reference", "SELECT n_name AS nation__name, r_name AS nation__region_name, n_name || ' / ' || r_name AS nation__label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", dimensions=["nation.name", "nation.region_name", "nation.label"])
_q("dimension_reference", "SELECT o_totalprice > 300000 OR o_orderpriority = '1-URGENT' AS orders__large_or_urgent, COUNT(*) AS orders__count FROM orders GROUP BY 1", dimensions=["orders.large_or_urgent"], measures=["orders.count"])
_q("function_dimension", "SELECT 'y' || CAST(year(o_orderdate) AS VARCHAR) AS orders__year_label, COUNT(*) AS orders__count FROM orders GROUP BY 1", dimensions=["orders.year_label"], measures=["orders.count"])
_q("globals_inheritance", "SELECT o_orderpriority AS orders__order_priority, COUNT(*) AS lineitem__row_count FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", dimensions=["orders.order_priority"], measures=["lineitem.row_count"])

# ---- filters -----------------------------------------------------------------------------
_STATUS = "SELECT o_orderpriority AS orders__order_priority, COUNT(*) AS orders__count FROM orders WHERE {} GROUP BY 1"
for _name, _filter, _where in (
    ("equals", _f("orders.status", "equals", "F"), "o_orderstatus = 'F'"),
    ("equals_many", _f("orders.status", "equals", "F", "P"), "o_orderstatus IN ('F', 'P')"),
    ("notEquals", _f("orders.status", "notEquals", "F"), "o_orderstatus <> 'F'"),
    ("notEquals_many", _f("orders.status", "notEquals", "F", "P"), "o_orderstatus NOT IN ('F', 'P')"),
    ("contains", _f("orders.order_priority", "contains", "URG", "LOW"), "o_orderpriority LIKE '%URG%' OR o_orderpriority LIKE '%LOW%'"),
    ("notContains", _f("orders.order_priority", "notContains", "URG", "LOW"), "o_orderpriority NOT LIKE '%URG%' AND o_orderpriority NOT LIKE '%LOW%'"),
    ("startsWith", _f("orders.order_priority", "startsWith", "1", "2-H_G"), "o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2-H_G%'"),
    ("notStartsWith", _f("orders.order_priority", "notStartsWith", "1"), "o_orderpriority NOT LIKE '1%'"),
    ("endsWith", _f("orders.order_priority", "endsWith", "H", "W"), "o_orderpriority LIKE '%H' OR o_orderpriority LIKE '%W'"),
    ("notEndsWith", _f("orders.order_priority", "notEndsWith", "H"), "o_orderpriority NOT LIKE '%H'"),
    ("gt", _f("orders.total", "gt", "250000.5"), "o_totalprice > 250000.5"),
    ("gte", _f("orders.customer_id", "gte", "100"), "o_custkey >= 100"),
    ("lt", _f("orders.total", "lt", "250000"), "o_totalprice < 250000"),
    ("lte", _f("orders.customer_id", "lte", "100"), "o_custkey <= 100"),
    ("set", _f("orders.finished_total", "set"), "CASE WHEN o_orderstatus = 'F' THEN o_totalprice END IS NOT NULL"),
    ("notSet", _f("orders.finished_total", "notSet"), "CASE WHEN o_orderstatus = 'F' THEN o_totalprice END IS NULL"),
    ("inDateRange", _f("orders.ordered_at", "inDateRange", "1996-01-01", "1996-12-31"), "o_orderdate >= '1996-01-01' AND o_orderdate <= '1996-12-31'"),
    ("notInDateRange", _f("orders.ordered_at", "notInDateRange", "1996-01-01", "1996-12-31"), "o_orderdate < '1996-01-01' OR o_orderdate > '1996-12-31'"),
    ("beforeDate", _f("orders.ordered_at", "beforeDate", "1997-03-01"), "o_orderdate < '1997-03-01'"),
    ("beforeOrOnDate", _f("orders.ordered_at", "beforeOrOnDate", "1997-03-01"), "o_orderdate <= '1997-03-01'"),
    ("afterDate", _f("orders.ordered_at", "afterDate", "1997-03-01"), "o_orderdate > '1997-03-01'"),
    ("afterOrOnDate", _f("orders.ordered_at", "afterOrOnDate", "1997-03-01"), "o_orderdate >= '1997-03-01'"),
    ("onTheDate", _f("orders.ordered_at", "onTheDate", "1997-03-01"), "o_orderdate >= '1997-03-01' AND o_orderdate < '1997-03-02'"),
    ("boolean", _f("orders.is_large", "equals", "true"), "o_totalprice > 300000"),
):
    _q(f"filter_{_name}", _STATUS.format(_where), dimensions=["orders.order_priority"], measures=["orders.count"], filters=[_filter])
_q("filter_and_or_nested", "SELECT o_orderstatus AS orders__status, COUNT(*) AS orders__count FROM orders WHERE (o_totalprice > 200000 AND (o_orderpriority LIKE '1%' OR o_custkey < 50)) OR o_orderstatus = 'P' GROUP BY 1",
   dimensions=["orders.status"], measures=["orders.count"],
   filters=[{"or": [{"and": [_f("orders.total", "gt", "200000"), {"or": [_f("orders.order_priority", "startsWith", "1"), _f("orders.customer_id", "lt", "50")]}]}, _f("orders.status", "equals", "P")]}])
_q("filter_having", "SELECT o_custkey AS orders__customer_id, COUNT(*) AS orders__count FROM orders GROUP BY 1 HAVING COUNT(*) >= 12", dimensions=["orders.customer_id"], measures=["orders.count"], filters=[_f("orders.count", "gte", "12")])
_q("filter_having_hidden", "SELECT o_custkey AS orders__customer_id, COUNT(*) AS orders__count FROM orders GROUP BY 1 HAVING SUM(o_totalprice) > 3000000 OR MAX(o_totalprice) > 490000",
   dimensions=["orders.customer_id"], measures=["orders.count"], filters=[{"or": [_f("orders.revenue", "gt", "3000000"), _f("orders.largest", "gt", "490000")]}])
_q("filter_mixed_and", "SELECT o_custkey AS orders__customer_id, COUNT(*) AS orders__count FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING COUNT(*) > 4",
   dimensions=["orders.customer_id"], measures=["orders.count"], filters=[{"and": [_f("orders.count", "gt", "4"), _f("orders.status", "equals", "O")]}])
_q("filter_mixed_or", "SELECT o_orderpriority AS orders__order_priority, COUNT(*) AS orders__count FROM orders GROUP BY 1 HAVING COUNT(*) > 3000 OR o_orderpriority LIKE '1%'",
   dimensions=["orders.order_priority"], measures=["orders.count"], filters=[{"or": [_f("orders.count", "gt", "3000"), _f("orders.order_priority", "startsWith", "1")]}])
_q("segment", _STATUS.format("(o_orderstatus = 'O' OR o_orderstatus = 'P') AND o_totalprice > 100000"), dimensions=["orders.order_priority"], measures=["orders.count"], segments=["orders.open_or_pending"], filters=[_f("orders.total", "gt", "100000")])
_q("segment_joined", "SELECT c_mktsegment AS customer__segment, COUNT(*) AS orders__count FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1", dimensions=["customer.segment"], measures=["orders.count"], segments=["customer.debtors"])

# ---- measures ----------------------------------------------------------------------------
_MEASURES = {
    "count": ("orders.count", "COUNT(*)"), "sum": ("orders.revenue", "ROUND(SUM(o_totalprice), 2)"), "average": ("orders.average_total", "ROUND(AVG(o_totalprice), 4)"),
    "min": ("orders.smallest", "MIN(o_totalprice)"), "max": ("orders.largest", "MAX(o_totalprice)"), "count_distinct": ("orders.customers", "COUNT(DISTINCT o_custkey)"),
    "count_distinct_approx": ("orders.statuses_approx", "COUNT(DISTINCT o_orderstatus)"), "median": ("orders.median_total", "ROUND(median(o_totalprice), 4)"),
    "custom": ("orders.value_range", "ROUND(MAX(o_totalprice) - MIN(o_totalprice), 2)"), "number": ("orders.revenue_per_order", "ROUND(SUM(o_totalprice) / COUNT(*), 4)"),
}
for _name, (_member, _sql) in _MEASURES.items():
    _q(f"measure_{_name}", f"SELECT o_orderpriority AS orders__order_priority, {_sql} AS {_member.replace('.', '__')} FROM orders GROUP BY 1", dimensions=["orders.order_priority"], measures=[_member])
_q("measure_filtered", "SELECT o_orderstatus AS orders__status, COUNT(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS orders__urgent_count, ROUND(COALESCE(SUM(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN o_totalprice END), 0), 2) AS orders__urgent_revenue FROM orders GROUP BY 1",
   dimensions=["orders.status"], measures=["orders.urgent_count", "orders.urgent_revenue"])
_q("measure_count_expr", "SELECT l_returnflag AS lineitem__return_flag, COUNT(CASE WHEN l_discount > 0.05 THEN l_tax END) AS lineitem__taxed FROM lineitem GROUP BY 1", dimensions=["lineitem.return_flag"], measures=["lineitem.taxed"])
_q("measure_ref", "SELECT o_orderstatus AS orders__status, ROUND(COALESCE(SUM(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN o_totalprice END), 0) / NULLIF(SUM(o_totalprice), 0), 6) AS orders__urgent_share FROM orders GROUP BY 1",
   dimensions=["orders.status"], measures=["orders.urgent_share"])
_q("measure_ref_two_views", "SELECT o_orderpriority AS orders__order_priority, ROUND(r / n, 4) AS orders__revenue_per_item FROM (SELECT o_orderpriority, SUM(o_totalprice) AS r FROM orders GROUP BY 1) JOIN (SELECT o_orderpriority, COUNT(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) USING (o_orderpriority)",
   dimensions=["orders.order_priority"], measures=["orders.revenue_per_item"])
_q("global_agg", "SELECT COUNT(*) AS orders__count, ROUND(SUM(o_totalprice), 2) AS orders__revenue, COUNT(DISTINCT o_custkey) AS orders__customers FROM orders", measures=["orders.count", "orders.revenue", "orders.customers"])

# ---- time --------------------------------------------------------------------------------
for _g in ("year", "quarter", "month", "week", "day"):
    _q(f"time_{_g}", f"SELECT date_trunc('{_g}', o_orderdate)::TIMESTAMP AS orders__ordered_at__{_g}, COUNT(*) AS orders__count FROM orders GROUP BY 1", measures=["orders.count"], time_dimensions=[_t("orders.ordered_at", _g)])
for _g in ("hour", "minute", "second"):
    _q(f"time_{_g}", f"SELECT date_trunc('{_g}', ts)::TIMESTAMP AS events__at__{_g}, COUNT(*) AS events__count FROM events GROUP BY 1", measures=["events.count"], time_dimensions=[_t("events.at", _g)])
_q("time_none", "SELECT ts AS events__at, COUNT(*) AS events__count FROM events GROUP BY 1", measures=["events.count"], time_dimensions=[_t("events.at")])
_q("time_timezone", "SELECT date_trunc('day', timezone('America/New_York', timezone('UTC', ts)))::TIMESTAMP AS events__at__day, COUNT(*) AS events__count FROM events GROUP BY 1", measures=["events.count"], time_dimensions=[_t("events.at", "day")], timezone="America/New_York")
_q("time_date_range", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS orders__ordered_at__month, ROUND(SUM(o_totalprice), 2) AS orders__revenue FROM orders WHERE o_orderdate >= '1996-02-01' AND o_orderdate <= '1997-02-01' GROUP BY 1",
   measures=["orders.revenue"], time_dimensions=[_t("orders.ordered_at", "month", ["1996-02-01", "1997-02-01"])])
_q("time_on_date_dimension", "SELECT date_trunc('quarter', CAST(o_orderdate AS DATE))::TIMESTAMP AS orders__ordered_on__quarter, COUNT(*) AS orders__count FROM orders GROUP BY 1", measures=["orders.count"], time_dimensions=[_t("orders.ordered_on", "quarter")])

# Phrases count from TODAY, a Sunday; the last day of a range counts to its first moment.
_D = f"DATE '{TODAY}'"
for _name, _phrase, _low, _high in (
    ("today", "today", _D, _D), ("yesterday", "yesterday", f"{_D} - 1", f"{_D} - 1"),
    ("this_week", "this week", f"date_trunc('week', {_D})", f"date_trunc('week', {_D}) + INTERVAL 6 DAY"),
    ("this_month", "this month", f"date_trunc('month', {_D})", f"date_trunc('month', {_D}) + INTERVAL 1 MONTH - INTERVAL 1 DAY"),
    ("this_quarter", "this quarter", f"date_trunc('quarter', {_D})", f"date_trunc('quarter', {_D}) + INTERVAL 3 MONTH - INTERVAL 1 DAY"),
    ("this_year", "this year", f"date_trunc('year', {_D})", "DATE '1998-12-31'"),
    ("last_week", "last week", f"date_trunc('week', {_D}) - INTERVAL 7 DAY", f"date_trunc('week', {_D}) - INTERVAL 1 DAY"),
    ("last_month", "last month", f"date_trunc('month', {_D}) - INTERVAL 1 MONTH", f"date_trunc('month', {_D}) - INTERVAL 1 DAY"),
    ("last_quarter", "last quarter", f"date_trunc('quarter', {_D}) - INTERVAL 3 MONTH", f"date_trunc('quarter', {_D}) - INTERVAL 1 DAY"),
    ("last_year", "last year", "DATE '1997-01-01'", "DATE '1997-12-31'"),
    ("last_days", "last 10 days", f"{_D} - 10", f"{_D} - 1"), ("last_weeks", "last 3 weeks", f"{_D} - 21", f"{_D} - 1"),
    ("last_months", "last 5 months", f"{_D} - INTERVAL 5 MONTH", f"{_D} - 1"), ("last_years", "last 2 years", f"{_D} - INTERVAL 2 YEAR", f"{_D} - 1"),
):
    _q(f"range_{_name}", f"SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS orders__ordered_at__day, COUNT(*) AS orders__count FROM orders WHERE o_orderdate >= {_low} AND o_orderdate <= {_high} GROUP BY 1",
       measures=["orders.count"], time_dimensions=[_t("orders.ordered_at", "day", [_phrase])])
_q("variable_dimension", "SELECT o_totalprice > 400000 AS orders__very_large, COUNT(*) AS orders__count FROM orders GROUP BY 1", dimensions=["orders.very_large"], measures=["orders.count"])
_q("interval_dimension", "SELECT date_trunc('quarter', o_orderdate + INTERVAL 30 DAY)::TIMESTAMP AS orders__due_at__quarter, COUNT(*) AS orders__count FROM orders GROUP BY 1", measures=["orders.count"], time_dimensions=[_t("orders.due_at", "quarter")])

# ---- joins -------------------------------------------------------------------------------
_q("join_two", "SELECT c_mktsegment AS customer__segment, ROUND(SUM(o_totalprice), 2) AS orders__revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", dimensions=["customer.segment"], measures=["orders.revenue"])
_q("join_three", "SELECT o_orderstatus AS orders__status, p_brand AS part__brand, SUM(l_quantity) AS lineitem__quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2", dimensions=["orders.status", "part.brand"], measures=["lineitem.quantity"])
_q("join_four", "SELECT r_name AS region__name, COUNT(*) AS orders__count FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1", dimensions=["region.name"], measures=["orders.count"])
_q("join_shortest", "SELECT n_name AS nation__name, COUNT(*) AS lineitem__count FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", dimensions=["nation.name"], measures=["lineitem.count"])
_q("join_through_hint", "SELECT n_name AS nation__name, COUNT(*) AS lineitem__count FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
   dimensions=["nation.name"], measures=["lineitem.count"], through=["order", "customer"])
_q("join_sql_view", "SELECT c_mktsegment AS customer__segment, ROUND(SUM(s), 2) AS customer_facts__spent FROM (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY 1) LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", dimensions=["customer.segment"], measures=["customer_facts.spent"])
_q("join_partial", "SELECT lang AS documents__lang, COUNT(*) AS labels__count, CAST(SUM(toxic) AS BIGINT) AS labels__toxic_count FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1", dimensions=["documents.lang"], measures=["labels.count", "labels.toxic_count"])

_PLACE = "(SELECT l_orderkey AS k, l_linenumber AS l, COUNT(*) AS n, MAX(l_quantity) AS most FROM lineitem GROUP BY 1, 2)"
_q("join_two_keys", f"SELECT n > 1 AS place__is_shared, COUNT(*) AS lineitem__count, SUM(l_quantity) AS lineitem__quantity FROM lineitem LEFT JOIN {_PLACE} ON k = l_orderkey AND l = l_linenumber GROUP BY 1", dimensions=["place.is_shared"], measures=["lineitem.count", "lineitem.quantity"])
_q("fanout_two_keys", f"SELECT l_returnflag AS lineitem__return_flag, COUNT(*) AS place__count, SUM(most) AS place__most FROM (SELECT DISTINCT l_returnflag, k, l, most FROM {_PLACE} LEFT JOIN lineitem ON k = l_orderkey AND l = l_linenumber) GROUP BY 1", dimensions=["lineitem.return_flag"], measures=["place.count", "place.most"])

# ---- fan-out -----------------------------------------------------------------------------
_q("fanout_one_view", "SELECT l_returnflag AS lineitem__return_flag, ROUND(SUM(o_totalprice), 2) AS orders__revenue, COUNT(*) AS orders__count FROM (SELECT DISTINCT l_returnflag, o_orderkey, o_totalprice FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1",
   dimensions=["lineitem.return_flag"], measures=["orders.revenue", "orders.count"])
_q("fanout_many_side_dim", "SELECT p_brand AS part__brand, COUNT(*) AS orders__count FROM (SELECT DISTINCT p_brand, o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey) GROUP BY 1", dimensions=["part.brand"], measures=["orders.count"])
_q("fanout_two_measure_views", "SELECT o_orderpriority AS orders__order_priority, ROUND(r, 2) AS orders__revenue, q AS lineitem__quantity FROM (SELECT o_orderpriority, SUM(o_totalprice) AS r FROM orders GROUP BY 1) FULL JOIN (SELECT o_orderpriority, SUM(l_quantity) AS q FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) USING (o_orderpriority)",
   dimensions=["orders.order_priority"], measures=["orders.revenue", "lineitem.quantity"])
_q("fanout_chasm", "SELECT n_name AS nation__name, c AS customer__count, s AS supplier__count FROM (SELECT c_nationkey AS k, COUNT(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS s FROM supplier GROUP BY 1) USING (k) LEFT JOIN nation ON k = n_nationkey", dimensions=["nation.name"], measures=["customer.count", "supplier.count"])
_q("fanout_having", "SELECT p_brand AS part__brand, COUNT(*) AS orders__count FROM (SELECT DISTINCT p_brand, o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey) GROUP BY 1 HAVING COUNT(*) > 2290", dimensions=["part.brand"], measures=["orders.count"], filters=[_f("orders.count", "gt", "2290")])
_q("fanout_global", "SELECT (SELECT ROUND(SUM(o_totalprice), 2) FROM orders) AS orders__revenue, (SELECT COUNT(*) FROM lineitem) AS lineitem__count", measures=["orders.revenue", "lineitem.count"])
_q("fanout_segment", "SELECT o_orderstatus AS orders__status, COUNT(*) AS orders__count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1", dimensions=["orders.status"], measures=["orders.count"], segments=["lineitem.returned"])

# ---- order and limit ---------------------------------------------------------------------
_q("order_limit_offset", "SELECT o_custkey AS orders__customer_id, COUNT(*) AS orders__count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 5",
   dimensions=["orders.customer_id"], measures=["orders.count"], order=[{"id": "orders.count", "desc": True}, {"id": "orders.customer_id"}], limit=20, offset=5)
_q("topk", "SELECT o_orderkey AS orders__order_id, o_totalprice AS orders__total FROM orders ORDER BY 2 DESC, 1 LIMIT 25", dimensions=["orders.order_id", "orders.total"], order=[{"id": "orders.total", "desc": True}, {"id": "orders.order_id"}], limit=25)
_q("order_time_dimension", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS orders__ordered_at__month, COUNT(*) AS orders__count FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 7", measures=["orders.count"], time_dimensions=[_t("orders.ordered_at", "month")], order=[{"id": "orders.ordered_at", "desc": True}], limit=7)
_q("full_pipeline", "WITH k AS (SELECT l_partkey, l_orderkey, l_quantity FROM lineitem), a AS (SELECT c_mktsegment AS s, p_brand AS b, m, SUM(o_totalprice) AS r FROM (SELECT DISTINCT c_mktsegment, p_brand, date_trunc('month', o_orderdate)::TIMESTAMP AS m, o_orderkey, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN k ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F') GROUP BY ALL), b AS (SELECT c_mktsegment AS s, p_brand AS b, date_trunc('month', o_orderdate)::TIMESTAMP AS m, SUM(l_quantity) AS q FROM k LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT COALESCE(a.s, b.s) AS customer__segment, COALESCE(a.b, b.b) AS part__brand, COALESCE(a.m, b.m) AS orders__ordered_at__month, ROUND(r, 2) AS orders__revenue, q AS lineitem__quantity FROM a FULL JOIN b ON a.s IS NOT DISTINCT FROM b.s AND a.b IS NOT DISTINCT FROM b.b AND a.m IS NOT DISTINCT FROM b.m ORDER BY orders__revenue DESC NULLS LAST, 1, 2, 3 LIMIT 100",
   measures=["orders.revenue", "lineitem.quantity"], dimensions=["customer.segment", "part.brand"], time_dimensions=[_t("orders.ordered_at", "month")], filters=[_f("orders.status", "equals", "F")],
   order=[{"id": "orders.revenue", "desc": True}, {"id": "customer.segment"}, {"id": "part.brand"}, {"id": "orders.ordered_at"}], limit=100)

# ---- motifs ------------------------------------------------------------------------------
_BASE = "WITH b AS (SELECT date_trunc('{g}', o_orderdate)::TIMESTAMP AS orders__ordered_at__{g}, ROUND(SUM(o_totalprice), 2) AS orders__revenue, SUM(o_totalprice) AS m FROM orders GROUP BY 1)"
_BY = "WITH b AS (SELECT o_orderpriority AS orders__order_priority, ROUND(SUM(o_totalprice), 2) AS orders__revenue, SUM(o_totalprice) AS m, COUNT(*) AS orders__count FROM orders GROUP BY 1)"
for _name, _g in (("yoy", "year"), ("qoq", "quarter"), ("mom", "month"), ("wow", "week"), ("dod", "day")):
    _q(f"motif_{_name}", _BASE.format(g=_g) + f" SELECT orders__ordered_at__{_g}, orders__revenue, ROUND(lag(m) OVER w, 2) AS previous_value, ROUND((m - lag(m) OVER w) / abs(lag(m) OVER w), 6) AS growth_rate FROM b WINDOW w AS (ORDER BY orders__ordered_at__{_g})",
       measures=["orders.revenue"], time_dimensions=[_t("orders.ordered_at", _g)], motif=_name)
_M = {"measures": ["orders.revenue"], "time_dimensions": [_t("orders.ordered_at", "month")]}
_P = {"measures": ["orders.revenue"], "dimensions": ["orders.order_priority"]}
_TIME = "orders__ordered_at__month, orders__revenue"
_q("motif_anomaly", _BASE.format(g="month") + f", s AS (SELECT *, AVG(m) OVER () AS a, stddev_pop(m) OVER () AS d FROM b) SELECT {_TIME}, ROUND(a, 2) AS mean_value, ROUND(d, 2) AS stddev_value, ROUND((m - a) / d, 6) AS z_score, CASE WHEN abs((m - a) / d) > 1 THEN 1 ELSE 0 END AS is_anomaly FROM s", motif="anomaly", motif_params={"threshold": 1}, **_M)
_q("motif_contribution", _BY + " SELECT orders__order_priority, orders__revenue, ROUND(SUM(m) OVER (), 2) AS total, ROUND(m / SUM(m) OVER (), 6) AS share FROM b", motif="contribution", **_P)
_q("motif_trend", _BASE.format(g="month") + f", n AS (SELECT *, row_number() OVER (ORDER BY orders__ordered_at__month) AS row_n FROM b), s AS (SELECT *, regr_slope(m, row_n) OVER () AS sl, regr_intercept(m, row_n) OVER () AS ic FROM n) SELECT {_TIME}, row_n, ROUND(sl, 2) AS slope, ROUND(ic, 2) AS intercept, ROUND(ic + sl * row_n, 2) AS trend_value FROM s", motif="trend", **_M)
_q("motif_moving_average", _BASE.format(g="month") + f" SELECT {_TIME}, ROUND(AVG(m) OVER (ORDER BY orders__ordered_at__month ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS moving_avg FROM b", motif="moving_average", **_M)
_q("motif_rank", _BY + " SELECT orders__order_priority, orders__revenue, rank() OVER (ORDER BY m DESC) AS rank FROM b", motif="rank", **_P)
_q("motif_percent_of_total", _BY + " SELECT orders__order_priority, orders__revenue, ROUND(100.0 * m / SUM(m) OVER (), 6) AS percent_of_total FROM b", motif="percent_of_total", **_P)
_q("motif_cumulative", _BASE.format(g="month") + f" SELECT {_TIME}, ROUND(SUM(m) OVER (ORDER BY orders__ordered_at__month ROWS UNBOUNDED PRECEDING), 2) AS cumulative_value FROM b", motif="cumulative", **_M)
_q("motif_order_limit", _BY + " SELECT orders__order_priority, orders__revenue, rank() OVER (ORDER BY m DESC) AS rank FROM b ORDER BY rank LIMIT 3", motif="rank", order=[{"id": "__motif.rank"}], limit=3, **_P)
_q("motif_over_fanout", "WITH b AS (SELECT l_returnflag AS lineitem__return_flag, COUNT(DISTINCT o_orderkey) AS orders__count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT lineitem__return_flag, orders__count, CAST(SUM(orders__count) OVER () AS BIGINT) AS total, ROUND(orders__count / SUM(orders__count) OVER (), 6) AS share FROM b", dimensions=["lineitem.return_flag"], measures=["orders.count"], motif="contribution")
_DAY = _BASE.format(g="month")
_AMOUNT = {"amount": "orders.revenue", "units": "orders.count"}
_q("motif_custom_abc_class", _BY + ", x AS (SELECT *, SUM(m) OVER (ORDER BY m DESC ROWS UNBOUNDED PRECEDING) / SUM(m) OVER () AS c, COALESCE(SUM(m) OVER (ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / SUM(m) OVER () AS p FROM b) SELECT orders__order_priority, orders__revenue, ROUND(c, 6) AS reached, CASE WHEN p < 0.5 THEN 'A' WHEN p < 0.7 THEN 'B' ELSE 'C' END AS abc FROM x",
   motif="abc_class", motif_params={"b_until": 0.7}, **_P)
_q("motif_custom_segment_gap", _BY + ", x AS (SELECT *, MAX(m) OVER () AS hi, MIN(m) OVER () AS lo FROM b) SELECT orders__order_priority, orders__revenue, ROUND(hi - m, 2) AS behind_best, ROUND(m - lo, 2) AS over_last, ROUND(100 * (hi - m) / hi, 6) AS behind_percent FROM x", motif="segment_gap", **_P)
_q("motif_custom_compound_rate", _DAY + f", x AS (SELECT *, row_number() OVER w - 1 AS k, first_value(m) OVER w AS f FROM b WINDOW w AS (ORDER BY orders__ordered_at__month)) SELECT {_TIME}, CAST(k AS INTEGER) AS periods, ROUND(CASE WHEN k > 0 THEN pow(m / f, 1.0 / k) - 1 END, 6) AS rate FROM x", motif="compound_rate", **_M)
_q("motif_custom_order_pause", "WITH b AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS d, SUM(o_totalprice) AS m FROM orders WHERE o_custkey <= 20 GROUP BY 1), x AS (SELECT *, date_diff('day', lag(d) OVER w, d) AS p, date_diff('day', d, lead(d) OVER w) AS n FROM b WINDOW w AS (ORDER BY d)) SELECT d AS orders__ordered_at__day, ROUND(m, 2) AS orders__revenue, CAST(p AS INTEGER) AS days_before, CAST(n AS INTEGER) AS days_after, CASE WHEN p > 20 AND n > 20 THEN 1 ELSE 0 END AS lonely FROM x",
   measures=["orders.revenue"], time_dimensions=[_t("orders.ordered_at", "day")], filters=[_f("orders.customer_id", "lte", "20")], motif="order_pause", motif_params={"usual_days": 20})
_q("motif_custom_price_variance", _BY + " SELECT orders__order_priority, orders__revenue, orders__count, ROUND(SUM(m) OVER () / SUM(orders__count) OVER (), 2) AS average_price, ROUND(m - orders__count * (SUM(m) OVER () / SUM(orders__count) OVER ()), 2) AS variance FROM b", dimensions=["orders.order_priority"], measures=["orders.revenue", "orders.count"], motif="price_variance", motif_params=_AMOUNT)
_q("motif_custom_momentum", _DAY + f" SELECT {_TIME}, ROUND(AVG(m) OVER (ORDER BY orders__ordered_at__month ROWS 2 PRECEDING) - AVG(m) OVER (ORDER BY orders__ordered_at__month ROWS 5 PRECEDING), 2) AS lead_of_short, ROUND(AVG(m) OVER (), 2) AS centre, ROUND(stddev_pop(m) OVER (), 2) AS unevenness FROM b", motif="momentum", motif_params={"long": 5}, **_M)
# A motif over as many rows as there are customers.
_CUSTOMERS = "WITH b AS (SELECT o_custkey AS orders__customer_id, ROUND(SUM(o_totalprice), 2) AS orders__revenue, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS m FROM orders GROUP BY 1)"
_C = {"dimensions": ["orders.customer_id"], "measures": ["orders.revenue"]}
_q("motif_rank_customers", "WITH b AS (SELECT o_custkey AS orders__customer_id, COUNT(*) AS orders__count FROM orders GROUP BY 1) SELECT *, rank() OVER (ORDER BY orders__count DESC) AS rank FROM b", dimensions=["orders.customer_id"], measures=["orders.count"], motif="rank")
_q("motif_contribution_customers", _CUSTOMERS + " SELECT orders__customer_id, orders__revenue, ROUND(SUM(m) OVER () / 100, 2) AS total, ROUND(m / SUM(m) OVER (), 6) AS share FROM b", motif="contribution", **_C)
_q("motif_anomaly_customers", "WITH b AS (SELECT o_custkey AS orders__customer_id, COUNT(*) AS orders__count FROM orders GROUP BY 1), s AS (SELECT *, AVG(orders__count) OVER () AS a, stddev_pop(orders__count) OVER () AS d FROM b) SELECT orders__customer_id, orders__count, ROUND(a, 2) AS mean_value, ROUND(d, 2) AS stddev_value, ROUND((orders__count - a) / d, 6) AS z_score, CASE WHEN abs((orders__count - a) / d) > 2 THEN 1 ELSE 0 END AS is_anomaly FROM s", dimensions=["orders.customer_id"], measures=["orders.count"], motif="anomaly")
_TWO = "WITH b AS (SELECT o_custkey AS orders__customer_id, date_trunc('month', o_orderdate)::TIMESTAMP AS orders__ordered_at__month, COUNT(*) AS orders__count FROM orders GROUP BY 1, 2)"
_CT = {"dimensions": ["orders.customer_id"], "measures": ["orders.count"], "time_dimensions": [_t("orders.ordered_at", "month")]}
_ORDER = "(ORDER BY orders__ordered_at__month, orders__customer_id{})"
_q("motif_cumulative_customers", _TWO + f" SELECT *, CAST(SUM(orders__count) OVER {_ORDER.format(' ROWS UNBOUNDED PRECEDING')} AS BIGINT) AS cumulative_value FROM b", motif="cumulative", **_CT)
_q("motif_mom_customers", _TWO + f" SELECT *, lag(orders__count) OVER {_ORDER.format('')} AS previous_value, ROUND((orders__count - lag(orders__count) OVER {_ORDER.format('')}) / lag(orders__count) OVER {_ORDER.format('')}, 6) AS growth_rate FROM b", motif="mom", **_CT)
_q("motif_moving_average_customers", _TWO + f" SELECT *, ROUND(AVG(orders__count) OVER {_ORDER.format(' ROWS BETWEEN 6 PRECEDING AND CURRENT ROW')}, 2) AS moving_avg FROM b", motif="moving_average", **_CT)
_q("motif_trend_customers", _TWO + f", n AS (SELECT *, row_number() OVER {_ORDER.format('')} AS row_n FROM b) SELECT *, ROUND(regr_slope(orders__count, row_n) OVER (), 2) AS slope, ROUND(regr_intercept(orders__count, row_n) OVER (), 2) AS intercept, ROUND(regr_intercept(orders__count, row_n) OVER () + regr_slope(orders__count, row_n) OVER () * row_n, 2) AS trend_value FROM n", motif="trend", **_CT)

# ---- rolling measures --------------------------------------------------------------------
for _name, _member, _part, _sql in (
    ("cumulative", "orders.running_revenue", "SUM(o_totalprice) AS x", "SUM(x) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)"),
    ("trailing", "orders.revenue_3_rows", "SUM(o_totalprice) AS x", "SUM(x) OVER (ORDER BY t ROWS 2 PRECEDING)"),
    ("average", "orders.average_3_rows", "SUM(o_totalprice) AS x, COUNT(*) AS n", "SUM(x) OVER (ORDER BY t ROWS 2 PRECEDING) / SUM(n) OVER (ORDER BY t ROWS 2 PRECEDING)"),
    ("filtered", "orders.urgent_running", "SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS x", "COALESCE(SUM(x) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 0)"),
    ("centred_max", "orders.largest_around", "MAX(o_totalprice) AS x", "MAX(x) OVER (ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
    ("leading", "orders.count_to_come", "COUNT(*) AS x", "CAST(SUM(x) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT)"),
):
    _value = _sql if "BIGINT" in _sql else f"ROUND({_sql}, 2)"
    _q(f"rolling_{_name}", f"SELECT t AS orders__ordered_at__month, {_value} AS {_member.replace('.', '__')} FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS t, {_part} FROM orders GROUP BY 1)", measures=[_member], time_dimensions=[_t("orders.ordered_at", "month")])

_TWO_DIMS = "WITH x AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS t, o_orderpriority AS p, SUM(o_totalprice) AS s, MAX(o_totalprice) AS h, COUNT(*) AS n FROM orders GROUP BY 1, 2)"
_q("rolling_two_dimensions", _TWO_DIMS + " SELECT t AS orders__ordered_at__month, p AS orders__order_priority, ROUND(SUM(s) OVER (ORDER BY t, p ROWS UNBOUNDED PRECEDING), 2) AS orders__running_revenue, ROUND(SUM(s) OVER w / SUM(n) OVER w, 2) AS orders__average_3_rows, ROUND(MAX(h) OVER (ORDER BY t, p ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS orders__largest_around, CAST(SUM(n) OVER (ORDER BY t, p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS orders__count_to_come FROM x WINDOW w AS (ORDER BY t, p ROWS 2 PRECEDING)",
   dimensions=["orders.order_priority"], measures=["orders.running_revenue", "orders.average_3_rows", "orders.largest_around", "orders.count_to_come"], time_dimensions=[_t("orders.ordered_at", "month")])

#: Float columns are compared at so many digits.
_DIGITS = {"share": 6, "growth_rate": 6, "z_score": 6, "percent_of_total": 6, "reached": 6, "behind_percent": 6, "rate": 6, "orders__urgent_share": 6, "orders__average_total": 4, "orders__median_total": 4, "orders__revenue_per_order": 4, "orders__revenue_per_item": 4}


def _rounded(df: DataFrame) -> DataFrame:
    for name, kind in df.dtypes:
        if kind == "double":
            df = df.withColumn(name, F.round(name, _DIGITS.get(name, 2)))
    return df


def _profile(target: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = profile.statistics(engine(spark, sf_dir), target)
        return _rounded(df.select(*[F.col(f"`{c}`").alias(c.split("|")[1]) for c in df.columns]))

    return run


_PROFILES = {
    "profile_string": ("orders.status", "SELECT COUNT(*) AS count, COUNT(*) - COUNT(o_orderstatus) AS null_count, COUNT(DISTINCT o_orderstatus) AS cardinality FROM orders"),
    "profile_number": ("part.price", "SELECT COUNT(*) AS count, COUNT(*) - COUNT(p_retailprice) AS null_count, COUNT(DISTINCT p_retailprice) AS cardinality, ROUND(MIN(p_retailprice), 2) AS min, ROUND(MAX(p_retailprice), 2) AS max, ROUND(AVG(p_retailprice), 2) AS mean FROM part"),
    "profile_datetime": ("orders.ordered_at", "SELECT COUNT(*) AS count, COUNT(*) - COUNT(o_orderdate) AS null_count, MIN(o_orderdate) AS min, MAX(o_orderdate) AS max FROM orders"),
    "profile_boolean": ("customer.in_debt", "SELECT COUNT(*) AS count, COUNT(*) - COUNT(c_acctbal) AS null_count, COUNT(*) FILTER (c_acctbal < 0) AS true_count, COUNT(*) FILTER (c_acctbal >= 0) AS false_count FROM customer"),
}


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.values(engine(spark, sf_dir), "events.event_type", profile.FEW_LIMIT)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _cli_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request as the command line spells it: filters, order, limit, motif and its parameter."""
    flags = ["query", "--dimension", "orders.order_priority", "--measure", "orders.count", "--filter", "orders.status:equals:F,O", "--filter", "orders.total:gt:1000", "--order", "orders.count:desc", "--limit", "4", "--motif", "anomaly", "--motif-param", "threshold=1"]
    return _rounded(engine(spark, sf_dir).query(cli.request_of(cli.parser().parse_args(flags))))


def _topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).with_topic_filters({"dimensions": ["orders.status"], "measures": ["orders.count"]}, "sales")


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second step of a saved query."""
    made = engine(spark, sf_dir)
    return _rounded(made.query(made.layer.saved_queries[0].steps[1].query))


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an envelope says of a good and of two bad requests."""
    made = engine(spark, sf_dir)
    out = [envelope.run(made, q, rows=3) for q in ({"dimensions": ["orders.order_id"]}, {"measures": ["orders.nothing"]}, "{")]
    return _rows(spark, [(x["status"], x.get("row_count"), len(x.get("data") or ()), ",".join(x.get("views_used") or ())) for x in out], "status string, row_count long, shown int, views string")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, model()).where("view = 'region' OR kind = 'topic'").select("kind", "path", "type")


def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = introspect.of_frame("labels", spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _rows(spark, [(found.name, c.name, c.type) for c in found.columns], "table_name string, column_name string, type string")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view drafted from a file, asked through a configured folder of files."""
    view = bootstrap.view("nation", spark.read.parquet(f"{sf_dir}/nation.parquet")) | {"datasource": "folder"}
    sources = Connections({"databases": [{"name": "folder", "type": "files", "file_search_path": sf_dir}]}).all()
    made = SemanticEngine(loader.layer([yaml.safe_dump(view)]), spark, sources=sources)
    return made.query({"dimensions": ["nation.n_regionkey"], "measures": ["nation.count", "nation.total_n_nationkey"]})


_OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "profile_values": (_values, f"SELECT event_type AS value, COUNT(*) AS frequency FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {profile.FEW_LIMIT}"),
    "cli_flags": (_cli_flags, "WITH b AS (SELECT o_orderpriority AS orders__order_priority, COUNT(*) AS orders__count FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 1000 GROUP BY 1), s AS (SELECT *, AVG(orders__count) OVER () AS a, stddev_pop(orders__count) OVER () AS d FROM b) SELECT orders__order_priority, orders__count, ROUND(a, 2) AS mean_value, ROUND(d, 2) AS stddev_value, ROUND((orders__count - a) / d, 6) AS z_score, CASE WHEN abs((orders__count - a) / d) > 1 THEN 1 ELSE 0 END AS is_anomaly FROM s ORDER BY orders__count DESC LIMIT 4"),
    "topic_filters": (_topic, "SELECT o_orderstatus AS orders__status, COUNT(*) AS orders__count FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1"),
    "saved_step": (_saved, _BY + " SELECT orders__order_priority, orders__revenue, ROUND(SUM(m) OVER (), 2) AS total, ROUND(m / SUM(m) OVER (), 6) AS share FROM b"),
    "envelope_statuses": (_envelope, "SELECT 'success' AS status, COUNT(*) AS row_count, 3 AS shown, 'orders' AS views FROM orders UNION ALL SELECT 'compile_error', NULL, 0, '' UNION ALL SELECT 'parse_error', NULL, 0, ''"),
    "catalog_entries": (_catalog, "SELECT * FROM (VALUES ('view', 'region', 'table'), ('dimension', 'region.region_id', 'number'), ('dimension', 'region.name', 'string'), ('measure', 'region.count', 'count'), ('entity', 'region.region', 'primary'), ('topic', 'sales', NULL)) t(kind, path, type)"),
    "schema_columns": (_schema, "SELECT 'labels' AS table_name, column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type FROM (DESCRIBE labels)"),
    "file_source": (_files, "SELECT n_regionkey AS nation__n_regionkey, COUNT(*) AS nation__count, CAST(SUM(n_nationkey) AS BIGINT) AS nation__total_n_nationkey FROM nation GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(request: dict) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: _rounded(engine(spark, sf_dir).query(request))

    out = {name: make(request) for name, (request, _) in QUERIES.items()}
    return out | {name: _profile(target) for name, (target, _) in _PROFILES.items()} | {name: run for name, (run, _) in _OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in QUERIES.items()} | {name: sql for name, (_, sql) in _PROFILES.items()}
    return out | {name: sql for name, (_, sql) in _OTHERS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["full_pipeline"](spark, sf_dir)
