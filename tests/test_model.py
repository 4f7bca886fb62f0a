"""Loading, validation, requests, dates, join paths: no Spark."""

from datetime import date

import pytest

from quillon import dates, loader, request, validate
from quillon.errors import JoinError, QueryError, SchemaError
from quillon.plans import refs
from quillon.plans.graph import JoinGraph

ORDERS = """
name: orders
description: orders
table: public.orders
entities:
  - {name: order, type: primary, key: id}
  - {name: customer, type: foreign, key: customer_id}
dimensions:
  - {name: id, type: number, expr: id}
  - {name: customer_id, type: number, expr: cust}
measures:
  - {name: count, type: count}
  - {name: mean, type: avg, expr: amount}
"""
CUSTOMERS = """
name: customers
sql: SELECT 1 AS id
entities: [{name: customer, key: id}]
dimensions: [{name: id, type: number, expr: id}]
"""


def test_views_read():
    layer = loader.layer([ORDERS, CUSTOMERS])
    orders = layer.view("orders")
    assert orders.measure("mean").type == "average"
    assert orders.primary_keys() == ("id",)
    assert layer.view("customers").entities[0].type == "primary"
    assert validate.problems(layer) == []


def test_globals():
    shared = """
semantics:
  dimensions:
    created: {type: datetime, expr: created_at}
  measures:
    - {total: null, type: sum, expr: x}
  entities:
    customer: {type: foreign, key: id}
"""
    text = """
name: v
table: t
entities: [{name: buyer, inherits_from: globals.semantics.entities.customer}]
dimensions:
  - {name: local, inherits_from: globals.semantics.dimensions.created}
  - {name: id, type: number, expr: id}
measures: [{inherits_from: globals.semantics.measures.total}]
"""
    v = loader.layer([text], globals_text=shared).view("v")
    assert [d.name for d in v.dimensions] == ["created", "id"]  # the global's name wins
    assert v.entities[0].name == "buyer" and v.entities[0].type == "foreign"
    assert v.measures[0].name == "total"
    with pytest.raises(SchemaError, match="missing"):
        loader.layer([text.replace("created}", "missing}")], globals_text=shared)


@pytest.mark.parametrize(
    "text",
    ["name: v\ntable: t\ndimensions: [{name: a, type: odd, expr: a}]", "table: t", "name: v\ntable: t\nmeasures: [{name: a}]", "a: [", "name: v\ntable: t\ndimensions: [{name: a, type: string}]"],
)
def test_bad_views(text):
    with pytest.raises(SchemaError):
        loader.layer([text])


def test_validation_reports_everything():
    bad = """
name: v
table: t
sql: SELECT 1
entities: [{name: e, key: nothing}, {name: f, type: foreign, key: d}]
dimensions: [{name: d, type: string, expr: d}, {name: d, type: string, expr: e}]
measures: [{name: m, type: sum}, {name: n, type: number, expr: "{{other.x}}"}]
"""
    motif = "name: m\nparams: {measure: {type: measure}}\noutputs: [{name: a, expr: '{{ unknown }}'}]"
    found = "\n".join(validate.problems(loader.layer([bad, CUSTOMERS, CUSTOMERS], ["name: t\nviews: [zz]"], [motif], ["name: q\nsteps: [{name: s}, {name: s}]"])))
    for part in ("'customers' is declared twice", "either table or sql", "'v.d' is declared twice", "'nothing'", "'v.m' of type sum", "'other'", "'unknown'", "step 's'", "'zz'"):
        assert part in found
    assert validate.warnings(loader.layer([bad])) == ["entity 'f' of view 'v' has no primary view"]


def test_request_forms():
    q = request.parse('{"measures": ["a.b"], "filters": [{"or": [{"member": "a.c", "operator": "set"}, {"and": []}]}], "strange": 1}')
    assert q.measures == ("a.b",) and q.filters[0].any_of and [f.operator for f in q.filters[0].leaves()] == ["set"]
    assert request.filter_flag("a.b:equals:x,y").values == ("x", "y")
    assert request.filter_flag("a.b:set").values == ()
    assert request.order_flag("a.b:desc").desc and not request.order_flag("a.b").desc
    assert request.motif_param_flag("k=3") == ("k", 3) and request.motif_param_flag("k=a.b") == ("k", "a.b")
    for bad in ("a.b", "a.b:odd:1"):
        with pytest.raises((QueryError, SchemaError)):
            request.filter_flag(bad)
    with pytest.raises(QueryError):
        request.order_flag("a.b:up")
    for op, values in (("equals", []), ("gt", []), ("inDateRange", ["1"])):
        with pytest.raises(QueryError):
            request.parse_filter({"member": "a.b", "operator": op, "values": values})
    assert request.default_filter({"field": "a.b", "op": "in", "values": ["x", "y"]}).operator == "equals"


TODAY = date(2024, 3, 31)  # a Sunday


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        ("today", "2024-03-31", "2024-03-31"), ("Yesterday", "2024-03-30", "2024-03-30"), ("this week", "2024-03-25", "2024-03-31"),
        ("this month", "2024-03-01", "2024-03-31"), ("this quarter", "2024-01-01", "2024-03-31"), ("this year", "2024-01-01", "2024-12-31"),
        ("last week", "2024-03-18", "2024-03-24"), ("last month", "2024-02-01", "2024-02-29"), ("last quarter", "2023-10-01", "2023-12-31"),
        (" last  year ", "2023-01-01", "2023-12-31"), ("last 7 days", "2024-03-24", "2024-03-30"), ("last 1 day", "2024-03-30", "2024-03-30"),
        ("last 2 weeks", "2024-03-17", "2024-03-30"), ("last 1 month", "2024-02-28", "2024-03-30"), ("last 14 months", "2023-01-28", "2024-03-30"),
        ("last 2 years", "2022-03-28", "2024-03-30"),
    ],
)
def test_phrases(text, low, high):
    assert dates.resolve([text], TODAY) == (low, high)


def test_ranges():
    assert dates.resolve(["2024-01-01", "2024-02-01"], TODAY) == ("2024-01-01", "2024-02-01")
    assert dates.resolve(None, TODAY) is None
    for bad in (["next week"], ["a", "b", "c"]):
        with pytest.raises(QueryError):
            dates.resolve(bad, TODAY)


def star(*views):
    texts = []
    for name, entities in views:
        keys = sorted({k for _, _, k in entities})
        dims = "".join(f"\n  - {{name: {k}, type: number, expr: {k}}}" for k in keys)
        texts.append(f"name: {name}\ntable: {name}\nentities:" + "".join(f"\n  - {{name: {e}, type: {t}, key: {k}}}" for e, t, k in entities) + f"\ndimensions:{dims}")
    return JoinGraph(loader.layer(texts))


DIAMOND = star(
    ("orders", [("store", "foreign", "s"), ("warehouse", "foreign", "w")]),
    ("stores", [("store", "primary", "s"), ("shipment", "foreign", "h")]),
    ("warehouses", [("warehouse", "primary", "w"), ("shipment", "foreign", "h")]),
    ("shipments", [("shipment", "primary", "h")]),
    ("alone", [("nobody", "primary", "x")]),
)


def test_paths_and_hints():
    assert [e.right for e in DIAMOND.tree("orders", {"shipments"})] == ["stores", "shipments"]
    assert [e.right for e in DIAMOND.tree("orders", {"shipments"}, ("warehouse",))] == ["warehouses", "shipments"]
    assert not any(e.many for e in DIAMOND.tree("orders", {"shipments"}))
    assert all(e.many for e in DIAMOND.tree("shipments", {"orders"}))
    assert DIAMOND.root_for({"shipments", "orders"}, {}) == "orders"
    with pytest.raises(JoinError):
        DIAMOND.tree("orders", {"alone"})
    with pytest.raises(JoinError):
        DIAMOND.root_for({"orders", "alone"}, {})


def test_refs():
    assert refs.backticked("""CONCAT("a b", 'it''s "x"', `c`)""") == """CONCAT(`a b`, 'it''s "x"', `c`)"""
    assert refs.names("{{ TABLE }}.x + {{a.b}} {{c}}") == [("TABLE", None), ("a", "b"), ("c", None)]
    assert refs.table_name("db.my table") == "db.`my table`"
