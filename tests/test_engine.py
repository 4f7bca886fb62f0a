"""Values over small fixtures with answers worked out by hand."""

import json
import re
from datetime import date, datetime

import pytest

from quillon import bootstrap, catalog, cli, envelope, loader, profile, queries
from quillon.engine import SemanticEngine
from quillon.errors import PlanError, QueryError, SchemaError, SourceError
from quillon.plans import planner
from quillon.sources import Connections, FileSource, connect, credential, introspect, test_connection as ping

# Parcels on their way, invented for these tests: id, step, sender, when, country, carrier, fee in cents.
PARCELS = [
    ("p1", "fee", "ann", "2024-06-03 08:15:00", "NO", "road", 1250), ("p2", "scan", "ann", "2024-06-03 09:40:00", "NO", "road", 0),
    ("p3", "fee", "bob", "2024-06-03 17:05:00", "PT", "rail", 3000), ("p4", "move", "cid", "2024-06-04 07:30:00", "AT", "rail", 0),
    ("p5", "fee", "cid", "2024-06-04 11:20:00", "AT", "air", 7600), ("p6", "scan", "dee", "2024-06-04 23:59:59", None, "air", 0),
    ("p7", "fee", "dee", "2024-06-05 06:00:00", "PT", "road", 450), ("p8", "move", "bob", "2024-06-05 12:10:00", "IS", "rail", 0),
    ("p9", "fee", "eve", "2024-06-05 13:45:00", "NO", "air", 2200), ("p10", "fee", "ann", "2024-06-05 20:30:00", "PT", "road", 1100),
]
VIEW = """
name: parcels
table: parcels
entities: [{name: parcel, key: parcel_id}, {name: country, type: foreign, key: country}]
dimensions:
  - {name: parcel_id, type: string, expr: parcel_id}
  - {name: kind, type: string, expr: step}
  - {name: country, type: string, expr: country}
  - {name: carrier, type: string, expr: carrier}
  - {name: at, type: datetime, expr: handled}
  - {name: euros, type: number, expr: fee_cents / 100.0D}
  - {name: charged, type: boolean, expr: "{{euros}} > 0"}
  - {name: big, type: boolean, expr: "fee_cents > {{variables.limit}}"}
  - {name: country_name, type: string, expr: "{{country.title}}"}
  - {name: loop_a, type: string, expr: "{{parcels.loop_b}}"}
  - {name: loop_b, type: string, expr: "{{parcels.loop_a}}"}
measures:
  - {name: n, type: count}
  - {name: senders, type: count_distinct, expr: sender}
  - {name: revenue, type: sum, expr: "{{parcels.euros}}"}
  - {name: paid, type: count, filters: [{expr: "step = 'fee'"}]}
  - {name: none, type: sum, expr: fee_cents, filters: [{expr: "step = 'none'"}]}
  - {name: per_sender, type: number, expr: "{{parcels.revenue}} / {{parcels.senders}}"}
  - {name: rolling_senders, type: count_distinct, expr: sender, rolling_window: {trailing: unbounded}}
segments:
  - {name: road_or_rail, expr: "carrier = 'road' OR carrier = 'rail'"}
"""
COUNTRY = """
name: countries
table: countries
entities: [{name: country, key: code}]
dimensions:
  - {name: code, type: string, expr: code}
  - {name: title, type: string, expr: title}
  - {name: parcels, type: number, expr: parcels.n, sub_query: true}
measures: [{name: n, type: count}, {name: area, type: sum, expr: area}]
"""
MOTIF = "name: double\nparams: {measure: {type: measure}, times: {type: number, default: 2}}\nadds: [{name: doubled, expr: '{{ measure }} * {{ times }}'}, {name: more, expr: 'doubled + 1'}]"
SAVED = "name: look\nsteps:\n  - {name: good, query: {measures: [parcels.n]}}\n  - {name: bad, query: {measures: [parcels.zz]}}\n  - {name: also, query: {dimensions: [parcels.carrier], measures: [parcels.n]}}"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(*r[:3], datetime.fromisoformat(r[3]), *r[4:]) for r in PARCELS]
    parcels = spark.createDataFrame(rows, "parcel_id string, step string, sender string, handled timestamp_ntz, country string, carrier string, fee_cents int")
    countries = spark.createDataFrame([("NO", "Norway", 7), ("PT", "Portugal", 2), ("AT", "Austria", 3), ("SE", "Sweden", 5)], "code string, title string, area int")
    layer = loader.layer([VIEW, COUNTRY], ["name: t\nviews: [parcels]\ndefault_filters: [{field: parcels.carrier, op: eq, value: rail}]"], [MOTIF], [SAVED], variables={"limit": 3000})
    return SemanticEngine(layer, spark, {"parcels": parcels, "countries": countries}, today=date(2024, 6, 6))


def rows(engine, **q):
    return sorted((tuple(r) for r in engine.query(q).collect()), key=str)


def test_totals(engine):
    assert rows(engine, measures=["parcels.n", "parcels.paid", "parcels.none"]) == [(10, 6, 0)]


def test_by_carrier(engine):
    got = rows(engine, dimensions=["parcels.carrier"], measures=["parcels.n", "parcels.revenue", "parcels.senders", "parcels.paid"])
    assert [(p, n, round(r, 2), u, b) for p, n, r, u, b in got] == [("air", 3, 98.0, 3, 2), ("rail", 3, 30.0, 2, 1), ("road", 4, 28.0, 2, 3)]


def test_motifs_by_day(engine):
    day = [{"dimension": "parcels.at", "granularity": "day"}]
    growth = engine.query({"measures": ["parcels.revenue"], "time_dimensions": day, "motif": "dod", "order": [{"id": "parcels.at"}]}).collect()
    assert [r.growth_rate and round(r.growth_rate, 6) for r in growth] == [None, 0.788235, -0.506579]
    trend = engine.query({"measures": ["parcels.revenue"], "time_dimensions": day, "motif": "trend"}).first()
    assert (round(trend.slope, 3), round(trend.intercept, 6)) == (-2.5, 57.0)
    total = engine.query({"measures": ["parcels.revenue"], "time_dimensions": day, "motif": "cumulative", "order": [{"id": "parcels.at.day"}]}).collect()
    assert [round(r.cumulative_value, 2) for r in total] == [42.5, 118.5, 156.0]


def test_motifs_by_carrier(engine):
    base = {"dimensions": ["parcels.carrier"], "measures": ["parcels.revenue"]}
    share = {r[0]: round(r.share, 6) for r in engine.query(base | {"motif": "contribution"}).collect()}
    assert share == {"air": 0.628205, "rail": 0.192308, "road": 0.179487}
    z = {r[0]: (round(r.z_score, 6), r.is_anomaly) for r in engine.query(base | {"motif": "anomaly"}).collect()}
    assert z == {"air": (1.413768, 0), "rail": (-0.67615, 0), "road": (-0.737618, 0)}
    assert {r[0]: r.rank for r in engine.query(base | {"motif": "rank"}).collect()} == {"air": 1, "rail": 2, "road": 3}
    assert {r[0]: (r.doubled, r.more) for r in engine.query({"dimensions": ["parcels.carrier"], "measures": ["parcels.n"], "motif": "double"}).collect()} == {"air": (6, 7), "rail": (6, 7), "road": (8, 9)}
    assert engine.query({"measures": ["parcels.n"], "motif": "double", "motif_params": {"times": 5}}).first().doubled == 50


@pytest.mark.parametrize(
    "q",
    [
        {"dimensions": ["parcels.carrier"], "measures": ["parcels.n"], "motif": "trend"},
        {"measures": ["parcels.n"], "motif": "nothing"},
        {"dimensions": ["parcels.carrier"], "measures": ["parcels.n", "parcels.revenue"], "motif": "rank"},
        {"dimensions": ["parcels.carrier"], "motif": "rank"},
        {"measures": ["parcels.n"], "motif": "double", "motif_params": {"times": "1; DROP"}},
        {"measures": ["parcels.n"], "motif": "rank", "motif_params": {"measure": "parcels.revenue"}},
        {"measures": ["parcels.zz"]}, {"dimensions": ["zz.a"]}, {"dimensions": ["a.b.c"]}, {}, {"measures": ["parcels.n"], "segments": ["parcels.zz"]},
        {"measures": ["parcels.n"], "order": [{"id": "parcels.senders"}]},
        {"measures": ["parcels.n"], "filters": [{"member": "parcels.euros", "operator": "gt", "values": ["many"]}]},
        {"measures": ["parcels.n"], "filters": [{"member": "parcels.at", "operator": "gt", "values": ["soon"]}]},
        {"measures": ["parcels.n"], "time_dimensions": [{"dimension": "parcels.at", "granularity": "decade"}]},
    ],
)
def test_bad_requests(engine, q):
    with pytest.raises(QueryError):
        engine.query(q)


@pytest.mark.parametrize(
    "q",
    [
        {"dimensions": ["parcels.loop_a"]},
        {"measures": ["parcels.rolling_senders"], "time_dimensions": [{"dimension": "parcels.at", "granularity": "day"}]},
        {"measures": ["parcels.per_sender"], "ungrouped": True},
        {"measures": ["parcels.n", "countries.n"], "ungrouped": True},
        {"dimensions": ["parcels.carrier"], "measures": ["parcels.n"], "filters": [{"or": [{"member": "parcels.n", "operator": "gt", "values": ["1"]}, {"member": "parcels.kind", "operator": "equals", "values": ["move"]}]}]},
    ],
)
def test_no_plan(engine, q):
    with pytest.raises(PlanError):
        engine.query(q)


def test_expressions(engine):
    assert rows(engine, dimensions=["parcels.charged"], measures=["parcels.n"]) == [(False, 4), (True, 6)]
    assert rows(engine, dimensions=["parcels.big"], measures=["parcels.n"]) == [(False, 9), (True, 1)]
    assert round(rows(engine, measures=["parcels.per_sender"])[0][0], 4) == round(156 / 5, 4)
    assert rows(engine, measures=["parcels.n"], segments=["parcels.road_or_rail"], filters=[{"member": "parcels.kind", "operator": "equals", "values": ["move"]}]) == [(2,)]


def test_joins_keep_rows(engine):
    names = rows(engine, dimensions=["parcels.country_name"], measures=["parcels.n"])
    assert names == [("Austria", 2), ("Norway", 3), ("Portugal", 3), (None, 2)]
    assert rows(engine, dimensions=["countries.title"], measures=["parcels.n"]) == names
    assert rows(engine, dimensions=["countries.code", "countries.parcels"]) == [("AT", 2), ("NO", 3), ("PT", 3), ("SE", 0)]


def test_fan_out(engine):
    # Areas by carrier: a country counts once for each carrier it has parcels on.
    assert rows(engine, dimensions=["parcels.carrier"], measures=["countries.area"]) == [("air", 10), ("rail", 5), ("road", 9), (None, 5)]
    assert rows(engine, measures=["countries.area", "parcels.n"]) == [(17, 10)]
    both = rows(engine, dimensions=["countries.title"], measures=["countries.area", "parcels.n"])
    assert both == [("Austria", 3, 2), ("Norway", 7, 3), ("Portugal", 2, 3), ("Sweden", 5, None), (None, None, 2)]


def test_fan_out_in_parts(spark, engine, tmp_path, monkeypatch):
    # Join and distinct rows of a fan-out keep their parts, by size of the files or else the session's; merged, one task had to hold all.
    monkeypatch.setattr(planner, "PART", 256, raising=False)
    engine.tables["parcels"].write.parquet(f"{tmp_path}/parcels")
    filed = SemanticEngine(engine.layer, spark, engine.tables | {"parcels": f"{tmp_path}/parcels"})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made, fewest in ((filed, 5), (engine, 4)):
            df = made.query({"dimensions": ["parcels.carrier"], "measures": ["countries.area"]})
            assert sorted(rows_of(df), key=str) == [("air", 10), ("rail", 5), ("road", 9), (None, 5)]
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            below = plan[plan.index("SortMergeJoin") :]
            assert "AQEShuffleRead" not in below
            parts = {int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", below)}
            assert len(parts) == 1 and min(parts) >= fewest
            assert plan[: plan.index("SortMergeJoin")].count("Exchange hashpartitioning") == 1  # distinct rows stay where the join made them
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_relative_dates(engine):
    q = {"measures": ["parcels.n"], "time_dimensions": [{"dimension": "parcels.at", "granularity": "day", "date_range": ["last 2 days"]}]}
    assert [r[1] for r in sorted(engine.query(q).collect())] == [3]  # to the start of the last day
    with pytest.raises(QueryError):
        engine.query({"measures": ["parcels.n"], "time_dimensions": [{"dimension": "parcels.at", "date_range": ["soon"]}]})


def test_columns_and_plan(engine):
    q = {"dimensions": ["parcels.carrier"], "measures": ["parcels.n"], "time_dimensions": [{"dimension": "parcels.at", "granularity": "day"}], "motif": "cumulative"}
    assert [(c.member, c.alias, c.kind) for c in engine.columns(q)] == [
        ("parcels.carrier", "parcels__carrier", "dimension"), ("parcels.at.day", "parcels__at__day", "time_dimension"),
        ("parcels.n", "parcels__n", "measure"), ("__motif.cumulative_value", "cumulative_value", "motif"),
    ]
    assert engine.query(q).columns == [c.alias for c in engine.columns(q)]
    assert "HashAggregate" in engine.explain(q)
    assert engine.views_used(q) == ["parcels"]
    assert rows_of(engine.with_topic_filters({"measures": ["parcels.n"]}, "t")) == [(3,)]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_pruning(spark):
    """Filters and columns reach the files; joined tables are read for their own columns only."""
    plan = queries.engine(spark, "/root/testdata/sf0.001").explain(
        {"dimensions": ["customer.segment"], "measures": ["orders.revenue"], "filters": [{"member": "orders.status", "operator": "equals", "values": ["F"]}]}
    )
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_envelope(engine):
    good = envelope.run(engine, {"dimensions": ["parcels.carrier"], "measures": ["parcels.revenue"], "order": [{"id": "parcels.carrier"}]})
    assert good["status"] == "success" and good["row_count"] == 3 and good["data"][1] == {"parcels__carrier": "rail", "parcels__revenue": 30.0}
    json.dumps(good)
    assert envelope.run(engine, {"dimensions": ["parcels.parcel_id"]}, rows=5)["row_count"] == 10
    assert envelope.run(engine, "{")["status"] == "parse_error"
    assert envelope.run(engine, {"measures": ["parcels.zz"]})["status"] == "compile_error"
    steps = envelope.saved(engine, "look")["steps"]
    assert [s["result"]["status"] for s in steps] == ["success", "compile_error", "success"]
    assert envelope.saved(engine, "zz")["status"] == "parse_error"


def test_profile(engine):
    got = profile.profile(engine, "parcels.country")
    assert (got["count"], got["null_count"], got["cardinality"], got["values_complete"]) == (10, 1, 4, True)
    assert got["values"][0] == {"value": "NO", "frequency": 3}
    number = profile.profile(engine, "parcels.euros")
    assert (number["min"], number["max"], round(number["mean"], 4)) == (0.0, 76.0, 15.6)
    with pytest.raises(QueryError):
        profile.profile(engine, "countries.parcels")
    assert [p["dimension"] for p in profile.profile(engine, "countries")] == ["countries.code", "countries.title"]


def test_catalog(engine, spark):
    kinds = {e["kind"] for e in catalog.entries(engine.layer)}
    assert kinds == {"view", "dimension", "measure", "segment", "entity", "topic", "motif", "saved_query"}
    assert catalog.table(spark, engine.layer).where("kind = 'motif'").count() == 13
    assert len(catalog.inspect_motifs(engine.layer)) == 13 and all(m["outputs"] for m in catalog.inspect_motifs(engine.layer))
    assert catalog.inspect_queries(engine.layer)[0]["steps"][0]["name"] == "good"
    assert catalog.inspect_view(engine.view("parcels"))["segments"][0]["name"] == "road_or_rail"


def test_files_bootstrap_and_cli(spark, tmp_path, capsys):
    data, project = tmp_path / "data", tmp_path / "project"
    data.mkdir()
    (data / "sales.csv").write_text("day,Region Name,amount\n2024-01-01,north,3\n2024-01-02,south,4\n")
    (data / "notes.jsonl").write_text('{"a": 1}\n')
    (data / "skip.txt").write_text("no")
    assert FileSource(str(data)).register(spark) == ["notes", "sales"]
    with pytest.raises(SourceError):
        FileSource(str(tmp_path / "none")).register(spark)
    paths = bootstrap.write(project, {"sales": spark.table("sales"), "information_schema.x": spark.table("notes")})
    assert [p.name for p in paths] == ["sales.view.yml"]
    view = loader.project(project).view("sales")
    assert {d.name: d.type for d in view.dimensions} == {"day": "date", "region_name": "string", "amount": "number"}
    flags = ["--project", str(project), "--data", str(data), "query", "--dimension", "sales.region_name", "--measure", "sales.total_amount", "--order", "sales.region_name:desc", "-x"]
    assert cli.main(flags, spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert [tuple(r.values()) for r in out["data"]] == [("south", 4), ("north", 3)]
    assert cli.main(["--project", str(project), "validate"], spark) == 0
    assert cli.main(["--project", str(project), "inspect", "catalog"], spark) == 0
    assert cli.main(["--project", str(project), "query", "-q", "{}", "--measure", "a.b"], spark) == 1
    assert cli.main(["--project", str(project), "--data", str(data), "inspect", "--profile", "sales.amount"], spark) == 0
    assert cli.main(["--project", str(tmp_path / "data"), "validate"], spark) == 1


def test_introspection(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    found = introspect.schema(spark, "default")
    assert ("id", "bigint") in [(c.name, c.type) for t in found[None] if t.name == "numbers" for c in t.columns]
    assert "default" in introspect.databases(spark)


def test_connections(monkeypatch):
    monkeypatch.setenv("SECRET_PW", "hush")
    monkeypatch.setenv("EMPTY", "")
    assert credential({"a": "x"}, "a") == "x" and credential({"a_var": "SECRET_PW"}, "a") == "hush"
    assert credential({"a_var": "EMPTY"}, "a", "d") == "d"
    with pytest.raises(SourceError):
        credential({"a": ""}, "a")
    base = {"host": "h", "user": "u", "password_var": "SECRET_PW", "database": "d", "token": "t", "path": "p", "catalog": "c", "account": "a", "project": "p", "warehouse_id": "w", "instance": "i", "developer_token": "t", "dataset_id": "x"}
    for kind in ("postgres", "redshift", "mysql", "clickhouse", "trino", "presto", "sqlite", "duckdb", "motherduck", "databricks", "snowflake", "bigquery", "domo"):
        source = connect(base | {"type": kind})
        assert "hush" not in str(source.redacted())
    pg = connect(base | {"type": "postgres"})
    assert pg.options["url"] == "jdbc:postgresql://h:5432/d" and pg.options["password"] == "hush"
    with pytest.raises(SourceError):
        connect({"type": "abacus"})
    found = Connections({"databases": [{"name": "one", "type": "spark"}]})
    assert found.find() and found.find("one") and set(found.all()) == {"one"}
    with pytest.raises(SourceError):
        found.find("two")


def test_remote_views_keep_their_sql():
    """SQL of a connection goes out as it is written; only the session's own has Spark's quotes."""
    sent = []

    class Remote:
        def query(self, spark, sql):
            sent.append(sql)

    layer = loader.layer(['name: v\nsql: SELECT "Order Id" FROM t\ndatasource: far\ndimensions: [{name: x, type: number, expr: x}]'])
    made = SemanticEngine(layer, None, sources={"far": Remote()})
    made.relation(layer.views[0])
    assert sent == ['SELECT "Order Id" FROM t']
    token = connect({"type": "databricks", "host": "h", "warehouse_id": "w", "token": "t0p"})
    assert token.options["PWD"] == "t0p" and token.redacted()["PWD"] == "***"


def test_embedded_files(spark, tmp_path):
    """SQLite and DuckDB files through the Python data source, nulls, mixed types and empty results too."""
    import sqlite3

    import duckdb

    lite, duck = str(tmp_path / "a.sqlite"), str(tmp_path / "a.duckdb")
    with sqlite3.connect(lite) as con:
        con.execute('CREATE TABLE "stock list" (id INTEGER, name TEXT, weight REAL, mixed, raw BLOB)')
        con.executemany('INSERT INTO "stock list" VALUES (?, ?, ?, ?, ?)', [(1, "ax", 1.5, 3, b"x"), (2, None, 2, "two", None), (None, "é", None, None, b"")])
    with duckdb.connect(duck) as con:
        con.execute("CREATE TABLE stock AS SELECT range AS id, 'n' || range AS name, DATE '2024-01-01' + range::INT AS day FROM range(25000)")
    small, large = connect({"type": "sqlite", "path": lite, "reader": "python"}), connect({"type": "duckdb", "path": duck, "reader": "python"})
    rows = sorted(small.table(spark, "stock list").collect(), key=str)
    assert [tuple(r) for r in rows] == [(1, "ax", 1.5, "3", bytearray(b"x")), (2, None, 2.0, "two", None), (None, "é", None, None, bytearray(b""))]
    assert small.query(spark, 'SELECT id FROM "stock list" WHERE id > 5').count() == 0 and ping(spark, small) and ping(spark, large)
    assert large.table(spark, "stock").agg({"id": "sum"}).first()[0] == 25000 * 24999 // 2
    view = "name: stock\ntable: stock\ndatasource: duck\ndimensions: [{name: day, type: date, expr: day}]\nmeasures: [{name: n, type: count}]"
    made = SemanticEngine(loader.layer([view]), spark, sources={"duck": large})
    q = {"measures": ["stock.n"], "time_dimensions": [{"dimension": "stock.day", "granularity": "year"}], "order": [{"id": "stock.day"}], "limit": 1}
    assert made.query(q).first()[1] == 366


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo", "UTC"])
def test_times_do_not_depend_on_the_session(spark, zone):
    """Hours that a zone skips or repeats, in and out of the session's zone."""
    from quillon.functions import truncated

    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = ["2024-03-10 02:30:45.25", "2024-11-03 01:59:59", "1969-12-31 23:30:10.5", "2024-03-09 16:00:00"]
        rows = spark.createDataFrame([(datetime.fromisoformat(t),) for t in times], "t timestamp_ntz")
        cut = lambda g, tz=None: [str(r[0]) for r in rows.select(truncated(rows.t, g, tz)).collect()]
        assert cut("hour") == ["2024-03-10 02:00:00", "2024-11-03 01:00:00", "1969-12-31 23:00:00", "2024-03-09 16:00:00"]
        assert cut("minute")[0] == "2024-03-10 02:30:00" and cut("second")[0] == "2024-03-10 02:30:45" and cut("second")[2] == "1969-12-31 23:30:10"
        assert cut("day")[0] == "2024-03-10 00:00:00" and cut("week")[0] == "2024-03-04 00:00:00" and cut("quarter")[1] == "2024-10-01 00:00:00"
        assert cut("hour", "Asia/Tokyo")[0] == "2024-03-10 11:00:00" and cut("day", "America/New_York")[3] == "2024-03-09 00:00:00"
        assert cut("hour", "America/New_York")[0] == "2024-03-09 21:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_view_counts_for_the_datasource(spark):
    """Views that only filters, segments, join paths or cross references name."""
    a = "name: a\ntable: a\ndatasource: one\nentities: [{name: b, type: foreign, key: b}]\ndimensions: [{name: b, type: number, expr: b}, {name: far, type: number, expr: '{{b.x}}'}]\nmeasures: [{name: n, type: count}]"
    b = "name: b\ntable: b\ndatasource: two\nentities: [{name: b, type: primary, key: x}]\ndimensions: [{name: x, type: number, expr: x}]\nsegments: [{name: s, expr: x > 0}]"
    tables = {n: spark.createDataFrame([(1,)], f"{c} int") for n, c in (("a", "b"), ("b", "x"))}
    made = SemanticEngine(loader.layer([a, b]), spark, tables)
    assert made.query({"measures": ["a.n"]}).first()[0] == 1
    for more in ({"filters": [{"member": "b.x", "operator": "gt", "values": ["0"]}]}, {"segments": ["b.s"]}, {"dimensions": ["a.far"]}):
        with pytest.raises(PlanError, match="span"):
            made.query({"measures": ["a.n"]} | more)


def test_windows_in_chunks(spark, monkeypatch):
    """Numbers, frames, running sums and ranks by chunk against plain Python, with nulls and ties."""
    import random

    from quillon.operators import ordered

    monkeypatch.setattr(ordered, "CHUNK", 7)
    monkeypatch.setattr(ordered, "SPANS", 9)
    rng = random.Random(2)
    base = datetime(2024, 1, 1)
    data = [(None if rng.random() < 0.1 else base.replace(month=rng.randint(1, 12)), rng.choice(["a", "b", "é", None]), i, rng.choice([None, 1, 2, 2, 50, -3])) for i in range(100)]
    df = spark.createDataFrame(data, "t timestamp_ntz, k string, i int, m long")
    first = lambda x: (x is not None, x or "")
    want = sorted(data, key=lambda r: ((r[0] is not None, r[0] or base), first(r[1]), r[2]))
    for periods in (True, False):
        rows = ordered.numbered(df, "t", ("k", "i"), periods)
        assert [r.i for r in sorted(rows.collect(), key=lambda r: r[ordered.NUMBER])] == [r[2] for r in want]
        for before, after in ((0, 0), (3, 2), (20, 0), (0, 9)):
            made = ordered.Chunks.of(rows, before, after).rows
            frame = ordered.Chunks.window().rowsBetween(-before, after)
            got = {r.i: r.c for r in ordered.Chunks.finished(made.withColumn("c", ordered.F.collect_list("i").over(frame))).collect()}
            ids = [r[2] for r in want]
            assert got == {x: ids[max(0, n - before) : n + after + 1] for n, x in enumerate(ids)}
        total, sums = None, {}
        for r in want:
            total = r[3] if total is None else total + (r[3] or 0)
            sums[r[2]] = total
        assert {r.i: r.s for r in ordered.running_sum(rows, "m", "s").collect()} == sums
    for kind in ("long", "double"):
        got = ordered.ranked(df.withColumn("m", ordered.F.col("m").cast(kind)), "m", "r").collect()
        assert len(got) == 100 and all(r.r == 1 + sum(x[3] is not None and (r.m is None or x[3] > r.m) for x in data) for r in got)


@pytest.mark.parametrize("chunk", [3, 100_000])
def test_rolling_in_chunks(spark, monkeypatch, chunk):
    """Every kind of frame over two dimensions, chunk by chunk, as plain windows give it."""
    from quillon.operators import ordered

    monkeypatch.setattr(ordered, "CHUNK", chunk)
    made = queries.engine(spark, "/root/testdata/sf0.001")
    names = ["running_revenue", "revenue_3_rows", "average_3_rows", "urgent_running", "largest_around", "count_to_come"]
    q = {"dimensions": ["orders.order_priority"], "measures": [f"orders.{n}" for n in names], "time_dimensions": [{"dimension": "orders.ordered_at", "granularity": "year"}]}
    got = sorted((tuple(r) for r in made.query(q).collect()), key=lambda r: (r[1], r[0]))
    base = made.query(q | {"measures": ["orders.revenue", "orders.count", "orders.largest"]}).collect()
    rows = sorted((tuple(r) for r in base), key=lambda r: (r[1], r[0]))
    s, n, h = ([r[i] for r in rows] for i in (2, 3, 4))
    for i, r in enumerate(got):
        assert abs(r[2] - sum(s[: i + 1])) < 0.01 and abs(r[3] - sum(s[max(0, i - 2) : i + 1])) < 0.01
        assert abs(r[4] - sum(s[max(0, i - 2) : i + 1]) / sum(n[max(0, i - 2) : i + 1])) < 0.01
        assert r[6] == max(h[max(0, i - 1) : i + 2]) and r[7] == sum(n[i:])
        urgent = sum(x[2] for x in rows[: i + 1] if x[0] == "1-URGENT")
        assert abs(r[5] - urgent) < 0.01


def test_no_single_task_over_groups(spark):
    """Motifs over many groups deal their rows; only cells and totals meet in one task."""
    made = queries.engine(spark, "/root/testdata/sf0.001")
    q = {"measures": ["orders.count"], "dimensions": ["orders.customer_id"], "time_dimensions": [{"dimension": "orders.ordered_at", "granularity": "day"}]}
    for motif in ("trend", "dod", "moving_average", "cumulative", "rank", "contribution", "anomaly"):
        plan = made.explain(q | {"motif": motif}, "simple")
        for line in plan.splitlines():
            if "Window [" in line:
                assert "customer_id" not in line.split("], [")[-1] or "__chunk" in line or "__cell" in line, (motif, line)


def test_ping(spark):
    assert ping(spark, connect({"type": "spark"}))


def test_layer_errors(spark):
    with pytest.raises(SchemaError):
        SemanticEngine(loader.layer(["name: v"]), spark)
    a = "name: a\ntable: t\ndatasource: one\ndimensions: [{name: x, type: number, expr: x}]\nentities: [{name: e, key: x}]"
    b = a.replace("name: a", "name: b").replace("one", "two").replace("{name: e, key", "{name: e, type: foreign, key")
    with pytest.raises(PlanError):
        SemanticEngine(loader.layer([a, b]), spark).query({"dimensions": ["a.x", "b.x"]})


def test_api(engine, spark):
    from quillon import api

    made = api.compile(spark, [VIEW, COUNTRY], {"measures": ["parcels.n"]}, engine.tables)
    assert made["frame"].first()[0] == 10 and "HashAggregate" in made["plan"] and made["columns"][0]["alias"] == "parcels__n"
    assert api.validate([VIEW, COUNTRY]) == [] and api.validate(["name: v"]) and api.validate(["a: ["])
    assert len(api.catalog_list([COUNTRY])) == 7 + 12
