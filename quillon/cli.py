"""Command line: query, validate, inspect, bootstrap, test-connection."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

import yaml

from quillon import bootstrap, catalog, envelope, loader, profile, request, validate
from quillon.errors import QueryError, SemanticError
from quillon.sources import Connections, FileSource, test_connection


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    top.add_argument("--project", default=".")
    top.add_argument("--config")
    top.add_argument("--data", help="folder whose files are the tables")
    sub = top.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("-q", "--query", help="a request as JSON")
    q.add_argument("--saved")
    q.add_argument("-x", "--execute", action="store_true")
    for flag in ("--dimension", "--measure", "--filter", "--segment", "--order", "--through", "--motif-param"):
        q.add_argument(flag, action="append", default=[])
    q.add_argument("--limit", type=int)
    q.add_argument("--offset", type=int)
    q.add_argument("--motif")
    sub.add_parser("validate")
    i = sub.add_parser("inspect")
    i.add_argument("what", nargs="?", default="views", choices=["views", "motifs", "queries", "catalog", "schema"])
    i.add_argument("--profile")
    b = sub.add_parser("bootstrap")
    b.add_argument("--out", default=".")
    t = sub.add_parser("test-connection")
    t.add_argument("name", nargs="?")
    return top


def request_of(args: argparse.Namespace) -> request.QueryRequest:
    """JSON or flags, not both; a motif and its parameters may be added to JSON."""
    flags = any((args.dimension, args.measure, args.filter, args.segment, args.order, args.through, args.limit is not None, args.offset is not None))
    if args.query and flags:
        raise QueryError("give either -q or flags")
    base = request.parse(args.query) if args.query else request.QueryRequest(
        tuple(args.measure), tuple(args.dimension), tuple(args.segment), tuple(map(request.filter_flag, args.filter)), (),
        tuple(map(request.order_flag, args.order)), args.limit, args.offset, through=tuple(args.through),
    )
    more = {}
    if args.motif:
        more["motif"] = args.motif
    if args.motif_param:
        more["motif_params"] = base.motif_params | dict(map(request.motif_param_flag, args.motif_param))
    return request.QueryRequest(**{**base.__dict__, **more})


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    show = lambda x: print(json.dumps(x, indent=2, default=str, ensure_ascii=False))
    try:
        root = loader.find_project(args.project) or Path(args.project)
        path = Path(args.config) if args.config else root / "config.yml"
        connections = Connections(yaml.safe_load(path.read_text()) if path.exists() else None)
        if args.command == "test-connection":
            print("ok" if test_connection(spark or _spark(), connections.find(args.name)) else "failed")
            return 0
        if args.command == "bootstrap":
            spark = spark or _spark()
            names = FileSource(args.data).register(spark) if args.data else [t.name for t in spark.catalog.listTables()]
            show([str(p) for p in bootstrap.write(args.out, {n: spark.table(f"`{n}`") for n in names})])
            return 0
        layer = loader.project(args.project)
        if args.command == "validate":
            found = validate.problems(layer)
            for line in found + [f"warning: {w}" for w in validate.warnings(layer)]:
                print(line, file=sys.stderr)
            print("invalid" if found else "valid")
            return int(bool(found))
        if args.command == "inspect" and not args.profile and args.what != "schema":
            show({
                "views": lambda: [catalog.inspect_view(v) for v in layer.views], "motifs": lambda: catalog.inspect_motifs(layer),
                "queries": lambda: catalog.inspect_queries(layer), "catalog": lambda: catalog.entries(layer),
            }[args.what]())
            return 0
        from quillon.engine import SemanticEngine

        spark = spark or _spark()
        if args.data:
            FileSource(args.data).register(spark)
        if args.command == "inspect" and args.what == "schema":
            from quillon.sources import introspect

            show({str(k): [{"table": t.name, "columns": [c.__dict__ for c in t.columns]} for t in v] for k, v in introspect.schema(spark).items()})
            return 0
        engine = SemanticEngine(layer, spark, sources={} if args.data else connections.all())
        if args.command == "inspect":
            show(profile.profile(engine, args.profile))
            return 0
        if args.saved:
            show(envelope.saved(engine, args.saved))
            return 0
        q = request_of(args)
        if not args.execute:
            print(engine.explain(q))
            return 0
        out = envelope.run(engine, q)
        show(out)
        return int(out["status"] != "success")
    except SemanticError as e:
        show(envelope.failure(e))
        return 1


if __name__ == "__main__":
    sys.exit(main())
