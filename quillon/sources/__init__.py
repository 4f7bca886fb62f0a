"""Where rows come from: session tables, files, and databases over JDBC or Spark connectors."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Protocol
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from quillon.errors import SourceError
from quillon.plans import refs

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json"}


class Source(Protocol):
    """A connection."""

    def table(self, spark: SparkSession, name: str) -> DataFrame: ...

    def query(self, spark: SparkSession, sql: str) -> DataFrame: ...


def credential(config: Mapping[str, Any], key: str, default: str | None = None, required: bool = True) -> str | None:
    """A direct value, else the variable named by <key>_var, else the default. An empty text counts as unset."""
    if config.get(key) not in (None, ""):
        return str(config[key])
    if name := config.get(f"{key}_var"):
        if got := os.environ.get(name):
            return got
    if default is None and required:
        raise SourceError(f"'{key}' is not set (give {key} or {key}_var)")
    return default


class SessionSource:
    """Tables of the session's catalog."""

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.table(refs.table_name(name))

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return spark.sql(refs.backticked(sql))


@dataclass
class FileSource(SessionSource):
    """Every parquet, csv, json and jsonl file of one folder is a table named by its stem."""

    folder: str

    def register(self, spark: SparkSession) -> list[str]:
        base = Path(self.folder)
        if not base.is_dir():
            raise SourceError(f"'{self.folder}' is not a folder")
        names = []
        for file in sorted(base.iterdir()):
            if kind := FORMATS.get(file.suffix.lower()):
                reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
                reader.format(kind).load(str(file)).createOrReplaceTempView(refs.quoted(file.stem))
                names.append(file.stem)
        return names

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if not spark.catalog.tableExists(name):
            self.register(spark)
        return super().table(spark, name)

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        self.register(spark)
        return super().query(spark, sql)


@dataclass
class ConnectorSource:
    """A database that Spark reads by a format and options; scans are split where bounds are given."""

    format: str
    options: dict[str, str]
    table_option: str = "dbtable"
    query_option: str = "query"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.format(self.format).options(**self.options).option(self.table_option, name).load()

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return spark.read.format(self.format).options(**self.options).option(self.query_option, sql).load()

    def redacted(self) -> dict[str, str]:
        """Options without secrets, fit for messages."""
        hidden = re.compile("password|pwd|token|secret|credentials", re.I)
        return {k: "***" if hidden.search(k) else re.sub(r"((?:token|password)=)[^&;]+", r"\1***", v) for k, v in self.options.items()}


@dataclass
class EmbeddedSource:
    """A SQLite or DuckDB file that executors share, read in Python without a driver."""

    kind: str
    path: str

    def _load(self, spark: SparkSession, sql: str) -> DataFrame:
        from quillon.sources.embedded import EmbeddedDataSource

        spark.dataSource.register(EmbeddedDataSource)
        return spark.read.format(EmbeddedDataSource.name()).options(engine=self.kind, path=self.path, query=sql).load()

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        quoted = ".".join('"' + part.replace('"', '""') + '"' for part in name.split("."))
        return self._load(spark, f"SELECT * FROM {quoted}")

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return self._load(spark, sql)


def _jdbc(url: str, driver: str, c: Mapping[str, Any], user: bool = True, password_required: bool = False) -> ConnectorSource:
    options = {"url": url, "driver": driver, "fetchsize": str(c.get("fetchsize", 10_000))}
    if user:
        options["user"] = credential(c, "user", c.get("default_user"))
        if password := credential(c, "password", None, password_required):
            options["password"] = password
    for key in ("partitionColumn", "lowerBound", "upperBound", "numPartitions"):
        if key in c:
            options[key] = str(c[key])
    return ConnectorSource("jdbc", options)


def connect(config: Mapping[str, Any]) -> Source:
    """A source from one entry of `databases` in config.yml, by its `type`."""
    kind, c = config.get("type"), config
    host = lambda port: f"{credential(c, 'host', 'localhost')}:{credential(c, 'port', str(port))}"
    if kind in ("spark", "databricks_session"):
        return SessionSource()
    if kind in ("files", "duckdb") and c.get("file_search_path"):
        return FileSource(str(c["file_search_path"]))
    if kind in ("duckdb", "sqlite") and str(c.get("reader", "")) == "python":
        return EmbeddedSource(kind, credential(c, "path"))
    if kind == "duckdb":
        return _jdbc(f"jdbc:duckdb:{credential(c, 'path', '')}", "org.duckdb.DuckDBDriver", c, user=False)
    if kind == "motherduck":
        token = credential(c, "token")
        return _jdbc(f"jdbc:duckdb:md:{credential(c, 'database', '', False)}?motherduck_token={quote(token)}", "org.duckdb.DuckDBDriver", c, user=False)
    if kind == "sqlite":
        return _jdbc(f"jdbc:sqlite:{credential(c, 'path')}", "org.sqlite.JDBC", c, user=False)
    if kind == "postgres":
        return _jdbc(f"jdbc:postgresql://{host(5432)}/{credential(c, 'database')}", "org.postgresql.Driver", c)
    if kind == "redshift":
        return _jdbc(f"jdbc:redshift://{host(5439)}/{credential(c, 'database')}", "com.amazon.redshift.jdbc.Driver", c)
    if kind == "mysql":
        return _jdbc(f"jdbc:mysql://{host(3306)}/{credential(c, 'database')}", "com.mysql.cj.jdbc.Driver", c)
    if kind == "clickhouse":
        return _jdbc(f"jdbc:clickhouse://{host(8123)}/{credential(c, 'database', 'default')}", "com.clickhouse.jdbc.ClickHouseDriver", c)
    if kind in ("presto", "trino"):
        path = "/".join(filter(None, [credential(c, "catalog"), credential(c, "schema", None, False)]))
        return _jdbc(f"jdbc:trino://{host(8080)}/{path}", "io.trino.jdbc.TrinoDriver", c)
    if kind == "databricks":
        url = f"jdbc:databricks://{credential(c, 'host')}:443;httpPath=/sql/1.0/warehouses/{credential(c, 'warehouse_id')};AuthMech=3;UID=token"
        source = _jdbc(url, "com.databricks.client.jdbc.Driver", c, user=False)
        source.options["PWD"] = credential(c, "token")
        return source
    if kind == "snowflake":
        names = {"sfURL": f"{credential(c, 'account')}.snowflakecomputing.com", "sfUser": credential(c, "user"), "sfPassword": credential(c, "password")}
        more = {"sfRole": "role", "sfWarehouse": "warehouse", "sfDatabase": "database", "sfSchema": "schema"}
        names |= {k: v for k, x in more.items() if (v := credential(c, x, None, False))}
        return ConnectorSource("snowflake", names)
    if kind == "bigquery":
        options = {"parentProject": credential(c, "project"), "viewsEnabled": "true"}
        options |= {k: v for k, x in {"dataset": "dataset", "credentialsFile": "key_path"}.items() if (v := credential(c, x, None, False))}
        return ConnectorSource("bigquery", options, table_option="table")
    if kind == "domo":
        options = {"instance": credential(c, "instance"), "developer_token": credential(c, "developer_token"), "dataset_id": credential(c, "dataset_id")}
        return ConnectorSource("domo", options)
    raise SourceError(f"unknown database type '{kind}'")


class Connections:
    """The databases of a config.yml."""

    def __init__(self, config: Mapping[str, Any] | None) -> None:
        self.entries = {d["name"]: d for d in (config or {}).get("databases") or ()}

    def find(self, name: str | None = None) -> Source:
        """By name, or the first."""
        if name is None:
            if not self.entries:
                raise SourceError("no databases are configured")
            name = next(iter(self.entries))
        if name not in self.entries:
            raise SourceError(f"database '{name}' is not configured")
        return connect(self.entries[name])

    def all(self) -> dict[str, Source]:
        return {name: connect(entry) for name, entry in self.entries.items()}


def test_connection(spark: SparkSession, source: Source) -> bool:
    """Whether SELECT 1 comes back."""
    return source.query(spark, "SELECT 1 AS one").first()[0] == 1


test_connection.__test__ = False  # not a test, whatever its name
