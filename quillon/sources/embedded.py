"""A Python data source over SQLite and DuckDB files."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

ROWS = 10_000


def _sqlite(path: str, sql: str) -> Iterator[pa.RecordBatch]:
    """Batches of one type: each column has the widest of SQLite's storage classes that occurs in it."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        kinds = [{k for (k,) in con.execute(f"SELECT DISTINCT typeof({_quoted(n)}) FROM ({sql})")} - {"null"} for n in names]
        types = [pa.int64() if k == {"integer"} else pa.float64() if k and k <= {"integer", "real"} else pa.binary() if k == {"blob"} else pa.string() for k in kinds]
        schema = pa.schema(list(zip(names, types, strict=True)))
        while True:
            rows = cursor.fetchmany(ROWS)
            columns = [pa.array([_cell(r[i], t) for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            if len(rows) < ROWS:
                return


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _cell(value: Any, kind: pa.DataType) -> Any:
    if value is None or not pa.types.is_string(kind):
        return value
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def _duckdb(path: str, sql: str) -> Iterator[pa.RecordBatch]:
    import duckdb

    with duckdb.connect(path, read_only=True) as con:
        reader = con.execute(sql).to_arrow_reader(ROWS)
        empty = True
        for batch in reader:
            empty = False
            yield batch
        if empty:
            yield pa.RecordBatch.from_pylist([], schema=reader.schema)


def batches(engine: str, path: str, sql: str) -> Iterator[pa.RecordBatch]:
    return {"sqlite": _sqlite, "duckdb": _duckdb}[engine](path, sql)


class EmbeddedDataSource(DataSource):
    """Options: engine (sqlite or duckdb), path, query. One query of one file is one partition."""

    @classmethod
    def name(cls) -> str:
        return "quillon_embedded"

    def schema(self):
        return from_arrow_schema(next(batches(self.options["engine"], self.options["path"], self.options["query"])).schema)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from batches(self.options["engine"], self.options["path"], self.options["query"])
