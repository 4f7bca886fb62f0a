"""Physical schemas: databases, tables, columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    nullable: bool


@dataclass(frozen=True)
class TableInfo:
    database: str | None
    name: str
    columns: tuple[ColumnInfo, ...]


def of_frame(name: str, df: DataFrame, database: str | None = None) -> TableInfo:
    return TableInfo(database, name, tuple(ColumnInfo(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema))


def databases(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())


def schema(spark: SparkSession, only: str | None = None) -> dict[str | None, list[TableInfo]]:
    """Tables by database (None: temporary views), in order of name."""
    out: dict[str | None, list[TableInfo]] = {}
    names = [only] if only else databases(spark)
    for database in names:
        for t in spark.catalog.listTables(database):
            home = None if t.isTemporary else database
            full = f"`{t.name}`" if t.isTemporary else f"`{database}`.`{t.name}`"
            out.setdefault(home, []).append(of_frame(t.name, spark.table(full), home))
    return {k: sorted({t.name: t for t in v}.values(), key=lambda t: t.name) for k, v in sorted(out.items(), key=lambda x: x[0] or "")}


def semantic_type(data_type: T.DataType) -> str:
    """The dimension type for a column's type."""
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.TimestampType | T.TimestampNTZType):
        return "datetime"
    return "boolean" if isinstance(data_type, T.BooleanType) else "string"
