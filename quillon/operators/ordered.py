"""Windows over all rows of a result in one order, without one task for all of them.

Rows are numbered first: cells that follow the order (a period and a range of the first other
column, or a span of time) are numbered by themselves, and only a row for each cell meets in one task.
Then rows go to chunks of equal size, each with as many rows of its neighbours as a frame reaches, and
windows run inside chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

#: Rows of a chunk, and cells that a span of times or of another column is cut into.
CHUNK, SPANS, PARTS = 100_000, 1024, 64
#: HOME: 0 for rows of the chunk itself, above for copies from chunks before, below for copies from chunks after.
NUMBER, CELL, HOME, AT = "__number", "__cell", "__home", "__chunk"


def _seconds(time: Column) -> Column:
    """Whole seconds of a date or time, whatever the session's zone."""
    t = time.cast("timestamp_ntz")
    return F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("double") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def _code(df: DataFrame, column: str) -> Column | None:
    """A number that never falls where the column rises."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    if isinstance(kind, T.StringType):
        return F.when(F.col(column).isNotNull(), F.least(F.ascii(F.substring(column, 1, 1)), F.lit(255)).cast("double"))
    return _seconds(F.col(column)) if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else None


def _spans(df: DataFrame, code: Column, n: int, name: str) -> DataFrame:
    """`df` with the span of `code`, of n equal ones between its ends; none for nulls, which come first."""
    ends = df.agg(F.min(code).alias("__low"), F.max(code).alias("__high"))  # one row
    df = df.crossJoin(F.broadcast(ends))
    width = F.when(F.col("__high") > F.col("__low"), F.col("__high") - F.col("__low")).otherwise(1.0)
    span = F.when(F.isnan(code) | code.isNull(), F.when(code.isNull(), -1).otherwise(n)).otherwise(F.floor((code - F.col("__low")) / width * (n - 1)))
    return df.withColumn(name, span.cast("int")).drop("__low", "__high")


def numbered(df: DataFrame, time: str, ties: tuple[str, ...], periods: bool) -> DataFrame:
    """`df` with NUMBER, from 1 on, in order of `time` and then `ties`, nulls first.

    periods: times are those of a calendar (days or longer), so few that each can be a cell of its own.
    """
    order = [F.col(c).asc_nulls_first() for c in (time, *ties)]
    code = _code(df, ties[0]) if periods and ties else None
    if periods:
        df = _spans(df, code, PARTS, "__part") if code is not None else df.withColumn("__part", F.lit(0))
        df = df.withColumn(CELL, F.struct(F.col(time).isNotNull().alias("known"), F.col(time).alias("time"), F.col("__part").alias("part"))).drop("__part")
    else:
        df = _spans(df, _seconds(F.col(time)), SPANS, CELL)
    cells = df.groupBy(CELL).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col(CELL).alias("__of"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(CELL).orderBy(*order))
    joined = df.withColumn(NUMBER, place).join(cells, F.col(CELL).eqNullSafe(F.col("__of")))
    return joined.withColumn(NUMBER, F.col(NUMBER) + F.col("__before")).drop(CELL, "__of", "__before")


@dataclass(frozen=True)
class Chunks:
    """Rows by chunk, with copies of rows that a neighbour's frames reach."""

    rows: DataFrame

    @staticmethod
    def of(numbered_rows: DataFrame, before: int, after: int = 0) -> Chunks:
        place, chunk = (F.col(NUMBER) - 1) % CHUNK, F.floor((F.col(NUMBER) - 1) / CHUNK)
        back, on = -(-after // CHUNK), -(-before // CHUNK)
        homes = [F.lit(0)]
        homes += [F.when(place >= i * CHUNK - before, F.lit(i)) for i in range(1, on + 1)]
        homes += [F.when(place < after - (i - 1) * CHUNK, F.lit(-i)) for i in range(1, back + 1)]
        rows = numbered_rows.withColumn(HOME, F.explode(F.filter(F.array(*homes), lambda x: x.isNotNull())))
        return Chunks(rows.withColumn(AT, chunk + F.col(HOME)))

    @staticmethod
    def window() -> WindowSpec:
        return Window.partitionBy(AT).orderBy(NUMBER)

    @staticmethod
    def finished(rows: DataFrame) -> DataFrame:
        return rows.where(F.col(HOME) == 0).drop(HOME, AT, NUMBER)


def running_sum(numbered_rows: DataFrame, column: str, name: str) -> DataFrame:
    """The sum of a column from the first row to each; null until the first value."""
    chunk = F.floor((F.col(NUMBER) - 1) / CHUNK)
    rows = numbered_rows.withColumn(AT, chunk)
    sums = rows.groupBy(AT).agg(F.sum(column).alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy(AT).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(AT).alias("__of"), before.alias("__sum"))
    rows = rows.withColumn(name, F.sum(column).over(Chunks.window().rowsBetween(Window.unboundedPreceding, 0))).join(sums, F.col(AT) == F.col("__of"))
    total = F.coalesce(F.col(name) + F.col("__sum"), name, "__sum")
    return rows.withColumn(name, total).drop(AT, NUMBER, "__of", "__sum")


def ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """1 and the number of rows with a higher value; nulls last.

    Whole numbers and decimals tie often: equal values are one row until the end. Sums of doubles
    rarely tie, and may differ in their last bit when computed again, so their rows are never joined by value.
    """
    if isinstance(df.schema[column].dataType, T.FractionalType) and not isinstance(df.schema[column].dataType, T.DecimalType):
        rows = _high_to_low(df.withColumn("__rows", F.lit(1)), column)
        inside = F.rank().over(Window.partitionBy(CELL).orderBy(F.col(column).desc_nulls_last()))
        return rows.withColumn(name, (inside + F.col("__above")).cast("long")).drop("__rows", "__above", CELL)
    values = _high_to_low(df.groupBy(column).agg(F.count("*").alias("__rows")), column)
    inside = Window.partitionBy(CELL).orderBy(F.col(column).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("__rows").over(inside), F.lit(0)) + F.col("__above") + 1
    values = values.select(F.col(column).alias("__value"), rank.cast("long").alias(name))
    return df.join(values, F.col(column).eqNullSafe(F.col("__value"))).drop("__value")


def _high_to_low(df: DataFrame, column: str) -> DataFrame:
    """`df` (with __rows) with the CELL of its value and __above, the rows in higher cells."""
    x = F.col(column).cast("double")
    scaled = F.when(x.isNull() | F.isnan(x), x).otherwise(F.signum(x) * F.log1p(F.abs(x)))  # spreads values of all sizes
    df = _spans(df, scaled, SPANS, CELL)
    cells = df.groupBy(CELL).agg(F.sum("__rows").alias("__all"))
    above = F.coalesce(F.sum("__all").over(Window.orderBy(F.col(CELL).desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col(CELL).alias("__of"), above.alias("__above"))
    return df.join(cells, F.col(CELL) == F.col("__of")).drop("__of")


def with_totals(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """`df` with aggregates over all its rows, from one row that every task gets."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])))
