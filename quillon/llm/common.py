"""Helpers shared by the corpus operators: shared storage and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Words are runs of anything but ASCII white space; bytes.split() cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a key that one task may join, and the most keys that can have more (their list is broadcast).
HOT, MOST_HOT = 1000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent in local mode (tests) a folder of this machine is
    created and set as the checkpoint folder; a cluster without it is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        own = spark.sparkContext.getCheckpointDir()
        if not own and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = own or f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at the end, but for those stored to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends here, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table made by stored(), when nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file.rpartition("/")[0])


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores before it until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def running(df: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """`df` with running sums in an order that tells all rows apart; `sums` maps new names to columns.

    Rows are dealt to tasks by ranges of the order and written; one task adds up a row for
    each range, never the rows themselves.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)
    ends = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    out = own.join(F.broadcast(ends), "__range")  # a row for each range
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *[f"__{n}" for n in sums])


def hot_join(many: DataFrame, one: DataFrame, key: str, tell: str, how: str = "inner") -> DataFrame:
    """`many` joined with `one`, which has each `key` once; keys with very many rows go to several tasks.

    `tell` is a column of `many` whose values differ among the rows of a hot key. The list of hot
    keys is broadcast: its length is MOST_HOT at most, since a key counts as hot above a share of the rows.
    """
    counts = many.groupBy(key).agg(F.count("*").alias("__n"))
    total = many.count()
    limit = max(HOT, total // MOST_HOT)
    if total <= limit:
        return many.join(one, key, how)
    heavy = stored(counts.where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")), "hot")
    if heavy.isEmpty():
        return many.join(one, key, how)
    heavy = F.broadcast(heavy)
    left = many.join(heavy, key, "left").withColumn("__salt", F.pmod(F.xxhash64(tell), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    right = one.join(heavy, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, where what is made of a text is larger than the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ship_code(spark: SparkSession) -> None:
    """Lets Python workers import this package where their path does not hold it yet."""
    package = Path(__file__).resolve().parents[1]
    root = str(package.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root:
        return
    sc = spark.sparkContext
    if getattr(sc, "_quillon_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quillon-code-")) / "quillon.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in package.rglob("*.py"):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._quillon_shipped = True
