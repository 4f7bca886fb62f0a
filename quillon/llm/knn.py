"""Exact top-k by inner product as a Voronoi join of queries and data.

The highest inner product is the least distance once every vector x gets one more component
sqrt(M^2 - |x|^2), M the largest norm, and every query is scaled to length M and gets a zero: a
query's own scale does not change its order. In that space queries and data are grouped by
their nearest pivot, and summaries take the place of the rows:

- data cells: number of rows and the k + 1 least distances from the pivot (of different ids);
- query cells: number, the least and greatest distance from each pivot, and the least distance
  from the plane half-way to each other pivot.

A group of query cells gets one bound from them, within which each of its queries has k
neighbours. A data row at distance d from pivot p is copied to a group only if the plane, and
the ring around p, can be reached within that bound. Groups are made as small as pays: the
summaries tell how many copies and comparisons each grouping costs. Both sides of a group are
dealt in blocks, and every unit of blocks is solved exactly in whole numbers.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.llm.common import ship_code, stored

SCALE = 1024
#: Pivots are the root of the number of vectors, up to what keeps a table of pivots by pivots at 8 MB.
MOST_PIVOTS = 1024
#: Rows of a block of data and of queries: one unit of work compares one with the other.
BLOCK, QUERIES = 4096, 1024
#: What one copied row costs beside one comparison; it steers the grouping, not the answer.
COPY_COST = 256
#: Relative slack of bounds for the rounding of distances.
SLACK = 1e-6
#: Quantiles of distances by cell that costs are reckoned from.
STEPS = 16
_log = logging.getLogger(__name__)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, whole numbers as doubles; rows with nulls or non-finite components go.

    A component beyond 2 ** 55 in size is an error, as its products would leave 128 bits.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & whole)
    limit = float(1 << 55)
    floored = lambda x: F.when(F.abs(x * float(scale)) < limit, F.floor(x * float(scale)).cast("double")).otherwise(
        F.raise_error(F.lit("a component of a vector is too large for exact scores")).cast("double")
    )
    return own.select("vec_id", F.transform("v", floored).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros, which changes no inner product."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


@dataclass
class Space:
    """Pivots in the space with one more component, and the largest norm."""

    points: np.ndarray
    top: float

    @property
    def dim(self) -> int:
        return self.points.shape[1] - 1

    def data(self, m: np.ndarray) -> np.ndarray:
        return np.column_stack([m, np.sqrt(np.maximum(self.top**2 - (m**2).sum(axis=1), 0))])

    def queries(self, m: np.ndarray) -> np.ndarray:
        norm = np.sqrt((m**2).sum(axis=1))
        return np.column_stack([m * np.divide(self.top, norm, out=np.zeros(len(m)), where=norm > 0)[:, None], np.zeros(len(m))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From every row to every pivot."""
        square = (x**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1) - 2 * (x @ self.points.T)
        return np.sqrt(np.maximum(square, 0))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 4096):
        yield batch.slice(at, 4096)


def _dealt(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """Each row's nearest pivot (ties: the first) and the distance to it, as data; its nearest pivot as a query."""
    for batch in batches:
        for part in _slices(batch):
            m = _matrix(part.column(1), space.dim)
            far = space.distances(space.data(m))
            cell = far.argmin(axis=1)
            own = np.where(part.column(2).to_numpy(zero_copy_only=False).astype(bool), space.distances(space.queries(m)).argmin(axis=1), -1)
            columns = [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(m)), cell]), pa.array(own.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["vec_id", "v", "cell", "dist", "query_cell"])


def _summaries(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """Of one task's queries, by cell: number, and by pivot the least and greatest distance and the least one from the half-way plane."""
    between = space.distances(space.points)
    found: dict[int, list] = {}
    for batch in batches:
        for part in _slices(batch):
            far, cells = space.distances(space.queries(_matrix(part.column(0), space.dim))), part.column(1).to_numpy()
            for c in np.unique(cells).tolist():
                mine = far[cells == c]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(between[c] > 0, (mine**2 - mine[:, [c]] ** 2) / (2 * between[c]), 0.0)
                new = [len(mine), mine.min(axis=0), mine.max(axis=0), plane.min(axis=0)]
                old = found.get(c)
                found[c] = [old[0] + new[0], np.minimum(old[1], new[1]), np.maximum(old[2], new[2]), np.minimum(old[3], new[3])] if old else new
    if found:
        columns = [pa.array([x[0] for x in found.values()], pa.int64()), *[pa.array([x[i] for x in found.values()], pa.list_(pa.float64())) for i in (1, 2, 3)]]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *columns], ["cell", "n", "low", "high", "plane"])


def _merged(table: pa.Table) -> pa.Table:
    cells, n = table.column("cell").to_numpy()[:1], table.column("n").to_numpy().sum(keepdims=True)
    ends = [f(np.array(table.column(c).to_pylist()), axis=0) for c, f in (("low", np.min), ("high", np.max), ("plane", np.min))]
    return pa.table([pa.array(cells), pa.array(n), *[pa.array([x], pa.list_(pa.float64())) for x in ends]], names=["cell", "n", "low", "high", "plane"])


@dataclass
class Plan:
    """Groups of query cells and which data they need: a row of `low`, `high` for each group, a column for each pivot.

    chunks and blocks: into how many blocks a group's queries and its data are dealt.
    """

    group_of: np.ndarray
    queries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    chunks: np.ndarray
    blocks: np.ndarray
    share: float = 1.0

    def needs(self, cell: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """For each group and row, whether the group needs the row."""
        return (self.low[:, cell] <= dist) & (dist <= self.high[:, cell])


def _chain(points: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cells in an order in which near pivots follow each other."""
    left, at, out = list(cells), 0, []
    while left:
        out.append(left.pop(at))
        if left:
            at = int(((points[left] - points[out[-1]]) ** 2).sum(axis=1).argmin())
    return np.array(out)


def grouped(space: Space, sizes: np.ndarray, nearest: list[np.ndarray], steps: np.ndarray, summaries: dict[int, tuple], k: int) -> Plan:
    """The cheapest of some groupings.

    sizes, nearest, steps: of each data cell its rows, its least distances, and quantiles of them;
    summaries: (n, low, high, plane) of each query cell.
    """
    cells = _chain(space.points, np.array(sorted(summaries)))
    n, low, high, plane = (np.array([summaries[c][i] for c in cells.tolist()]) for i in range(4))
    slack, best = SLACK * max(space.top, 1.0), None
    full = np.flatnonzero(sizes)
    cell_of, ring = np.repeat(full, [len(nearest[j]) for j in full]), np.concatenate([nearest[j] for j in full])
    place = np.concatenate([[0], np.cumsum(n)[:-1]])
    count = 1
    while True:
        group = np.unique(place * count // n.sum(), return_inverse=True)[1]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        g_low, g_high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        g_plane, g_n = np.minimum.reduceat(plane, first), np.add.reduceat(n, first)
        reach = g_high[:, cell_of] + ring
        bound = np.partition(reach, k, axis=1)[:, k] if reach.shape[1] > k else np.full(len(first), np.inf)
        bound = bound[:, None] + slack
        need = (g_plane <= bound) & (sizes > 0)
        near, far = np.where(need, g_low - bound, np.inf), np.where(need, g_high + bound, -np.inf)
        share = np.zeros(len(first))
        for j in full.tolist():
            share += sizes[j] * ((steps[j] >= near[:, [j]] - slack) & (steps[j] <= far[:, [j]] + slack)).mean(axis=1)
        cost = float((share * (-(-g_n // QUERIES) * COPY_COST + g_n)).sum())
        if best is None or cost < best[0]:
            group_of = np.full(len(sizes), -1)
            group_of[cells] = group
            scanned = float((share * g_n).sum() / (sizes.sum() * n.sum()))
            best = cost, Plan(group_of, g_n, near - slack, far + slack, -(-g_n // QUERIES), np.ones(len(first), np.int64), scanned)
        if count >= min(len(cells), MOST_PIVOTS):
            return best[1]
        count *= 2


def _counted(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows that each group needs, of one task."""
    total = np.zeros(len(plan.queries), np.int64)
    for batch in batches:
        for part in _slices(batch):
            total += plan.needs(part.column(0).to_numpy(), part.column(1).to_numpy()).sum(axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["grp", "n"])


def _hash(ids: np.ndarray, by: int) -> np.ndarray:
    """64 well mixed bits of each id."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(by * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _copies(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Data rows for the groups that need them, by block, and once for each block of the group's queries."""
    for batch in batches:
        for part in _slices(batch):
            ids = part.column(0).to_numpy()
            group, row = np.nonzero(plan.needs(part.column(2).to_numpy(), part.column(3).to_numpy()))
            times = plan.chunks[group]
            chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            group, row = np.repeat(group, times), np.repeat(row, times)
            block = _hash(ids[row], 1) % plan.blocks[group].astype(np.uint64)
            yield from _units(part, group, chunk, block, row)


def _asked(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Queries for every block of their group."""
    for batch in batches:
        for part in _slices(batch):
            group = plan.group_of[part.column(2).to_numpy()]
            chunk = _hash(part.column(0).to_numpy(), 2) % plan.chunks[group].astype(np.uint64)
            times = plan.blocks[group]
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row = np.repeat(np.arange(len(group)), times)
            yield from _units(part, group[row], chunk[row], block, row)


def _units(part: pa.RecordBatch, group: np.ndarray, chunk: np.ndarray, block: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(row), 16_384):
        here = slice(at, at + 16_384)
        take = pa.array(row[here])
        numbers = [pa.array(x[here].astype(np.int32)) for x in (group, chunk, block)]
        yield pa.RecordBatch.from_arrays([*numbers, part.column(0).take(take), part.column(1).take(take)], ["grp", "chunk", "block", "vec_id", "v"])


def scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every partial sum stays below 2 ** 53, else in whole numbers of any size."""
    if len(q) and len(m) and float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1] >= 2**53:
        whole = lambda x: np.array([list(map(int, r)) for r in x.tolist()], object).reshape(x.shape)
        return whole(q) @ whole(m).T
    return (q @ m.T).astype(np.int64)


def _solved(queries: pa.Table, data: pa.Table, dim: int, k: int) -> pa.Table:
    """The k best of one block of data for each query of one block."""
    kind = pa.decimal128(38, 0)
    if not queries.num_rows or not data.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind)], names=["query_id", "vec_id", "score"])
    ids = data.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], _matrix(data.column("v"), dim)[order]
    asked, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("v"), dim)
    out: list[tuple] = []
    for at in range(0, len(q), 256):
        got, who = scores(q[at : at + 256], m), asked[at : at + 256]
        own = who[:, None] == ids
        keep = min(k + int(own.sum(axis=1).max()), len(ids))
        if got.dtype == object:
            floor = np.array([sorted(r)[-keep] for r in got], object)
        else:
            floor = np.partition(got, len(ids) - keep, axis=1)[:, len(ids) - keep]
        row, column = np.nonzero((got >= floor[:, None]).astype(bool) & ~own)
        value = got[row, column]
        sort = sorted(range(len(row)), key=lambda i: (row[i], -value[i], column[i])) if got.dtype == object else np.lexsort((column, -value, row))
        row, column, value = row[sort], column[sort], value[sort]
        start = np.searchsorted(row, np.arange(len(who)))
        use = np.arange(len(row)) - start[row] < k
        out.append((who[row[use]], ids[column[use]], value[use]))
    query, vec, value = (np.concatenate(x) for x in zip(*out, strict=True))
    exact = pa.array(value.tolist(), kind) if value.dtype == object else pa.array(value).cast(pa.decimal128(19, 0)).cast(kind)
    return pa.table([pa.array(query), pa.array(vec), exact], names=["query_id", "vec_id", "score"])


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = SCALE, pivots: int | None = None, report: list[Plan] | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each query row.

    `is_query` is a condition on column `vec_id`. Candidates are all rows but those with the
    query's own id; ties go to the smaller id; with fewer than k candidates all are returned.
    Rows with a null id, a null vector, or a null or non-finite component take no part, and
    vectors of different lengths are compared over the shorter. A repeated id is a candidate as
    often as it occurs, and as a query answers once (with the first of its vectors). Empty tables
    give no rows; other columns are not read. Scores are exact; one that does not fit 64 bits is
    an error. `pivots` defaults to the root of the number of rows; `report` gets the plan, with
    the share of all comparisons that is made.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    own = quantised(vectors, id_col, vector_col, scale).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    own = stored(own, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows, dim, top = own.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not rows:
        return spark.createDataFrame([], schema)
    pivots = pivots or max(1, min(MOST_PIVOTS, int(rows**0.5)))
    # As many rows as there are pivots, by a hash of the id.
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").toArrow()
    space = Space(np.zeros((1, (dim or 1) + 1)), float(top or 0.0) ** 0.5)
    space.points = np.unique(space.data(_matrix(sample.column("v"), dim or 1)), axis=0)
    dealt = stored(own.mapInArrow(partial(_dealt, space=space), "vec_id long, v array<double>, cell int, dist double, query_cell int"), "cells")
    queries = dealt.where("query_cell >= 0").select("vec_id", "v", "query_cell")
    queries = stored(queries.groupBy("vec_id").agg(F.min(F.struct("v", "query_cell")).alias("r")).select("vec_id", "r.v", "r.query_cell"), "queries")

    # Summaries: a row for each pivot.
    p = len(space.points)
    sizes, nearest, steps = np.zeros(p, np.int64), [np.empty(0)] * p, np.zeros((p, STEPS + 1))
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("dist", [i / STEPS for i in range(STEPS + 1)], 1000).alias("q")).collect():
        sizes[r.cell], steps[r.cell] = r.n, r.q
    close = dealt.groupBy("cell", "vec_id").agg(F.max("dist").alias("dist"))
    close = close.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("dist"))).where(F.col("place") <= k + 1)
    for r in close.groupBy("cell").agg(F.collect_list("dist").alias("d")).collect():
        nearest[r.cell] = np.array(r.d)
    parts = queries.select("v", F.col("query_cell").alias("cell")).mapInArrow(partial(_summaries, space=space), (summary := "cell int, n long, low array<double>, high array<double>, plane array<double>"))
    summaries = {r.cell: (r.n, r.low, r.high, r.plane) for r in parts.groupBy("cell").applyInArrow(_merged, summary).collect()}
    if not summaries:
        return spark.createDataFrame([], schema)

    plan = grouped(space, sizes, nearest, steps, summaries, k)
    needed = dealt.select("cell", "dist").mapInArrow(partial(_counted, plan=plan), "grp int, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect()
    asked = np.zeros(len(plan.queries))
    for r in needed:
        plan.blocks[r.grp], asked[r.grp] = max(1, -(-r.n // (BLOCK - BLOCK // 8))), r.n
    plan.share = float((asked * plan.queries).sum() / (rows * plan.queries.sum()))
    _log.info("%d pivots, %d groups, %.4f of all comparisons", p, len(plan.queries), plan.share)
    if report is not None:
        report.append(plan)

    unit = "grp int, chunk int, block int, vec_id long, v array<double>"
    data = dealt.select("vec_id", "v", "cell", "dist").mapInArrow(partial(_copies, plan=plan), unit).groupBy("grp", "chunk", "block")
    asks = queries.mapInArrow(partial(_asked, plan=plan), unit).groupBy("grp", "chunk", "block")
    solve = partial(_solved, dim=space.dim, k=k)
    found = asks.cogroup(data).applyInArrow(lambda a, b: solve(a, b), "query_id long, vec_id long, score decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    fits = F.col("score").between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    score = F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))


def oracle(every: int, k: int = 10, scale: int = SCALE) -> str:
    """The same in DuckDB SQL over `embeddings`, for vectors of one length."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % {every} = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
