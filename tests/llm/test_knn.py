"""Exact search against brute force."""

import math

import numpy as np
import pytest

from quillon.llm import knn

F = knn.F


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(1024 * float(np.float32(x))) for x in v])
    out = set()
    for q in (i for i in good if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q][0], v)), i) for i, vs in good.items() if i != q for v in vs)
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])}
    return out


def vectors(n, dim, rng, groups=5, spread=0.2):
    centres = rng.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + spread * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def run(spark, rows, every=10, k=5, **options):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, cell string")
    got = knn.top_k(df, F.col("vec_id") % every == 0, k=k, **options).collect()
    out = {(r.query_id, r["rank"], r.vec_id, r.score) for r in got}
    assert len(out) == len(got)
    return out


ODD = [(2000, None), (2010, [None] * 8), (2020, [float("nan")] * 8), (2030, [float("inf")] + [0.0] * 7), (2040, [0.0] * 8), (None, [1.0] * 8)]


@pytest.mark.parametrize(("block", "queries", "copy", "pivots"), [(4096, 1024, 256, None), (20, 7, 256, 16), (20, 1024, 0, 40), (4096, 3, 0, 1)])
def test_top_k(spark, monkeypatch, block, queries, copy, pivots):
    """Whatever the sizes of blocks, the number of pivots and the grouping."""
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "QUERIES", queries)
    monkeypatch.setattr(knn, "COPY_COST", copy)
    rows = vectors(300, 8, np.random.default_rng(1))
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + ODD  # a hot vector, all ties
    assert run(spark, rows, pivots=pivots) == brute(rows, 10, 5)


def test_bounds_leave_comparisons_out(spark, monkeypatch):
    """On vectors in clusters most of the comparisons are never made, and no unit outgrows its blocks."""
    monkeypatch.setattr(knn, "BLOCK", 64)
    monkeypatch.setattr(knn, "QUERIES", 16)
    monkeypatch.setattr(knn, "COPY_COST", 4)
    rows = vectors(2000, 16, np.random.default_rng(4), groups=17, spread=0.02)
    report = []
    assert run(spark, rows, every=20, report=report) == brute(rows, 20, 5)
    assert report[0].share < 0.5 and len(report[0].queries) > 1
    plan = report[0]
    assert (plan.blocks > 1).any() and (plan.chunks * 16 >= plan.queries).all()


def test_fewer_than_k_and_empty(spark):
    rows = vectors(4, 3, np.random.default_rng(2))
    assert run(spark, rows, every=2, k=10) == brute(rows, 2, 10)
    assert run(spark, [(0, [1.0])]) == set()
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == set()
    assert run(spark, []) == set()


def test_repeated_ids(spark):
    """Rows with a query's id are no candidates of it, however many; others count as often as they occur."""
    rng = np.random.default_rng(5)
    rows = vectors(40, 4, rng, groups=3)
    rows += [(10, rows[10][1])] * 30 + [(7, rows[7][1])] * 12
    assert run(spark, rows, pivots=5) == {(q, r, v, s) for q, r, v, s in run(spark, rows, pivots=1)}
    got = sorted(run(spark, rows, pivots=9))
    assert all(q != v for q, _, v, _ in got)
    scored = sorted(((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(rows[20][1], v)), i) for i, v in rows if i != 20))[:5]
    assert [(v, s) for q, _, v, s in got if q == 20] == [(i, -s) for s, i in scored]


def test_lengths_and_large_values(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, [1.0, 1.0, 1.0]), (3, []), (10, [1e6, -1e6, 1e6])]
    assert run(spark, rows) == brute(rows, 10, 5)


def test_scores_beyond_doubles_and_longs(spark):
    """Products beyond 2 ** 53 are exact; a score that leaves 64 bits, or a component that cannot be exact, is an error."""
    rng = np.random.default_rng(6)
    rows = [(i, (1500.0 * (1 << 14) * rng.uniform(0.9, 1, 32)).astype(np.float32).tolist()) for i in range(40)]
    want = brute(rows, 10, 5)
    if max(s for *_, s in want) < 2**63:
        assert run(spark, rows) == want
    small = [(i, (60000.0 * rng.uniform(0.9, 1, 32)).astype(np.float32).tolist()) for i in range(40)]
    want = brute(small, 10, 5)
    assert 2**53 < max(s for *_, s in want) < 2**63 and run(spark, small) == want
    for bad in ([1e30] * 3, [float(1 << 34)] * 3):
        with pytest.raises(Exception, match="does not fit 64 bits|too large"):
            run(spark, [(0, bad), (1, bad), (2, [1.0] * 3)])
