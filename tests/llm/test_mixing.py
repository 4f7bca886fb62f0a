"""Mixing against a direct computation, and the edges."""

import math

import pytest

from quillon.llm import mixing


def waterfill(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Targets by rounds of stopping and resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free = {}, set(order)
    left = share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        stop = [s for s in free if w[s] * level > limit * sizes[s]]
        if not stop:
            return target | {s: w[s] * level for s in free}
        for s in stop:
            target[s] = float(limit * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def corpus():
    rows, n = [], 0
    for source, count in (("b", 400), ("a", 30), (None, 60), ("d", 5), ("é", 200), ("c", 1), ("empty", 3)):
        for i in range(count):
            words = 0 if source == "empty" else 1 + (n * 7919) % (300 if i % 50 else 3000)
            rows.append((n, " ".join(["w"] * words), source, "clash", 1))
            n += 1
    return [*rows, (n, None, "a", "x", 2), (None, "no id here", "a", "x", 2), rows[3]]


@pytest.fixture(params=[4, 23])
def ranges(spark, request):
    """How many ranges the order is dealt by, which must not matter."""
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mix(spark, ranges):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = waterfill(sizes)
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))
    source_of = {r[0]: r[2] for r in rows}
    taken, smallest = {}, {}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s])
        assert r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.01 * t) or s in ("c", "d"), (s, taken[s], t)
        docs_of = [len((r[1] or "").split()) for r in rows if r[2] == s]
        assert abs(taken[s] - t) <= max(docs_of)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_whole_copies_and_columns(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string, size string, target int")
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in rows.collect())
    taken = mixing.mix(docs.dropDuplicates(["doc_id", "text"])).agg({"taken": "sum"}).first()[0]
    assert abs(words - taken) < 0.02 * taken


def test_odds_of_inclusion_decide(spark):
    """A plain random order would take other documents, and longer documents are taken more often."""
    import random

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.choice([4, 400])), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sql = mixing.oracle().replace("(u / (1 - u)) / (p / (1 - p))", "u")
    other = {r[0]: r[4] for r in by_sql(docs, sql)}
    assert sum(other[r.doc_id] != r.taken for r in got) > 50
    sampled = [r for r in got if r.target < r.source_size]
    share = lambda size: sum(r.copies for r in sampled if r.size == size) / sum(r.size == size for r in sampled)
    assert share(400) > 2 * share(4) > 0


def by_sql(documents, sql):
    import duckdb

    con = duckdb.connect()
    table = documents.toArrow()
    con.register("documents", table)
    return con.execute(sql).fetchall()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0
    nothing = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(nothing).collect()] == [(0, 0.0), (0, 0.0)]


def test_registered_sql_holds_for_hot_sources(spark, ranges):
    """The same documents as the SQL takes, whatever the number of documents of a source and of ranges."""
    import random

    for seed, count in ((0, 9000), (1, 700), (2, 40)):
        rng = random.Random(seed)
        rows = [(i, " ".join(["w"] * min(3000, int(rng.paretovariate(0.8) * 20))), "cab"[(i % 4) % 3]) for i in range(count)]
        rows += [(None, "no id at all " * n, "a") for n in range(1, 20)]
        documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        got = sorted(((r.doc_id, r.size, r.taken) for r in mixing.mix(documents).collect()), key=key)
        assert got == sorted(((r[0], r[1], r[4]) for r in by_sql(documents, mixing.oracle())), key=key)
