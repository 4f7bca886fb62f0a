"""Near-duplicates against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quillon.llm import simhash
from quillon.llm.graph import components


def brute_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = sorted(up)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                up[root(b)] = root(a)
    return {f: root(f) for f in fps}


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    out = [None, "", "  \n", "One", "one", "ONE two", "é É", "a b c d", "A b\tc\nd", "x y " * 200]
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randint(5, 300))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_fingerprint():
    for t in texts():
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_near_duplicates(spark):
    rows = [(i * 3 % 97 + i, t, "c") for i, t in enumerate(texts())]
    rows += [rows[20], (None, "no id at all", "c"), (None, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots, least = brute_components(fps), {}
    for row, fp in zip(rows, fps):
        if row[0] is not None:
            least[roots[fp]] = min(least.get(roots[fp], row[0]), row[0])
    want = Counter((r[0], f"{fp:016x}", least.get(roots[fp])) for r, fp in zip(rows, fps))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({roots[fp] for fp in fps})


def test_near_duplicates_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.without_near_duplicates(docs).count() == 0


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_links_connect_as_all_pairs(spark, monkeypatch, segments):
    """Dense balls of fingerprints, buckets cut into blocks, and every cut of the ring."""
    monkeypatch.setattr(simhash, "plan", lambda nodes, distance: segments)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = np.random.default_rng(6)
    fps = []
    for _ in range(8):
        centre = int(rng.integers(0, 2**63))
        for _ in range(40 if segments == 2 else 150):
            x = centre
            for b in rng.choice(64, rng.integers(0, 8), replace=False).tolist():
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    got = {r.node % 2**64: r.label for r in components(simhash.fingerprint_links(nodes), "a", "b").collect()}
    want = brute_components(fps)
    groups, labels = {}, {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
        labels.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, labels.values()))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (None, 4), (1001, 1000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(301)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("segments", [2, 3, 4])
@pytest.mark.parametrize("large", [5, 256, 10**9])
def test_every_unit_tries_chains(monkeypatch, segments, large):
    """Small and large comparison units find the same components, and both by chains alone."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "LARGE", large)
    tried = []
    chain_ok = simhash._chain_ok
    monkeypatch.setattr(simhash, "_chain_ok", lambda x, *rest: tried.append(len(x)) or chain_ok(x, *rest))
    rng = np.random.default_rng(7)
    centre, fps = int(rng.integers(0, 2**63)), set()
    while len(fps) < (700 if segments > 2 else 120):
        x = centre
        for b in rng.choice(24, rng.integers(0, 9), replace=False).tolist():
            x ^= 1 << b
        fps.add(x)
    nodes = np.array(sorted(fps), np.uint64)
    (*keys,) = simhash._keys(iter([pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64))], ["fp"])]), segments, 4)
    table = pa.Table.from_batches(keys)
    table = table.append_column("unit", pa.array(np.zeros(table.num_rows, np.int32))).select(["key", "unit", "fp"]).sort_by("key")
    up = simhash.Forest()
    for batch in simhash._links(iter(table.combine_chunks().to_batches(max_chunksize=5000)), segments, 4):
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            assert ((a ^ b) % 2**64).bit_count() <= 4
            up.joins(a % 2**64, b % 2**64)
    want, got = brute_components(sorted(fps)), {f: up.root(f) for f in fps}

    def groups(of):
        out = {}
        for f in sorted(fps):
            out.setdefault(of[f], []).append(f)
        return sorted(out.values())

    assert groups(got) == groups(want) and tried


def test_long_text_and_no_distance(spark):
    long = "w1 w2 w3 w4 w5 w6 w7 " * 40_000
    docs = spark.createDataFrame([(1, long), (2, long + "end"), (3, "short one"), (4, "short one")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, distance=0).collect()}
    assert got[3] == got[4] == 3


def test_hot_component_and_fingerprint(spark, monkeypatch):
    """Keys of many rows are dealt to several tasks and answer as before."""
    from quillon.llm import common

    monkeypatch.setattr(common, "HOT", 7)
    rows = [(i, "the same text again") for i in range(60)] + [(100 + i, None) for i in range(40)] + [(200 + i, f"other {i} words of its own") for i in range(10)] + [(None, "the same text again")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == (0 if r.doc_id is None or r.doc_id < 60 else 100) for r in got if r.doc_id is None or r.doc_id < 200)
