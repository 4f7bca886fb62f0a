"""Near-duplicates by shingles against the Jaccard similarity of all pairs."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from quillon.llm import overlap, simhash

SF = "/root/testdata/sf0.001"


def brute_groups(texts):
    """For each text the least index of its group."""
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if not a and not sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(sets))]


def edited(rng, base, vocabulary, n):
    copy = list(base)
    for _ in range(n):
        copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
    return copy


def texts():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    out = [None, "", " \n", "One", "one", "ONE two", "é É", "a b c d", "A b\tc\nd", "x y " * 200]
    line = rng.choices(vocabulary, k=30)
    for _ in range(40):  # chains of copies, and a line that many texts have
        base = rng.choices(vocabulary, k=rng.randint(5, 300))
        for _ in range(rng.randint(1, 5)):
            base = edited(rng, base, vocabulary, rng.randint(0, 8))
            out.append(" ".join(base if rng.random() < 0.5 else base + line))
    base = rng.choices(vocabulary, k=120)
    out += [" ".join(edited(rng, base, vocabulary, rng.randint(0, 5))) for _ in range(150)]
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"FREQUENT": 0},
        {"FREQUENT": 200_000, "PAIRS": 10},
        {"PAIR_ROOM": 10**9},  # sets are compared in place wherever two can be similar
        {"BLOCK": 20, "SAMPLE": 1, "PAIR_ROOM": 200},  # salted groups, blocks against blocks, both ways of comparing
        {"SHINGLES": 500, "TURNS": 2},
    ],
    ids=str,
)
def test_groups_equal_all_pairs(spark, monkeypatch, sizes):
    """Whatever the sizes that deal the work."""
    for name, value in sizes.items():
        monkeypatch.setattr(overlap, name, value)
    rows = [(i, t, "c") for i, t in enumerate(texts())]
    roots = brute_groups([r[1] for r in rows])
    docs = spark.createDataFrame(rows + rows[30:40], "doc_id long, text string, sid string")
    got = {r.doc_id: r.component_id for r in overlap.near_duplicates(docs.repartition(5)).collect()}
    assert got == dict(enumerate(roots))
    kept = simhash.without_similar(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.without_similar(docs).count() == 0


def test_stage_is_five_words_and_0_8(spark):
    """The stage of the pipeline on documents whose near copies differ in more bits than op1 links."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = {rows[i].doc_id for i in brute_groups([r.text for r in rows])}
    got = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == Counter(want) and 177 not in got


def test_chains_leave_similar_sets_in():
    """Pairs at 0.8 and above pass the chains; most pairs of unlike sets do not."""
    import numpy as np

    rng = np.random.default_rng(9)
    kept = lambda a, b: overlap._candidates(np.full(len(a), 9), np.zeros(len(a), np.int64), [np.array(w) for w in zip(*a)], *b)
    passed = []
    for n in (10, 20, 300):
        base = [rng.integers(-(2**63), 2**63 - 1, n) for _ in range(300)]
        near = [np.concatenate([b[: n - n // 10], rng.integers(-(2**63), 2**63 - 1, n // 10)]) for b in base]
        both = [overlap._fingerprint(s) for s in base + near]
        one = np.arange(300)
        assert len(kept(both, (one, one + 300))) == 300
        good = kept(both, (one[1:], one[:-1]))
        bits = [sum(((int(x) ^ int(y)) % 2**64).bit_count() for x, y in zip(both[i], both[i - 1])) for i in range(1, 300)]
        assert good.tolist() == [i for i in range(1, 300) if bits[i - 1] <= overlap.WITHIN]
        passed.append(len(good))
    assert passed[-1] == 0


def test_in_place_comparison_spans_what_all_pairs_link():
    """The forest of one unit connects its sets as all links do, sets of one label counted as connected."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(12)
    sets = []
    for _ in range(12):
        base = rng.integers(-(2**63), 2**63 - 1, rng.integers(1, 60))
        sets += [np.unique(np.where(rng.random(len(base)) < 0.08, rng.integers(-(2**63), 2**63 - 1, len(base)), base)) for _ in range(6)]
    labels = [i - i % 2 if i < 12 else i for i in range(len(sets))]
    got = overlap._spanning(pa.table({"sid": list(range(len(sets))), "label": labels, "grams": [s.tobytes() for s in sets]})).to_pylist()
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    same = list(zip(range(len(sets)), labels))

    def roots(edges):
        forest = simhash.Forest()
        for a, b in edges:
            forest.joins(a, b)
        return [forest.root(i) for i in range(len(sets))]

    assert {(r["a"], r["b"]) for r in got} <= set(links) and roots(same + links) == roots(same + [(r["a"], r["b"]) for r in got])
    assert 0 < len(got) < len(set(labels))
