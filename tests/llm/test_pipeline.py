"""The pipeline, stage by stage and as a whole, against plain Python over the same rows."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline
from quillon.llm import mixing, pii, queries, toxicity
from quillon.llm.tokenize import encoder
from test_mixing import waterfill
from test_overlap import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of documents, and of each stage on its predecessor's rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], SF), "test-stage"))
    return out


def test_columns(stages):
    for rows in stages[1:-1]:
        assert rows.columns == stages[0].columns and [f.dataType for f in rows.schema] == [f.dataType for f in stages[0].schema]


def test_toxicity_stage(spark, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet").where(queries.toxicity_training()))
    want = {r.doc_id for r in stages[0].collect() if model.score(r.text) < 0.5}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_near_duplicate_stage(stages):
    before = sorted(stages[1].select("doc_id", "text").collect())
    want = {before[i].doc_id for i in brute_groups([r.text for r in before])}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(want)


def test_personal_data_stage(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    assert all(r.n_chars == len(r.text) for r in after.values())
    changed = [d for d in before if before[d] != after[d].text]
    assert changed and all(any(c.isdigit() or c == "@" for c in before[d]) for d in changed)


def test_mixing_stage(stages):
    sizes = Counter()
    for r in stages[3].collect():
        sizes[r.source] += len(r.text.split())
    want, got = waterfill(dict(sizes)), Counter()
    copies = Counter()
    for r in stages[4].collect():
        got[r.source] += len(r.text.split())
        copies[r.doc_id] += 1
    assert max(copies.values()) <= mixing.LIMIT
    for s, t in want.items():
        largest = max(len(r.text.split()) for r in stages[3].collect() if r.source == s)
        assert abs(got[s] - t) <= largest


def test_packing_stage(stages):
    enc = encoder(queries.word_bpe())
    want = Counter((r.doc_id, len(enc.ids([r.text])[0]) // 4 + 1) for r in stages[4].collect())
    rows = stages[5].collect()
    assert sum(r.length for r in rows) == sum(n * c for (_, n), c in want.items())
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096
    assert len(fill) <= -(-sum(fill.values()) // 4096) + 2


def test_run(spark, stages):
    count = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert count(corpus_pipeline.run(spark, SF)) == count(stages[-1])
    assert pii.pseudonymised(stages[3], "k").count() == stages[3].count()


ODD = [
    (1, "plain words " * 30, "en", "a", 360), (1, "plain words " * 30, "en", "a", 360), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id 4845168114407329", "en", "a", 20),
    (None, None, None, None, None), (4, "mail jan.doe@mail.example.com " + "é " * 20, "fr", None, 5), (5, "w " * 60_000, "xx", "long", 120_000), (6, "x" * 300_000, "xx", "long", 300_000),
    (7, "tie one two three four", "en", "a", 1), (8, "tie one two three four", "en", "a", 1), (9, "\n\n \t", "en", "a", 4),
]
CLASHES = ["score", "size", "copies", "taken", "fp", "key", "part", "u", "q", "target", "rank", "length", "toxic", "words", "label", "first"]


@pytest.mark.parametrize("rows", [ODD, []])
@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, tmp_path, rows, labelled):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables: stages run and keep their columns."""
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(1, 1, 0), (3, None, None), (4, 1, 1), (None, 0, 1), (99, 0, 1)] if labelled else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = plain
    for name in CLASHES:
        docs = docs.withColumn(name, corpus_pipeline.F.lit("mine"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == columns, name
        assert all(r[c] == "mine" for r in docs.select(*CLASHES).collect() for c in CLASHES)
        if name == "near_duplicates" and rows:
            kept = {(r.doc_id, r.text) for r in docs.collect()}
            assert (1, "plain words " * 30) in kept and (8, "tie one two three four") not in kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert bool(packed) == bool(rows)
    assert "4845168114407329" not in "".join(r.text or "" for r in docs.collect())
