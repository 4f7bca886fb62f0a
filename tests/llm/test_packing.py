"""Packing and token-id files against brute force."""

import random
import subprocess
import sys
import tracemalloc
from io import BytesIO
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing, pfor, tokenize
from quillon.llm.tokenize import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "a", "don't stop I'LL 's'S x's'' '''s", "ÀÉ ß ÿ É", "<|endoftext|> a<|startoftext|>b", "İstanbul ΟΔΟΣ", "a b\x85c\x1cd",
    "日本語 テスト", "é café", "12 3a4b5", "!!!a???", "​zero", "º ª µ ×÷", "\n\t\r\x0b\x0c", "x" * 5000, "one two " * 3000, "same text", "same text",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", "y", 1), (3, "again", None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, part int")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_matches_library(library):
    assert Encoder(PATH).ids(TEXTS) == [ids_of(library, t) for t in TEXTS]


@pytest.mark.parametrize("keep", [1_000_000, 40, 1])
def test_encoder_groups_and_memory(library, monkeypatch, keep):
    """Groups of rows, and pieces forgotten and met again, change nothing."""
    monkeypatch.setattr(tokenize, "KEEP", keep)
    monkeypatch.setattr(tokenize, "GROUP", 300)
    rng, texts = random.Random(3), list(TEXTS)
    for _ in range(60):
        texts.append(" ".join("".join(rng.choices("abéß'.,7", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 40))))
    enc = Encoder(PATH)
    assert enc.by_word
    for _ in range(2):
        out = [raw for at, found in enc.groups(pa.array(texts)) for raw in found]
        assert out == [ids_of(library, t) for t in texts]
    for odd in ([" "], [None], [], ["\n \t"]):
        assert enc.ids(odd) == [b""] * len(odd)


def test_encoder_keeps_known_pieces(monkeypatch):
    """A full table forgets what a group does not use, and encodes nothing anew that it uses and knows."""
    monkeypatch.setattr(tokenize, "KEEP", 6)
    enc, seen = Encoder(PATH), []
    encode = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda pieces: seen.extend(pieces.to_pylist()) or encode(pieces))
    texts = ["one two three four", "three five four six seven", "six three eight"]
    assert [enc.ids([t])[0] for t in texts] == Encoder(PATH).ids(texts)
    assert sorted(seen) == sorted("one two three four five six seven eight".split())
    assert len(enc.pieces) <= 6


_MEMORY = """
import re, sys
import numpy as np, pyarrow as pa
from quillon.llm.tokenize import Encoder
mb = lambda what: int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
rng = np.random.default_rng(5)
letters = rng.integers(97, 123, (200_000, 6), np.uint8)
words = np.hstack([letters, np.full((200_000, 1), 32, np.uint8)])
rows = [words[rng.integers(0, 200_000, 500)].tobytes().decode() for _ in range(8000)]
texts, enc = pa.array(rows), Encoder(sys.argv[1])
del rows
enc.ids(["a"])
before = mb("VmRSS")
n = sum(len(raw) for _, found in enc.groups(texts) for raw in found)
assert n > 8000 * 500 * 4
print(mb("VmHWM") - before)
"""


def test_encoder_memory():
    """28 MB of text: what an encoder takes follows the group, not the batch; an executor has a worker for each core beside its heap."""
    out = subprocess.run([sys.executable, "-c", _MEMORY, PATH], capture_output=True, text=True, timeout=120, check=True)
    assert float(out.stdout) < 120


def test_pack_places_every_id(docs, library):
    rows = packing.pack(docs, PATH, capacity=64).collect()
    want = [(d, ids_of(library, t) + b"\1\0\0\0") for d, t in docs.select("doc_id", "text").collect()]
    assert sum(r.length for r in rows) == sum(len(x) // 4 for _, x in want)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    cut = [(d is None, d or 0, i, 64 * i, len(c := x[a : a + 256]) // 4, crc32(c)) for d, x in want for i, a in enumerate(range(0, len(x), 256))]
    assert got == sorted(cut)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64


def test_fillings_are_near_the_bound():
    rng = random.Random(1)
    counts = {}
    for _ in range(5000):
        n = min(512, int(rng.lognormvariate(4, 1)) + 1)
        counts[n] = counts.get(n, 0) + 1
    plan = packing.fillings(counts, 512)
    used = {}
    for times, filling in plan:
        assert sum(n * k for n, k in filling.items()) <= 512
        for n, k in filling.items():
            used[n] = used.get(n, 0) + times * k
    assert used == counts
    assert sum(t for t, _ in plan) <= -(-sum(n * c for n, c in counts.items()) // 512) + 1


def test_fullest_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        lengths = sorted({rng.randint(1, 40) for _ in range(6)}, reverse=True)
        counts = {n: rng.randint(1, 3) for n in lengths}
        sums = {lengths[0]}
        for n in lengths:
            for _ in range(counts[n] - (n == lengths[0])):
                sums |= {s + n for s in sums if s + n <= 60}
        got = packing.fullest(counts, lengths, 60)
        assert sum(n * k for n, k in got.items()) == max(sums)
        assert got[lengths[0]] >= 1 and all(k <= counts[n] for n, k in got.items())


def test_pack_empty(docs):
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for ids in ([], [7], [0, 2**32 - 1], [5] * 100, rng.integers(0, 50000, 4096), np.append(rng.integers(9, 20, 4000), [2**31, 2**32 - 1])):
        ids = np.array(ids, np.uint32)
        assert (pfor.decode_block(pfor.encode_block(ids)) == ids).all()
    few = np.append(rng.integers(0, 16, 4000), [2**31]).astype(np.uint32)
    assert len(pfor.encode_block(few)) < 4001 // 2 + 40  # the outlier is an exception


def test_file_round_trip():
    sink, docs = BytesIO(), [(None, b""), (1, np.arange(10000, dtype="<u4").tobytes()), (2, b""), (3, np.full(5, 9, "<u4").tobytes())]
    writer = pfor.Writer(block=128)
    for doc, raw in docs:
        sink.writelines(x + pfor.NEWLINE for x in writer.add(doc, raw))
    sink.writelines(x + pfor.NEWLINE for x in writer.close())
    reader = pfor.Reader(sink)
    assert list(reader.documents(blocks_at_once=3)) == [(d, len(x) // 4, crc32(x)) for d, x in docs]
    assert (reader.blocks(5, 6) == np.arange(640, 768)).all()


def test_token_ids_in_order(docs, library):
    rows = sorted(pfor.round_trip(docs, PATH, files=3).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    want = sorted((d is None, d or 0, crc32(x := ids_of(library, t) + b"\2\0\0\0"), len(x) // 4) for d, t in docs.select("doc_id", "text").collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in rows) == want


def test_files_are_in_order_and_rows_without_id_spread(spark, library, tmp_path):
    """Many rows without an id, and ids out of order, over several files that hold what the format says."""
    rows = [(None, f"no id {i}") for i in range(60)] + [(i * 37 % 100, f"text {i}\nnext") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pfor.write_ids(docs, PATH, str(tmp_path / "out"), files=5)
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    assert len(files) >= 6
    found = [[d for d, _, _ in pfor.Reader(BytesIO(p.read_bytes())).documents()] for p in files]
    assert sum(1 for f in found if None in f) >= 2 and not any(None in f and set(f) != {None} for f in found)
    assert [d for f in found for d in f if d is not None] == list(range(100))
    got = sorted(pfor.read_ids(spark, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 60 + list(range(100))
    by_id = {d: len(ids_of(library, t)) // 4 + 1 for d, t in rows if d is not None}
    assert all(r.n_tokens == by_id[r.doc_id] for r in got if r.doc_id is not None)


def test_records_hold_few_rows_at_a_time():
    """A batch of 20 MB is written with a small part of it in Python objects."""
    raw = np.arange(2000, dtype="<u2").tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([raw] * 5000, pa.binary())], ["doc_id", "ids"])
    tracemalloc.start()
    try:
        size = sum(out.nbytes for out in pfor._records(iter([batch]), width=2))
        assert tracemalloc.get_traced_memory()[1] < 10_000_000
    finally:
        tracemalloc.stop()
    assert size > 5000 * 2000 * 10 // 8  # ids below 2000 at the width of a percentile, 11 bits


def test_token_ids_empty(docs):
    assert pfor.round_trip(docs.limit(0), PATH).count() == 0
