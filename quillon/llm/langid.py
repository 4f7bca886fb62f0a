"""Language identification by error-correcting output codes over n-grams of bytes.

Every language has a codeword of +1 and -1. One binary classifier for each bit tells the
languages with +1 from those with -1 by log-odds of hashed n-grams, averaged over the text.
Decoding adds up exponential losses, weighted by how well each bit separates the languages in
training, and takes the codeword with the least.

All languages of the training rows are learned, however many: counts by language and n-gram stay
distributed, and what reaches the driver is two sums for each bit and n-gram, and a mean for each
language and bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm.common import free_name, ship_code, stored

#: Buckets for n-grams, the orders, and the classifiers at least. The model is BUCKETS * bits floats.
BUCKETS, ORDERS, BITS = 1 << 14, (1, 2, 3), 15
#: Bytes of a text that are counted at once; n-grams across their ends count too, once.
STEP = 1 << 20
#: Shares are added up as whole numbers of this part, so that sums do not depend on their order.
PART = 1 << 50
UNKNOWN = "und"
AMBIGUOUS = 0.7
OUTPUTS = ("lang_pred", "score", "ambiguous")


def _normal(text: np.ndarray, before: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, other ASCII as spaces, of which one in a row stays; `before` is what came last."""
    b = text.astype(np.uint32)
    upper = (b >= 65) & (b <= 90)
    b = np.where(upper, b + 32, b)
    b = np.where((b >= 97) & (b <= 122) | (b >= 128), b, 32)
    if not len(b):
        return b
    last = np.concatenate([before[-1:] if len(before) else [0], b[:-1]])
    return b[(b != 32) | (last != 32)]


def gram_counts(text: bytes) -> np.ndarray:
    """How often each bucket's n-grams occur in the normal form of a whole text."""
    total, carry = np.zeros(BUCKETS, np.int64), np.empty(0, np.uint32)
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), STEP):
        new = _normal(raw[at : at + STEP], carry)
        b = np.concatenate([carry, new])
        code = np.zeros(len(b), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            code = b.copy() if n == 1 else (code[:-1] << np.uint32(8)) | b[n - 1 :]
            fresh = code[max(0, len(carry) - n + 1) :]  # those that end in the new part
            if n in ORDERS and len(fresh):
                total += np.bincount(((fresh * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(18)) % BUCKETS, minlength=BUCKETS)
        carry = b[-(max(ORDERS) - 1) :]
    return total


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n rows of +1/-1. All dichotomies for few languages, else a fixed random code of 8 log2(n) bits or more."""
    if n <= 1:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= bits:
        columns = [[1 if i == 0 or not (c >> (i - 1)) & 1 else -1 for i in range(n)] for c in range(1, 2 ** (n - 1))]
        return np.array(columns, float).T
    size = max(bits, 8 * int(np.ceil(np.log2(n))))
    rng, best, found = np.random.default_rng(7), -1, None
    for _ in range(max(1, 200 * 200 // (n * n))):  # of some codes, the one with the largest least distance
        code = np.where(rng.random((n, size)) < 0.5, 1.0, -1.0)
        mixed = (np.abs(code.sum(axis=0)) < n).all()
        least = min(int(((size - code[i : i + 1000] @ code.T) / 2 + size * (np.arange(i, min(n, i + 1000))[:, None] == np.arange(n))).min()) for i in range(0, n, 1000))
        if mixed and least > best or found is None:
            best, found = least, code
    return found


class Model:
    """Weights of the bits, the code, and the languages; small, and shipped to every task."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        found = gram_counts(text.encode("utf-8", "surrogatepass"))
        total, n = self.weights @ found.astype(np.float32), found.sum()
        margin = np.clip(total / max(n, 1), -3, 3)
        loss = (self.trust * np.exp(-self.code * margin)).sum(axis=1) / self.trust.sum()
        odds = np.exp(-4 * (loss - loss.min()))
        best = int(loss.argmin())
        score = float(odds[best] / odds.sum())
        return self.languages[best], score, score < AMBIGUOUS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language of one task, handed on by 100 languages. Every text counts alike, however long."""
    sums: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])], ["lang", "gram", "n"])
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if lang not in sums:
                if len(sums) >= 100:
                    yield from rows()
                sums[lang] = np.zeros(BUCKETS, np.int64)
            sums[lang] += gram_counts(text)
    yield from rows()


def _shared(batches: Iterator[pa.RecordBatch], place: dict[str, int], code: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    """By n-gram, sums over languages of a language's share: for each bit those with +1, then all."""
    sums = np.zeros((BUCKETS, code.shape[1] + 1), np.int64)
    for batch in batches:
        who = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
        share = np.rint(batch.column(2).to_numpy() / scale[who] * PART).astype(np.int64)
        add = np.column_stack([(code[who] > 0) * share[:, None], share])
        np.add.at(sums, batch.column(1).to_numpy(), add)
    at = np.flatnonzero(sums[:, -1])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["gram", "sums"])


def _means(batches: Iterator[pa.RecordBatch], place: dict[str, int], weights: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    """By language, sums of share times weight for each bit."""
    for batch in batches:
        who = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
        value = (batch.column(2).to_numpy() / scale[who])[:, None] * weights[:, batch.column(1).to_numpy()].T
        kinds, at = np.unique(who, return_inverse=True)
        sums = np.zeros((len(kinds), len(weights)), np.int64)
        np.add.at(sums, at, np.rint(value * PART).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(list(sums), pa.list_(pa.int64()))], ["lang", "sums"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> Model:
    """A model from all rows with a text and a language, and all languages among them.

    No rows give a model without languages, which answers UNKNOWN.
    """
    ship_code(docs.sparkSession)
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = own.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").cast("double").alias("n"))
    counts = stored(counts, "gram-counts")
    # A row for each language, and below one for each n-gram of BUCKETS.
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    n, code = len(languages), codewords(len(languages), bits)
    width = code.shape[1]
    weights, trust = np.zeros((width, BUCKETS)), np.ones(width)
    if n > 1:
        place = {x: i for i, x in enumerate(languages)}
        scale = np.array([totals[x] + 0.5 * BUCKETS for x in languages])
        parts = counts.mapInArrow(partial(_shared, place=place, code=code, scale=scale), "gram int, sums array<long>")
        sums = np.zeros((BUCKETS, width + 1))
        each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width + 1)]
        for r in parts.groupBy("gram").agg(*each).toLocalIterator():
            sums[r.gram] = np.array(r[1:]) / PART
        rest = 0.5 / scale  # the share of an n-gram that a language never has
        for j in range(width):
            plus, minus = code[:, j] > 0, code[:, j] < 0
            up, down = (sums[:, j] + rest[plus].sum()) / plus.sum(), (sums[:, -1] - sums[:, j] + rest[minus].sum()) / minus.sum()
            weights[j] = np.log(up / np.maximum(down, rest.min()))
        means = rest[:, None] * weights.sum(axis=1)
        found = counts.mapInArrow(partial(_means, place=place, weights=weights, scale=scale), "lang int, sums array<long>")
        for r in found.groupBy("lang").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("s")).toLocalIterator():
            means[r.lang] += np.array(r.s) / PART  # expected mean log-odds of each language
        norm = np.abs(means).mean(axis=0)
        norm[norm == 0] = 1.0
        weights /= norm[:, None]
        trust = np.maximum(0.05, (code * means / norm).min(axis=0))
    return Model(languages, code, weights.astype(np.float32), trust)


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [model.decode(t) for t in batch.column(0).to_pylist()]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        columns = [pa.array([x[i] for x in got], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "lang_pred", "score", "ambiguous"])


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` and lang_pred, score (0 to 1), ambiguous for every row, from its whole text alone.

    A null text, or one without a letter, is UNKNOWN with score 0. Repeated rows get equal
    results; ties between languages go to the first by name; an empty table gives no rows. Texts
    of any length are read in parts that join without a seam. A kept column with the name of
    an output, in any case, comes back with underscores before its name.
    """
    ship_code(docs.sparkSession)
    kept, taken = docs.select(*keep), list(OUTPUTS)
    names = []
    for name in kept.columns:
        names.append(free_name(taken, name))
        taken.append(names[-1])
    own = docs.select(F.col(text_col).cast("string"), *keep).toDF(free_name(names, "__text"), *names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return own.mapInArrow(partial(_predict, model=model), f"{schema}, lang_pred string, score double, ambiguous boolean")
