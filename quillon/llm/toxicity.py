"""Toxicity by a weighted finite-state pattern grammar.

A text is a string of word classes cut into clauses. Small transducers rewrite it: one marks
insults (words and stems learned from labels, with their log-odds as weights), one threats, one
targets, one the reach of negation, one reported speech. Their composition is a machine with
few states that emits the clauses it accepts, weighed by what negates, reports or aims them.
Only accepted clauses count: how many, how heavy, how varied, and threats by kind. A
logistic model fitted on labelled rows turns that into a probability; its weights for threats
start from a prior, as labels seldom hold enough of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from quillon.llm.common import free_name, ship_code, slices, stored

#: Labelled rows that the model is fitted on at most; chosen by a hash of the id.
TRAIN_ROWS = 12_000
#: What makes a term of the learned lexicon: texts and share of the toxic texts that have it, and the lower bound of its weight.
LEAST_TEXTS, LEAST_SHARE, LEAST_WEIGHT = 3, 0.005, 1.75
STEMS = (5, 6, 7, 8)
#: Words that a negation reaches, and what is left of an insult when negated or reported.
REACH, NEGATED, REPORTED, AIMED = 3, 0.3, 0.4, 1.25

# Closed-class words of English, French, German and Spanish, and verbs of violence with their endings.
NEGATION = frozenset("not no never neither nor isn't aren't wasn't don't won't ne pas jamais nicht kein keine nie nunca jamás".split())
REPORT = frozenset("said says say called quoted reported wrote claims claimed dit disait sagte sagt schrieb dijo dice escribió".split())
TARGET = frozenset("you your you're they them he him she her te tu toi vous ton du dich dir euch ihr dein sie usted ustedes vosotros ellos os".split())
INTENT = frozenset("i i'll we we'll will shall gonna going must je vais veux nous allons ich wir werde werden voy vamos quiero".split())
_VERBS = {
    "kill murder destroy threaten punch": " s ed ing", "hurt": " s ing", "beat": " s en ing", "stab": " s bed bing", "shoot": " s ing", "shot": "", "hang": " s ed ing", "hung": "",
    "tu frapp menac": "er e es ent é ée és ait erai eras era erons ant", "schlag töt": "en e t et st te ten", "geschlagen getötet schlägt schlägst bedrohe bedrohen bedroht": "",
    "mat golpe amenaz": "ar o as a an é ó aré arás ará aremos ando ado",
}
THREAT = frozenset(v + e for verbs, ends in _VERBS.items() for v in verbs.split() for e in (ends.split(" ") if ends else [""]))
#: Infinitives with the person as an ending.
THREAT_AND_TARGET = frozenset(v + e for v in ("matar", "golpear", "amenazar") for e in ("te", "lo", "la", "los", "las", "le", "les", "os"))
#: Log-odds that a direct threat and any other are expected to add.
THREAT_PRIOR = (4.0, 2.0)
_TOKEN = re.compile(r"\w+(?:'\w+)?|[.!?;:\n]")
_CLAUSE_END = frozenset(".!?;:\n")


# Symbols that the transducers read: sets of word classes as bits.
INSULT, THREATENS, TARGETS, NEGATES, REPORTS, INTENDS, END, COLON = (1 << i for i in range(8))


@dataclass(frozen=True)
class Arc:
    """What reading a symbol does: factors on a word's weight and on the clause's, and at the end of a clause whether it has an insult, and the kind of its threat."""

    state: int
    word: float = 1.0
    clause: float = 1.0
    insulting: bool = False
    threat: int = 0


Transducer = Callable[[int, int], Arc]


def insults(state: int, x: int) -> Arc:
    """Accepts clauses with an insult."""
    return Arc(0, insulting=bool(state)) if x & END else Arc(int(state or x & INSULT > 0))


def threats(state: int, x: int) -> Arc:
    """Accepts clauses with a verb of violence and a target: kind 2 with an intent (I will ...), else 1."""
    if x & END:
        return Arc(0, threat=0 if state & 3 < 3 else 2 if state & 4 else 1)
    return Arc(state | (1 if x & THREATENS else 0) | (2 if x & TARGETS else 0) | (4 if x & INTENDS else 0))


def targets(state: int, x: int) -> Arc:
    """Weighs clauses up that are aimed at someone."""
    return Arc(0, clause=AIMED if state else 1.0) if x & END else Arc(int(state or x & TARGETS > 0))


def negation(state: int, x: int) -> Arc:
    """Weighs insults and threats down within reach of a negation; the state is the words left of it."""
    word = NEGATED if state and x & (INSULT | THREATENS) else 1.0
    return Arc(0 if x & END else REACH if x & NEGATES else max(0, state - 1), word=word)


def reported(state: int, x: int) -> Arc:
    """Weighs reported clauses down; a report goes on past a colon, as in: he said: ..."""
    if x & END:
        return Arc(int(state and x & COLON > 0), clause=REPORTED if state else 1.0)
    return Arc(int(state or x & REPORTS > 0))


def composed(*parts: Transducer) -> list[dict[int, tuple[int, float, float, bool, int]]]:
    """The product of transducers over their reachable states: by state, by symbol, (state, word, clause, insulting, threat)."""
    symbols = [*range(END), END, END | COLON]
    start = (0,) * len(parts)
    number, table, todo = {start: 0}, [], [start]
    while todo:
        at = todo.pop(0)
        row = {}
        for x in symbols:
            arcs = [part(s, x) for part, s in zip(parts, at, strict=True)]
            after = tuple(a.state for a in arcs)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row[x] = (number[after], math.prod(a.word for a in arcs), math.prod(a.clause for a in arcs), any(a.insulting for a in arcs), max(a.threat for a in arcs))
        table.append(row)
    return table


MACHINE = composed(insults, threats, targets, negation, reported)
_CLASS = {".": END, "!": END, "?": END, ";": END, "\n": END, ":": END | COLON}
for _bit, _words in ((THREATENS, THREAT), (TARGETS, TARGET), (NEGATES, NEGATION), (REPORTS, REPORT), (INTENDS, INTENT), (THREATENS | TARGETS, THREAT_AND_TARGET)):
    for _word in _words:
        _CLASS[_word] = _CLASS.get(_word, 0) | _bit
_THREATENING = THREAT | THREAT_AND_TARGET


@dataclass(frozen=True)
class Clause:
    """An accepted clause: the weight of its insults, each insult's own weight in it, and its threat's kind and strength."""

    weight: float
    insults: tuple[tuple[str, float], ...]
    threat: int = 0
    strength: float = 0.0


@dataclass
class Grammar:
    """Learned insult weights over the fixed word classes."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def insult(self, word: str) -> float:
        """Weight of a word: its own, or that of its longest known stem."""
        got = self.words.get(word)
        if got is None:
            got = 0.0
            for n in reversed(STEMS):
                if len(word) > n and (w := self.stems.get(word[:n])):
                    return w
        return got

    def clauses(self, tokens: list[str]) -> Iterator[Clause]:
        """Each clause that the composed machine accepts."""
        state, found, strength = 0, [], 0.0
        for token in [*tokens, "."]:
            w = self.insult(token)
            x = _CLASS.get(token, 0) | (INSULT if w else 0)
            state, word, clause, insulting, threat = MACHINE[state][x]
            if w:
                found.append((token, w * word))
            if x & THREATENS:
                strength = max(strength, word)
            if x & END:
                if insulting or threat:
                    weighed = tuple((t, v * clause) for t, v in found)
                    yield Clause(sum(v for _, v in weighed), weighed, threat, min(1.0, strength * clause) if threat else 0.0)
                found, strength = [], 0.0

    def features(self, text: str | None) -> list[float]:
        """What the matched clauses of a text amount to; zeros where none matches."""
        tokens = _TOKEN.findall((text or "").lower())
        kinds = set(tokens)
        if kinds.isdisjoint(_THREATENING) and not any(map(self.insult, kinds)):
            return [0.0] * FEATURES
        found = list(self.clauses(tokens))
        rude = [c.weight for c in found if c.insults]
        hits = sum(len(c.insults) for c in found)
        varied: dict[str, float] = {}
        for c in found:
            for token, w in c.insults:
                varied[token] = max(w, varied.get(token, 0.0))
        best = sorted(varied.values(), reverse=True)
        threat = [sum(c.strength for c in found if c.threat == kind) for kind in (2, 1)]
        return [
            math.log1p(sum(rude)),
            max(rude, default=0.0),
            sum(sorted(rude, reverse=True)[:3]),
            math.log1p(hits),
            math.log1p(sum(best[:5])),
            min(1.0, sum(best[1:2])),
            math.log1p(100 * hits / len(tokens)),
            float(bool(rude)),
            *(min(1.0, t) for t in threat),
        ]


FEATURES = 10
PRIOR = np.array([0.0] * (FEATURES - 2) + list(THREAT_PRIOR))


@dataclass
class Model:
    grammar: Grammar
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights @ [*self.grammar.features(text), 1.0], -30, 30))))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the distinct words of a text, and a one-value min-hash of its five-word shingles: near copies mostly share it."""
    for batch in slices(batches):
        sketches, words = [], []
        for text in batch.column(0).to_pylist():
            tokens = (text or "").lower().split()
            parts = [" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))]
            sketches.append(min(xxh64_intdigest(p) for p in parts) >> 1)
            words.append(list({t for t in _TOKEN.findall((text or "").lower()) if t not in _CLAUSE_END and len(t) > 1}))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sketches, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["text", "toxic", "sketch", "words"]
        )


def _featured(batches: Iterator[pa.RecordBatch], grammar: Grammar) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [grammar.features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])


def _lexicon(sample: DataFrame) -> Grammar:
    """Insult words and stems by the lower bound of their log-odds over distinct texts."""
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Grammar()
    stems = F.flatten(F.transform("words", lambda w: F.filter(F.array(*[F.when(F.length(w) > n, F.concat(F.lit("^"), F.substring(w, 1, n))) for n in STEMS]), lambda s: s.isNotNull())))
    terms = F.explode(F.array_distinct(F.concat("words", stems))).alias("term")
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * toxic))
    # Few by nature: a text's distinct terms over LEAST_SHARE, whatever the number of texts.
    often = sample.where("toxic = 1").select(terms).groupBy("term").agg(F.count("*").alias("a")).where(F.col("a") >= least)
    often = stored(often, "terms")
    other = sample.where("toxic = 0").select(terms).join(often.select("term"), "term").groupBy("term").agg(F.count("*").alias("b"))
    both = often.join(other, "term", "left").na.fill(0, ["b"])
    a, b = F.col("a"), F.col("b")
    weight = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    bound = weight - 1.64 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    # No more than distinct terms of TRAIN_ROWS texts that LEAST_SHARE of the toxic ones have.
    rows = both.select("term", weight.alias("weight"), bound.alias("bound")).where(F.col("bound") >= LEAST_WEIGHT).collect()
    return Grammar({r.term: r.weight for r in rows if r.term[0] != "^"}, {r.term[1:]: r.weight for r in rows if r.term[0] == "^"})


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, shrunk towards `prior`; a last column of ones is added and not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    mean = np.append(np.zeros(x.shape[1] - 1) if prior is None else prior, 0.0)
    w, shrink = mean.copy(), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ (w - mean))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """A model from at most `rows` labelled documents; near copies count once.

    Labels without a document, null labels and null texts are left out; of several labels of a
    document the highest counts. Without rows of both kinds the model scores everything alike.
    """
    ship_code(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("toxic")).where("__id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("__id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    sample = own.join(F.broadcast(known), "__id").select("text", "toxic")  # `rows` pairs of numbers
    sample = sample.mapInArrow(_sketched, "text string, toxic int, sketch long, words array<string>")
    sample = stored(sample, "labelled")
    once = sample.groupBy("sketch", "toxic").agg(F.min_by("words", F.struct(F.size("words"), F.xxhash64("text"))).alias("words"))
    grammar = _lexicon(once)
    got = sample.select("text", "toxic").mapInArrow(partial(_featured, grammar=grammar), "toxic int, x array<double>").toPandas()
    if got.toxic.nunique() < 2:
        share = float(got.toxic.mean()) if len(got) else 0.0
        return Model(grammar, np.append(PRIOR, math.log((share * len(got) + 0.5) / ((1 - share) * len(got) + 1.5))))
    return Model(grammar, fit(np.array(got.x.tolist(), float), got.toxic.to_numpy(float), PRIOR))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        scores = pa.array([model.score(t) for t in batch.column(0).to_pylist()], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], [*batch.schema.names[1:], "score"])


def scored(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` and score, from the whole text alone, however long, for every row.

    A null or empty text scores as one without a matched clause; repeated rows score alike; an
    empty table gives no rows. A kept column with the name score, in any case, comes back with
    underscores before its name.
    """
    ship_code(docs.sparkSession)
    kept, taken = docs.select(*keep), ["score"]
    for name in kept.columns:
        taken.append(free_name(taken, name))
    own = docs.select(F.col(text_col).cast("string"), *keep).toDF(free_name(taken, "__text"), *taken[1:])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return own.mapInArrow(partial(_scored, model=model), f"{schema}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score `threshold` or more; columns as they came, one named score too."""
    rows = scored(docs, model, [F.col(f"`{c}`") for c in docs.columns], text_col)
    return rows.where(F.col("score") < threshold).drop("score").toDF(*docs.columns)
