"""Quality measures, token counts, languages and toxicity against brute force or held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from quillon.llm import langid, quality, queries, tokencount, toxicity

F = langid.F
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def measured(text):
    words = words_of(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup, lines = set(), 0, [x for x in (text or "").split("\n") if words_of(x)]
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in quality.SYMBOLS), dup, len(hit), len(lines)


TEXTS = [
    None, "", " ", "\n\n", "a", "a a a a", "a b a b a b", "a\x0bb\x0cc\x85d\xa0e f", "x\nx\n x\n\nx\n", "#*$%&|<> é ß 日本語", "one two three " * 40, "\t".join("abc") + "\r\nabc",
    "word " * 60 + "\n" + "$$$ ### " * 30, "é" * 3000,
]


def docs(spark, texts=TEXTS):
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "no id", "y", 1), (1, "again", None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score int")


def test_measures(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab \n#", k=200)) for _ in range(30)]
    got = quality.ledger(docs(spark, texts)).collect()
    want = Counter((d, *measured(t)) for d, t in docs(spark, texts).select("doc_id", "text").collect())
    assert Counter((r.doc_id, *(r[m] for m in quality.MEASURES)) for r in got) == want


def test_verdicts_and_ablations(spark):
    rows = quality.verdicts(docs(spark)).collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.failed_rules & quality.POLICIES["v1"])
    rows = quality.ledger(docs(spark))
    masks = [r.failed_rules & quality.POLICIES["v1"] for r in rows.collect()]
    got = {r.rule: (r.failed, r.kept_without) for r in quality.ablations(rows, "v1").collect()}
    want = {n: (sum(bool(m & b) for m in masks), sum(m == b for m in masks)) for n, b in quality.BIT.items()}
    assert got == {k: v for k, v in want.items() if v[0]}
    assert quality.verdicts(docs(spark).limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    made = Tokenizer(models.Unigram(tokencount.vocabulary(PIECES), unk_id=0, byte_fallback=True))
    made.normalizer = normalizers.Replace(Regex(r"[\x09-\x0D\x20]+"), " ")
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


def test_token_counts(spark, library):
    sample = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = [*TEXTS, *sample, "▁a▁▁b", " lead", "trail ", "<0x41> <s> </s>", "\U0001f600\U0001f600 ok", "mixed日\U00013000語"]
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs(spark, texts), PIECES).where("doc_id <> 1").collect()}
    want = {i: len(library.encode(t or "").ids) for i, t in enumerate(texts) if i != 1}
    assert got == want | {None: None} or {k: v for k, v in got.items() if k is not None} == want
    assert tokencount.token_counts(docs(spark).limit(0), PIECES).count() == 0


def test_token_count_ties_and_unknowns():
    """Small vocabularies with equal scores and no bytes, against the library."""
    rng = random.Random(2)
    for trial in range(40):
        pieces = [("<unk>", 0.0), ("▁", -2.0)] + [("".join(rng.choices("ab", k=rng.randint(1, 4))), float(-rng.randint(1, 4))) for _ in range(6)]
        pieces = list(dict(pieces).items())
        made = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
        made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = tokencount.Counter(pieces)
        for _ in range(20):
            text = "".join(rng.choices("abc", k=rng.randint(1, 12)))
            assert counter.count(text) == len(made.encode(text).ids), (trial, pieces, text)


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 9, 40])
def test_codewords(n):
    code = langid.codewords(n)
    assert len(code) == n
    if n > 1:
        apart = [int((a != b).sum()) for i, a in enumerate(code) for b in code[i + 1 :]]
        assert min(apart) >= (1 if n == 2 else 2)


def plain_model(rows):
    """Shares of n-grams by language, the code, weights and trust, in plain loops."""
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    langs = sorted(counts)
    size = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    code = langid.codewords(len(langs)).tolist()
    share = {x: [(counts[x][g] + 0.5) / size[x] for g in range(langid.BUCKETS)] for x in langs}
    weights, trust = [], []
    for j in range(len(code[0])):
        plus, minus = ([x for x, c in zip(langs, code) if c[j] == sign] for sign in (1, -1))
        w = [math.log(sum(share[x][g] for x in plus) / len(plus)) - math.log(sum(share[x][g] for x in minus) / len(minus)) for g in range(langid.BUCKETS)]
        means = [sum(a * b for a, b in zip(share[x], w)) for x in langs]
        norm = sum(map(abs, means)) / len(means)
        weights.append([x / norm for x in w])
        trust.append(max(0.05, min(c[j] * m for c, m in zip(code, means)) / norm))
    return langs, code, weights, trust


def plain_grams(text):
    b, out = [], []
    for c in text.encode():
        c = c + 32 if 65 <= c <= 90 else c
        c = c if 97 <= c <= 122 or c >= 128 else 32
        if c != 32 or not b or b[-1] != 32:
            b.append(c)
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            code = int.from_bytes(bytes(b[i : i + n]), "big")
            out.append(((code * 2654435761 + n * 40503) % 2**32 >> 18) % langid.BUCKETS)
    return out


def plain_decode(model, text):
    langs, code, weights, trust = model
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    found = plain_grams(text)
    margins = [max(-3.0, min(3.0, sum(w[g] for g in found) / len(found))) for w in weights]
    loss = [sum(t * math.exp(-c * m) for t, c, m in zip(trust, row, margins)) / sum(trust) for row in code]
    odds = [math.exp(-4 * (x - min(loss))) for x in loss]
    best = loss.index(min(loss))
    return langs[best], odds[best] / sum(odds)


def test_languages_registered_query(spark):
    """Every row of the registered query against plain loops, on its own split by crc32."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    model = plain_model([(r.text, r.lang) for r in rows if not out[r.doc_id]])
    got = {r.doc_id: r for r in queries.op3_language(spark, sf).collect()}
    assert got.keys() == out.keys() and 0 < sum(out.values()) < len(out)
    for r in rows:
        lang, score = plain_decode(model, r.text)
        mine = got[r.doc_id]
        assert mine.held_out == out[r.doc_id] and mine.lang_pred == lang and abs(mine.score - score) < 1e-4


def test_many_languages_and_seams(spark, monkeypatch):
    """More languages than any table of them is cut at, and texts in parts of any size."""
    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    own = {f"l{i:03}": rng.sample(letters, 6) for i in range(230)}
    rows = [(i, "".join(rng.choices(own[x], k=200)), x) for i, x in enumerate([*own] * 3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(own)
    test = [("".join(rng.choices(own[x], k=200)), x) for x in own]
    assert sum(model.decode(t)[0] == x for t, x in test) > 0.9 * len(test)
    text = ("Some  words é 12 " * 50 + "\n\n  end ").encode()
    want = langid.gram_counts(text)
    assert want.tolist() == [Counter(plain_grams(text.decode()))[g] for g in range(langid.BUCKETS)]
    for step in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "STEP", step)
        assert (langid.gram_counts(text) == want).all()


def test_language_edges(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.col("doc_id") % 4 == 2
    model = langid.train(rows.where(~held))
    got = langid.predict(rows.where(held), model, [F.col("doc_id"), F.col("lang").alias("Score"), F.col("lang").alias("__text")])
    assert got.columns == ["doc_id", "_Score", "__text", "lang_pred", "score", "ambiguous"]
    got = got.collect()
    assert sum(r.lang_pred == r._Score for r in got) >= 0.99 * len(got)
    tie = spark.createDataFrame([(i, "same words here", x) for i, x in enumerate("ba")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(tie, langid.train(tie), [F.col("doc_id")]).collect()} == {"a"}
    long = spark.createDataFrame([(1, "the of and that with this is " * 90_000)], "doc_id long, text string")
    assert langid.predict(long, model, [F.col("doc_id")]).first().lang_pred == "en"
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ²½ !? \n"), (4, "the of and that with this is"), (4, "the of and that with this is")], "doc_id long, text string")
    out = sorted(langid.predict(odd, model, [F.col("doc_id")]).collect())
    assert [(r.lang_pred, r.score) for r in out[:3]] == [("und", 0.0)] * 3
    assert out[3] == out[4] and out[3].lang_pred == "en" and 0 <= out[3].score <= 1
    assert langid.predict(odd.limit(0), model, [F.col("doc_id")]).count() == 0
    nothing = langid.train(rows.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, nothing, [F.col("doc_id")]).collect()} == {"und"}
    alone = langid.train(rows.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.predict(odd, alone, [F.col("doc_id")]).collect()} == {"und", "fr"}


def test_grammar_clauses():
    g = toxicity.Grammar({"moron": 4.0, "scum": 4.0}, {"idiot": 3.0})
    score = lambda text: sum(c.weight for c in g.clauses(toxicity._TOKEN.findall(text.lower())))
    plain = score("such a moron here.")
    assert plain == 4.0 and g.insult("idiotic") == 3.0
    assert score("you are a moron.") > plain > score("not a moron.") > 0
    assert score('he said: moron.') < plain
    assert score("it said: moron.") == score("it said moron.") < plain == score("it said. moron.")
    assert score("not one two moron.") < plain == score("not one two three moron.")
    assert score("nothing here. words only!") == 0
    threat = lambda text: [(c.threat, round(c.strength, 3)) for c in g.clauses(toxicity._TOKEN.findall(text.lower()))]
    assert threat("i will kill you.") == [(2, 1.0)] == threat("Je vais te tuer!") == threat("Ich werde dich töten") == threat("voy a matarte")
    assert threat("she killed them and threatens you") == [(1, 1.0)] and threat("kill the lights. you saw") == []
    assert threat("i will not kill you")[0][1] < 0.5 and threat("he said: i will kill you")[0][1] <= 0.5
    assert g.features(None) == [0.0] * toxicity.FEATURES == g.features("") == g.features("clean words")
    model = toxicity.Model(g, toxicity.np.append(toxicity.PRIOR, -2.9))
    assert model.score("i will kill you.") > 0.5 > model.score("i will not kill you.") > model.score("words") > 0


def plain_features(grammar, text):
    """The grammar as nested loops over clauses and words, without transducers."""
    clauses, words = [], []
    tokens = re.findall(r"\w+(?:'\w+)?|[.!?;:\n]", (text or "").lower())
    for t in [*tokens, "."]:
        if t in ".!?;:\n":
            clauses.append((words, t))
            words = []
        else:
            words.append(t)
    rude, every, hits, threats, carried = [], {}, 0, [0.0, 0.0], False
    for words, end in clauses:
        told = carried or any(w in toxicity.REPORT for w in words)
        carried = told and end == ":"
        factor = toxicity.REPORTED if told else 1.0
        both = toxicity.THREAT_AND_TARGET
        aimed = any(w in toxicity.TARGET or w in both for w in words)
        factor *= toxicity.AIMED if aimed else 1.0
        denied = [any(v in toxicity.NEGATION for v in words[max(0, i - toxicity.REACH) : i]) for i in range(len(words))]
        found = [(w, grammar.insult(w) * (toxicity.NEGATED if no else 1.0) * factor) for w, no in zip(words, denied) if grammar.insult(w)]
        verbs = [toxicity.NEGATED if no else 1.0 for w, no in zip(words, denied) if w in toxicity.THREAT or w in both]
        if found:
            rude.append(sum(v for _, v in found))
            hits += len(found)
        for w, v in found:
            every[w] = max(v, every.get(w, 0.0))
        if verbs and aimed:
            threats[0 if any(w in toxicity.INTENT for w in words) else 1] += min(1.0, max(verbs) * factor)
    if not rude and not any(threats):
        return [0.0] * 10
    best, log = sorted(every.values(), reverse=True), math.log1p
    return [log(sum(rude)), max(rude, default=0.0), sum(sorted(rude)[-3:]), log(hits), log(sum(best[:5])), min(1.0, sum(best[1:2])), log(100 * hits / len(tokens)), float(bool(rude)), *(min(1.0, t) for t in threats)]


def plain_lexicon(rows):
    """Weights of words and stems from (text, toxic), in plain loops."""
    once = {}
    for text, toxic in rows:
        tokens = text.lower().split()
        sketch = min(xxhash.xxh64_intdigest(" ".join(tokens[i : i + 5])) for i in range(max(1, len(tokens) - 4))) >> 1
        words = {t for t in re.findall(r"\w+(?:'\w+)?|[.!?;:\n]", text.lower()) if len(t) > 1}
        once.setdefault((sketch, toxic), []).append(words)
    seen = {0: Counter(), 1: Counter()}
    totals = Counter(toxic for _, toxic in once)
    for (_, toxic), sets in once.items():
        words = min(sets, key=len)
        seen[toxic].update(words | {"^" + w[:n] for w in words for n in toxicity.STEMS if len(w) > n})
    out = {}
    for term, a in seen[1].items():
        b = seen[0][term]
        weight = math.log((a + 0.5) / (totals[1] + 1)) - math.log((b + 0.5) / (totals[0] + 1))
        if a >= max(toxicity.LEAST_TEXTS, math.ceil(toxicity.LEAST_SHARE * totals[1])) and weight - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= toxicity.LEAST_WEIGHT:
            out[term] = weight
    return out


def test_toxicity_registered_query(spark):
    """Every row of the registered query against plain loops, on its own split by crc32."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    known = [(r.text, labels[r.doc_id]) for r in rows if r.doc_id in labels and not out[r.doc_id]]
    docs, table = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, table.where(queries.toxicity_training()))
    learned = model.grammar.words | {f"^{t}": w for t, w in model.grammar.stems.items()}
    want = plain_lexicon(known)
    assert learned.keys() == want.keys() and all(math.isclose(learned[t], want[t]) for t in want)
    x = toxicity.np.array([plain_features(model.grammar, t) for t, _ in known])
    weights = toxicity.fit(x, toxicity.np.array([float(y) for _, y in known]), toxicity.PRIOR)
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, sf).collect()}
    assert got.keys() == out.keys()
    for r in rows:
        z = sum(a * b for a, b in zip([*plain_features(model.grammar, r.text), 1.0], weights))
        mine = got[r.doc_id]
        assert mine.held_out == out[r.doc_id] and mine.predicted == int(mine.score >= 0.5)
        assert abs(mine.score - 1 / (1 + math.exp(-z))) < 1e-6
    toxic = [got[d].predicted for d, y in labels.items() if y and out[d]]
    clean = [got[d].predicted for d, y in labels.items() if not y and out[d]]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.col("doc_id") % 5 == 0
    model = toxicity.train(docs, labels.where(~held), rows=1500)
    got = toxicity.scored(docs.where(held), model, [F.col("doc_id")]).join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert sum(s >= 0.5 for s in toxic) >= 0.85 * len(toxic)
    assert sum(s >= 0.5 for s in clean) <= 0.01 * len(clean)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b")], "doc_id long, text string, score string")
    scores = {r.score for r in toxicity.scored(odd.drop("score"), model, [F.col("doc_id")]).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    for name in ("score", "Score", "__text", "_score"):
        kept = toxicity.without_toxic(odd.withColumnRenamed("score", name), model)
        assert kept.columns == ["doc_id", "text", name] and sorted(r[2] for r in kept.collect()) == ["a", "b", "b"]
    long = spark.createDataFrame([(1, "plain words. " * 100_000), (2, "x" * 500_000)], "doc_id long, text string")
    assert toxicity.without_toxic(long, model).count() == 2
    assert toxicity.without_toxic(odd.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.9 for r in toxicity.scored(docs, toxicity.train(docs, none), [F.col("doc_id")]).collect())
    one = spark.createDataFrame([(1, 0), (None, 1), (2, None), (7, 1)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in toxicity.scored(docs, toxicity.train(docs, one), [F.col("doc_id")]).collect())
