"""Quality rules as a bitmask ledger.

Each text is measured once. A ledger row holds the measurements and one failure bit per rule;
a policy is a named mask over those bits, so another policy, or the effect of leaving a rule
out, is bit arithmetic over the ledger and never reads the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm.common import ship_code

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` (SQL over the measurements) is true."""

    name: str
    fails: str


#: A rule's place is its bit; places never change, new rules are added at the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": BIT["few_words"] | BIT["repeated_words"] | BIT["symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL_BYTES = SYMBOLS.encode()
_CONTINUED = bytes(range(0x80, 0xC0))


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of one UTF-8 text; null and empty texts measure zero."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).translate(None, _CONTINUED))
    symbols = len(text) - len(text.translate(None, _SYMBOL_BYTES))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeats = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        size = len(number)
        # Windows as pairs of numbers, so that no product leaves 64 bits.
        pair = ids[:-1] * size + ids[1:]
        _, pair = np.unique(pair, return_inverse=True)
        _, window, count = np.unique(pair[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
        often = np.flatnonzero(count[window] > 1)
        if len(often):
            hit = np.zeros(n, bool)
            for i in range(3):
                hit[often + i] = True
            repeats = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, MEASURES and failed_rules, a mask of the rules that fail.

    A null or empty text measures zero and fails few_words; a null id stays null; repeated rows
    give repeated rows; an empty table gives none; other columns are not read.
    """
    ship_code(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = own.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule.fails), BIT[rule.name]).otherwise(0) for rule in RULES]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return rows.withColumn("failed_rules", mask)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed_rules").bitwiseAND(POLICIES[policy]) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """rule, failed, kept_without: by rule of a policy, the rows that fail it, and those that only it rejects.

    Bit counts over the distinct masks: one aggregation over the ledger to at most 2 ** rules rows.
    """
    mask = POLICIES[policy]
    masks = rows.groupBy(F.col("failed_rules").bitwiseAND(mask).alias("mask")).agg(F.count("*").alias("n"))
    one = F.when(F.bit_count("mask") == 1, F.col("n")).otherwise(0)
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).alias("bit")) for r in RULES if BIT[r.name] & mask])).alias("r")
    hit = masks.select("mask", "n", one.alias("one"), rules).where(F.col("mask").bitwiseAND(F.col("r.bit")) != 0)
    return hit.groupBy(F.col("r.rule").alias("rule")).agg(F.sum("n").alias("failed"), F.sum("one").alias("kept_without"))


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """Ledger rows with base_failed and kept (no failure of the base rules or of `policy`)."""
    rows = ledger(docs)
    return rows.withColumn("base_failed", ~passes("base")).withColumn("kept", passes("base") & passes(policy))


def oracle() -> str:
    """verdicts() in DuckDB SQL over `documents`, without failed_rules and n_lines."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
g AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
o AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM o) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
  len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(p.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(r.fails for r in RULES)}) AS kept FROM f"""
