"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming
carries, for each place, the best score and the number of pieces that reach it. Ties follow the
tokenizers library: a place keeps the first candidate that reaches it, and those come in order
of their start, so of equal scores the longest last piece wins. A character without a piece of
its own costs the least score less 10 and falls back to its bytes where the vocabulary has
them; else a run of such characters is one unknown token.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import ship_code

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker keeps, and their longest; longer ones are counted each time.
KEEP, LONGEST = 800_000, 64
_BLANK = re.compile(r"[\x09-\x0D\x20]+")


def vocabulary(model: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with log-probabilities by Zipf's rule from their rank.

    The file's own scores are merge ranks, not log-probabilities; the rule keeps their order.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    total = math.log(sum(1 / (i + 1) for i in range(n)))
    return [(sp.id_to_piece(i), -math.log(i + 1) - total) for i in range(n)]


class Counter:
    """count(text): how many tokens the unigram tokenizer of a vocabulary makes of it."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.words: dict[str, int] = {}

    def _word(self, word: str) -> int:
        n, unknown = len(word), self.unknown
        best: list[float] = [0.0] * (n + 1)
        count: list[int] = [0] + [-1] * n
        open_run = [False] * (n + 1)  # the best path ends in unknown characters
        at, single = 0, False

        def close(end: int, single: bool) -> None:
            """After all pieces that end at `end`: the single character as an unknown."""
            if not single:
                score = best[end - 1] + unknown
                if count[end] < 0 or score > best[end]:
                    char = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not open_run[end - 1])
                    best[end], count[end], open_run[end] = score, count[end - 1] + char, True

        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            while at < end - 1:  # places that no piece ends at, and the one before
                at += 1
                close(at, single)
                single = False
            start = end - size
            score += best[start]
            if count[end] < 0 or score > best[end]:
                best[end], count[end], open_run[end] = score, count[start] + 1, False
            single = single or size == 1
        while at < n:
            at += 1
            close(at, single)
            single = False
        return count[n]

    def count(self, text: str | None) -> int:
        """Text with runs of ASCII white space as one blank, cut before each blank or space mark."""
        if not text:
            return 0
        if SPACE in text or text[-1] in "\x09\x0a\x0b\x0c\x0d\x20":
            marked = _BLANK.sub(SPACE, text)
            words = (marked if marked[0] == SPACE else SPACE + marked).split(SPACE)[1:]
        else:
            words = [w for w in _BLANK.split(text) if w]
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    word = words[i]
                    found[i] = n = known.get(word) or self._word(SPACE + word)
                    if len(word) <= LONGEST:
                        if len(known) >= KEEP:
                            known.clear()
                        known[word] = n
        return sum(found)


@lru_cache(maxsize=2)
def _counter(model: str) -> Counter:
    return Counter(vocabulary(model))


def _counts(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    counter = _counter(model)
    for batch in batches:
        counts = [counter.count(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens for every row; 0 for a null or empty text.

    A null id stays null; repeated rows give repeated rows; an empty table gives none; other
    columns are not read. Texts are counted whole, however long.
    """
    ship_code(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(partial(_counts, model=model), "doc_id long, n_tokens long")
