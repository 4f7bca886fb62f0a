"""Token ids of whole texts with the tokenizers library, each distinct piece once.

The vocabulary's pre-tokenizer never joins text across ASCII white space, so ids of a text are
the ids of its white-space separated words in order. Texts in the printable ASCII and Latin-1
letters are cut as the tokenizer's own pattern would, and each distinct piece goes through the
library's model once while a worker remembers it; any other text goes through the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text whose distinct words are looked up together (all arrays of a group take some 20 times that), and pieces of one call.
GROUP, CALL = 4_000_000, 2000
#: Pieces whose ids a worker keeps for later groups; about 50 bytes each, and as much again while they are looked up.
KEEP = 250_000
#: Pieces of a plain word, as the vocabulary's own pattern cuts it.
_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 ]+)"
# Fixed value: the pattern of vocabularies that may be cut so.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_LOWER_WORD_PIPE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
}


def _byte_letters() -> dict[int, str]:
    """Latin-1 characters above ASCII as byte-level tokenizers spell their UTF-8 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}


def _spread(flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start:stop] of every pair in a row, and where each ends, from 0 on."""
    n = stops - starts
    ends = np.concatenate([[0], np.cumsum(n)])
    kind = np.int32 if max(int(ends[-1]), len(flat)) < 2**31 else np.int64
    source = np.repeat((starts - ends[:-1]).astype(kind), n)
    source += np.arange(ends[-1], dtype=kind)
    return flat[source], ends


class Encoder:
    """ids(texts) -> little-endian uint32 ids of each text, as bytes. None counts as an empty text."""

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = {k: [x["type"] for x in (spec[k] or {}).get({"normalizer": "normalizers", "pre_tokenizer": "pretokenizers"}[k], [])] for k in _LOWER_WORD_PIPE}
        self.by_word = kinds == _LOWER_WORD_PIPE and spec["model"].get("end_of_word_suffix") == "</w>"
        self.by_word = self.by_word and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": _PATTERN}
        self.ends = np.zeros(max(self.whole.get_vocab(True).values()) + 1, bool)
        for token, i in self.whole.get_vocab(False).items():
            self.ends[i] = token.endswith("</w>")
        self.letters = _byte_letters()
        self.pieces, self.flat, self.stops = pa.array([], pa.large_string()), np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _plain(self, text: str) -> bool:
        try:
            return self.by_word and not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
        except UnicodeEncodeError:
            return False

    def _encode(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces in a row, and where each piece ends."""
        parts = []
        for i in range(0, len(pieces), CALL):
            text = " ".join(pieces[i : i + CALL].to_pylist())
            if not text.isascii():
                text = text.translate(self.letters)
            parts.append(np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4"))
        ids = np.concatenate(parts) if parts else np.empty(0, "<u4")
        return ids, np.flatnonzero(self.ends[ids]) + 1

    def _known(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a table of pieces, where each starts and ends, in the order of `pieces`; new ones join the table."""
        at = pc.index_in(pieces, value_set=self.pieces)
        new, old = at.is_null().to_numpy(zero_copy_only=False), at.drop_null().to_numpy()
        place = np.empty(len(pieces), np.int64)
        place[~new] = old
        if new.any():
            fresh = pieces.filter(pa.array(new))
            if len(self.pieces) + len(fresh) > KEEP:  # only what is used now stays
                self.flat, self.stops = _spread(self.flat, self.stops[old], self.stops[old + 1])
                self.pieces = self.pieces.take(pa.array(old))
                place[~new] = np.arange(len(old))
            place[new] = np.arange(len(self.pieces), len(self.pieces) + len(fresh))
            ids, ends = self._encode(fresh)
            self.stops = np.concatenate([self.stops, len(self.flat) + ends])
            self.flat = np.concatenate([self.flat, ids])
            self.pieces = pa.concat_arrays([self.pieces, fresh])
        return self.flat, self.stops[place], self.stops[place + 1]

    def _model_ids(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct plain words in a row, and where each word ends."""
        cut = pc.replace_substring_regex(words, _PIECE, r"\1 ")
        last = np.cumsum(pc.count_substring(cut, " ").to_numpy())
        pieces = pc.split_pattern(cut, " ").flatten()
        pieces = pieces.filter(pc.not_equal(pieces, "")).dictionary_encode()
        flat, starts, stops = self._known(pieces.dictionary)
        which = pieces.indices.to_numpy()
        ids, ends = _spread(flat, starts[which], stops[which])
        return ids, ends[last]

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: each distinct word goes through the model once, then to its places."""
        lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        cuts = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        place = words.indices.to_numpy()
        flat, ends = self._model_ids(words.dictionary)
        starts = np.concatenate([[0], ends])[:-1]
        out, stops = _spread(flat, starts[place], ends[place])
        raw = out.tobytes()
        bounds = (4 * stops[cuts]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out, plain = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if text and self._plain(text):
                plain.append(i)
            elif text:
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if plain:
            for i, raw in zip(plain, self._plain_ids([texts[i] for i in plain]), strict=True):
                out[i] = raw
        return out

    def groups(self, texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """(first row, ids of each row) of consecutive rows with about GROUP bytes of text."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + GROUP, side="right")))
            yield at, self.ids(texts[at:stop].to_pylist())
            pa.default_memory_pool().release_unused()  # else an idle worker keeps what the largest group took
            at = stop


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    return Encoder(path)


def largest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(True).values())
