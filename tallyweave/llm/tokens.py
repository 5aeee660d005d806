"""Token ids of whole texts by a public word BPE, each distinct pre-token encoded once per task."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Distinct pre-tokens that a task remembers; it starts anew beyond that. About 100 MB.
CACHE_WORDS = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _classes() -> tuple[str, str, str]:
    """Letters, numbers and signs among the characters that the short way handles, as regex classes.

    These are unchanged by NFC, and Python and the tokenizer agree on their lower case. Texts
    with any other character go through the tokenizer whole.
    """
    plain = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]) if c not in "­İ"]
    plain += list("–—‘’“”„…€")

    def of(kinds: str) -> str:
        return "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] in kinds)

    return of("L"), of("N"), of("PSC")


class WordBpe:
    """Ids as little-endian unsigned 32-bit numbers, equal to the tokenizer's own on every text."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        letters, numbers, signs = _classes()
        self.plain = re.compile(f"[ \\t\\n\\r{letters}{numbers}{signs}]*")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[{signs}]+").findall
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if "<|" in text or not self.plain.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts = self.split(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            self.learn(list(set(parts).difference(self.known)))
            return b"".join(map(self.known.__getitem__, parts))

    def learn(self, new: list[str]) -> None:
        """Encode pre-tokens as one text; every pre-token ends in a token that ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new):
            raise ValueError("the tokenizer splits a pre-token again")
        at = 0
        for word, upto in zip(new, cuts.tolist(), strict=True):
            self.known[word] = ids[at:upto].tobytes()
            at = upto


_ENCODERS: dict[str | None, WordBpe] = {}


def encoder(path: str | None = None) -> WordBpe:
    """One encoder per worker process and vocabulary. What it has learned is to be forgotten at a task's end."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]
