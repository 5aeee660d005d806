"""Token counts by a unigram model, with dynamic programming shared over a trie of pre-tokens.

Each task collects the distinct pre-tokens that it hasn't met, sorts them and reads the sorted
list as a trie: a node is a prefix that the word before doesn't share. The forward score of a
node, the best sum of piece scores over all ways to cut the prefix, is computed once, level by
level, from the scores of its ancestors; words keep the token count of their terminal node.
Counting needs no shuffle, and what a task remembers is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens that a task remembers before it starts anew, and how many make one trie.
CACHE_WORDS, TRIE_WORDS = 600_000, 50_000
#: Longer pre-tokens are scored on their own: a path that shares nothing.
TRIE_DEPTH = 48
WORD_START = "▁"
#: Natural logarithm by which a byte of an unknown character scores below the rarest piece.
BYTE_PENALTY = 10.0

_BASE = np.uint64(0x9E3779B97F4A7C15)


def zipf_scores(pieces: list[str], shift: float = 2.7) -> dict[str, float]:
    """Log-probabilities of pieces in order of frequency, by the law of Zipf and Mandelbrot."""
    total = math.log(sum(1 / (r + shift) for r in range(1, len(pieces) + 1)))
    return {piece: -math.log(r + shift) - total for r, piece in enumerate(pieces, 1)}


def load_pieces(path: str | None = None) -> list[str]:
    """Ordinary pieces of a public vocabulary in order of rank; control and byte pieces are left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Unigram:
    """Best segmentations under piece scores. Unknown characters count as their UTF-8 bytes.

    Equal scores: the shorter last piece wins. Substrings are looked up by 64-bit hash.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.byte = min(scores.values()) - BYTE_PENALTY
        hashes: dict[int, float] = {}
        for piece, score in scores.items():
            h = 0
            for depth, c in enumerate(reversed(piece), 1):  # every piece read backwards, and its prefixes
                h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
                if depth == len(piece):
                    hashes[h] = score
                else:
                    hashes.setdefault(h, -math.inf)
        self.keys = np.array(sorted(hashes), dtype=np.uint64)
        self.values = np.array([hashes[int(k)] for k in self.keys])

    def alone(self, word: str) -> tuple[int, float]:
        """Token count and score of one string."""
        best, count = [0.0], [0]
        for i in range(1, len(word) + 1):
            single = self.scores.get(word[i - 1])
            size = 1 if single is not None else len(word[i - 1].encode())
            top, tokens = best[i - 1] + (single if single is not None else self.byte * size), count[i - 1] + size
            for length in range(2, min(i, self.longest) + 1):
                score = self.scores.get(word[i - length : i])
                if score is not None and best[i - length] + score > top:
                    top, tokens = best[i - length] + score, count[i - length] + 1
            best.append(top)
            count.append(tokens)
        return count[-1], best[-1]

    def many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and scores of sorted distinct strings of at most ``TRIE_DEPTH`` characters."""
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        depth = int(lengths.max(initial=0))
        if not n or not depth:
            return np.zeros(n, np.int64), np.zeros(n)
        codes = np.array(words, dtype=f"<U{depth}").view(np.uint32).reshape(n, depth).astype(np.uint64)
        shared = np.zeros(n, np.int64)
        shared[1:] = np.logical_and.accumulate(codes[1:] == codes[:-1], axis=1).sum(axis=1)
        rows = np.arange(n)
        # node[d][i]: the row that holds the node of row i's first d characters
        node = np.zeros((depth + 1, n), np.int64)
        best, count = np.zeros((depth + 1, n)), np.zeros((depth + 1, n), np.int64)
        for d in range(1, depth + 1):
            fresh = (lengths >= d) & (shared < d)
            node[d] = np.maximum.accumulate(np.where(fresh, rows, 0))
            at = rows[fresh]
            code = codes[at, d - 1]
            size = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
            top = np.full(len(at), -np.inf)
            tokens = np.zeros(len(at), np.int64)
            live, h = np.arange(len(at)), np.zeros(len(at), np.uint64)
            for length in range(1, min(d, self.longest) + 1):
                h = h * _BASE + codes[at[live], d - length] + np.uint64(1)
                spot = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[spot] == h
                score = np.where(hit, self.values[spot], -np.inf)
                if length == 1:  # every character can stand alone, an unknown one as bytes
                    known = score > -np.inf
                    score = np.where(known, score, self.byte * size)
                    added = np.where(known, 1, size)
                else:
                    added = 1
                above = node[d - length, at[live]]
                total = best[d - length, above] + score
                better = total > top[live]
                top[live] = np.where(better, total, top[live])
                tokens[live] = np.where(better, count[d - length, above] + added, tokens[live])
                live, h = live[hit], h[hit]
                if not len(live):
                    break
            best[d, at], count[d, at] = top, tokens
        ends = node[lengths, rows]
        return count[lengths, ends], best[lengths, ends]


class Counter:
    """Counts and scores of whole texts in one task, each distinct pre-token scored once."""

    def __init__(self, model: Unigram):
        self.model = model
        self.index: dict[str, int] = {}
        self.counts, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.index) > CACHE_WORDS:
            self.index, self.counts, self.scores = {}, np.zeros(0, np.int64), np.zeros(0)
        new: set[str] = set()
        for words in texts:
            new.update(words)
        new.difference_update(self.index)
        short = sorted(w for w in new if len(w) < TRIE_DEPTH)
        for at in range(0, len(short), TRIE_WORDS):
            part = short[at : at + TRIE_WORDS]
            self._add(part, *self.model.many([WORD_START + w for w in part]))
        for word in new:
            if len(word) >= TRIE_DEPTH:
                count, score = self.model.alone(WORD_START + word)
                self._add([word], np.array([count]), np.array([score]))

    def _add(self, words: list[str], counts: np.ndarray, scores: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.counts), len(self.counts) + len(words)), strict=True))
        self.counts, self.scores = np.concatenate([self.counts, counts]), np.concatenate([self.scores, scores])

    def total(self, words: list[str]) -> tuple[int, float]:
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return int(self.counts[at].sum()), float(self.scores[at].sum())


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", pieces: str | None = None) -> DataFrame:
    """Per row: ``key``, ``n_pretokens``, ``n_tokens`` and ``log_score``, the score of the best cut.

    Pre-tokens are runs without white space, each with a leading word mark. A null or empty text
    has no tokens and score 0. Repeated rows and null keys are rows of their own; other columns
    are ignored; an empty table gives no rows. ``pieces`` is the path of a vocabulary file.
    """
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType(
        [
            T.StructField(key, rows.schema[key].dataType), T.StructField("n_pretokens", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("log_score", T.DoubleType()),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Unigram(zipf_scores(load_pieces(pieces))))
        for batch in batches:
            held, size, first = [], 0, 0
            for i, value in enumerate(batch.column(1)):
                held.append(value.as_py().split())
                size += len(held[-1])
                if size >= 500_000 or i + 1 == batch.num_rows:
                    counter.learn(held)
                    totals = [counter.total(words) for words in held]
                    out = [
                        batch.column(0).slice(first, len(held)), pa.array([len(w) for w in held], pa.int64()),
                        pa.array([t[0] for t in totals], pa.int64()), pa.array([t[1] for t in totals], pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(out, schema.names)
                    held, size, first = [], 0, i + 1

    return rows.mapInArrow(count, schema)
