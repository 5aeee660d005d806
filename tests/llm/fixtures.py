"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

WORDS = "the quick brown fox jumps over lazy dogs while seven old owls watch from tall green trees near water".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


def documents():
    """doc_id, text, lang, source and a column that clashes with outputs."""
    base = prose(60, 1)
    near = base.split()
    near[-1] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, prose(80, 2), "en", "a"), (5, "", "en", None),
        (6, None, None, "a"), (7, "one two", "en", "a"), (7, "one two", "en", "a"), (8, prose(6000, 3), "de", "b"), (None, prose(40, 4), None, None),
        (None, prose(40, 4), None, None), (9, "x" * 30_000, "en", "a"), (10, "wörter und ßymbole ŉ … “q” 漢字 😀 İ Σ\n\n\tend\x0b", "de", "b"),
        (11, "same line\nsame line\nsame line\nother", "en", "a"), (12, "go " * 50, "en", "a"),
    ]
    return [(*r, "clash", -5) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, kept string, n_words int"
