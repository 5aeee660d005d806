"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The field tags tokens (runs of letters and digits, or single signs) as secret begin, inside or
outside from their shape, their neighbours, the chunk between white space that they lie in, and
features of the whole file. One chain runs over all tokens of a whole text and is decoded by
Viterbi. A token whose score for outside exceeds the others by more than any neighbours can make
up for is outside in every best sequence; the chain falls apart there, so the decoding loop skips
such tokens without changing the result. The field is trained here, on pattern spans of a bounded
sample of pieces and on generated lines.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import fresh
from tallyweave.session import cut

#: Pieces of the corpus that training may use: those with the smallest hashes.
SAMPLE_CHUNKS = 1_500
EPOCHS, RATE, DECAY, SEED = 6, 0.3, 1e-4, 7
#: A field span shorter than this is not reported (values of the base patterns count from here too).
SHORTEST = 6

# Base patterns (fixed values) and the least length of the group that counts.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")
_PART = re.compile(r"[A-Za-z0-9]+|\s+|[^A-Za-z0-9\s]")
#: Where training looks for pieces: a letter beside a digit, a long run, digits parted by a sign, a rule word, or a fixed stride.
_CUE = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Za-z0-9]{14}|[0-9][-_.][A-Za-z0-9]|(?:passw|pwd|secret|token|key|auth|bearer|credential|login)", re.I)
STRIDE, REACH = 2_000, 60  # characters between plain pieces; characters around a cue
#: Tokens in front of a token in which a rule word counts.
RULE_REACH = 4
#: Different tokens whose kinds a task keeps between texts.
CACHE = 1 << 17
TAGS = 3  # outside, begin, inside
_RULES = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login")
_DIGITS, _FLIPS = re.compile("[0-9]+|[^0-9]+"), re.compile("[a-z][A-Z]")
_RULED = re.compile("(?ai)" + "|".join(_RULES))
_VOWELS = str.maketrans("", "", "aeiouAEIOU")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of every pattern match that counts, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def file_features(text: str) -> list[str]:
    low = text.lower()
    lines = text.count("\n") + 1
    signs = sum(map(text.count, "{}();="))
    return [f"file_rule={any(w in low for w in _RULES)}", f"file_code={signs * 50 > len(text)}", f"file_lines={min(lines.bit_length(), 6)}"]


def _shape(token: str) -> str:
    if not token.isascii():
        return "other"
    if not token.isalnum():
        return token
    kinds = [any(map(f, token)) for f in (str.islower, str.isupper, str.isdigit)]
    return "".join(k for k, on in zip("aA9", kinds, strict=True) if on)


def _rule(token: str) -> bool:
    return _RULED.search(token) is not None


def kind_of(token: str) -> tuple:
    """All that the features of a token depend on."""
    n = len(token)
    if n == 1 and not (token.isascii() and token.isalnum()):
        return token if token.isascii() else "other", 0, 0, 0, False, False, 0, -1, False, token
    low, alpha = token.islower(), token.isalpha()
    if low and alpha:
        shape, turns, flips = "a", 0, 0
    else:
        shape = _shape(token)
        turns = 0 if alpha else min(len(_DIGITS.findall(token)) - 1, 6)
        flips = 0 if low else min(len(_FLIPS.findall(token)), 4)
    hexes = n >= 8 and not token.strip("0123456789abcdef")
    vowels = 5 * (n - len(token.translate(_VOWELS))) // n if alpha and n >= 8 else -1
    return shape, min(n // 4, 8), min(n // 6, 5), turns, hexes, token.startswith("AKIA"), flips, vowels, _rule(token), "word"


def own_features(kind: tuple) -> list[str]:
    """Features of a token alone."""
    shape, length, wide, turns, hexes, akia, flips, vowels, _, _ = kind
    out = ["bias", f"shape={shape}", f"length={length}", f"turns={turns}", f"shape={shape}|length={wide}", f"hex={hexes}", f"akia={akia}", f"flips={flips}"]
    return [*out, f"vowels={vowels}|{shape}"] if vowels >= 0 else out


def _chunk_kind(groups: int, letters: bool, capitals: bool, digits: bool) -> int:
    return min(groups, 4) * 8 + letters * 4 + capitals * 2 + digits


def token_features(text: str, whole: list[str]) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Spans and features of all tokens of a text."""
    spots, features, at = [], [], 0
    for chunk in re.findall(r"\S+", text):
        start = text.index(chunk, at)
        at = start + len(chunk)
        tokens = _TOKEN.findall(chunk)
        kind = _chunk_kind(sum(t.isascii() and t.isalnum() for t in tokens), *(any(re.search(x, t) for t in tokens) for x in ("[a-z]", "[A-Z]", "[0-9]")))
        for m in _TOKEN.finditer(chunk):
            spots.append((m.start() + start, m.end() + start))
            features.append([f"glued={m.start() > 0}|{_shape(m[0])}", f"mail={'@' in chunk}", f"link={'://' in chunk}", f"chunk={kind}"])
    names = [text[a:b] for a, b in spots]
    for i, token in enumerate(names):
        rule = next((j for j in range(1, min(i, RULE_REACH) + 1) if _rule(names[i - j])), 0)
        features[i] += own_features(kind_of(token))
        features[i] += [
            f"rule={rule}", f"rule={rule > 0}|shape={_shape(token)}", f"before={_before(names[i - 1]) if i else 'none'}",
            f"next={_shape(names[i + 1]) if i + 1 < len(names) else 'none'}", *whole,
        ]
    return spots, features


def _before(token: str) -> str:
    return "word" if token.isascii() and token.isalnum() else token


class Field:
    """A linear chain over three tags with weights per (feature, tag) and (tag, tag)."""

    def __init__(self, weights: dict[str, list[float]] | None = None, moves: list[list[float]] | None = None):
        self.weights = weights or {}
        self.moves = np.array(moves if moves is not None else np.zeros((TAGS + 1, TAGS)))  # the last row: from the start
        self.moves[0, 2] = self.moves[TAGS, 2] = -1e4  # inside never follows outside

    def scores(self, features: list[list[str]]) -> np.ndarray:
        none = (0.0,) * TAGS
        return np.array([[sum(w[t] for w in found) for t in range(TAGS)] for found in ([self.weights.get(f, none) for f in fs] for fs in features)])

    def decode(self, features: list[list[str]]) -> list[int]:
        """The best tag sequence (Viterbi); equal scores take the smaller tag."""
        emit = self.scores(features)
        best, back = self.moves[TAGS] + emit[0], []
        for row in emit[1:]:
            total = best[:, None] + self.moves[:TAGS]
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + row
        tags = [int(best.argmax())]
        for came in reversed(back):
            tags.append(int(came[tags[-1]]))
        return tags[::-1]

    def fit(self, examples: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE) -> Field:
        """Maximum likelihood by stochastic steps with per-weight rates (Adagrad), in a fixed order."""
        order, seen = list(range(len(examples))), {}
        moves_seen = np.full_like(self.moves, 1e-8)
        shuffle = random.Random(SEED)
        for _ in range(epochs):
            shuffle.shuffle(order)
            for k in order:
                features, tags = examples[k]
                emit = self.scores(features)
                n = len(tags)
                ahead, behind = np.zeros((n, TAGS)), np.zeros((n, TAGS))
                ahead[0] = self.moves[TAGS] + emit[0]
                for i in range(1, n):
                    ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + self.moves[:TAGS], axis=0) + emit[i]
                for i in range(n - 2, -1, -1):
                    behind[i] = np.logaddexp.reduce(self.moves[:TAGS] + emit[i + 1] + behind[i + 1], axis=1)
                norm = np.logaddexp.reduce(ahead[-1])
                marginal = np.exp(ahead + behind - norm)
                slope = -marginal
                slope[np.arange(n), tags] += 1
                steps = np.zeros_like(self.moves)
                steps[TAGS] = slope[0]
                for i in range(1, n):
                    pair = np.exp(ahead[i - 1][:, None] + self.moves[:TAGS] + emit[i] + behind[i] - norm)
                    steps[:TAGS] -= pair
                    steps[tags[i - 1], tags[i]] += 1
                moves_seen += steps**2
                self.moves += rate * steps / np.sqrt(moves_seen)
                self.moves[0, 2] = self.moves[TAGS, 2] = -1e4
                for fs, s in zip(features, slope.tolist(), strict=True):
                    if max(map(abs, s)) < 1e-4:
                        continue
                    for f in fs:
                        w, g = self.weights.setdefault(f, [0.0] * TAGS), seen.setdefault(f, [1e-8] * TAGS)
                        for t in range(TAGS):
                            step = s[t] - DECAY * w[t]
                            g[t] += step * step
                            w[t] += rate * step / math.sqrt(g[t])
        return self


class _Ids(dict):
    """A number for every different token, made when it is first asked for."""

    def __init__(self, make):  # noqa: ANN001
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> int:
        number = self[part] = self.make(part)
        return number


class Chain:
    """Scores and best tags of whole texts under a field, by table look-ups per different token.

    Same features and same best sequence as :func:`token_features` with :meth:`Field.decode`.
    """

    # Columns of the scores of a kind: free, glued, free near a rule word, glued near one, as the token before, as the token after.
    _WIDE, _RULE, _BEFORE, _NEXT = 6, 2, 4, 5

    def __init__(self, field: Field):
        self.field = field
        moves = field.moves
        self._moves = moves.tolist()
        w = field.weights
        self._of = lambda *names: [sum(w[f][t] for f in names if f in w) for t in range(TAGS)]
        self._rules = np.array([self._of(f"rule={k}") for k in range(1, RULE_REACH + 1)])
        self._around = np.array([self._of(f"chunk={k}", f"mail={m}", f"link={x}") for x in (False, True) for m in (False, True) for k in range(40)])
        self._none = np.array(self._of("before=none")), np.array(self._of("next=none"))
        # What the moves can add at most if a token is tagged t and not outside: where no inside
        # follows, and where one follows and becomes a begin.
        last = np.append(moves[:TAGS], np.zeros((TAGS, 1)), axis=1)  # the last column: no token follows
        came = [max(moves[p, t] - moves[p, 0] for p in range(TAGS + 1)) for t in (1, 2)]
        goes = [max(last[t, n] - last[0, n] for n in (0, 1, TAGS)) for t in (1, 2)]
        again = max(last[2, n] - last[1, n] for n in range(TAGS + 1))
        self._bound = [c + g for c, g in zip(came, goes, strict=True)]
        self._bound_inside = [c + moves[t, 2] - moves[0, 1] + again for t, c in zip((1, 2), came, strict=True)]
        self._kinds: dict[tuple, int] = {}
        self._scores = np.zeros((1024 * self._WIDE, TAGS))
        self._facts = np.zeros((4, 1024), np.int64)  # rule word, run, letters and digits in it, sign
        self._ids = _Ids(self._id)

    def _id(self, part: str) -> int:
        """Number of the token's kind; 0 is white space."""
        if part.isspace():
            return 0
        kind = kind_of(part)
        if kind[-1] != "word" and f"before={kind[-1]}" not in self.field.weights and kind[-1] not in "@:/":
            kind = (*kind[:-1], "unseen")
        k = self._kinds.get(kind)
        if k is None:
            k = self._kinds[kind] = len(self._kinds) + 1
            if k == self._facts.shape[1]:
                self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
                self._facts = np.concatenate([self._facts, np.zeros_like(self._facts)], axis=1)
            shape, before = kind[0], kind[-1]
            run = before == "word"
            mix = 4 * ("a" in shape) + 2 * ("A" in shape) + ("9" in shape) if run else 0
            self._facts[:, k] = [kind[8], run, mix, {"@": 1, ":": 2, "/": 3}.get(before, 0)]
            own, free, glued = own_features(kind), f"glued=False|{shape}", f"glued=True|{shape}"
            near, far = f"rule=True|shape={shape}", f"rule=False|shape={shape}"
            self._scores[k * self._WIDE : (k + 1) * self._WIDE] = [
                self._of(*own, far, "rule=0", free), self._of(*own, far, "rule=0", glued), self._of(*own, near, free), self._of(*own, near, glued),
                self._of(f"before={before}"), self._of(f"next={shape}"),
            ]
        return k

    def emissions(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and tag scores of every token."""
        if len(self._ids) > CACHE:
            self._ids.clear()
        parts = _PART.findall(text)
        ids = np.fromiter(map(self._ids.__getitem__, parts), np.int64, len(parts))
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        is_token = ids > 0
        spot = np.flatnonzero(is_token)
        n = len(spot)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TAGS))
        chunk = np.cumsum(~is_token)[spot]  # white space parts tokens, so equal numbers share a chunk
        lengths = np.diff(ends, prepend=0)[spot]
        ids, ends = ids[spot], ends[spot]
        starts = ends - lengths
        known = self._facts
        glued = np.zeros(n, bool)
        glued[1:] = chunk[1:] == chunk[:-1]
        heads = np.flatnonzero(~glued)
        of = np.cumsum(~glued) - 1
        sign = known[3].take(ids)
        mail = np.maximum.reduceat(sign == 1, heads)
        link = np.zeros(n, bool)
        if n > 2:
            link[:-2] = (sign[:-2] == 2) & (sign[1:-1] == 3) & (sign[2:] == 3) & glued[1:-1] & glued[2:]
        link = np.maximum.reduceat(link, heads)
        groups = np.minimum(np.add.reduceat(known[1].take(ids), heads), 4)
        kinds = np.bitwise_or.reduceat(known[2].take(ids), heads)
        rule = np.zeros(n, np.int64)
        cues = np.flatnonzero(known[0].take(ids))
        for k in range(RULE_REACH, 0, -1):
            at = cues + k
            rule[at[at < n]] = k
        base = ids * self._WIDE
        emit = self._scores.take(base + glued + self._RULE * (rule > 0), axis=0)
        at = np.flatnonzero(rule)
        emit[at] += self._rules[rule[at] - 1]
        emit[1:] += self._scores.take(base[:-1] + self._BEFORE, axis=0)
        emit[:-1] += self._scores.take(base[1:] + self._NEXT, axis=0)
        emit[0] += self._none[0]
        emit[-1] += self._none[1]
        around = self._around.take(groups * 8 + kinds + 40 * mail + 80 * link, axis=0) + np.array(self._of(*file_features(text)))
        emit += around.take(of, axis=0)
        return starts, ends, emit

    def decode(self, emit: np.ndarray) -> list[tuple[int, int]]:
        """Token index and tag of every token that is not outside in the best sequence."""
        ahead = np.full(len(emit), -np.inf)
        ahead[:-1] = emit[1:, 2] - emit[1:, 1]
        open_ = np.zeros(len(emit), bool)
        for t, bound, inside in zip((1, 2), self._bound, self._bound_inside, strict=True):
            open_ |= emit[:, 0] - emit[:, t] <= np.maximum(bound, inside + ahead) + 1e-9
        at = np.flatnonzero(open_)
        out: list[tuple[int, int]] = []
        if not len(at):
            return out
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            first, last = int(run[0]), int(run[-1])
            out += self._best(first, emit[first : last + 1].tolist(), last + 1 < len(emit))
        return out

    def _best(self, first: int, emit: list[list[float]], more: bool) -> list[tuple[int, int]]:
        moves = self._moves
        came = moves[0] if first else moves[TAGS]
        best, back = [c + e for c, e in zip(came, emit[0], strict=True)], []
        for row in emit[1:]:
            new, froms = [], []
            for t in range(TAGS):
                values = [best[p] + moves[p][t] for p in range(TAGS)]
                top = max(values)
                froms.append(values.index(top))
                new.append(top + row[t])
            best = new
            back.append(froms)
        if more:  # the next token is outside
            best = [b + moves[t][0] for t, b in enumerate(best)]
        tags = [best.index(max(best))]
        for froms in reversed(back):
            tags.append(froms[tags[-1]])
        return [(first + i, t) for i, t in enumerate(reversed(tags)) if t]


def label(spots: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[int]:
    """Tags of tokens under secret spans (the value, without the name before it)."""
    tags, inside = [], None
    for a, b in spots:
        at = next((s for s in spans if s[0] <= a and b <= s[1]), None)
        tags.append(0 if at is None else 2 if at == inside else 1)
        inside = at
    return tags


def values(text: str) -> list[tuple[int, int]]:
    """Spans of secret values under the base patterns."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] + [m.span() for m in HEX.finditer(text)]
    return sorted(out)


def generated(n: int = 600, seed: int = SEED) -> list[tuple[list[list[str]], list[int]]]:
    """Training lines made from templates: secrets in many settings, and things that look alike."""
    rng = random.Random(seed)

    def chars(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))

    hexes, alnum = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    words = "the and of to is here value note see from with item page user order list".split()
    long = "correct horse battery staple monday river window orange purple dragon summer garden winter market engine simple forest castle silver".split()

    def secret() -> str:
        return rng.choice([
            lambda: chars(hexes, 16, 40), lambda: chars(alnum, 16, 40), lambda: "AKIA" + chars(alnum.upper(), 16, 16),
            lambda: "ghp_" + chars(alnum, 30, 36), lambda: "sk-" + chars(alnum, 24, 40), lambda: chars(alnum, 10, 14) + rng.choice("-_.") + chars(alnum, 8, 14),
        ])()

    def harmless() -> str:
        return rng.choice([
            lambda: f"{chars(alnum[:24], 3, 8)}{rng.randint(1, 99)}@{chars(alnum[:24], 3, 8)}.example.com", lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
            lambda: f"{chars(alnum[:24], 3, 7)}{rng.randint(1, 9999)}", lambda: f"https://{chars(alnum[:24], 4, 8)}.org/p{rng.randint(1, 999)}/{chars(alnum[:24], 3, 9)}",
            lambda: f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}:00", lambda: f"{rng.randint(1, 99)}{rng.choice(['kg', 'km', 'th', 'px', 'GB'])}",
            lambda: f"{chars(alnum[:24], 4, 8)}_{rng.randint(1, 99)}.txt",
        ])()

    def letters() -> str:
        return rng.choice([
            lambda: "".join(rng.choice(long) for _ in range(rng.randint(2, 4))), lambda: chars(alnum[:48], 14, 30), lambda: chars(alnum[:24], 12, 24), lambda: chars(alnum[24:48], 12, 24),
        ])()

    def parted() -> str:
        sign, kind = rng.choice("--_."), rng.choice([alnum[24:48], "0123456789", alnum[24:48] + "0123456789", hexes])
        size = rng.choice([4, 4, 5, 6])
        if rng.random() < 0.4:
            return sign.join(chars(rng.choice([alnum[24:48], "0123456789"]), size, size) for _ in range(rng.randint(3, 5)))
        return sign.join(chars(kind, size, size) for _ in range(rng.randint(3, 5)))

    def alike() -> str:
        """Lines with rule words or secret-like shapes that hold no secret."""
        name = rng.choice(_RULES)
        return rng.choice([
            lambda: f"the {name} is {rng.choice(['required', 'wrong', 'missing', 'optional', 'described', 'important', 'necessary'])}", lambda: f"{name} {rng.choice(long)} {rng.choice(long)}",
            lambda: f"{name}: {rng.choice(['string', 'none', 'required', 'optional', 'integer', 'see below'])}", lambda: f"{name} = {rng.choice(['None', 'null', 'value', 'getUserName()', 'request.headers'])}",
            lambda: f"{rng.choice(long)}-{rng.choice(long)}-{rng.choice(long)}", lambda: f"{rng.choice(['internationalization', 'responsibilities', 'characteristics', 'telecommunications'])}",
            lambda: f"{rng.randint(1, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: f"{rng.randint(1, 9)},{rng.randint(100, 999)},{rng.randint(100, 999)}",
            lambda: f"{rng.choice(long)}{rng.choice(long).title()}{rng.choice(long).title()}({rng.choice(long)})", lambda: f"{rng.randint(1, 10**9)}", lambda: f"{name} {rng.choice(words)} {rng.choice(words)}",
            lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.choice(['author', 'authority', 'keyboard', 'monkey', 'tokens'])} {rng.choice(long)}", lambda: f"{rng.choice(long)}_{rng.choice(long)}_{rng.choice(long)}",
        ])()

    out = []
    for _ in range(n):
        near = " ".join(rng.choice(words) for _ in range(4))
        if rng.random() < 0.5:
            value, name = rng.choice([secret, secret, letters, parted, lambda: chars("0123456789", 8, 20)])(), rng.choice([*_RULES, *_RULES, "Authorization: Bearer", "license key", "DB_PASSWORD"])
            setting = rng.choice(["{} is {}", "{}={}", "{}: {}", '{} = "{}"', "{} -> {}", "{} {}", "my {} was {}", "'{}': '{}'"])
            if name.endswith("Bearer"):
                setting = "{} {}"
            head = f"{near} " + setting.partition("{}")[0] + name + setting.partition("{}")[2].partition("{}")[0]
            text = head + value + setting.rpartition("{}")[2] + " " + near
            spans = [(len(head), len(head) + len(value))]
        elif rng.random() < 0.5:
            text, spans = f"{near} {rng.choice(['', 'token ', 'key ', 'id '])}{harmless()} {near}", []
        else:
            text, spans = f"{near} {alike()} {near}", []
        spots, features = token_features(text, file_features(text))
        out.append((features, label(spots, spans)))
    return out


def pieces(text: str) -> Iterator[str]:
    """Stretches around what may be a secret, and one in every ``STRIDE`` characters, cut at white space."""
    done = at = 0
    while at < len(text):
        m = _CUE.search(text, at, at + STRIDE)
        here = m.start() if m else at
        low, high = max(done, here - REACH), min(len(text), (m.end() if m else at) + REACH)
        piece = text[low:high]
        if low and not text[low - 1].isspace():
            piece = piece.partition(" ")[2]
        if high < len(text) and not text[high].isspace():
            piece = piece.rpartition(" ")[0]
        if piece.strip():
            yield piece
        done = high
        at = high if m else at + STRIDE


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE_CHUNKS) -> Field:
    """A field fitted to generated lines and to at most ``sample`` pieces of ``docs`` that patterns label.

    Pieces come from the ``sample`` texts with the smallest hashes. Every task passes on those of
    its pieces with the smallest hashes, at most ``sample``.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[str, str]] = {}
        limit = 1 << 64
        for batch in batches:
            for value in batch.column(0):
                whole = value.as_py()
                near: str | None = None
                for piece in pieces(whole):
                    h = int.from_bytes(hashlib.blake2b(piece.encode(errors="replace"), digest_size=8).digest(), "big")
                    if h >= limit:
                        continue
                    near = near or json.dumps(file_features(whole))
                    held[h] = min(held.get(h, (near, piece)), (near, piece))
                    if len(held) >= 2 * sample:
                        held = dict(sorted(held.items())[:sample])
                        limit = max(held) + 1
        kept = sorted(held.items())[:sample]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{h:016x}" for h, _ in kept], pa.string()), pa.array([x[0] for _, x in kept], pa.string()), pa.array([x[1] for _, x in kept], pa.string())],
            ["h", "near", "piece"],
        )

    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    drawn = F.xxhash64("_text")
    few = [r["h"] for r in texts.select(drawn.alias("h")).distinct().orderBy("h").limit(sample).collect()]
    texts = texts.filter(drawn <= max(few, default=0))
    found = texts.mapInArrow(emit, "h string, near string, piece string").groupBy("h").agg(F.min(F.struct("near", "piece")).alias("x"))
    examples = []
    for row in found.orderBy("h").limit(sample).collect():
        piece = row["x"]["piece"]
        spots, features = token_features(piece, json.loads(row["x"]["near"]))
        examples.append((features, label(spots, values(piece))))
    return Field().fit(generated() + examples)


def field_spans(text: str, chain: Chain, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that the field tags and that touch none of ``taken``."""
    starts, ends, emit = chain.emissions(text)
    if not len(emit):
        return []
    found: list[list[int]] = []
    before = -1
    for i, tag in chain.decode(emit):
        if tag == 2 and found and before == i - 1 and starts[i] == found[-1][1]:
            found[-1][1] = int(ends[i])
        else:
            found.append([int(starts[i]), int(ends[i])])
        before = i
    return [(a, b, "crf") for a, b in found if b - a >= SHORTEST and not any(s[0] < b and s[1] > a for s in taken)]


def scan_secrets(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: start, end and kind of every span, by start and then kind.

    Spans count code points, end exclusive, over whole texts. Base kinds (``assign``, ``access``,
    ``hex``) come from patterns and always stay; ``crf`` spans are those of the field that overlap
    none of them. A null or empty text has none. A column named ``secrets`` is replaced, others
    pass through; repeated rows and an empty table need no special case. Without ``field``, one is
    trained on ``docs``.
    """
    model = field or train(docs, text)
    weights, moves = model.weights, model.moves.tolist()
    kept = docs.drop("secrets")
    rows = kept.select("*", F.coalesce(F.col(text).cast("string"), F.lit("")).alias(fresh(kept, "_text")))
    spot = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    names = kept.columns
    schema = T.StructType([*[kept.schema[c] for c in names], T.StructField("secrets", spot)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType([T.StructField("secrets", spot)])).field(0).type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Chain(Field(weights, moves))
        for batch in batches:
            found = []
            for value in batch.column(len(names)):
                whole = value.as_py()
                spans = base_spans(whole)
                extra = field_spans(whole, known, spans)
                if extra:
                    spans = sorted(spans + extra, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(found, arrow)], [*names, "secrets"])

    return rows.mapInArrow(scan, schema)


def redact(docs: DataFrame, field: Field | None = None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; overlapping spans become one mark. Columns pass through."""
    held = fresh(docs, "secrets")
    scanned = scan_secrets(docs.withColumnRenamed("secrets", held) if held != "secrets" else docs, field, text)
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, span):  # noqa: ANN001, ANN202
        inside = span["start"] < acc["at"]
        between = F.substr(F.col(text), (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], span["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], between, F.lit(mark))).alias("out")
        )

    cleaned = F.aggregate("secrets", state, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), (acc["at"] + 1).cast("int"))))
    clean = scanned.withColumn(text, F.when(F.size("secrets") > 0, cleaned).otherwise(F.col(text))).drop("secrets")
    return clean.withColumnRenamed(held, "secrets").select(*docs.columns)
