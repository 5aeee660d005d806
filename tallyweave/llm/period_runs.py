"""Periodic runs of words by a dictionary of basic factors.

A run is a longest stretch of words that repeats with a smallest period. For every power of two the
factors (stretches) of that many words get names, each from the names of its two halves, so equal
factors have equal names. The next occurrence of a factor within twice its length proposes the
distance as a period. In a run such occurrences follow one another in arithmetic progressions, and
neighbouring factors of a run give the same progression shifted by one; they are one proposal,
which is extended word by word to both sides and kept once.

Periods above L and up to 2L are proposed by factors of L words, and periods 1 and 2 by single
words, so each run comes from one level only. A cyclic word of q letters that is no power has more
than q / 2 different factors of L words when q / 2 <= L < q, so one of them occurs once in a
period; a run of three periods or more contains it and its next occurrence. Names of factors
that occur once are dropped, so a level costs no more than the repeated factors it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.llm.common import span_hashes, text_chunks, words

#: A run has at least so many words and so many periods.
MIN_WORDS = 6
MIN_PERIODS = 4


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Numbers of words: equal within one document if and only if the words are equal, never across documents."""
    hashes = span_hashes(data, starts, ends)
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        same[1:] = (owner[a] == owner[b]) & (hashes[a] == hashes[b])
        pairs = np.flatnonzero(same)
        if len(pairs) and not _bytes_equal(data, starts, ends, order[pairs - 1], order[pairs]):
            return _exact_names(data, starts, ends, owner)
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(~same)
    return names


def _bytes_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray) -> bool:
    """Whether every word of ``left`` has the bytes of its partner in ``right``."""
    size = ends[left] - starts[left]
    if not np.array_equal(size, ends[right] - starts[right]):
        return False
    total = np.cumsum(size)
    step = np.arange(total[-1]) - np.repeat(total - size, size)
    return np.array_equal(data[np.repeat(starts[left], size) + step], data[np.repeat(starts[right], size) + step])


def _exact_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Names by the bytes themselves, for the case that two words share a hash."""
    raw, known = data.tobytes(), {}
    keys = zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True)
    return np.array([known.setdefault((o, raw[a:b]), len(known)) for o, a, b in keys], np.int64)


def _grow(word: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The longest stretch around [start, end) that keeps ``period``."""
    step = 8
    while end < len(word):
        upto = min(end + step, len(word))
        differ = word[end:upto] != word[end - period : upto - period]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = upto, step * 2
    step = 8
    while start > 0:
        down = max(start - step, 0)
        differ = (word[down:start] != word[down + period : start + period])[::-1]
        if differ.any():
            start -= int(differ.argmax())
            break
        start, step = down, step * 2
    return start, end


def _extended(word: np.ndarray, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray, min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) that come from proposals; a proposal inside a run already found adds none."""
    need = np.maximum(min_words, min_periods * periods)
    right = ends < len(word)
    right[right] = word[ends[right]] == word[(ends - periods)[right]]
    left = starts > 0
    left[left] = word[starts[left] - 1] == word[(starts + periods)[left] - 1]
    able = (ends - starts >= need) | left | right
    starts, ends, periods, need = starts[able], ends[able], periods[able], need[able]
    order = np.lexsort((starts, periods))
    found, upto, of = [], -1, -1
    for a, b, q, least in zip(starts[order].tolist(), ends[order].tolist(), periods[order].tolist(), need[order].tolist(), strict=True):
        if q == of and b <= upto:
            continue
        a, upto = _grow(word, a, b, q)
        of = q
        if upto - a >= least:
            found.append((a, upto, q))
    return found


def periodic_runs(word: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the sequence ``word``, by start and then period."""
    if min_periods < 3:
        raise ValueError("a run of fewer than three periods need not contain a factor that proposes its period")
    at = np.arange(len(word), dtype=np.int64)  # places of factors that occur more than once
    names = np.asarray(word, np.int64)
    size, found = 1, []
    while len(at):
        order = np.argsort(names, kind="stable")
        ranked, where = names[order], at[order]
        again = np.zeros(len(order), bool)
        again[1:] = ranked[1:] == ranked[:-1]
        gap = np.zeros(len(order), np.int64)
        gap[1:][again[1:]] = (where[1:] - where[:-1])[again[1:]]
        chosen = (gap > size) & (gap <= 2 * size) if size > 1 else (gap > 0) & (gap <= 2)
        first, period = where[chosen] - gap[chosen], gap[chosen]
        if len(first):
            by_place = np.lexsort((first, period))
            first, period = first[by_place], period[by_place]
            fresh = np.ones(len(first), bool)
            fresh[1:] = (period[1:] != period[:-1]) | (first[1:] != first[:-1] + 1)
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], len(first)) - 1
            found += _extended(word, first[heads], first[tails] + period[tails] + size, period[heads], min_words, min_periods)
        # names of factors twice as long, where both halves occur again
        shared = again.copy()
        shared[:-1] |= again[1:]
        name_at = np.full(len(word) + size, -1, np.int64)
        name_at[where[shared]] = np.cumsum(~again)[shared]
        at = np.sort(where[shared])
        other = name_at[at + size]
        at, other = at[other >= 0], other[other >= 0]
        names = name_at[at] * (len(word) + 1) + other
        size *= 2
    return sorted((a, b - a, q) for a, b, q in found)


def find_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``runs``, ``collapsed``.

    ``runs`` lists the runs (start, length, period, in words from 0) by start, then period.
    ``collapsed`` is the text's words joined by one space without those that lie in a run behind its
    first period. Words are runs of characters other than space, tab and line breaks. A null or empty
    text has no words, no runs and an empty collapsed text; repeated rows and null keys give rows of
    their own; a text of any length is read whole, by one task; other columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([
        T.StructField(key, rows.schema["_key"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                starts, ends, firsts = words(data, offsets)
                counts = np.diff(firsts)
                owner = np.repeat(np.arange(hi - lo), counts)
                found = periodic_runs(word_names(data, starts, ends, owner), min_words, min_periods)
                # no run spans two documents, as these share no names
                drop = np.zeros(len(starts) + 1, np.int64)
                for a, n, q in found:
                    drop[a + q] += 1
                    drop[a + n] -= 1
                kept = np.cumsum(drop[:-1]) == 0
                runs = [[] for _ in range(hi - lo)]
                for a, n, q in found:
                    runs[owner[a]].append({"start": a - int(firsts[owner[a]]), "length": n, "period": q})
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo).cast(arrow.field(0).type), pa.array(counts, pa.int64()), pa.array(runs, arrow.field(2).type),
                     pa.array(_joined(data, starts[kept], ends[kept], owner[kept], hi - lo), pa.string())],
                    schema=arrow,
                )

    return rows.mapInArrow(scan, schema)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """The given words of each document, joined by one space."""
    size = ends - starts + 1  # with the space behind
    upto = np.cumsum(size)
    out = np.full(int(upto[-1]) if len(upto) else 0, 0x20, np.uint8)
    step = np.arange(len(out)) - np.repeat(upto - size, size)
    inside = step < np.repeat(size - 1, size)
    out[inside] = data[(np.repeat(starts, size) + step)[inside]]
    raw = out.tobytes()
    bounds = np.concatenate([[0], upto])[np.searchsorted(owner, np.arange(n + 1))]
    return [raw[a : max(b - 1, a)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of :func:`find_runs`: number of runs, the longest (smallest start, then period, among equals), and hashes."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    made = found.withColumn("_best", best)
    return made.select(
        key, F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_best.back")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.less")).alias("period"), F.call_function("div", F.col("_best.length") * 1000, -F.col("_best.less")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
