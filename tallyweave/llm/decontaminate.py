"""Benchmark decontamination by pigeonhole edit matching.

An item may occur with up to ``k`` edits, a share of its length. It is split into ``k + 1``
pieces, so at least one piece of every such occurrence is exact: all pieces are found in one pass
over a text by a multi-pattern automaton. The same counting over pairs of neighbouring pieces says
that a pair has at most one edit (or a piece without neighbour none), which is checked next to the
hit before the whole item is verified around it by Myers' bit-parallel distance.

Texts and items are compared in lower case with every run of white space as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import fresh

#: Edits allowed, as a share of an item's length.
ERROR_RATE = 0.12
#: Characters of items that one pass over the documents looks for.
BLOCK_CHARS = 2_000_000


def normalize(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edits of the pattern against any substring of the text, and where its first such end is.

    None if that takes more than ``budget`` edits.
    """
    m = len(pattern)
    if not m:
        return (0, 0)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | (1 << i)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, None
    for end, c in enumerate(text, 1):
        equal = at.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus, minus = (down | ~(horizontal | up)) & mask, up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up, down = (minus | ~(vertical | plus)) & mask, plus & vertical
        if score <= budget and (best is None or score < best[0]):
            best = (score, end)
    return best


def one_edit_prefix(pattern: str, text: str) -> bool:
    """Whether a prefix of ``text`` is the pattern with at most one edit."""
    n = len(pattern)
    if text.startswith(pattern):
        return True
    i = 0
    limit = min(n, len(text))
    while i < limit and pattern[i] == text[i]:
        i += 1
    rest = pattern[i + 1 :]
    # from the first difference on: another character, a missing one, or one too many in the text
    swapped = i < len(text) and text.startswith(rest, i + 1)
    return swapped or text.startswith(rest, i) or text.startswith(pattern[i:], i + 1)


@dataclass
class Items:
    """Pieces of a block of items in one automaton."""

    texts: list[str]
    budgets: list[int]
    pieces: dict[str, list[tuple[int, int, str, str]]] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: list[str], rate: float = ERROR_RATE) -> Items:
        texts = [normalize(t) for t in raw]
        out = cls(texts, [min(int(len(t) * rate), max(len(t) - 1, 0)) for t in texts])
        for i, (text, budget) in enumerate(zip(texts, out.budgets, strict=True)):
            if not text:
                continue
            cuts = [len(text) * p // (budget + 1) for p in range(budget + 2)]
            parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            for p, part in enumerate(parts):
                left = parts[p - 1] if p % 2 else ""
                right = parts[p + 1] if p % 2 == 0 and p + 1 < len(parts) else ""
                out.pieces.setdefault(part, []).append((i, cuts[p], left, right))
        return out

    def automaton(self):  # noqa: ANN201
        import ahocorasick

        made = ahocorasick.Automaton()
        for part, uses in self.pieces.items():
            made.add_word(part, (len(part), uses))
        if self.pieces:
            made.make_automaton()
        return made

    def find(self, text: str, automaton) -> list[tuple[int, int, int]]:  # noqa: ANN001
        """Item, least distance and first such end for every item within its budget in a normalised text."""
        seen: dict[int, list[int]] = {}
        best: dict[int, tuple[int, int]] = {}
        for last, (size, uses) in automaton.iter(text):
            begin, end = last + 1 - size, last + 1
            for item, offset, left, right in uses:
                start = begin - offset
                budget = self.budgets[item]
                spots = seen.get(item)
                if spots and any(abs(start - s) <= budget for s in spots):
                    continue
                if right and not one_edit_prefix(right, text[end : end + len(right) + 1]):
                    continue
                if left and not one_edit_prefix(left[::-1], text[max(0, begin - len(left) - 1) : begin][::-1]):
                    continue
                # any occurrence with this piece at a diagonal within the budget of this one lies in this window
                low = max(0, start - 2 * budget)
                found = myers(self.texts[item], text[low : start + len(self.texts[item]) + 2 * budget], budget)
                seen.setdefault(item, []).append(start)
                if found and (item not in best or (found[0], found[1] + low) < best[item]):
                    best[item] = (found[0], found[1] + low)
        return [(item, d, end) for item, (d, end) in sorted(best.items())]


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of bounded size, read one partition at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    for row in rows.distinct().toLocalIterator():
        ids.append(row["k"])
        texts.append(row["t"])
        size += len(row["t"])
        if size >= BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE
) -> DataFrame:
    """``docs`` with ``items``: item, distance and end (in the normalised text) of every item that occurs.

    Per item the least distance and its first end. Whole texts are searched; null and empty texts
    and items match nothing. Items are taken in blocks of bounded size, each in a pass of its own
    over all documents; items with equal keys and texts count once. A column named ``items`` is
    replaced, others pass through; repeated rows and empty tables need no special case.
    """
    kind = benchmark.schema[item].dataType
    hit = T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("distance", T.LongType()), T.StructField("end", T.LongType())]))
    out = docs.drop("items")
    names = out.columns
    out = out.withColumn("items", F.array().cast(hit))
    from pyspark.sql.pandas.types import to_arrow_schema

    def search(block: Items, ids: list):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = block.automaton()
            for batch in batches:
                found = []
                for value, before in zip(batch.column(len(names) + 1), batch.column(len(names)), strict=True):
                    whole = normalize(value.as_py())
                    hits = block.find(whole, automaton) if whole and block.pieces else []
                    found.append(before.as_py() + [{"item_id": ids[i], "distance": d, "end": e} for i, d, e in hits])
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(found, arrow)], [*names, "items"])

        return run

    schema = T.StructType([*[out.schema[c] for c in names], T.StructField("items", hit)])
    arrow = to_arrow_schema(schema).field("items").type
    for ids, texts in _blocks(benchmark, item, item_text):
        whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
        out = out.select("*", whole.alias(fresh(out, "_text"))).mapInArrow(search(Items.of(texts, rate), ids), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """``docs`` without the rows in which an item of ``benchmark`` occurs; columns pass through."""
    held = fresh(docs, "items")
    found = find_items(docs.withColumnRenamed("items", held) if held != "items" else docs, benchmark, **options)
    return found.filter(F.size("items") == 0).drop("items").withColumnRenamed(held, "items").select(*docs.columns)
