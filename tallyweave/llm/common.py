"""What several training-data operators share: batches of text, checked joins, connected classes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import cut

#: A table of at most so many narrow rows (a few dozen bytes each, some MB in all) is broadcast.
BROADCAST_ROWS = 200_000
#: A key is hot when it holds more than one row in so many; there are at most as many hot keys.
HOT_SHARE = 1_000
#: Text that is held as numpy arrays at a time, unless one document alone is longer.
CHUNK_BYTES = 1 << 18


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def key_match(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of ``keys``, named ``_k_<key>`` on the right side."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join per-key facts to all rows of the key, null keys included, whatever the skew.

    ``groups`` has one row per key with its number of rows in ``size`` and is read several times
    (pass a written table). Up to ``limit`` keys are broadcast. Beyond that, keys with
    more than one row in ``HOT_SHARE`` of all are broadcast, which are ``HOT_SHARE`` at most, and
    the others are joined by a shuffle in which no key is large.
    """
    named = groups.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    drop = [f"_k_{k}" for k in keys]
    if groups.count() <= limit:
        side = F.broadcast(named)
        return rows.join(side, key_match(rows, side, keys), how).drop(*drop)
    total = groups.agg(F.sum(size)).first()[0]
    hot = F.col(size) * min(HOT_SHARE, limit) > F.lit(total)
    heads = F.broadcast(named.filter(hot))
    marked = rows.join(heads, key_match(rows, heads, keys), "left_semi"), rows.join(heads, key_match(rows, heads, keys), "left_anti")
    tails = named.filter(~hot)
    return (
        marked[0].join(heads, key_match(marked[0], heads, keys), "inner").drop(*drop)
        .unionByName(marked[1].join(tails, key_match(marked[1], tails, keys), how).drop(*drop))
    )


def checked(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint for a written narrow table that is counted to be small, else none."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """UTF-8 bytes of a string column in chunks: first row, end row, bytes, row offsets in them.

    Nulls count as empty. The bytes are views of the Arrow buffer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed values: public multipliers of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk: start and end byte of each, and the first word of each row (one more at the end).

    A word is a run without space, tab or line breaks; it never spans two rows.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    fresh[cuts] |= inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span, from running polynomial sums."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Smallest vertex of each vertex's connected class: ``vertex``, ``root``.

    Every round takes the least root among the neighbours and then the root of that root, so
    the number of rounds grows with the logarithm of a class's diameter; it ends when no root
    changes. Each round is written to the shared folder, nothing is collected. A vertex with many
    neighbours and the root of a giant class are hot keys; both look-ups are split by
    :func:`join_groups`.
    """
    one = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.first("a")).alias("root"), F.count(F.lit(1)).alias("n")))
    while True:
        looked = join_groups(both, roots.withColumnRenamed("vertex", "b"), ["b"], "n", "inner")
        near = looked.groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots.vertex == near.a)
        step = cut(step.select("vertex", F.least("root", "near").alias("root"), F.col("root").alias("was"), "n"))
        sizes = step.groupBy("root").agg(F.count(F.lit(1)).alias("_size"))
        above = step.select(F.col("vertex").alias("_v"), F.col("root").alias("_up"))
        ups = cut(sizes.join(above, sizes.root == above._v).drop("_v"))
        jumped = join_groups(step, ups, ["root"], "_size", "inner")
        new = cut(jumped.select("vertex", F.least("root", "_up").alias("root"), "was", "n"))
        moved = new.filter("root <> was").limit(1).count()
        roots = new.drop("was")
        if not moved:
            return roots.drop("n")
