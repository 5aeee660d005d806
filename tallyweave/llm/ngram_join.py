"""N-gram Jaccard join of all documents with Bayesian pruning of candidates.

1. Every text becomes a set of hashed word 5-grams and ``BANDS * ROWS`` MinHash values; equal sets
   are one *set* with a number of copies, and all later work is on distinct sets.
2. Sets that share the values of a band are candidates. A bucket compares the values of its
   members step by step and drops a pair as soon as the posterior probability of reaching the
   threshold falls below ``TOLERANCE``. Of the pairs that stay, a bucket passes on a spanning
   forest, never the pairs; the forests' connected classes are small groups of look-alikes.
3. Within each such group every pair is verified exactly: intersections of whole sets are products
   of incidence matrices, in blocks. Only the number of links and the class leave a block.

A pair at the threshold itself escapes all bands with probability (1 - 0.8^5)^40 < 2e-7 and the
pruning with less than 1e-7; more similar pairs much less. Buckets and groups of any size are cut
into pairs of bounded blocks, so none is ever held by one task and none is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import checked, components, fresh, join_groups, mix, span_hashes, text_chunks, words
from tallyweave.session import cut

NGRAM, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
#: Values that a bucket compares, and how many at a time.
COMPARED, STEP = 64, 16
TOLERANCE = 1e-9
#: Sets in a block of a bucket (values only) and in a block of verification (whole sets).
BUCKET_BLOCK, SET_BLOCK = 4096, 512
_COLUMNS = 4096  # shingles per incidence product

_RANDOM = np.random.default_rng(12345)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 63, NGRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word 5-grams of each text of a column.

    Words are runs without blanks, as they stand. A text of one to four words has one shingle of
    them all, a text without words none.
    """
    for first, end, data, offsets in text_chunks(column):
        starts, ends, heads = words(data, offsets)
        hashed = span_hashes(data, starts, ends)
        n = len(hashed)
        grams = np.zeros(max(n - NGRAM + 1, 0), np.uint64)
        for k in range(NGRAM):
            grams += hashed[k : k + len(grams)] * _PLACES[k]
        grams = mix(grams)
        for i in range(end - first):
            a, b = int(heads[i]), int(heads[i + 1])
            if b - a >= NGRAM:
                yield np.unique(grams[a : b - NGRAM + 1])
            elif b > a:
                short = (hashed[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of one set, as unsigned 32-bit numbers."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among ``n`` values with P(similarity >= threshold) >= ``tolerance``.

    With a uniform prior the posterior after m matches is Beta(m + 1, n - m + 1), whose upper tail
    at t is the probability of at most m successes in n + 1 trials of probability t.
    """
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def forest(values: np.ndarray, limits: list[int]) -> np.ndarray:
    """For each row of MinHash values, the first row of its class under the pairs that pruning keeps."""
    n = len(values)
    seed = np.full(n, -1, np.int64)
    left = np.arange(n)
    for start in range(n):
        if seed[start] >= 0:
            continue
        seed[start] = start
        left = left[left != start]
        stack = [start]
        while stack and len(left):
            one = values[stack.pop()]
            near, matches = left, np.zeros(len(left), np.int64)
            for k, limit in enumerate(limits):
                part = slice(k * STEP, (k + 1) * STEP)
                matches = matches + (values[near, part] == one[part]).sum(axis=1)
                stay = matches >= limit
                near, matches = near[stay], matches[stay]
                if not len(near):
                    break
            if len(near):
                seed[near] = start
                left = left[seed[left] < 0]
                stack.extend(near.tolist())
    return seed


def links(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether each set of ``rows`` and each of ``columns`` reach the threshold, from whole sets."""
    sizes = np.array([len(s) for s in sets])
    which = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts >= 2
    place = np.cumsum(shared) - 1
    keep = shared[inverse]
    which, column = which[keep], place[inverse[keep]]
    order = np.argsort(column, kind="stable")
    which, column = which[order], column[order]
    inside = np.zeros((len(rows), len(columns)), np.float32)
    total = int(shared.sum())
    for at in range(0, total, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        cells = np.zeros((len(sets), min(_COLUMNS, total - at)), np.float32)
        cells[which[a:b], column[a:b] - at] = 1
        inside += cells[rows] @ cells[columns].T
    inside = inside.astype(np.int64)
    union = sizes[rows][:, None] + sizes[columns][None, :] - inside
    return inside * 1_000_000 >= union * round(threshold * 1_000_000)


def classes(linked: np.ndarray) -> np.ndarray:
    """First row of each row's connected class in a square matrix of links."""
    seed = np.full(len(linked), -1, np.int64)
    for start in range(len(linked)):
        if seed[start] < 0:
            seed[start] = start
            stack = [start]
            while stack:
                near = np.flatnonzero(linked[stack.pop()] & (seed < 0))
                seed[near] = start
                stack.extend(near.tolist())
    return seed


def _blocks(rows: DataFrame, group: str, size: str, block: int, item: str) -> DataFrame:
    """Each row once per pair of blocks that it takes part in: ``_i``, ``_j`` and its own ``_mine``."""
    count = F.ceil(F.col(size) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("block"), F.col(group), F.col(item)), count).cast("int")
    placed = rows.withColumn("_mine", mine)
    pairs = F.transform(F.sequence(F.lit(0), count - 1), lambda o: F.struct(F.least("_mine", o).alias("i"), F.greatest("_mine", o).alias("j")))
    out = placed.withColumn("_pair", F.explode(pairs))
    return out.withColumns({"_i": F.col("_pair.i"), "_j": F.col("_pair.j")}).drop("_pair")


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows that agree in their first columns; a group is a pair of blocks, so it is bounded."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:n_keys]):
        yield key, [r[n_keys:] for r in group]


def _by_pair(rows: DataFrame, group: str, names: list[str], work: Callable, schema: str) -> DataFrame:
    keys = [group, "_i", "_j"]
    ordered = rows.select(*keys, "_mine", *names).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(work, schema)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``text_md5``, the digest ``set_id`` of its shingles (null without words) and their MinHash values."""
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.select(key, F.md5(F.col("_text").cast("binary")).alias("text_md5"), "_text")
    schema = T.StructType(
        [rows.schema[key], T.StructField("text_md5", T.StringType()), T.StructField("set_id", T.StringType()), T.StructField("minhash", T.BinaryType())]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = [], []
            for shingles in shingle_sets(batch.column(2)):
                known = len(shingles) > 0
                ids.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest() if known else None)
                values.append(minhash(shingles).tobytes() if known else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.string()), pa.array(values, pa.binary())], schema.names)

    return rows.mapInArrow(sketch, schema)


def look_alikes(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Groups of sets connected by candidate pairs that Bayesian pruning keeps: ``vertex``, ``root``."""
    width = 4 * ROWS
    band = F.array(*[F.xxhash64(F.lit(b), F.substring("minhash", b * width + 1, width)) for b in range(BANDS)])
    bands = sets.select("set_id", F.explode(band).alias("band"))
    full = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = bands.join(full, "band")
    values = sets.select("set_id", F.substring("minhash", 1, 4 * COMPARED).alias("values"))
    placed = _blocks(members, "band", "n", BUCKET_BLOCK, "set_id").join(values, "set_id")
    limits = [least_matches(k * STEP, threshold) for k in range(1, COMPARED // STEP + 1)]

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[str] = []
        right: list[str] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["a", "b"])

        for _, group in _grouped(batches, 3):
            group.sort(key=lambda r: r[1])
            matrix = np.frombuffer(b"".join(r[2] for r in group), dtype="<u4").reshape(len(group), COMPARED)
            for i, s in enumerate(forest(matrix, limits).tolist()):
                if i != s:
                    left.append(group[i][1])
                    right.append(group[s][1])
            if len(left) >= 10_000:
                yield out()
                left, right = [], []
        yield out()

    edges = _by_pair(placed, "band", ["set_id", "values"], prune, "a string, b string")
    return components(edges.distinct())


def verified(groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact links inside groups: ``set_id``, ``links`` (documents linked through other sets), ``seed``.

    ``groups``: ``set_id``, ``root``, ``n`` (sets of the root), ``copies``, ``shingles``. One row per
    set and pair of blocks; ``seed`` is another set of the same class, or the set itself.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in _grouped(batches, 3):
            group.sort(key=lambda r: r[1])
            sets = [np.frombuffer(r[3], dtype="<u8") for r in group]
            copies = np.array([r[2] for r in group], np.int64)
            mine = np.array([r[0] for r in group])
            every = np.arange(len(group))
            if i == j:
                linked = links(sets, every, every, threshold)
                linked[every, every] = False
            else:
                rows, columns = every[mine == i], every[mine == j]
                linked = np.zeros((len(group), len(group)), bool)
                if len(rows) and len(columns):
                    part = links(sets, rows, columns, threshold)
                    linked[np.ix_(rows, columns)] = part
                    linked[np.ix_(columns, rows)] = part.T
            seeds = classes(linked)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[1] for r in group], pa.string()), pa.array(linked.astype(np.int64) @ copies, pa.int64()),
                    pa.array([group[s][1] for s in seeds.tolist()], pa.string()),
                ],
                ["set_id", "links", "seed"],
            )

    placed = _blocks(groups, "root", "n", SET_BLOCK, "set_id")
    return _by_pair(placed, "root", ["set_id", "copies", "shingles"], verify, "set_id string, links long, seed string")


def _same_row(left: DataFrame, right: DataFrame, key: str) -> Column:
    return left[key].eqNullSafe(right["_key"]) & (left["text_md5"] == right["_md5"])


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``class_id``, ``n_links``, ``n_copies``, ``text_md5``.

    Two documents are linked if the Jaccard similarity of their word 5-grams is ``threshold`` or
    more. ``n_links`` counts all linked documents, exact copies and copies of linked texts among
    them, ``n_copies`` those with the same shingles; ``class_id`` is the smallest key of the
    connected class. Documents without words (and null texts) are linked to nothing and form a
    class of their own. Repeated rows count as documents; null keys are allowed, a class of null
    keys alone has a null id. Other columns are ignored; an empty table gives no rows.
    """
    drawn = cut(sketches(docs, key, text))
    per_set = drawn.filter("set_id is not null").groupBy("set_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min(key).alias("low"), F.min(F.struct(F.col(key).alias("k"), F.col("text_md5").alias("m"))).alias("one"),
        F.first("minhash").alias("minhash"),
    )
    sets = cut(per_set)
    alike = cut(look_alikes(sets, threshold))
    sizes = cut(alike.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    chosen = join_groups(alike, sizes, ["root"], "n", "inner")
    chosen = chosen.join(sets.drop("minhash"), chosen.vertex == sets.set_id).select(
        "set_id", "root", "n", "copies", "low", F.col("one.k").alias("_key"), F.col("one.m").alias("_md5")
    )
    chosen = cut(chosen)
    # whole texts of one document per chosen set, read again
    texts = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    texts = texts.withColumn("text_md5", F.md5(F.col("_text").cast("binary")))
    side = checked(chosen.select("_key", "_md5", "set_id", "root", "n", "copies"))
    found = texts.join(side, _same_row(texts, side, key)).select("set_id", "root", "n", "copies", "_text")
    schema = "set_id string, root string, n long, copies long, shingles binary"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blobs, pa.binary())], ["set_id", "root", "n", "copies", "shingles"])

    groups = found.mapInArrow(hashed, schema)
    # rows that repeat key and text both come through; one of them stays
    groups = groups.dropDuplicates(["set_id"])
    parts = cut(verified(groups, threshold))
    linked = parts.groupBy("set_id").agg(F.sum("links").alias("links"))
    merged = components(parts.select("set_id", "seed"), "set_id", "seed")
    classed = cut(merged.join(chosen.select("set_id", "low"), merged.vertex == F.col("set_id")).select("set_id", "root", "low"))
    roots = cut(classed.groupBy("root").agg(F.min("low").alias("class_low"), F.count(F.lit(1)).alias("_n")))
    classed = join_groups(classed, roots, ["root"], "_n", "inner")
    facts = sets.select("set_id", "copies", "low").join(linked, "set_id", "left").join(classed.select("set_id", "class_low", "root"), "set_id", "left")
    facts = facts.select(
        "set_id", "copies", F.coalesce("class_low", "low").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "set_id").alias("class_set"),
    )
    joined = join_groups(drawn.drop("minhash"), cut(facts), ["set_id"], "copies")
    return joined.select(
        key, F.when(F.col("set_id").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"), "text_md5",
        "class_set",
    )


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest key (then of the smallest text digest).

    Documents without words all stay. Columns pass through.
    """
    found = cut(jaccard_join(docs, key, text, threshold).filter("class_set is not null"))
    best = F.min(F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("k"), F.col("text_md5").alias("m")))
    kept = found.groupBy("class_set").agg(best.alias("_best"), F.count(F.lit(1)).alias("_n"))
    kept = cut(kept.filter("_n > 1"))
    marked = join_groups(found, kept, ["class_set"], "_n", "inner")
    mine = F.col("_best.k").eqNullSafe(F.col(key)) & (F.col("_best.m") == F.col("text_md5"))
    of_key, of_text, first, same, own = (fresh(docs, c) for c in ("_key", "_md5", "_first", "_same", "_own_md5"))
    rows = marked.groupBy(F.col(key).alias(of_key), F.col("text_md5").alias(of_text)).agg(F.max(mine).alias(first), F.count(F.lit(1)).alias(same))
    rows = cut(rows.filter(~F.col(first) | (F.col(same) > 1)))  # rows that go, and kept rows that are repeated
    tagged = docs.withColumn(own, F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    side = checked(rows)
    tagged = tagged.join(side, tagged[key].eqNullSafe(side[of_key]) & (tagged[own] == side[of_text]), "left")
    names = docs.columns
    single = tagged.filter(F.col(first).isNull()).select(*names)
    repeated = tagged.filter(F.col(first)).dropDuplicates([of_key, of_text]).select(*names)
    return single.unionByName(repeated)
