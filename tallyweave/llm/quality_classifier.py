"""Quality scores by similarity-weighted votes of labelled neighbours in a latent semantic space.

A text becomes counts of hashed byte trigrams and a few measures of its style in soft bins. A
bounded sample of labelled rows gives weights and, by singular value decomposition, a space of
``DIMENSIONS`` latent terms. The labelled vectors (``SAMPLE`` x ``DIMENSIONS`` numbers at most) go
to every task; every document is projected, compared with all of them by blocked matrix products,
and scored by its nearest neighbours' labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import fresh, span_hashes, text_chunks, words

#: Labelled rows that are learned from: those with the smallest hashes, a third of them from each label at least if there are so many.
SAMPLE = 3000
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 15, 8.0
#: Hash buckets of trigrams; bins of each style measure; share of the squared norm that style has.
BUCKETS, BINS, STYLE = 2048, 12, 0.5
_ROWS = 256  # texts whose counts are held at a time

# Style measures and the upper end of their range (larger values share the last bin).
MEASURES = {
    "words": 12.0, "word_length": 16.0, "same_as_before": 0.5, "rare_words": 1.0, "signs": 0.3, "bars": 0.15, "capitals": 0.2, "digits": 0.1, "lines": 0.05,
    "repeated": 1.0, "wide": 0.4,
}
FEATURES = BUCKETS + BINS * len(MEASURES)
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in "#*$%&<>=~^_+@{}[]\\/"]] = 1
_KIND[ord("|")] = 2
_KIND[ord("A") : ord("Z") + 1] = 3
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[ord("\n")] = 5
_KIND[0x80:] = 6


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of raw features of whole texts, some texts at a time."""
    for first, end, data, offsets in text_chunks(column):
        for a in range(0, end - first, _ROWS):
            b = min(a + _ROWS, end - first)
            part = data[offsets[a] : offsets[b]]
            yield _features(part, offsets[a : b + 1] - offsets[a])


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, FEATURES), np.float32)
    if len(data) >= 3:
        d = data.astype(np.uint32)
        code = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
        inside = row[:-2] == row[2:]
        cell = row[:-2][inside] * BUCKETS + code[inside]
        out[:, :BUCKETS] = np.log1p(np.bincount(cell, minlength=n * BUCKETS).reshape(n, BUCKETS))
    starts, ends, heads = words(data, offsets)
    count = np.diff(heads)
    of = np.repeat(np.arange(n), count)
    hashed = span_hashes(data, starts, ends)
    same = np.zeros(len(hashed))
    same[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
    distinct = np.zeros(n)
    again = np.zeros(n)
    for i in range(n):  # sets of one text's words and word triples
        mine = hashed[heads[i] : heads[i + 1]]
        distinct[i] = len(np.unique(mine))
        triples = mine[:-2] + mine[1:-1] * np.uint64(3) + mine[2:] * np.uint64(7) if len(mine) > 2 else mine[:0]
        again[i] = 1 - len(np.unique(triples)) / max(len(triples), 1) if len(triples) else 0
    kinds = np.bincount(row * 8 + _KIND[data], minlength=n * 8).reshape(n, 8)
    total = np.maximum(sizes, 1)
    many = np.maximum(count, 1)
    values = {
        "words": np.log1p(count), "word_length": np.bincount(of, ends - starts, n) / many, "same_as_before": np.bincount(of, same, n) / many,
        "rare_words": distinct / many, "signs": kinds[:, 1] / total, "bars": kinds[:, 2] / total, "capitals": kinds[:, 3] / total,
        "digits": kinds[:, 4] / total, "lines": kinds[:, 5] / total, "repeated": again, "wide": kinds[:, 6] / total,
    }
    rows = np.arange(n)
    for k, (name, top) in enumerate(MEASURES.items()):
        spot = np.clip(values[name] / top, 0, 1) ** 0.5 * (BINS - 1)
        low = np.minimum(spot.astype(np.int64), BINS - 2)
        base = BUCKETS + k * BINS
        out[rows, base + low] = 1 - (spot - low)
        out[rows, base + low + 1] = spot - low
    return out


@dataclass
class Space:
    """Weights and axes of the latent space with the labelled vectors."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, raw: np.ndarray) -> np.ndarray:
        weighted = raw * self.weights
        for part, share in ((slice(0, BUCKETS), 1 - STYLE), (slice(BUCKETS, None), STYLE)):
            norm = np.linalg.norm(weighted[:, part], axis=1, keepdims=True)
            weighted[:, part] *= np.sqrt(share) / np.maximum(norm, 1e-12)
        latent = weighted @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Share of label 1 in the weighted votes; 0.5 without labelled rows."""
        if not len(self.labels):
            return np.full(len(raw), 0.5)
        likeness = self.project(raw) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
        weight = np.exp(SHARPNESS * (np.take_along_axis(likeness, near, axis=1) - 1).astype(np.float64))
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)


def _axes(matrix: np.ndarray, dimensions: int, rounds: int = 8) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    start = np.random.default_rng(1).standard_normal((matrix.shape[1], dimensions + 16)).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, turn = np.linalg.svd(matrix @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :dimensions], dtype=np.float32)


def fit(raw: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Space:
    """Weights by inverse frequency, axes by singular value decomposition of the labelled rows."""
    raw = np.asarray(raw, np.float32).reshape(-1, FEATURES)
    seen = (raw > 0).sum(axis=0)
    weights = np.log((1 + len(raw)) / (1 + seen)).astype(np.float32) + 1
    space = Space(weights, np.eye(FEATURES, dtype=np.float32), raw[:0], np.asarray(labels, np.float64))
    if len(raw):
        whole = space.project(raw)
        space.axes = _axes(whole, dimensions)
        space.vectors = space.project(raw)
    else:
        space.axes = space.axes[:, :dimensions]
    return space


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Space:
    """A space from at most ``sample`` labelled rows outside the held-out third.

    Rows come in the order of a hash of their key. Label 0 is the rarer one as a rule, so a third
    of the sample is kept for each label before the rest is filled in order.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    known = known.dropDuplicates(["_key"]).withColumn("_h", F.xxhash64(F.lit("sample"), "_key"))
    third = sample // 3
    first = [known.filter(F.col("_label") == v).orderBy("_h", "_key").limit(sample) for v in (0, 1)]
    # ranks over at most twice ``sample`` rows of three numbers
    ranked = first[0].unionByName(first[1]).withColumn("_rank", F.row_number().over(Window.partitionBy("_label").orderBy("_h", "_key")))
    taken = ranked.orderBy(F.col("_rank") > third, "_h", "_key").limit(sample).drop("_rank")
    side = F.broadcast(taken)  # at most ``sample`` rows of three numbers
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.join(side, F.col("_k") == F.col("_key")).select("_h", "_label", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [r.astype("<f4").tobytes() for part in features(batch.column(2)) for r in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["h", "label", "raw"])

    # a key with several texts keeps one of them, so the sample stays bounded
    found = rows.mapInArrow(count, "h long, label int, raw binary").groupBy("h").agg(F.min("label").alias("label"), F.min("raw").alias("raw"))
    got = sorted(found.collect(), key=lambda r: r["h"])
    raw = np.frombuffer(b"".join(bytes(r["raw"]) for r in got), dtype="<f4").reshape(-1, FEATURES)
    return fit(raw, np.array([r["label"] for r in got]))


def score_quality(docs: DataFrame, space: Space, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5 on).

    Only the text counts; null and empty texts are scored as empty. Columns named ``score`` or
    ``predicted`` are replaced, others pass through; rows are scored one by one, so repeated rows
    and an empty table need no special case.
    """
    kept = docs.drop("score", "predicted")
    names = kept.columns
    rows = kept.select("*", F.coalesce(F.col(text).cast("string"), F.lit("")).alias(fresh(kept, "_text")))
    schema = T.StructType([*[kept.schema[c] for c in names], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [space.score(raw) for raw in features(batch.column(len(names)))]
            scores = np.clip(np.concatenate(parts), 0, 1) if parts else np.zeros(0)
            out = [*[batch.column(i) for i in range(len(names))], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, [*names, "score", "predicted"])

    return rows.mapInArrow(vote, schema)
