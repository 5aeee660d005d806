"""Packing of documents into sequences by first-fit decreasing in randomised groups.

Documents are tokenised once; those longer than a sequence are cut into full sequences and a
rest. Pieces go to groups of bounded expected size by a hash of their position, so no key is hot,
and each group is packed on its own: pieces in decreasing length, each into the first bin with
room, found in a tournament tree of the bins' free capacities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.tokens import encoder
from tallyweave.session import cut

SEQUENCE = 4096
END_ID = 2
#: Expected pieces per group.
GROUP = 4096


def first_fit_decreasing(lengths: list[int] | np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; equal lengths keep their order."""
    lengths = np.asarray(lengths, dtype=np.int64)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n and lengths.max() > capacity:
        raise ValueError("a piece is longer than a sequence")
    leaves = 1 << max(n - 1, 0).bit_length()
    free = [capacity] * (2 * leaves)  # free[i]: most room in any bin below node i; all bins exist from the start
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if asked for, ``ids``.

    A document's ids are its text's (a null text has none) and then ``END_ID``.
    """
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    fields = [T.StructField(key, rows.schema[key].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = np.array([END_ID], dtype="<u4").tobytes()

    names = [f.name for f in fields]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            who, numbers, blobs = [], ([], [], [], []), []
            for i, text_ in enumerate(batch.column(1)):
                ids = bpe.ids(text_.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, SEQUENCE):
                    part = ids[4 * start : 4 * (start + SEQUENCE)]
                    who.append(i)
                    for column, value in zip(numbers, (start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(value)
                    if with_ids:
                        blobs.append(part)
            out = [batch.column(0).take(pa.array(who, pa.int64())), *[pa.array(c, pa.int64()) for c in numbers]]
            if with_ids:
                out.append(pa.array(blobs, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names)
        bpe.known.clear()  # Spark keeps the worker for other tasks

    return rows.mapInArrow(cut_up, T.StructType(fields))


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, group: int = GROUP, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with their place: the columns of :func:`pieces`, ``sequence_id``, ``offset``.

    Every document has at least one piece (``END_ID`` alone for an empty or null text), so repeated
    rows and null keys are packed as rows of their own. Pieces in a sequence follow one another
    from offset 0 without gaps. Other columns are ignored; an empty table gives no rows.
    """
    made = pieces(docs, key, text, tokenizer, with_ids).withColumn("_row", F.monotonically_increasing_id())
    made = cut(made)
    groups = max(1, round(made.count() / group))
    placed_in = F.pmod(F.xxhash64(F.lit("pack"), "_row"), F.lit(groups))
    slim = made.select(placed_in.alias("_group"), "_row", "length")

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row", kind="stable")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy())
        return pd.DataFrame({"_row": part["_row"], "sequence_id": part["_group"] * (1 << 32) + bins, "offset": offsets})

    spots = slim.groupBy("_group").applyInPandas(place, "_row long, sequence_id long, offset long")
    return made.join(spots, "_row").drop("_row")


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of every sequence, from packed pieces with ids: ``sequence_id``, ``n_tokens``, ``ids``.

    A sequence holds at most ``SEQUENCE`` tokens, so its pieces are a bounded group.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("_parts"))
    ids = F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return joined.select("sequence_id", "n_tokens", ids.alias("ids"))
