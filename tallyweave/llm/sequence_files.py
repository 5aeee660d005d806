"""Token ids as equal-length sequences in Arrow files, with zero-copy random access.

A folder holds, per write task, one Arrow file of sequences and one of documents, and a manifest.
A sequence file is Arrow's file format, the stream format with a footer, in batches of
fixed-size-list columns: ``ids`` (the narrowest unsigned type that holds the vocabulary) and two
masks of a bit per id, ``mask`` for ids of a document (false for padding) and ``last`` for a
document's last id. All batches but a file's last have the same number of rows, so the place of any
sequence follows from its number, and a mapped file hands it out as a view. A document file has per document its key,
its first id in the file and its number of ids.

Writers give their files names of their own and the driver names the files that count in the
manifest, last and by a rename. A task that is lost or run twice leaves files nobody reads.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.llm.tokens import WordBpe

FORMAT = "arrow_sequences"
MANIFEST = "_manifest.json"
#: Ids in a sequence, and sequences in a batch: about two million ids are held while writing.
LENGTH = 2048
BATCH = 256
END_ID = 2


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path in it for a URI or a plain path."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), os.path.abspath(path))


def _source(place: arrow_fs.FileSystem, path: str) -> pa.NativeFile:
    """A mapped file where the file system is local, else a file with random access."""
    return pa.memory_map(path) if isinstance(place, arrow_fs.LocalFileSystem) else place.open_input_file(path)


def read_manifest(folder: str) -> dict:
    place, path = _open(folder)
    with place.open_input_stream(f"{path}/{MANIFEST}") as source:
        return json.loads(source.read())


def flat(column: pa.Array) -> pa.Array:
    """All values of a fixed-size-list column, without a copy."""
    width = column.type.list_size
    return column.values.slice(column.offset * width, len(column) * width)


def bits(values: pa.Array) -> np.ndarray:
    """A mask as bytes, a copy."""
    return values.to_numpy(zero_copy_only=False)


class FastBpe(WordBpe):
    """The encoder with a quicker way to learn pre-tokens: no offsets are computed."""

    def learn(self, new: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new):
            raise ValueError("the tokenizer splits a pre-token again")
        raw, upto = ids.tobytes(), (4 * cuts).tolist()
        self.known.update(zip(new, [raw[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)], strict=True))


_ENCODERS: dict[str | None, FastBpe] = {}


def _encoder(path: str | None) -> FastBpe:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = FastBpe(path)
    return _ENCODERS[path]


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote; no name if it had no rows."""

    number: int
    name: str
    documents: int
    sequences: int
    tokens: int


class _SequenceSink:
    """Cuts a stream of documents' ids into full batches of one file."""

    def __init__(self, sink: pa.NativeFile, kind: np.dtype, length: int, batch: int):
        self.length, self.batch, self.kind = length, batch, kind
        kinds = {"ids": pa.from_numpy_dtype(kind), "mask": pa.bool_(), "last": pa.bool_()}
        self.schema = pa.schema([(name, pa.list_(value, length)) for name, value in kinds.items()])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.ids, self.last, self.used = np.zeros(length * batch, kind), np.zeros(length * batch, bool), 0
        self.sequences = self.tokens = 0

    def put(self, ids: np.ndarray) -> None:
        """One document's ids."""
        at, n = 0, len(ids)
        self.tokens += n
        while at < n:
            step = min(n - at, len(self.ids) - self.used)
            self.ids[self.used : self.used + step] = ids[at : at + step]
            at, self.used = at + step, self.used + step
            self.last[self.used - 1] = at == n
            if self.used == len(self.ids):
                self.flush()

    def flush(self) -> None:
        rows = -(-self.used // self.length)
        if not rows:
            return
        self.ids[self.used :] = 0
        full = rows * self.length
        columns = [self.ids[:full], np.arange(full) < self.used, self.last[:full]]
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in columns], schema=self.schema))
        self.last[:] = False
        self.sequences, self.used = self.sequences + rows, 0

    def close(self) -> None:
        self.flush()
        self.writer.close()


class SequenceWriter(DataSourceArrowWriter):
    """Encodes and writes rows (key, text) in the order in which they come."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.folder, self.tokenizer = options["path"], options.get("tokenizer")
        self.length, self.batch, self.end = (int(options.get(k, v)) for k, v in (("length", LENGTH), ("batch", BATCH), ("end_id", END_ID)))
        self.key, self.overwrite = schema[0], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        place, path = _open(self.folder)
        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{uuid.uuid4().hex}"
        bpe = _encoder(self.tokenizer)
        kind = np.min_scalar_type(max(bpe.tokenizer.get_vocab_size() - 1, self.end))
        end = np.array([self.end], "<u4").tobytes()
        index_schema = pa.schema([(self.key.name, to_arrow_schema(T.StructType([self.key])).field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        sink = index = files = None
        documents = 0
        for batch in iterator:
            if not len(batch):
                continue
            if sink is None:
                place.create_dir(path, recursive=True)
                files = [place.open_output_stream(f"{path}/{name}.{kind_of}.arrow") for kind_of in ("sequences", "documents")]
                sink, index = _SequenceSink(files[0], kind, self.length, self.batch), pa.ipc.new_file(files[1], index_schema)
            starts, counts = [], []
            for text in batch.column(1):
                ids = np.frombuffer(bpe.ids(text.as_py() or "") + end, "<u4")
                starts.append(sink.tokens)
                counts.append(len(ids))
                sink.put(ids)
            documents += len(starts)
            keys = batch.column(0).cast(index_schema.field(0).type)
            index.write_batch(pa.record_batch([keys, pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index_schema))
        bpe.known.clear()  # Spark keeps the worker for other tasks
        if sink is None:
            return Part(number, "", 0, 0, 0)
        sink.close()
        index.close()
        for f in files:
            f.close()
        return Part(number, name, documents, sink.sequences, sink.tokens)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        place, path = _open(self.folder)
        place.create_dir(path, recursive=True)
        known = place.get_file_info(f"{path}/{MANIFEST}").type != arrow_fs.FileType.NotFound
        if known and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.folder} holds sequences already")
        old = read_manifest(self.folder)["parts"] if known else []
        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.number)
        facts = {
            "length": self.length, "batch": self.batch, "end_id": self.end, "key": json.loads(T.StructType([self.key]).json()),
            "parts": [{"name": m.name, "documents": m.documents, "sequences": m.sequences, "tokens": m.tokens} for m in parts],
        }
        draft = f"{path}/.{uuid.uuid4().hex}"
        with place.open_output_stream(draft) as sink:
            sink.write(json.dumps(facts).encode())
        place.move(draft, f"{path}/{MANIFEST}")
        self._remove([part["name"] for part in old])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._remove([m.name for m in messages if m is not None and m.name])

    def _remove(self, names: list[str]) -> None:
        place, path = _open(self.folder)
        for name in names:
            for kind_of in ("sequences", "documents"):
                place.delete_file(f"{path}/{name}.{kind_of}.arrow")


class _Piece(InputPartition):
    """A part with the ids and sequences before it."""

    def __init__(self, name: str, tokens: int, sequences: int):
        self.name, self.tokens, self.sequences = name, tokens, sequences


class SequenceReader(DataSourceReader):
    """Documents or sequences of a folder, a task per part."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.folder, self.rows, self.schema = options["path"], options.get("rows", "documents"), schema

    def partitions(self) -> list[InputPartition]:
        out, tokens, sequences = [], 0, 0
        for part in read_manifest(self.folder)["parts"]:
            out.append(_Piece(part["name"], tokens, sequences))
            tokens, sequences = tokens + part["tokens"], sequences + part["sequences"]
        return out or [_Piece("", 0, 0)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        place, path = _open(self.folder)
        file = pa.ipc.open_file(_source(place, f"{path}/{partition.name}.sequences.arrow"))
        arrow = to_arrow_schema(self.schema)
        if self.rows == "sequences":
            at = partition.sequences
            for i in range(file.num_record_batches):
                batch = file.get_batch(i)
                numbers = pa.array(np.arange(at, at + len(batch)))
                yield pa.record_batch([numbers, *[batch.column(c).cast(arrow.field(c).type) for c in ("ids", "mask", "last")]], schema=arrow)
                at += len(batch)
            return
        index = pa.ipc.open_file(_source(place, f"{path}/{partition.name}.documents.arrow"))
        spans = _Spans(file)
        with_ids = "ids" in self.schema.names
        for i in range(index.num_record_batches):
            batch = index.get_batch(i)
            sums, blobs = [], []
            starts = batch.column("start").to_numpy()
            for start, n in zip(starts.tolist(), batch.column("n_tokens").to_pylist(), strict=True):
                crc, pieces = 0, []
                for piece in spans.of(start, n):
                    raw = piece.astype("<u4").tobytes()
                    crc = zlib.crc32(raw, crc)
                    if with_ids:
                        pieces.append(raw)
                sums.append(crc)
                blobs.append(b"".join(pieces))
            columns = [batch.column(0).cast(arrow.field(0).type), pa.array(starts + partition.tokens), batch.column("n_tokens"), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.array(blobs, pa.binary()))
            yield pa.record_batch(columns, schema=arrow)


class _Spans:
    """Ids of documents from one file, read forwards; the masks must agree with the index."""

    def __init__(self, file: pa.RecordBatchFileReader):
        self.file, self.number = file, -1
        self.ids = self.mask = self.last = np.zeros(0, np.uint8)
        self.full = len(flat(file.get_batch(0).column("ids"))) if file.num_record_batches else 0

    def of(self, start: int, n: int) -> Iterator[np.ndarray]:
        at, upto = start, start + n
        while at < upto:
            number, inside = divmod(at, self.full)
            if number != self.number:
                batch = self.file.get_batch(number)
                ids, mask, last = (flat(batch.column(c)) for c in ("ids", "mask", "last"))
                self.number, self.ids, self.mask, self.last = number, ids.to_numpy(), bits(mask), bits(last)
            take = min(upto - at, self.full - inside)
            here = slice(inside, inside + take)
            ends = np.flatnonzero(self.last[here]).tolist()
            if not self.mask[here].all() or ends != ([take - 1] if at + take == upto else []):
                raise ValueError("masks and index of a sequence file disagree")
            yield self.ids[here]
            at += take


class ArrowSequences(DataSource):
    """The format of this module for ``df.write.format`` and ``spark.read.format``.

    Options: ``path``; writing: ``tokenizer``, ``length``, ``batch``, ``end_id``; reading: ``rows``
    ("documents" or "sequences") and ``ids`` ("true" adds each document's ids).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        if self.options.get("rows", "documents") == "sequences":
            return T.StructType().add("sequence", "long").add("ids", T.ArrayType(T.IntegerType())).add("mask", T.ArrayType(T.BooleanType())).add("last", T.ArrayType(T.BooleanType()))
        fields = T.StructType.fromJson(read_manifest(self.options["path"])["key"])
        for name in ("start", "n_tokens", "ids_crc32"):
            fields = fields.add(name, T.LongType())
        return fields.add("ids", T.BinaryType()) if self.options.get("ids") == "true" else fields

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SequenceReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SequenceWriter(self.options, schema, overwrite)


def write_sequences(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, overwrite: bool = False
) -> None:
    """Write the ids of all texts, each followed by ``END_ID``, in ascending order of ``key``.

    The stream of ids of a part is cut every ``length`` ids; the part's last sequence is padded.
    Null keys come first; rows with equal keys follow by a hash of their texts; a null text is
    empty; repeated rows are documents of their own. Other columns are ignored; an empty table
    gives a folder without sequences. A folder that holds sequences is refused unless
    ``overwrite`` is set.
    """
    docs.sparkSession.dataSource.register(ArrowSequences)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text")).withColumn("_row", F.monotonically_increasing_id())
    order = ["_key", "_hash", "_row"]  # the row's number only parts the ranges of a row that is repeated very often
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("_key").alias(key), F.col("_text").alias(text if text != key else "_text"))
    out = rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("length", length)
    (out.option("tokenizer", tokenizer) if tokenizer else out).save(folder)


def read_documents(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Per document: key, ``start`` (ids before it in the folder), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``.

    All come from the files; ``ids`` and the checksum are over little-endian unsigned 32-bit ids.
    """
    spark.dataSource.register(ArrowSequences)
    return spark.read.format(FORMAT).option("ids", str(ids).lower()).load(folder)


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """``sequence`` (number from 0 in the folder), ``ids``, ``mask`` and ``last`` of every sequence."""
    spark.dataSource.register(ArrowSequences)
    return spark.read.format(FORMAT).option("rows", "sequences").load(folder)


class Sequences:
    """Random access for a training loop: ``self[i]`` is a view of the ids (numpy) and of the two masks (Arrow) of sequence ``i``."""

    def __init__(self, folder: str):
        facts = read_manifest(folder)
        self.place, self.path = _open(folder)
        self.batch, self.names, self.firsts, self.files = facts["batch"], [p["name"] for p in facts["parts"]], [0], {}
        for part in facts["parts"]:
            self.firsts.append(self.firsts[-1] + part["sequences"])

    def __len__(self) -> int:
        return self.firsts[-1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        part = bisect_right(self.firsts, i) - 1
        if part not in self.files:
            self.files[part] = pa.ipc.open_file(_source(self.place, f"{self.path}/{self.names[part]}.sequences.arrow"))
        number, row = divmod(i - self.firsts[part], self.batch)
        one = self.files[part].get_batch(number).slice(row, 1)
        return flat(one.column("ids")).to_numpy(), flat(one.column("mask")), flat(one.column("last"))
