"""Token ids as Arrow IPC files of fixed-size lists.

A shard holds one range of ids' documents.  Its token file has record batches of
two fixed-size-list columns, ``input_ids`` and ``mask`` (false on the padding at
the shard's end), so sequence ``i`` is a view at a computed place of the mapped
file; its index file gives each document's place in the shard's id stream.
Files are written under names of their own attempt and only those in the
manifest are read, so a repeated or speculative task does no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage
from .encoding import encoder, text_slices

SEQUENCE = 2048
ROWS = 256
MANIFEST = "shard int, tokens_file string, index_file string, n_docs bigint, n_tokens bigint, n_sequences bigint"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Arrow reads it."""
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file:///" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


class SequenceWriter:
    """Appends ids to a token file; whole record batches leave memory as they fill."""

    def __init__(self, sink, dtype: type, length: int = SEQUENCE, rows: int = ROWS, pad: int = 0):
        self.length, self.size, self.pad, self.filled, self.total = length, length * rows, pad, 0, 0
        self.buffer = np.empty(self.size, dtype)
        self.schema = pa.schema({"input_ids": pa.list_(pa.from_numpy_dtype(dtype), length), "mask": pa.list_(pa.bool_(), length)})
        self.writer = pa.ipc.new_file(sink, self.schema)

    def append(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while len(ids):
            n = min(len(ids), self.size - self.filled)
            self.buffer[self.filled : self.filled + n] = ids[:n]
            self.filled, ids = self.filled + n, ids[n:]
            if self.filled == self.size:
                self._flush()

    def _flush(self) -> None:
        width = -(-self.filled // self.length) * self.length
        self.buffer[self.filled : width] = self.pad
        mask = np.arange(width) < self.filled
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (self.buffer[:width], mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.filled = 0

    def close(self) -> None:
        if self.filled:
            self._flush()
        self.writer.close()


class TokenFile:
    """Random access to a token file; on a local file system nothing is copied but what is asked for."""

    def __init__(self, uri: str):
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(system, pyarrow.fs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1
        self.at, self.batch = -1, None

    def _values(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.batch = k, self.reader.get_batch(k).column("input_ids").values.to_numpy()
        return self.batch

    def sequence(self, i: int) -> np.ndarray:
        row = i % self.rows
        return self._values(i // self.rows)[row * self.length : (row + 1) * self.length]

    def ids(self, start: int, n: int) -> np.ndarray:
        size, parts = self.rows * self.length, []
        while n > 0:
            k, at = divmod(start, size)
            parts.append(self._values(k)[at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write shards in ascending order of ``id_col`` under ``path``; returns the manifest, a row a shard.

    Cases: a null text is an empty document; a null id comes first; rows with
    equal ids, nulls too, follow each other by a hash of their texts, so one id
    of very many rows spreads over shards; other columns are not read; an empty
    table has no shard.
    """
    spark = docs.sparkSession
    uri = qualified(spark, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        dtype = np.uint16 if max(coder.largest, end_id) < 1 << 16 else np.uint32
        shard = TaskContext.get().partitionId()
        system, folder = pyarrow.fs.FileSystem.from_uri(uri)
        system.create_dir(folder, recursive=True)
        stem = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        index_schema, n_docs, out = pa.schema({"id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()}), 0, None
        for b in batches:
            if out is None:
                sinks = [system.open_output_stream(f"{folder}/{stem}.{kind}.arrow") for kind in ("tokens", "index")]
                out, index = SequenceWriter(sinks[0], dtype, sequence, pad=end_id), pa.ipc.new_file(sinks[1], index_schema)
            starts, lengths = [], []
            for first, last, texts in text_slices(b.column(1)):
                offsets, ids = coder.encode_batch(texts)
                starts.append(out.total + offsets[:-1] + np.arange(last - first))
                lengths.append(np.diff(offsets) + 1)
                out.append(np.insert(ids.astype(dtype), offsets[1:], end_id))
            n_docs += b.num_rows
            index.write_batch(pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(lengths), pa.int64())], schema=index_schema))
        if out is None:
            return
        for x in (out, index, *sinks):
            x.close()
        row = {"shard": shard, "tokens_file": f"{uri}/{stem}.tokens.arrow", "index_file": f"{uri}/{stem}.index.arrow", "n_docs": n_docs, "n_tokens": out.total, "n_sequences": -(-out.total // sequence)}
        yield pa.RecordBatch.from_pylist([row], pa.schema({"shard": pa.int32(), "tokens_file": pa.string(), "index_file": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "n_sequences": pa.int64()}))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").drop("h")
    return storage.materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of every document, from the files.

    The running start needs one row a shard in one task, not one a document.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "n_tokens", "ids"]
        for b in batches:
            for row in b.to_pylist():
                tokens = TokenFile(row["tokens_file"])
                system, path = pyarrow.fs.FileSystem.from_uri(row["index_file"])
                with system.open_input_file(path) as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        for at in range(0, part.num_rows, 512):
                            piece = part.slice(at, 512)
                            spans = zip(piece.column("start").to_pylist(), piece.column("n_tokens").to_pylist())
                            ids = pa.array([tokens.ids(s, n).astype("<u4").tobytes() for s, n in spans], pa.binary())
                            start = pa.array(piece.column("start").to_numpy() + row["base"])
                            yield pa.RecordBatch.from_arrays([piece.column("id"), start, piece.column("n_tokens"), ids], names)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = shards.repartitionByRange(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, "id bigint, start bigint, n_tokens bigint, ids binary")
