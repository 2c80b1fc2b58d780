"""Bounded-space online packing of token sequences.

Every partition keeps ``open_windows`` windows.  A document's whole windows are
cut off first; its rest goes to the open window that it fills best; if none has
room, the fullest leaves and a new one opens.  Windows still open at a
partition's end are the leftovers: they are laid end to end over all partitions
and cut at window boundaries, the last stretch at powers of two, so they add no
padding.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .encoding import encoder, text_slices

CAPACITY = 4096
OPEN_WINDOWS = 64
#: Leftover sequences are numbered from here, beyond (partition << 32) + window of the others.
MERGED_FROM = 1 << 62
FLUSH_BYTES = 1 << 23


class WindowPacker:
    """Places (item, length) with length <= capacity; ``closed`` gets each window's items when it leaves."""

    def __init__(self, capacity: int, open_windows: int, closed):
        self.capacity, self.most, self.closed = capacity, open_windows, closed
        self.free: list[tuple[int, int]] = []  # (room left, serial), ascending
        self.items: dict[int, list] = {}
        self.serial = 0

    def place(self, item, length: int) -> None:
        k = bisect_left(self.free, (length, -1))
        if k < len(self.free):
            room, serial = self.free.pop(k)
        else:
            if len(self.free) == self.most:
                self.closed(self.items.pop(self.free.pop(0)[1]))
            room, serial = self.capacity, self.serial
            self.serial += 1
            self.items[serial] = []
        self.items[serial].append(item)
        if room == length:
            self.closed(self.items.pop(serial))
        else:
            insort(self.free, (room - length, serial))

    def leftovers(self) -> list[list]:
        return [self.items[serial] for _, serial in self.free]


def _pack(tokenizer_path: str, end_id: int, capacity: int, open_windows: int, key_type: pa.DataType):
    schema = pa.schema({"key": key_type, "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "part": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, part = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        rows: list[tuple] = []
        state = {"window": 0, "bytes": 0}

        def close(pieces: list[tuple]) -> None:
            offset, sequence = 0, (part << 32) + state["window"]
            for key, start, total, ids in pieces:
                rows.append((key, start, len(ids) // 4, total, part, sequence, offset, ids))
                offset += len(ids) // 4
                state["bytes"] += len(ids) + 64
            state["window"] += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            state["bytes"] = 0
            return batch

        packer = WindowPacker(capacity, open_windows, close)
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, last, texts in text_slices(b.column(1)):
                offsets, found = coder.encode_batch(texts)
                found = found.astype("<u4").tobytes()
                for key, begin, stop in zip(keys[first:last], offsets[:-1].tolist(), offsets[1:].tolist()):
                    ids, total = found[4 * begin : 4 * stop] + end, stop - begin + 1
                    whole = total - total % capacity
                    for start in range(0, whole, capacity):
                        close([(key, start, total, ids[4 * start : 4 * (start + capacity)])])
                    if whole < total:
                        packer.place((key, whole, total, ids[4 * whole :]), total - whole)
                    if state["bytes"] > FLUSH_BYTES:
                        yield flush()
        if rows:
            yield flush()
        at = 0
        for pieces in packer.leftovers():
            for key, start, total, ids in pieces:
                rows.append((key, start, len(ids) // 4, total, part, None, at, ids))
                at += len(ids) // 4
        if rows:
            yield flush()

    return run


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, descending."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def _merge(left: DataFrame, total: int, capacity: int) -> DataFrame:
    """Cut leftover pieces, placed at ``at`` of one stream of ``total`` ids, where sequences end."""
    tail = total - total % capacity
    bounds = [tail]
    for size in powers(total - tail):
        bounds.append(bounds[-1] + size)
    marks = F.array(*[F.lit(b).cast("long") for b in bounds[: -1 or None]] if total > tail else [F.lit(total).cast("long")])
    end = F.col("at") + F.col("length")
    next_whole = (F.floor(F.col("at") / capacity) + 1) * capacity

    def within(c: Column) -> Column:
        return (c > F.col("at")) & (c < end)

    inner = F.array_distinct(F.concat(F.filter(F.array(next_whole), lambda c: within(c) & (c <= tail)), F.filter(marks, within)))
    starts = F.array_sort(F.concat(F.array("at"), inner))
    spans = F.transform("starts", lambda s, i: F.struct(s.alias("from"), F.coalesce(F.get("starts", i + 1), F.col("end")).alias("to")))
    cut = left.withColumn("end", end).withColumn("starts", starts).withColumn("span", F.explode(spans))
    here = F.col("span.from")
    passed = F.filter(marks, lambda b: b <= here)
    in_tail = here >= tail
    sequence = F.when(in_tail, F.lit(tail // capacity) + F.size(passed) - 1).otherwise(F.floor(here / capacity))
    offset = F.when(in_tail, here - F.array_max(passed)).otherwise(here % capacity)
    skip, n = here - F.col("at"), F.col("span.to") - here
    return cut.select("key", (F.col("start") + skip).alias("start"), n.alias("length"), "doc_tokens", (sequence + MERGED_FROM).cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), F.substring("ids", (4 * skip + 1).cast("int"), (4 * n).cast("int")).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``id_col``, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit).

    A null text packs as an empty document (``end_id`` alone).  Repeated rows and
    ids pack once a row.  A sequence holds at most ``capacity`` ids; it needs no
    padding if it is full or its size is a power of two.
    """
    key_type = pa.from_numpy_dtype("int64")
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    schema = "key bigint, start bigint, length bigint, doc_tokens bigint, part bigint, sequence_id bigint, offset bigint, ids binary"
    placed = storage.materialise(rows.mapInArrow(_pack(tokenizer_path, end_id, capacity, open_windows, key_type), schema), "packed", compression="zstd")
    whole = placed.where(F.col("sequence_id").isNotNull()).drop("part")
    left = placed.where(F.col("sequence_id").isNull())
    sizes = left.groupBy("part").agg(F.sum("length").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    merged = _merge(left.join(bases, "part").withColumn("at", F.col("base") + F.col("offset")), total, capacity)
    return whole.unionByName(merged).withColumnRenamed("key", id_col)
