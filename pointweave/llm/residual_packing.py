"""Hierarchical residual packing: documents whole, in as few sequences as best fit finds.

A task packs its documents by best fit, longest first, a buffer at a time; bins
that are nearly full leave with their ids.  What is left of all tasks, underfull
bins, are items of the next level: they are dealt into groups, packed by best
fit again, and groups melt together by a fan-in a level until one bounded group
is left or a level saves nothing.  Only bin numbers and sizes travel between
levels; the ids of a piece are written once, where its task encoded it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .encoding import encoder, text_slices

CAPACITY = 2048
#: A bin whose room is at most a 64th of the capacity is nearly full.
NEARLY = 64
#: Ids that a task holds before it packs them, and open bins that it carries on at most.
BUFFER_IDS, OPEN_BINS = 1 << 21, 2048
#: Underfull bins that one group packs at most, and groups that melt into one a level.
GROUP_BINS, FAN_IN = 1 << 18, 16
#: A level that saves less than this share of its bins is the last; the group of all is always packed.
WORTHWHILE = 0.002
PIECES = "piece int, start bigint, length bigint, ids binary, bin bigint, offset bigint, size bigint"


class BestFit:
    """Open bins by their room; the bin that an item fills best is found by one shift of a bit set."""

    def __init__(self, capacity: int):
        self.mask, self.open = 0, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, length: int) -> int | None:
        """The bin of least room for ``length``, no longer open; None if none has room."""
        higher = self.mask >> length
        if not higher:
            return None
        return self._pop(length + (higher & -higher).bit_length() - 1)

    def _pop(self, room: int) -> int:
        held = self.by_room[room]
        found = held.pop()
        if not held:
            self.mask ^= 1 << room
        self.open -= 1
        return found

    def put(self, bin_: int, room: int) -> None:
        self.by_room[room].append(bin_)
        self.mask |= 1 << room
        self.open += 1

    def fullest(self) -> int:
        return self._pop((self.mask & -self.mask).bit_length() - 1)

    def rest(self) -> list[int]:
        return [b for held in self.by_room for b in held]


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; bins are numbered from 0 as they open."""
    into, offset, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    fit, lengths = BestFit(capacity), sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = lengths[i]
        b = fit.take(n)
        if b is None:
            b = len(used)
            used.append(0)
        into[i], offset[i] = b, used[b]
        used[b] += n
        if used[b] < capacity:
            fit.put(b, capacity - used[b])
    return into, offset


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else whole windows behind a first piece that may be shorter."""
    first = total if total <= capacity else total % capacity
    return [(0, first)] * bool(first) + [(at, capacity) for at in range(first, total, capacity)]


class LocalPacker:
    """A task's bins; ``pieces`` of bins that left wait in ``done`` for the next batch."""

    def __init__(self, capacity: int, part: int):
        self.capacity, self.near, self.part = capacity, capacity // NEARLY, part
        self.fit, self.serial = BestFit(capacity), 0
        self.bins: dict[int, tuple[int, list[tuple]]] = {}
        self.waiting: list[tuple] = []
        self.held = 0
        self.done: list[tuple] = []

    def add(self, row: int, piece: int, start: int, ids: memoryview) -> None:
        self.waiting.append((row, piece, start, len(ids) // 4, ids))
        self.held += len(ids) // 4

    def close(self, b: int) -> None:
        used, pieces = self.bins.pop(b)
        offset = 0
        for row, piece, start, length, ids in pieces:
            self.done.append((row, piece, start, length, bytes(ids), (self.part << 32) + b, offset, used))
            offset += length

    def settle(self, last: bool) -> None:
        """Pack what waits, longest first; open bins beyond OPEN_BINS leave, the fullest first, and all at the end."""
        self.waiting.sort(key=lambda x: -x[3])
        for item in self.waiting:
            n = item[3]
            b = self.fit.take(n)
            if b is None:
                b = self.serial
                self.serial += 1
                self.bins[b] = (0, [])
            used, pieces = self.bins[b]
            pieces.append(item)
            self.bins[b] = (used + n, pieces)
            if self.capacity - used - n:
                self.fit.put(b, self.capacity - used - n)
            else:
                self.close(b)
        self.waiting, self.held = [], 0
        while self.fit.open and (last or self.fit.open > OPEN_BINS or self.fit.mask & (1 << self.near + 1) - 1):
            self.close(self.fit.fullest())


def _local(tokenizer_path: str, end_id: int, capacity: int):
    fields = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "bin": pa.int64(), "offset": pa.int64(), "size": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        packer, schema = LocalPacker(capacity, TaskContext.get().partitionId()), None

        def flush() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(packer.done), 4096):
                columns = zip(*packer.done[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)
            packer.done = []

        for b in batches:
            schema = pa.schema({"row": b.schema.field(0).type} | fields)
            rows = b.column(0).to_pylist()
            for first, last, texts in text_slices(b.column(1)):
                offsets, found = coder.encode_batch(texts)
                found = found.astype("<u4").tobytes()
                for row, begin, stop in zip(rows[first:last], offsets[:-1].tolist(), offsets[1:].tolist()):
                    ids = memoryview(found[4 * begin : 4 * stop] + end)
                    for k, (start, n) in enumerate(cut(stop - begin + 1, capacity)):
                        packer.add(row, k, start, ids[4 * start : 4 * (start + n)])
                        if packer.held >= BUFFER_IDS:
                            packer.settle(False)
                            yield from flush()
        packer.settle(True)
        yield from flush()

    return run


def _pack_group(capacity: int):
    def pack(group: pa.Table) -> pa.Table:
        bins, sizes = group.column("bin").to_numpy(), group.column("size").to_numpy()
        order = np.argsort(bins, kind="stable")
        bins, sizes = bins[order], sizes[order]
        into, offset = best_fit_decreasing(sizes, capacity)
        # A bin is named after the first item laid in it, which no other bin holds.
        name = np.zeros(into.max(initial=-1) + 1, np.int64)
        name[into[offset == 0]] = bins[offset == 0]
        total = np.bincount(into, sizes, len(name)).astype(np.int64)
        return pa.table({"bin": bins, "into": name[into], "base": offset, "total": total[into]})

    return pack


def merge_underfull(bins: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin, into, base): the sequence and the place there of every underfull bin of (bin, size), a level of the tree at a time."""
    bins = storage.materialise(bins.select("bin", "size"), "underfull-bins")
    placed = bins.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("base"))
    n, groups = bins.agg(F.count("*"), F.count_distinct(F.shiftright("bin", 32))).first()
    level, depth = bins, 0
    while n > 1:
        least, depth = -(-n // GROUP_BINS), depth + 1
        groups = max(least, -(-groups // FAN_IN))
        # Sizes of all kinds meet in every group: dealt by a hash, not by the tasks that left them.
        dealt = level.select("bin", "size", F.pmod(F.xxhash64("bin", F.lit(depth)), F.lit(groups)).alias("group"))
        packed = storage.materialise(dealt.groupBy("group").applyInArrow(_pack_group(capacity), "bin bigint, into bigint, base bigint, total bigint"), "packed-level")
        moved = packed.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("base").alias("more"))
        step = placed.join(moved, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        placed = storage.materialise(step, "placed-bins")
        level = storage.materialise(packed.where((F.col("base") == 0) & (F.lit(capacity) - F.col("total") > capacity // NEARLY)).select(F.col("into").alias("bin"), F.col("total").alias("size")), "underfull-bins")
        before, n = n, level.count()
        saved = before - packed.where("base = 0").count()
        if groups == 1 or (groups == least and saved < WORTHWHILE * before):
            break
    return placed


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``id_col``, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id and offset.

    Every document ends in ``end_id``.  One of at most ``capacity`` ids is one
    piece; a longer one is cut so that all pieces but the first are full.

    Cases: a null or empty text is ``end_id`` alone; a text of any length is cut
    into windows while the task goes on, so memory holds its ids but no more than
    a buffer of others; rows of null or repeated ids, and repeated rows, pack a
    row each; other columns are not read, whatever their names; an empty table
    has no pieces.  Numbers of sequences follow the input's partitions.
    """
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    schema = f"row {docs.schema[id_col].dataType.simpleString()}, {PIECES}"
    placed = storage.materialise(rows.mapInArrow(_local(tokenizer_path, end_id, capacity), schema), "local-bins", compression="zstd")
    underfull = F.lit(capacity) - F.col("size") > capacity // NEARLY
    moved = merge_underfull(placed.where(underfull & (F.col("offset") == 0)).select("bin", "size"), capacity)
    full = placed.where(~underfull).select("row", "piece", "start", "length", "ids", F.col("bin").alias("sequence_id"), "offset")
    left = placed.where(underfull).join(moved, "bin").select("row", "piece", "start", "length", "ids", F.col("into").alias("sequence_id"), (F.col("base") + F.col("offset")).alias("offset"))
    return full.unionByName(left).withColumnRenamed("row", id_col)
