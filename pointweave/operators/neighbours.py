"""Nearest neighbours by an index of cells whose number of probes is measured, not guessed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written

#: Vectors up to which every one is compared; rows that the index is fitted on at most; its cells at most.
EXACT_ROWS, SAMPLE_ROWS, MOST_CELLS = 10_000, 20_000, 512
#: Sampled queries that measure how many cells are needed, the share of neighbours wanted, and rows of a cell compared at once.
MEASURED, WANTED, BLOCK_ROWS = 400, 0.95, 4_096
ROUNDS, SEED = 8, 7
#: Queries whose distances to a block are held at once.
QUERIES_AT_ONCE = 128


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact to rounding and never below zero."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)


@dataclass
class Cells:
    """Centres of cells, and how many of the nearest a query looks into."""

    centres: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(squared(vectors, self.centres), axis=1, kind="stable")[:, :n]

    @classmethod
    def fit(cls, sample: np.ndarray, k: int) -> Cells:
        """Centres by Lloyd rounds; probes are the fewest that find WANTED of the k nearest of sampled queries in the sample."""
        rng = np.random.default_rng(SEED)
        n = int(min(MOST_CELLS, max(1, len(sample) ** 0.5)))
        centres = sample[rng.choice(len(sample), n, replace=False)]
        for _ in range(ROUNDS):
            own = squared(sample, centres).argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, sample)
            held = np.bincount(own, minlength=n)
            centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
        cells = cls(centres, n)
        own = cells.nearest(sample, 1)[:, 0]
        asked = rng.choice(len(sample), min(MEASURED, len(sample)), replace=False)
        near = np.argsort(squared(sample[asked], sample), axis=1, kind="stable")[:, : k + 1]
        order = np.argsort(cells.nearest(sample[asked], n), axis=1)  # a cell's rank for each query
        rank = np.take_along_axis(order, own[near], 1)
        cells.probes = int(np.ceil(np.quantile(rank, WANTED, method="inverted_cdf"))) + 1
        return cells


def fitted(vectors: DataFrame, group: str, vector: str, k: int, exact_rows: int = EXACT_ROWS) -> Cells | None:
    """Cells from a bounded sample that takes from every group as much as there is room for; None if all rows can be compared."""
    n, groups = vectors.agg(F.count("*"), F.approx_count_distinct(group)).first()
    if n <= exact_rows:
        return None
    each = max(1, SAMPLE_ROWS // max(1, groups))
    first = Window.partitionBy(group).orderBy(F.xxhash64(vector))
    sample = vectors.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= each).select(vector).limit(SAMPLE_ROWS)
    return Cells.fit(np.array([r[0] for r in sample.collect()], np.float64), k)


def _assign(cells: Cells | None, probes: int, name: str):
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(name)
            v = b.column(at)
            matrix = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(v), -1)
            found = cells.nearest(matrix, probes).tolist() if cells and len(v) else [[0]] * len(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    return run


def ordered(keys: pa.ChunkedArray) -> np.ndarray:
    """Places of keys in ascending order, null first; a struct by its fields."""
    keys = keys.combine_chunks()
    fields = keys.flatten() if pa.types.is_struct(keys.type) else [keys]
    table = pa.Table.from_arrays(fields, [str(i) for i in range(len(fields))])
    return pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names], null_placement="at_start").to_numpy()


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1)


def _kth(near: np.ndarray, k: int) -> np.ndarray:
    """Each row's value of place ``k`` (from 0) in ascending order; few places are found by minima, which are set aside and put back."""
    if k > 3:
        return np.partition(near, k, axis=1)[:, k]
    rows, aside = np.arange(len(near)), []
    for _ in range(k):
        at = near.argmin(1)
        aside.append((at, near[rows, at]))
        near[rows, at] = np.inf
    found = near.min(1)
    for at, value in aside[::-1]:
        near[rows, at] = value
    return found


def closest(asked: np.ndarray, held: np.ndarray, k: int, root: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): the ``k`` rows of ``held`` closest to each of ``asked``, in order, ties to the earlier row.

    d is the sum of squares, or its ``root``, added in the order of the components.
    Products only choose: whatever their rounding may hide is added up, and so are
    rows that are not finite, whose distance comes last. Equal rows are compared once.
    """
    bits = np.ascontiguousarray(held).view(np.dtype((np.void, held.shape[1] * 8))).ravel()
    _, first, name, times = np.unique(bits, return_index=True, return_inverse=True, return_counts=True)
    members, begin, once = np.argsort(name, kind="stable"), np.cumsum(times) - times, held[first]
    with np.errstate(all="ignore"):
        na, nb = (asked**2).sum(1), (once**2).sum(1)
    odd_a, odd_b = ~(na < 1e300), ~(nb < 1e300)
    na, nb = np.where(odd_a, 0, na), np.where(odd_b, 0, nb)
    # A query's own square is the same for all rows: products of (a, 1) and (-2 b, b * b) rank them.
    a = np.column_stack([np.where(odd_a[:, None], 0, asked), np.ones(len(asked))])
    b = np.vstack([np.where(odd_b[:, None], 0, -2 * once).T, nb])
    slack = 2e-15 * (held.shape[1] + 8) * (na + nb.max())
    found, columns, any_odd = [], (np.ascontiguousarray(asked.T), np.ascontiguousarray(once.T)), (odd_a.any(), odd_b.any())
    for at in range(0, len(asked), QUERIES_AT_ONCE):
        own = slice(at, at + QUERIES_AT_ONCE)
        near = a[own] @ b
        if any_odd[1]:
            near[:, odd_b] = np.inf
        able = near <= (_kth(near, min(k, len(once)) - 1) + slack[own])[:, None]
        if any_odd[1]:
            able[:, odd_b] = True
        if any_odd[0]:
            able[odd_a[own]] = True
        i, j = np.divmod(np.flatnonzero(able), len(once))
        i += at
        d = np.zeros(len(i))
        with np.errstate(all="ignore"):
            for x, y in zip(*columns):
                apart = x[i] - y[j]
                d += apart * apart
        copies = np.minimum(times[j], k)
        step = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        i, d, j = np.repeat(i, copies), np.repeat(np.sqrt(d) if root else d, copies), members[np.repeat(begin[j], copies) + step]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[kept], j[kept], d[kept]))
    return tuple(np.concatenate(x) for x in zip(*found))


def k_nearest(queries: DataFrame, stored: DataFrame, k: int, cells: Cells | None, vector: str = "vector") -> DataFrame:
    """(query, near, d): each query's k nearest stored rows with their squared distances, ties to the lesser ``near``.

    ``queries`` has query and ``vector``, ``stored`` has near and ``vector``; both
    keys may be of any type that orders.  Vectors must be whole and of one length;
    rows of a null vector are left out.  With ``cells`` a query looks into its
    nearest cells alone; without, all rows are one cell.  Rows and queries of a
    cell are dealt into blocks of some BLOCK_ROWS, and each pair of blocks is compared
    by itself, so no task holds much.
    """

    def assigned(rows: DataFrame, name: str, probes: int) -> DataFrame:
        rows = rows.where(F.col(vector).isNotNull()).select(name, F.col(vector).cast("array<double>").alias("vector"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(_assign(cells, probes, "vector"), f"{kinds}, cells array<int>").select(name, "vector", F.explode("cells").alias("cell"))

    def dealt(rows: DataFrame, name: str, blocks: DataFrame) -> DataFrame:
        return rows.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("vector", name), F.col("blocks")).alias("block"), name, "vector")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))

    def met(rows: DataFrame, others: DataFrame, mine: str, theirs: str) -> DataFrame:
        return rows.withColumnRenamed("block", mine).join(others, "cell").withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    held = written(assigned(stored, "near", 1), "neighbour-cells")
    asked = written(assigned(queries, "query", cells.probes if cells else 1), "neighbour-queries")
    there, here = counted(held), counted(asked)
    left, right = met(dealt(asked, "query", here), there, "part", "block"), met(dealt(held, "near", there), here, "block", "part")
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, near {stored.schema['near'].dataType.simpleString()}, d double"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        i = j = np.zeros(0, np.int64)
        d = np.zeros(0)
        if len(left) and len(right):
            right = right.take(pa.array(ordered(right.column("near"))))
            i, j, d = closest(matrix(left.column("vector")), matrix(right.column("vector")), k)
        return pa.table({"query": left.column("query").take(pa.array(i)), "near": right.column("near").take(pa.array(j)), "d": pa.array(d)})

    found = left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "part")).applyInArrow(search, kinds)
    order = Window.partitionBy("query").orderBy("d", "near")
    return found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")
