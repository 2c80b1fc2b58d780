"""Hard negatives by exact search over blocks that are rotated to their principal axes.

Components are quantised to integers.  A block of vectors is written once with
its own orthogonal rotation to principal components and, for some leading parts,
each vector's norm of what is behind.  A query is rotated the same way and adds
up partial products over leading components; what is left of a product is
bounded by the two residual norms plus slack for rounding.  Pairs that cannot be
among the answers leave early, the others are verified by integer products.

Two rounds over the blocks: the first finds each anchor's positives, among rows
of its label; their scores give windows, and the second finds the best rows of
other labels in every window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .impact_search import quantised

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: In percent of the positive's score.
LOWEST, HIGHEST = 50, 95
#: Components of a block of vectors and of a block of queries, and queries that are bounded at once.
BLOCK_VALUES, QUERY_VALUES, TILE_ROWS = 1 << 19, 1 << 18, 128
#: Shares of the components after which pairs leave.
PARTS = (8, 4, 2)
VERIFIED_VALUES = 1 << 20
INDEX = "dim bigint, g bigint, ids binary, labels binary, kind string, ints binary, axes binary, leading binary, norms binary"


def ends_of(dim: int) -> list[int]:
    """How many leading components have been added up when pairs leave."""
    return sorted({max(1, dim // part) for part in PARTS} if dim else {0})


@dataclass
class Work:
    """Products of a pair's components that a search made, and those of brute force."""

    made: int = 0
    whole: int = 0


@dataclass
class Block:
    """Vectors sorted by label and id, their rotation, and norms: of the whole, then of what is behind each of ends_of."""

    ids: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    axes: np.ndarray
    leading: np.ndarray
    norms: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray) -> Block:
        order = np.lexsort((ids, labels))
        ids, labels, ints = ids[order], labels[order], ints[order]
        real = ints.astype(np.float64)
        largest = np.abs(real).max(initial=1)
        axes = np.linalg.eigh((real / largest).T @ (real / largest))[1][:, ::-1] if ints.shape[1] else np.zeros((0, 0))
        return cls(ids, labels, ints, axes, *rotated(ints, axes))

    def row(self) -> dict[str, bytes | str]:
        most = np.abs(self.ints).max(initial=0)
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
        parts = {"ids": self.ids, "labels": self.labels, "axes": self.axes, "leading": self.leading, "norms": self.norms}
        return {k: np.ascontiguousarray(v).tobytes() for k, v in parts.items()} | {"kind": kind, "ints": self.ints.astype(kind).tobytes()}

    @classmethod
    def of(cls, row: dict, dim: int) -> Block:
        ids = np.frombuffer(row["ids"], np.int64)
        shaped = lambda name, n: np.frombuffer(row[name], np.float64).reshape(n, -1) if dim else np.zeros((n, dim if name != "norms" else 2))
        return cls(ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["ints"], row["kind"]).astype(np.int64).reshape(len(ids), dim), shaped("axes", dim), shaped("leading", len(ids)), shaped("norms", len(ids)))


def rotated(ints: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leading components, norms of the whole and behind each end) of vectors along ``axes``."""
    along = ints.astype(np.float64) @ axes
    ends = ends_of(ints.shape[1])
    behind = [np.sqrt((along[:, end:] ** 2).sum(1)) for end in (0, *ends)]
    return along[:, : ends[-1]], np.stack(behind, axis=1)


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of ``a`` and j of ``b``, exact: longs where all fit, else Python integers."""
    dim = max(1, a.shape[1])
    exact = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * dim < 1 << 63 and min(a.min(initial=0), b.min(initial=0)) > -(1 << 63)
    out = np.zeros(len(i), np.int64 if exact else object)
    step = max(1, VERIFIED_VALUES // dim)
    for at in range(0, len(i), step):
        x, y = a[i[at : at + step]], b[j[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", x, y) if exact else (x.astype(object) * y.astype(object)).sum(1)
    return out


def bounded(queries: np.ndarray, leading: np.ndarray, norms: np.ndarray, block: Block, some: slice, possible: np.ndarray, keep: Callable, work: Work) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of the block, exact score) of the pairs of ``possible`` that ``keep`` cannot rule out.

    ``keep`` gets lower and upper bounds of all scores, and which pairs are still
    possible; it returns which remain.
    """
    dim, ends = queries.shape[1], ends_of(queries.shape[1])
    rows = np.arange(some.start, some.stop)
    work.whole += int(possible.sum()) * dim
    sums = np.zeros(possible.shape)
    rounding = 64 * max(1, dim) * np.finfo(float).eps
    at = 0
    for k, end in enumerate(ends, 1):
        sums += leading[:, at:end] @ block.leading[rows, at:end].T
        work.made += len(queries) * len(rows) * (end - at)
        # What is behind, the rounding of rotated sums, and one for numbers near zero.
        slack = np.outer(norms[:, k], block.norms[rows, k]) + rounding * np.outer(norms[:, 0], block.norms[rows, 0]) + rounding
        possible = possible & keep(sums - slack, sums + slack, possible)
        used = possible.any(0)
        if np.count_nonzero(used) < 0.8 * len(rows):
            rows, sums, possible = rows[used], sums[:, used], possible[:, used]
        at = end
        if np.count_nonzero(possible) * dim <= len(queries) * len(rows) * (dim - end):
            break
    query, column = np.nonzero(possible)
    work.made += len(query) * dim
    return query, rows[column], products(queries, block.ints, query, rows[column])


def _threshold(values: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest value; -inf where a row has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def first(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, best first, ties by id."""
    order = np.lexsort((ids, -scores, query))
    ordered = query[order]
    begins = np.searchsorted(ordered, ordered)
    return order[np.arange(len(order)) - begins < k]


def find_positives(query_ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, block: Block, k: int = POSITIVES, work: Work | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): each query's k best rows of its label and another id in the block."""
    work = work or Work()
    leading, norms = rotated(queries, block.axes)
    out = []
    for label in np.unique(labels):
        some = slice(*np.searchsorted(block.labels, [label, label + 1]).tolist())
        own = np.flatnonzero(labels == label)
        for at in range(0, len(own) if some.stop > some.start else 0, TILE_ROWS):
            tile = own[at : at + TILE_ROWS]

            def keep(low, high, possible):
                return high >= _threshold(np.where(possible, low, -np.inf), k)[:, None]

            others = query_ids[tile][:, None] != block.ids[some][None, :]
            query, row, score = bounded(queries[tile], leading[tile], norms[tile], block, some, others, keep, work)
            best = first(query, block.ids[row], score, k)
            out.append((tile[query[best]], block.ids[row[best]], score[best]))
    return _joined(out)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


def window(score: int) -> tuple[int, int]:
    """The least and the greatest score of a negative for a positive of this score."""
    return -(-LOWEST * score // 100), HIGHEST * score // 100


def find_negatives(labels: np.ndarray, queries: np.ndarray, windows: list[list[int]], block: Block, k: int = NEGATIVES, work: Work | None = None) -> list[tuple[int, int, int, int]]:
    """(query, positive's score, id, score): for each query and score of a positive, the k best rows of other labels in its window."""
    work = work or Work()
    leading, norms = rotated(queries, block.axes)
    out = []
    for at in range(0, len(queries), TILE_ROWS):
        tile = slice(at, min(at + TILE_ROWS, len(queries)))
        own = windows[tile]
        most = max(map(len, own), default=0)
        spans = [[window(s) for s in scores] + [(1, 0)] * (most - len(scores)) for scores in own]
        limits = np.array([[(float(a), float(b)) if a <= b else (np.inf, -np.inf) for a, b in row] for row in spans]).reshape(len(own), most, 2)

        def keep(low, high, possible):
            kept = np.zeros(possible.shape, bool)
            for j in range(limits.shape[1]):
                least, greatest = limits[:, j, 0], limits[:, j, 1]
                sure = np.where(possible & (high <= greatest[:, None]), low, -np.inf)
                kept |= (high >= np.maximum(least, _threshold(sure, k))[:, None]) & (low <= greatest[:, None])
            return kept

        others = labels[tile][:, None] != block.labels[None, :]
        query, row, score = bounded(queries[tile], leading[tile], norms[tile], block, slice(0, len(block.ids)), others, keep, work)
        for j in range(most):
            low = np.array([row_[j][0] for row_ in spans], object if score.dtype == object else np.int64)[query]
            high = np.array([row_[j][1] for row_ in spans], object if score.dtype == object else np.int64)[query]
            within = np.flatnonzero((score >= low) & (score <= high))
            best = within[first(query[within], block.ids[row[within]], score[within], k)]
            out += [(at + q, own[q][j], i, s) for q, i, s in zip(query[best].tolist(), block.ids[row[best]].tolist(), score[best].tolist())]
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _build(group: pa.Table) -> pa.Table:
    dim, times = group.column("dim")[0].as_py(), group.column("n").to_numpy()
    block = Block.build(*(np.repeat(x, times, axis=0) for x in (group.column("id").to_numpy(), group.column("label").to_numpy(), _matrix(group.column("v"), dim))))
    return pa.Table.from_pylist([{"dim": dim, "g": group.column("g")[0].as_py()} | block.row()]).select(["dim", "g", "ids", "labels", "kind", "ints", "axes", "leading", "norms"])


FOUND = pa.schema({"id": pa.int64(), "a": pa.int64(), "asked": pa.int64(), "found": pa.int64(), "score": pa.int64()})


def _search(negatives: bool):
    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(index) or not len(asked):
            return FOUND.empty_table()
        held = index.to_pylist()[0]
        dim = held["dim"]
        block, queries = Block.of(held, dim), _matrix(asked.column("v"), dim)
        ids, names, labels = (asked.column(c).to_numpy() for c in ("id", "a", "label"))
        if negatives:
            found = find_negatives(labels, queries, asked.column("windows").to_pylist(), block)
            query, own, other, score = zip(*found) if found else ((),) * 4
            query = np.array(query, np.int64)
        else:
            query, other, score = find_positives(ids, labels, queries, block)
            own, other, score = [None] * len(query), other.tolist(), score.tolist()
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (ids[query], names[query], own, other, score)], schema=FOUND)

    return search


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def mine(vectors: DataFrame, label: Column, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's hard negatives.

    Positives are an anchor's POSITIVES best rows of the same label and another
    id; for each, the NEGATIVES best rows of other labels whose score is LOWEST to
    HIGHEST percent of the positive's are ranked.  Scores are integer inner
    products of floor(SCALE * x); ties go to the smaller id.

    Cases: rows with a null id, label or vector, and vectors with null or
    non-finite components or with integers beyond a long, take no part; empty
    vectors score 0 with each other, and vectors of different sizes do not meet;
    rows alike are counted once and repeated as positives and negatives; anchors
    alike ask once, and an id with several vectors is several anchors; a found
    score beyond a long is an error, never a wrapped number; other columns are not
    read, whatever their names; an empty table gives an empty result.

    A row found very often is one row with a count.  Blocks are dealt by a hash,
    so no label or id makes a large one; the pairs of a query block and an index
    block are one task's bounded work.
    """
    vector = F.col(vector_col)
    fits = F.forall(vector, lambda x: F.abs(x.cast("double")) < 2.0**62 / SCALE)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(fits, quantised(vector, SCALE)).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("id", "label", "v").agg(F.bool_or("asks").alias("asks"), F.least(F.count("*"), F.lit(max(POSITIVES, NEGATIVES))).cast("int").alias("n"))
    rows = storage.materialise(rows.withColumn("dim", F.size("v").cast("long")).withColumn("a", F.xxhash64("id", "label", "v")), "quantised-vectors")
    values, asked = (x or 0 for x in rows.agg(F.sum(F.col("dim") * F.col("n")), F.sum(F.when(F.col("asks"), F.col("dim")))).first())
    blocks, query_blocks = -(-values // BLOCK_VALUES) or 1, -(-asked // QUERY_VALUES) or 1
    index = rows.select("id", "label", "v", "n", "dim", F.pmod("a", F.lit(blocks)).alias("g")).groupBy("dim", "g").applyInArrow(_build, INDEX)
    index = storage.materialise(index, "rotated-blocks").withColumn("h", _numbers(query_blocks))
    anchors = rows.where("asks").select("id", "label", "v", "dim", "a", F.pmod(F.shiftright("a", 32), F.lit(query_blocks)).alias("h"))
    keys = ["dim", "g", "h"]

    def found(queries: DataFrame, negatives: bool) -> DataFrame:
        dealt = queries.withColumn("g", _numbers(blocks))
        return index.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_search(negatives), "id bigint, a bigint, asked bigint, found bigint, score bigint")

    def best(frame: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "found")
        return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    positives = storage.materialise(best(found(anchors, False), POSITIVES, "id", "a").select("id", "a", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = positives.groupBy("id", "a").agg(F.array_sort(F.collect_set("positive_score")).alias("windows"))
    negatives = best(found(anchors.join(windows, ["id", "a"]), True), NEGATIVES, "id", "a", "asked").withColumnRenamed("asked", "positive_score")
    return positives.join(negatives, ["id", "a", "positive_score"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
