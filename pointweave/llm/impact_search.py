"""Exact top-k inner products over an impact-ordered index, scored a segment at a time.

Components are quantised to integers.  The index of a block of vectors holds its
postings (vector, dimension, value) in segments of descending impact: a segment
is one power of two of the value's magnitude, and it knows each vector's norm of
what the later segments hold.  A block of queries adds one segment after the
other to its accumulators.  What is still to come is bounded by the norms, so
after each segment a vector is out for a query as soon as its upper bound is
below the k-th best lower bound.  Scoring stops when exact scores of all that is
not out cost less than the postings to come, or none are to come; the vectors
that are not out are then rescored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

K = 20
SCALE = 64
BLOCK_ROWS = 4096
BLOCK_POSTINGS = 1 << 22
QUERY_ROWS = 1024


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as long; null if the vector is null or has a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _exact_type(*matrices: np.ndarray):
    """The fastest type in which all inner products of two such matrices are exact integers."""
    most = 1
    for m in matrices:
        most *= int(np.abs(m).max(initial=1)) or 1
    most *= max(m.shape[1] for m in matrices)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


@dataclass
class Segment:
    """Postings of one range of impacts, and by vector the norm of the values of later segments."""

    vector: np.ndarray
    dimension: np.ndarray
    value: np.ndarray
    next_norm: np.ndarray

    def tile(self, shape: tuple[int, int], dtype) -> np.ndarray:
        """The segment's values by dimension and vector, all others zero."""
        out = np.zeros(shape[::-1], dtype)
        out[self.dimension, self.vector] = self.value
        return out


def build_segments(vectors: np.ndarray) -> list[Segment]:
    """Segments of descending impact; the last holds what is left, and zeros are in none."""
    impact = np.abs(vectors)
    top = int(impact.max(initial=0)).bit_length()
    out = []
    for power in range(top - 1, -1, -1):
        here = impact >> power == 1
        if here.any():
            rest = np.where(impact < 1 << power, vectors, 0).astype(np.float64)
            at = np.nonzero(here)
            out.append(Segment(*(x.astype(np.int32) for x in at), vectors[at], np.sqrt((rest**2).sum(1))))
    return out


@dataclass
class Work:
    """Postings that queries met in an index, and how many of them were scored for the query."""

    postings: int = 0
    scored: int = 0


def search_block(
    queries: np.ndarray,
    query_ids: np.ndarray,
    vectors: np.ndarray,
    ids: np.ndarray,
    k: int = K,
    work: Work | None = None,
    segments: list[Segment] | None = None,
    floors: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, ids and scores of its best k among the block's rows with another id; best first, ties by id.

    ``segments`` are the stored ones of the block.  ``floors`` holds for each query
    a score that k rows elsewhere reach (minus infinity: none known); rows below it
    are not returned.  A query leaves the scoring as soon as rescoring what it may
    still find costs less than the postings to come.
    """
    segments = build_segments(vectors) if segments is None else segments
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    dtype = _exact_type(queries, vectors)
    real = np.float32 if dtype is np.float32 else np.float64
    asked = queries.astype(dtype)
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    # A floor may lie beyond what the type holds exactly: the next number below never rules out a tie.
    lowest = np.finfo(real).min / 2
    least_of = np.nextafter(np.maximum(floors, lowest).astype(real), real(-np.inf))
    own = query_ids[:, None] == ids[None, :]
    scores = np.zeros((len(queries), len(ids)), dtype)
    last = len(ids) - min(k, len(ids))
    to_come = sum(len(s.value) for s in segments)
    if work is not None:
        work.postings += to_come * len(queries)
    possible = ~own
    active = np.arange(len(queries))
    rest = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    for segment in [None, *segments]:
        if segment is not None:
            scores[active] += asked[active] @ segment.tile(vectors.shape, dtype)
            to_come -= len(segment.value)
            rest = segment.next_norm
            if work is not None:
                work.scored += len(segment.value) * len(active)
        now, mine = scores[active].astype(real, copy=False), own[active]
        # A thousandth and one more cover the rounding of norms and sums.
        slack = np.outer(norm[active], np.where(rest > 0, 1.001 * rest, 0)).astype(real, copy=False)
        slack += real(rest.any())
        sure = now - slack
        sure[mine] = -np.inf
        least = np.maximum(np.partition(sure, last, axis=1)[:, last], least_of[active])
        slack += now
        possible[active] = (slack >= least[:, None]) & ~mine
        active = active[np.count_nonzero(possible[active], axis=1) * vectors.shape[1] > to_come]
        if not len(active):
            break
    for i in range(len(queries)):
        members = np.flatnonzero(possible[i])
        exact = (vectors[members].astype(object if dtype is object else np.int64) @ queries[i]).astype(np.int64)
        if len(members) > 4 * k:
            floor = np.partition(exact, len(exact) - k)[len(exact) - k]
            members, exact = members[exact >= floor], exact[exact >= floor]
        order = np.lexsort((ids[members], -exact))[:k]
        yield ids[members][order], exact[order]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


#: A block's segments, a row each by place; place 0 holds the block's ids and whole norms.
STORED = "dim int, band int, part bigint, place int, ids array<bigint>, vector array<int>, dimension array<int>, value array<bigint>, next_norm array<double>"
STORED_SCHEMA = pa.schema(
    {"dim": pa.int32(), "band": pa.int32(), "part": pa.int64(), "place": pa.int32(), "ids": pa.list_(pa.int64()), "vector": pa.list_(pa.int32()), "dimension": pa.list_(pa.int32()), "value": pa.list_(pa.int64()), "next_norm": pa.list_(pa.float64())}
)
FOUND = pa.schema({"query_id": pa.int64(), "found": pa.list_(pa.int64()), "scores": pa.list_(pa.int64())})


def _store_block(block: pa.Table) -> pa.Table:
    """The segments of one block's rows, each repeated as often as it counts."""
    dim, band, part = (block.column(x)[0].as_py() for x in ("dim", "band", "part"))
    times = block.column("n").to_numpy()
    held = np.repeat(_matrix(block.column("v"), dim), times, axis=0)
    ids = np.repeat(block.column("id").to_numpy(), times)
    norms = np.sqrt((held.astype(np.float64) ** 2).sum(1))
    out = [{"dim": dim, "band": band, "part": part, "place": 0, "ids": ids, "vector": [], "dimension": [], "value": [], "next_norm": norms}]
    for place, s in enumerate(build_segments(held), 1):
        out.append({"dim": dim, "band": band, "part": part, "place": place, "ids": [], "vector": s.vector, "dimension": s.dimension, "value": s.value, "next_norm": s.next_norm})
    return pa.Table.from_arrays([pa.array([row[f.name] for row in out], f.type) for f in STORED_SCHEMA], schema=STORED_SCHEMA)


def _values(column: pa.ChunkedArray, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def load_block(stored: pa.Table) -> tuple[np.ndarray, np.ndarray, list[Segment]]:
    """Ids, vectors and segments of one stored block."""
    stored = stored.sort_by("place")
    ids = _values(stored.column("ids"), 0)
    segments = [Segment(*(_values(stored.column(x), i) for x in ("vector", "dimension", "value", "next_norm"))) for i in range(1, len(stored))]
    vectors = np.zeros((len(ids), stored.column("dim")[0].as_py()), np.int64)
    for s in segments:
        vectors[s.vector, s.dimension] = s.value
    return ids, vectors, segments


def _search(index: DataFrame, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the best k of every block for the queries that ``pairs`` lets meet it."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return FOUND.empty_table()
        ids, vectors, segments = load_block(left)
        query_ids, queries = right.column("id").to_numpy(), _matrix(right.column("v"), vectors.shape[1])
        floors = right.column("floor").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy()
        found = list(search_block(queries, query_ids, vectors, ids, k, segments=segments, floors=floors))
        return pa.Table.from_arrays([pa.array(query_ids), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([s for _, s in found], pa.list_(pa.int64()))], schema=FOUND)

    keys = ["dim", "band", "part", "h"]
    left = index.join(pairs, ["dim", "band", "part"])
    # Both sides read the pairs, so the queries' columns get names of their own plan.
    right = asked.join(pairs, ["dim", "h"]).select(*(F.col(x).alias(x) for x in (*keys, "id", "v", "floor")))
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id bigint, found array<bigint>, scores array<bigint>")
    return parts.select("query_id", F.explode(F.arrays_zip("found", "scores")).alias("x")).select("query_id", F.col("x.found").alias("vec_id"), F.col("x.scores").alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows.

    Vectors that are null or empty or hold null or non-finite components, and
    rows with a null id, take no part; vectors of different sizes do not meet.
    Every row whose id is not the query's is a candidate, repeated rows too, so an
    id may be found more than once; rows alike in id and vector ask once, and an
    id of several vectors gets the best of all of them.  A query with fewer other
    rows gets them all.  Scores must fit a long; one that does not is an error,
    never a wrapped number.  Other columns are not read; an empty table gives an
    empty result.

    Rows alike are counted first, so an id repeated very often is one row with a
    count.  Vectors are dealt by the power of two of their squared norm and, within
    it, into blocks of bounded size; each block's segments are built once and
    stored.  Every query first searches the block of its size with the greatest
    norms.  The k-th best score there is its floor: pairs of a block and queries
    that no norm lets reach it are never shuffled, and in other blocks it rules rows
    out from the first segment on.  A task's work is one block and one block of
    queries.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.groupBy("id", "v").agg(F.bool_or("asks").alias("asks"), F.count("*").alias("n"))
    rows = rows.withColumns({"dim": F.size("v"), "norm": F.sqrt(squares)})
    # A double's exponents bound the number of bands of a size.
    rows = rows.withColumn("band", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 2)).otherwise(-1).cast("int"))
    rows = storage.materialise(rows, "impact-rows")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_POSTINGS) / F.col("dim"))))
    dealt = rows.groupBy("dim", "band").agg(F.ceil(F.count("*") / F.first(room)).alias("parts"))
    deal = F.xxhash64("id", "v")
    block = ["dim", "band", "part"]
    blocks = rows.join(dealt, ["dim", "band"]).select("dim", "band", F.pmod(deal, F.col("parts")).alias("part"), "id", "v", F.least("n", F.lit(k)).cast("int").alias("n"))
    index = storage.materialise(blocks.groupBy(*block).applyInArrow(_store_block, STORED), "impact-index")
    held = index.where(F.col("place") == 0).select(*block, F.size("ids").alias("rows"), F.array_max("next_norm").alias("top"))
    asking = rows.where("asks").groupBy("dim").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("parts"))
    asked = rows.where("asks").join(asking, "dim").select("id", "v", "dim", "norm", F.pmod(F.shiftright(deal, 32), F.col("parts")).alias("h"))
    first = held.groupBy("dim").agg(F.max_by(F.struct("band", "part"), F.struct(F.col("rows") > k, "top", "rows", "band", "part")).alias("x")).select("dim", "x.*")

    seeds = _search(index, asked.withColumn("floor", F.lit(None).cast("long")), first.join(asking, "dim").select(*block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("h")), k)
    seeds = storage.materialise(seeds, "impact-seeds")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    floors = seeds.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    asked = storage.materialise(asked.join(floors, "id", "left"), "impact-queries")
    # What a block's greatest norm must reach for any query of the block of queries; null where a query has no floor.
    needed = F.when(F.col("norm") > 0, F.col("floor") / F.col("norm"))
    wanted = asked.groupBy("dim", "h").agg(F.when(F.count(needed) == F.count("*"), F.min(needed)).alias("needed"))
    others = held.join(first, block, "left_anti")
    pairs = others.join(wanted, "dim").where(F.col("needed").isNull() | (F.col("top") * 1.001 + 1 >= F.col("needed"))).select(*block, "h")
    found = seeds.unionByName(_search(index, asked, pairs, k))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
