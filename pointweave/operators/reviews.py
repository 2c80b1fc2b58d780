"""Reviews, evaluations and exports that rest on several operators."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import manifest_diff
from .ordering import even_sample
from .regions import distance, finite

#: How far a keypoint may be from a track's pixel, and how many points a keypoint's place may take.
KEYPOINT_RADIUS, MOST_A_POINT = 2.0, 4
#: Products below this may have lost digits; rounds in which a hull drops all points that are no corners at once.
TINY, SWEEPS = 1e-290, 24


def image_identity(files: DataFrame) -> DataFrame:
    """(name, sha256) of image files (path, sha256), by their base names."""
    return files.select(F.regexp_extract("path", r"([^/\\]+)$", 1).alias("name"), "sha256")


def review_problems(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(name, problem) of images that a stored review no longer fits: missing, undeclared or changed."""
    return manifest_diff(stored, now, "name", "sha256")


def public_columns(rows: DataFrame, root: Column, path: str = "path", private: Sequence[str] = ("mask_path", "image_path", "folder")) -> DataFrame:
    """Rows as a client may see them: no local paths, but a URL of the file under ``root``."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return rows.withColumn("url", F.concat(root, F.lit("/"), name)).drop(path, *private)


def pixel_differences(a: DataFrame, b: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """(keys, problem) of pixels that two images do not share with the same value; empty if they are equal."""
    left, right = a.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__l")), b.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__r"))
    problem = F.when(F.col("__r").isNull(), "left_alone").when(F.col("__l").isNull(), "right_alone").when(~F.col("__a").eqNullSafe(F.col("__b")), "value")
    return left.join(right, list(keys), "full_outer").withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "problem")


def to_world(point: Column, rotation: Column, shift: Column) -> Column:
    """A point of a camera's frame in the world's, where the camera sees x as rotation * x + shift; ``rotation`` is an array of rows."""
    moved = [point[j] - shift[j] for j in range(3)]
    return F.array(*[sum(rotation[j][i] * moved[j] for j in range(3)) for i in range(3)])


def assign_keypoints(keypoints: DataFrame, tracks: DataFrame, radius: float = KEYPOINT_RADIUS, most: int = MOST_A_POINT) -> DataFrame:
    """(keypoint, point, distance): each keypoint's nearest track pixel of its image within ``radius``, ``most`` keypoints a point.

    ``keypoints`` (image, keypoint, x, y) and ``tracks`` (image, point, x, y) meet
    in grid cells and their neighbours; of too many at a point the nearest stay.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = keypoints.select("image", "keypoint", F.col("x").alias("qx"), F.col("y").alias("qy"), cell("x").alias("gx"), cell("y").alias("gy"))
    for c in ("gx", "gy"):
        near = near.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    stored = tracks.select("image", "point", "x", "y", cell("x").alias("gx"), cell("y").alias("gy"))
    met = near.join(stored, ["image", "gx", "gy"]).withColumn("distance", distance((F.col("x"), F.col("qx")), (F.col("y"), F.col("qy")))).where(F.col("distance") <= radius)
    best = met.groupBy("image", "keypoint").agg(F.min(F.struct("distance", "point")).alias("m")).select("image", "keypoint", "m.point", "m.distance")
    first = F.row_number().over(Window.partitionBy("image", "point").orderBy("distance", "keypoint"))
    return best.withColumn("__r", first).where(F.col("__r") <= most).select("image", "keypoint", "point", "distance")


def not_too_near(queries: DataFrame, nearest: DataFrame, extent: float, share: float = 0.001, query_id: str = "query_id") -> DataFrame:
    """Queries without a neighbour (query, distance) nearer than ``share`` of the scene's extent."""
    near = nearest.where(F.col("distance") < share * extent).select(query_id)
    return queries.join(near, query_id, "left_anti")


def _turn(a: tuple, b: tuple, c: tuple) -> int:
    """Whether the way a, b, c turns left (1), right (-1) or goes straight (0); exact where doubles cannot tell."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    if not abs(left - right) > 1e-14 * (abs(left) + abs(right)) + TINY or not math.isfinite(left - right):
        (ax, ay), (bx, by), (cx, cy) = (tuple(map(Fraction, p)) for p in (a, b, c))
        left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    return (left > right) - (left < right)


def convex_hull(points: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull in order; points on its edges and repeated ones are none."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def chain(side):
        out: list[tuple[float, float]] = []
        for p in side:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(ordered) + chain(ordered[::-1])


def _turns(a: tuple, b: tuple, c: tuple) -> np.ndarray:
    """``_turn`` of many ways at once, points as pairs of arrays; those that doubles cannot tell are decided one by one."""
    with np.errstate(all="ignore"):
        (ux, uy), (vx, vy) = (b[0] - a[0], b[1] - a[1]), (c[0] - a[0], c[1] - a[1])
        left, right = ux * vy, uy * vx
        turn = np.sign(left - right)
        none = ((ux == 0) | (vy == 0)) & ((uy == 0) | (vx == 0))
        open_ = ~none & ~((np.abs(left - right) > 1e-14 * (np.abs(left) + np.abs(right)) + TINY) & np.isfinite(left - right))
    turn[none] = 0
    for i in np.flatnonzero(open_).tolist():
        turn[i] = _turn(*[(float(x[i]), float(y[i])) for x, y in (a, b, c)])
    return turn


def _chain(group: np.ndarray, u: np.ndarray, v: np.ndarray, side: int) -> np.ndarray:
    """Which points, in order of (group, u, v), are on their group's lower (side 1) or upper (-1) chain, ends included.

    A point that does not turn to its side between two others is no corner, so all
    such go at once, until none is left; groups where that goes on are walked point by point.
    """
    kept, at = np.ones(len(u), bool), np.arange(len(u))
    for _ in range(SWEEPS):
        own = group[at]
        mid = np.flatnonzero(own[2:] == own[:-2]) + 1
        out = mid[_turns(*[(u[x], v[x]) for x in (at[mid - 1], at[mid], at[mid + 1])]) * side <= 0]
        if not len(out):
            return kept
        kept[at[out]] = False
        stay = np.isin(own, own[out])
        stay[out] = False
        at = at[stay]
    for points in np.split(at, np.flatnonzero(np.diff(group[at])) + 1):
        stack: list[int] = []
        for i in points.tolist():
            while len(stack) > 1 and side * _turn(*[(float(u[k]), float(v[k])) for k in (*stack[-2:], i)]) <= 0:
                stack.pop()
            stack.append(i)
        kept[points] = False
        kept[stack] = True
    return kept


def hull_rows(group: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows that are corners of their group's hull, group by group in the order of the ring; ``group`` ascends, (u, v) within it."""
    new = np.ones(len(u), bool)
    new[1:] = (group[1:] != group[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    rows = np.flatnonzero(new)
    group, u, v = group[rows], u[rows], v[rows]
    edge = np.diff(group, prepend=-1, append=-1) != 0
    low, high = np.flatnonzero(_chain(group, u, v, 1)), np.flatnonzero(_chain(group, u, v, -1) & ~edge[:-1] & ~edge[1:])
    at = np.concatenate([low, high])
    back = np.arange(len(at)) >= len(low)
    return rows[at[np.lexsort((np.where(back, -at, at), back, group[at]))]]


def _codes(keys: pa.Array) -> np.ndarray:
    return keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch (by, u, v) with the corners alone, unless its groups are so small that most points are corners."""
    for b in batches:
        codes = _codes(b.column(0))
        if len(codes) >= 16 * (codes.max(initial=0) + 1):
            u, v = b.column(1).to_numpy(), b.column(2).to_numpy()
            order = np.lexsort((v, u, codes))
            b = b.take(pa.array(order[hull_rows(codes[order], u[order], v[order])]))
        yield b


def _hulls(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Batches (by, u, v) of whole hulls in the order of their rings, from points in order of (by, u, v).

    Of a group that goes on in the next batch only what may still be a corner is
    held once it has more than ``at_once`` points.
    """

    def rings(b: pa.RecordBatch, codes: np.ndarray) -> np.ndarray:
        return hull_rows(codes, b.column(1).to_numpy(), b.column(2).to_numpy())

    held: list[pa.RecordBatch] = []
    waiting, limit = 0, at_once
    for b in batches:
        if not b.num_rows:
            continue
        same = bool(held) and held[-1].column(0)[-1:].equals(b.column(0)[:1]) and held[-1].column(0)[-1:].equals(b.column(0)[-1:])
        held.append(b)
        waiting += b.num_rows
        if same and waiting <= limit:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = _codes(whole.column(0))
        runs = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        codes = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(keys))))
        last = int(runs[-1])
        if last:
            done = whole.slice(0, last)
            yield done.take(pa.array(rings(done, codes[:last])))
        rest, limit = whole.slice(last), at_once
        if rest.num_rows > at_once:
            rest = rest.take(pa.array(np.sort(rings(rest, codes[last:] - codes[last]))))
            limit = max(at_once, 2 * rest.num_rows)
        held, waiting = [rest], rest.num_rows
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield whole.take(pa.array(rings(whole, np.zeros(whole.num_rows, np.int64))))


def _ordered(points: DataFrame, by: str) -> DataFrame:
    """(by, u, v), a group in one task and in order: only what is a corner of its own batch, where batches hold large parts of groups."""
    kind = points.schema[by].dataType
    key = F.when(F.col(by) == 0, F.lit(0).cast(kind)).otherwise(F.col(by)) if isinstance(kind, T.FractionalType) else F.col(by)  # one zero
    found = points.select(key.alias(by), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).where(finite("u", "v"))
    return found.mapInArrow(_parts, f"`{by}` {kind.simpleString()}, u double, v double").repartition(by).sortWithinPartitions(by, "u", "v")


def hull_corners(points: DataFrame, by: str, at_once: int = 100_000) -> DataFrame:
    """(by, u, v): the corners of the convex hull of each group's points; rows with a null or non-finite coordinate are left out.

    The corners of a union are among the corners of its parts, so each task first
    keeps those of large parts that it reads.  A group's rest then comes to one task
    in order, which finds the hulls of all groups of a batch at once and holds of
    a larger group some ``at_once`` points beside its corners.
    """
    return _ordered(points, by).mapInArrow(lambda batches: _hulls(batches, at_once), f"`{by}` {points.schema[by].dataType.simpleString()}, u double, v double")


def hull_area(points: DataFrame, by: str, at_once: int = 100_000) -> DataFrame:
    """(by, area) of the convex hull of each group's points (u, v), exact but for the rounding of the area's own sum.

    The corners of one hull meet in one task at last: many only if so many points
    lie on a curve, never because there are many points.  A group of fewer than
    three corners has no area.
    """

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _hulls(batches, at_once):
            codes = _codes(b.column(0))
            first = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            sizes = np.diff(np.append(first, len(codes)))
            u, v = (b.column(c).to_numpy() - np.repeat(b.column(c).to_numpy()[first], sizes) for c in (1, 2))
            following = np.arange(1, len(codes) + 1)
            following[first + sizes - 1] = first
            twice = np.add.reduceat(u * v[following] - u[following] * v, first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first)), pa.array(np.abs(twice) / 2)], [by, "area"])

    return _ordered(points, by).mapInArrow(areas, f"`{by}` {points.schema[by].dataType.simpleString()}, area double")


def category_masks(scores: DataFrame, columns: DataFrame, *pixel: str, least: float = 0.5) -> DataFrame:
    """(pixel, label, score, on): a label's score is the best of its class columns (label, class), and it is on from ``least``."""
    named = scores.join(F.broadcast(columns.select("label", "class").distinct()), "class")  # a catalog's labels
    return named.groupBy(*pixel, "label").agg(F.max("score").alias("score")).withColumn("on", F.col("score") >= least)


def member_samples(samples: DataFrame, members: DataFrame, item: str = "point_id") -> DataFrame:
    """Samples with ``member``, one for the points of a label set and zero else: the colour that a semantic rendering blends."""
    chosen = members.select(item).distinct().withColumn("__m", F.lit(1.0))
    return samples.join(chosen, item, "left").withColumn("member", F.coalesce("__m", F.lit(0.0))).drop("__m")


def pass_latency(passes: DataFrame, by: str = "pass") -> DataFrame:
    """(pass, images, total, slowest, masks) of timed images (pass, seconds, masks)."""
    return passes.groupBy(by).agg(F.count("*").alias("images"), F.sum("seconds").alias("total"), F.max("seconds").alias("slowest"), F.sum("masks").alias("masks"))


def preview_with_classes(points: DataFrame, members: DataFrame, most: int, index: str = "source_index") -> DataFrame:
    """``most`` evenly spaced points with the sorted classes that each belongs to; an empty array where there are none."""
    sampled = even_sample(points, [index], most).drop("ordinal")
    held = members.join(sampled.select(index), index, "left_semi").groupBy(index).agg(F.array_sort(F.collect_set("class")).alias("classes"))
    return sampled.join(held, index, "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))


def anchors_by_view(depths: DataFrame, folder: str) -> DataFrame:
    """Writes anchors (view, px, py, inverse_depth) by view under ``folder``; returns the manifest (view, anchors, least, greatest)."""
    ok = (F.col("inverse_depth") > 0) & ~F.isnan("inverse_depth") & (F.col("inverse_depth") != float("inf"))
    depths.where(ok).write.partitionBy("view").mode("errorifexists").parquet(folder)
    held = depths.sparkSession.read.schema(depths.schema).parquet(folder)
    return held.groupBy("view").agg(F.count("*").alias("anchors"), F.min("inverse_depth").alias("least"), F.max("inverse_depth").alias("greatest"))


def full_frame_problem(mask_width: Column, mask_height: Column, width: Column, height: Column) -> Column:
    """Why a mask cannot be laid on a camera's grid: no size, or another aspect than rounding of one side explains."""
    # Some whole-image scale must give both mask sides by rounding: the two intervals of that scale meet.
    low = F.greatest((mask_width - 0.5) / width, (mask_height - 0.5) / height)
    high = F.least((mask_width + 0.5) / width, (mask_height + 0.5) / height)
    return F.when(F.least(mask_width, mask_height, width, height) < 1, "size").when(low > high, "aspect")


