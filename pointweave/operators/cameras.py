"""Cameras and calibrations: normal forms, checks, back-projection, gates of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot


def rigid_inverse(rotation: Sequence[Column], translation: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """(rotation, translation) of the inverse of a rigid motion, rotations row by row."""
    turned = [rotation[3 * j + i] for i in range(3) for j in range(3)]
    moved = [-(turned[3 * i] * translation[0] + turned[3 * i + 1] * translation[1] + turned[3 * i + 2] * translation[2]) for i in range(3)]
    return turned, moved


def affine_inverse(matrix: Column) -> Column:
    """The inverse of sixteen entries, row by row, whose last row is 0, 0, 0, 1; null for others, singular ones and non-finite entries."""
    m = lambda i, j: F.get(matrix, F.lit(4 * i + j)).cast("double")
    minor = lambda i, j: m((i + 1) % 3, (j + 1) % 3) * m((i + 2) % 3, (j + 2) % 3) - m((i + 1) % 3, (j + 2) % 3) * m((i + 2) % 3, (j + 1) % 3)
    det = m(0, 0) * minor(0, 0) + m(0, 1) * minor(0, 1) + m(0, 2) * minor(0, 2)
    linear = [[minor(j, i) / F.nullif(det, F.lit(0.0)) for j in range(3)] for i in range(3)]
    moved = [-(linear[i][0] * m(0, 3) + linear[i][1] * m(1, 3) + linear[i][2] * m(2, 3)) for i in range(3)]
    rows = [x for i in range(3) for x in (*linear[i], moved[i])]
    affine = (m(3, 0) == 0) & (m(3, 1) == 0) & (m(3, 2) == 0) & (m(3, 3) == 1) & _finite(matrix, 16)
    return F.when(affine & F.coalesce(det != 0, F.lit(False)), F.array(*rows, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))


def _finite(values: Column, n: int) -> Column:
    """Whether an array has ``n`` entries, all finite; false for null."""
    return F.coalesce((F.size(values) == n) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf"))), F.lit(False))


def camera_form(cameras: DataFrame) -> DataFrame:
    """Cameras in any of their forms with ``matrix`` (world to camera, sixteen entries), ``focal`` and ``centre`` ([x, y]) and ``problem``.

    The pose is the first of world_to_camera, camera_to_world (sixteen entries) and R
    with t (nine and three) that is not null; the intrinsics are K (nine entries) or
    else fx, fy (null: fx), cx and cy.  Columns that are not there count as null.
    ``problem`` is ``pose`` or ``intrinsics`` where these are absent, non-finite, not
    invertible or, for focal lengths, not positive.
    """
    have = lambda c, kind: F.col(c) if c in cameras.columns else F.lit(None).cast(kind)
    direct, back, turn, move, k = (have(c, "array<double>") for c in ("world_to_camera", "camera_to_world", "R", "t", "K"))
    given = lambda a, n: F.when(_finite(a, n), a.cast("array<double>"))
    entry = lambda a, i: F.get(a, F.lit(i)).cast("double")
    built = F.array(*[x for i in range(3) for x in (*[entry(turn, 3 * i + j) for j in range(3)], entry(move, i))], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    pose = F.when(direct.isNotNull(), given(direct, 16)).when(back.isNotNull(), affine_inverse(back)).when(_finite(turn, 9) & _finite(move, 3), built)
    fx, fy, cx, cy = (have(c, "double").cast("double") for c in ("fx", "fy", "cx", "cy"))
    inner = F.when(k.isNotNull(), F.when(_finite(k, 9), F.array(*[entry(k, i) for i in (0, 4, 2, 5)]))).otherwise(F.array(fx, F.coalesce(fy, fx), cx, cy))
    valid = _finite(inner, 4) & (F.get(inner, F.lit(0)) > 0) & (F.get(inner, F.lit(1)) > 0)
    problem = F.when(pose.isNull(), "pose").when(~F.coalesce(valid, F.lit(False)), "intrinsics")
    return cameras.withColumns({"matrix": pose, "focal": F.slice(inner, 1, 2), "centre": F.slice(inner, 3, 2), "problem": problem})


def is_rigid(rotation: Column, tolerance: float = 1e-4) -> Column:
    """Whether nine entries are a rotation: rows of length one, at right angles, right-handed."""
    row = lambda i: F.slice(rotation, 3 * i + 1, 3)
    ok = F.size(rotation) == 9
    for i in range(3):
        ok = ok & (F.abs(dot(row(i), row(i)) - 1) <= tolerance) & (F.abs(dot(row(i), row((i + 1) % 3))) <= tolerance)
    at = lambda i, j: F.get(rotation, F.lit(3 * i + j))
    turn = at(0, 0) * (at(1, 1) * at(2, 2) - at(1, 2) * at(2, 1)) - at(0, 1) * (at(1, 0) * at(2, 2) - at(1, 2) * at(2, 0)) + at(0, 2) * (at(1, 0) * at(2, 1) - at(1, 1) * at(2, 0))
    return ok & (turn > 0)


def back_project(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """A pixel with a depth as a point in the camera's frame."""
    return [(u - cx) / fx * depth, (v - cy) / fy * depth, depth]


def pixel_affine(u: Column, v: Column, matrix: Sequence[float]) -> list[Column]:
    """Pixels under (a, b, c, d, e, f): (a u + b v + c, d u + e v + f)."""
    a, b, c, d, e, f = matrix
    return [a * u + b * v + c, d * u + e * v + f]


def pixel_grid(sizes: DataFrame) -> DataFrame:
    """(frame, px, py) of every pixel of every (frame, width, height)."""
    rows = sizes.select("frame", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("py"))
    return rows.select("frame", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("px"), "py")


def first_valid(cameras: DataFrame, by: str, position: str, valid: Column, *columns: str) -> DataFrame:
    """The first camera of each group that passes ``valid``."""
    best = cameras.where(valid).groupBy(by).agg(F.min(F.struct(position, *columns)).alias("m"))
    return best.select(by, F.col(f"m.{position}").alias(position), *[F.col(f"m.{c}").alias(c) for c in columns])


def calibration_problems(images: DataFrame, calibrations: DataFrame) -> DataFrame:
    """(name, problem) where calibrations do not answer images one to one, in size, hash and pinhole form."""
    one = Window.partitionBy("name")
    c = calibrations.withColumn("times", F.count("*").over(one)).select(F.col("name").alias("c"), "times", F.col("width").alias("cw"), F.col("height").alias("ch"), F.col("sha256").alias("csha"), "fx", "fy")
    both = images.join(c, images["name"] == F.col("c"), "full_outer")
    problem = (
        F.when(F.col("c").isNull(), "missing")
        .when(F.col("name").isNull(), "unknown_image")
        .when(F.col("times") > 1, "repeated")
        .when((F.col("cw") != F.col("width")) | (F.col("ch") != F.col("height")), "size")
        .when(F.col("csha") != F.col("sha256"), "hash")
        .when(~F.coalesce((F.col("fx") > 0) & (F.col("fy") > 0), F.lit(False)), "focal")
    )
    return both.select(F.coalesce("name", "c").alias("name"), problem.alias("problem")).where("problem IS NOT NULL").distinct()


def pair_gate(points: DataFrame, baselines: DataFrame, least: float = 0.005) -> DataFrame:
    """(pair, ratio, accepted): baseline over median depth must reach ``least``."""
    depth = points.where("depth > 0").groupBy("pair").agg(F.percentile("depth", F.lit(0.5)).alias("median"))
    ratio = F.col("baseline") / F.col("median")
    return baselines.join(depth, "pair", "left").select("pair", ratio.alias("ratio"), F.coalesce(ratio >= least, F.lit(False)).alias("accepted"))


def harmonic_bank(points: DataFrame, width: int) -> DataFrame:
    """(address, value) of ragged coefficients in a padded row-major bank: source_index * width + place."""
    flat = points.select("source_index", F.posexplode("sh").alias("k", "value"))
    return flat.where(F.col("k") < width).select((F.col("source_index") * width + F.col("k")).alias("address"), "value")


def lineage_steps(parents: DataFrame, steps: Sequence[tuple[str, DataFrame]], copies: int = 2) -> DataFrame:
    """Rows (position, origin) after growth steps on them: clone appends the named rows, split appends ``copies`` blocks of them and drops the rows themselves, prune drops them.

    Appended blocks keep the order of their parents; positions are closed up.
    """
    from .ordering import with_ordinal

    state = parents.select("position", "origin")
    for kind, chosen in steps:
        named = state.join(chosen.select("position").distinct(), "position", "left_semi")
        kept = state.join(chosen.select("position").distinct(), "position", "left_anti") if kind in ("split", "prune") else state
        blocks = {"clone": 1, "split": copies, "prune": 0}[kind]
        rows = kept.select(F.lit(0).alias("block"), "position", "origin")
        for b in range(blocks):
            rows = rows.unionByName(named.select(F.lit(b + 1).alias("block"), "position", "origin"))
        state = with_ordinal(rows, ["block", "position"]).select(F.col("ordinal").alias("position"), "origin")
    return state
