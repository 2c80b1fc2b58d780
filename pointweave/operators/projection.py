"""Points seen by calibrated views: projection, visibility, supports, compositing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frustum

#: Fixed values of the two visibility rules.
NEAREST = 1e-6
WINNER_OPACITY = 0.05
TOLERANT_OPACITY = 0.02
ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE = 0.01, 0.02
SUPPORT_POINTS = 250_000


def to_camera(points: DataFrame, cameras: DataFrame, most_cameras: int = 100_000) -> DataFrame:
    """Every point in every camera's frame: cx, cy, cz and the camera's columns.

    Cameras have frame, fx, fy, cx0, cy0, width, height and r00..r22, t0..t2.
    Every pair is the result asked for.  The cameras are broadcast behind a check
    of their number; beyond it neither side is.
    """
    held = cameras.limit(most_cameras + 1).count()
    return _in_camera(points.crossJoin(F.broadcast(cameras) if held <= most_cameras else cameras))


def _in_camera(pairs: DataFrame) -> DataFrame:
    axis = lambda i: sum((F.col(f"r{i}{j}") * F.col(c) for j, c in enumerate("xyz")), F.col(f"t{i}"))
    return pairs.withColumns({"camx": axis(0), "camy": axis(1), "camz": axis(2)})


def project(points: DataFrame, cameras: DataFrame, least_depth: float = 1e-5) -> DataFrame:
    """u and v of every point in every camera; the depth divides as at least ``least_depth``."""
    return _on_image(to_camera(points, cameras), least_depth)


def project_inside(points: DataFrame, cameras: DataFrame, least_depth: float = 1e-5) -> DataFrame:
    """u and v of the points that lie in each camera's image, and no others.

    Points and cameras meet by equi-joins on grid cells that a camera's frustum
    touches, so what a camera does not see is never paired with it.
    """
    return _on_image(_in_camera(frustum.candidates(points, cameras, least_depth)), least_depth).where(inside_image())


def _on_image(seen: DataFrame, least_depth: float) -> DataFrame:
    z = F.greatest(F.col("camz"), F.lit(least_depth))
    return seen.withColumns({"u": F.col("fx") * F.col("camx") / z + F.col("cx0"), "v": F.col("fy") * F.col("camy") / z + F.col("cy0"), "depth": F.col("camz")})


def inside_image() -> Column:
    return (F.col("depth") > NEAREST) & (F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height"))


def pixel_winners(seen: DataFrame, *pixel: str, depth: str = "depth", point: str = "point_id") -> DataFrame:
    """The nearest point of each pixel, equal depths to the least id: ``pixel`` columns, point, depth."""
    best = seen.groupBy(*pixel).agg(F.min(F.struct(F.col(depth), F.col(point))).alias("m"))
    return best.select(*pixel, F.col(f"m.{point}").alias(point), F.col(f"m.{depth}").alias(depth))


def visible_grid(projected: DataFrame) -> DataFrame:
    """(frame, px, py, point_id, depth): truncated pixels of points in the image with opacity .05 or more, one winner each."""
    ok = projected.where(inside_image() & (F.col("opacity") >= WINNER_OPACITY))
    cells = ok.withColumns({"px": F.floor("u"), "py": F.floor("v")})
    return pixel_winners(cells, "frame", "px", "py")


def visible_with_tolerance(seen: DataFrame, *pixel: str, depth: str = "depth", absolute: float = ABSOLUTE_TOLERANCE, relative: float = RELATIVE_TOLERANCE) -> DataFrame:
    """Rows not farther behind their pixel's nearest depth than the tolerance, with ``front``."""
    front = F.min(depth).over(Window.partitionBy(*pixel))
    tolerance = absolute + relative * F.greatest(F.col(depth), F.lit(0.0))
    return seen.withColumn("front", front).where(F.col(depth) <= F.col("front") + tolerance)


def visible_points(projected: DataFrame) -> DataFrame:
    """Tolerant visibility: the continuous centre is tested against the image, then rounded half to even and clipped to a pixel."""
    ok = projected.where(inside_image() & (F.col("opacity") >= TOLERANT_OPACITY))
    clip = lambda c, most: F.greatest(F.lit(0), F.least(F.rint(c), F.col(most) - 1)).cast("long")
    return visible_with_tolerance(ok.withColumns({"px": clip("u", "width"), "py": clip("v", "height")}), "frame", "px", "py")


def measured_depth_agrees(seen: DataFrame, measured: DataFrame, scale: float = 1.0) -> DataFrame:
    """Drop rows whose pixel has a measured depth that differs by more than the tolerance; missing, non-positive and non-finite measures decide nothing."""
    tolerance = ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * F.greatest(F.col("depth"), F.lit(0.0))
    d = F.col("measured") * scale
    unknown = d.isNull() | F.isnan(d) | (d <= 0) | (d == float("inf"))
    return seen.join(measured, ["frame", "px", "py"], "left").where(unknown | (F.abs(F.col("depth") - d) <= tolerance)).drop("measured")


def mask_support(winners: DataFrame, mask_pixels: DataFrame, points: int) -> DataFrame:
    """(frame, mask_id, point_id): distinct winners under each mask, thinned by id to at most ``SUPPORT_POINTS`` of ``points``."""
    stride = max(1, -(-points // SUPPORT_POINTS))
    return mask_pixels.join(winners.where(F.col("point_id") % stride == 0), ["frame", "px", "py"]).select("frame", "mask_id", "point_id").distinct()


def window_coverage(mask_pixels: DataFrame, frames: DataFrame, at: DataFrame, radius: int = 1) -> DataFrame:
    """Share of set pixels in the clipped window around each row of ``at``, as ``coverage``.

    Only set pixels are stored; each enters the windows that hold it by an equi-join.
    """
    radius = max(0, min(5, radius))
    shifts = F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1)]))
    spread = mask_pixels.withColumn("dx", shifts).withColumn("dy", shifts)
    spread = spread.select("frame", "mask_id", (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py"))
    counts = spread.groupBy("frame", "mask_id", "px", "py").agg(F.count("*").alias("set"))
    span = lambda c, most: F.least(F.col(most), F.col(c) + radius + 1) - F.greatest(F.lit(0), F.col(c) - radius)
    joined = at.join(counts, ["frame", "mask_id", "px", "py"], "left").join(frames, "frame")
    return joined.withColumn("coverage", F.coalesce("set", F.lit(0)) / F.greatest(F.lit(1), span("px", "width") * span("py", "height"))).drop("set")


def evidence(coverage: Column, depth: Column, front: Column) -> Column:
    """Reliability of a point under a mask: contour share clipped to [.35, 1], less up to three quarters for its gap behind the front."""
    tolerance = ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * F.greatest(depth, F.lit(0.0))
    gap = F.greatest(F.lit(0.0), depth - front) / F.greatest(tolerance, F.lit(1e-8))
    return F.greatest(F.lit(0.35), F.least(coverage, F.lit(1.0))) * (1 - 0.75 * F.greatest(F.lit(0.0), F.least(gap, F.lit(1.0))))


def composite(samples: DataFrame, *pixel: str, order: Sequence[str], alpha: str, values: Mapping[str, str]) -> DataFrame:
    """Front-to-back blending: the sum of alpha * value * the light that nearer samples let through."""
    nearer = Window.partitionBy(*pixel).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    passed = F.exp(F.coalesce(F.sum(F.log(1 - F.col(alpha) + 1e-8)).over(nearer), F.lit(0.0)))
    lit = samples.withColumn("__w", F.col(alpha) * passed)
    sums = [F.sum(F.col("__w") * F.col(v)).alias(name) for name, v in values.items()]
    return lit.groupBy(*pixel).agg(*sums, F.sum("__w").alias("coverage"))


def nearest_pixel_grid(mask_size: tuple[int, int], camera_size: tuple[int, int]) -> tuple[Column, Column]:
    """Camera pixels (x, y) from mask pixels by nearest neighbour, with integer arithmetic."""
    (mw, mh), (cw, ch) = mask_size, camera_size
    return F.floor(F.col("px") * cw / mw), F.floor(F.col("py") * ch / mh)


def screen_pick(projected: DataFrame, x: float, y: float, within: float = 17.0) -> DataFrame:
    """The point nearest a screen position: distance plus four times depth decides, then the id."""
    d = F.sqrt((F.col("u") - x) * (F.col("u") - x) + (F.col("v") - y) * (F.col("v") - y))
    near = projected.withColumn("distance", d).where(F.col("distance") < within)
    return near.withColumn("score", F.col("distance") + 4 * F.col("depth")).orderBy("score", "point_id").limit(1)
