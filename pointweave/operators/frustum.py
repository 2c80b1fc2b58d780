"""Which points a camera can see: an octree of grid cells tested against the planes of each camera's frustum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import written
from .regions import AXES, finite

#: Halvings of the scene's box down to the cells that points are kept in, and halvings a step.
LEVELS, STEP = 6, 2
NEAREST = 1e-6
CAMERA = ("fx", "fy", "cx0", "cy0", "width", "height", *(f"r{i}{j}" for i in range(3) for j in range(3)), "t0", "t1", "t2")


def touches(low: tuple[Column, Column, Column], side: Column, least_depth: float) -> Column:
    """Whether the cube from ``low`` may hold a point of the image: for no plane does it lie wholly behind.

    On a plane's far side a linear form is negative on all the cube, whose greatest
    value is that at its centre plus half a side times the sizes of its
    coefficients.  Rounding, the cells' own rounding, and depths that divide as
    ``least_depth`` only ever let more cubes through.
    """
    c = {name: F.col(f"camera.{name}") for name in CAMERA}
    axis = [([c[f"r{i}{j}"] for j in range(3)], c[f"t{i}"]) for i in range(3)]

    def form(a: Column, i: int, b: Column, spare: Column) -> Column:
        """a * axis i + b * depth, at its greatest, is not below zero."""
        weights = [a * u + b * v for u, v in zip(axis[i][0], axis[2][0])]
        centre = [x + side / 2 for x in low]
        terms = [w * x for w, x in zip(weights, centre)] + [a * axis[i][1], b * axis[2][1]]
        reach = sum((F.abs(w) for w in weights), F.lit(0.0)) * side / 2
        size = sum((F.abs(t) for t in terms), reach)
        return sum(terms, reach) + reach * 1e-6 + size * 1e-9 + spare >= 0

    one = F.lit(1.0)
    spare = [(F.abs(c[p]) + F.abs(c[w])) * (2 * least_depth) for p, w in (("cx0", "width"), ("cy0", "height"))]
    sides = [form(c["fx"], 0, c["cx0"], spare[0]), form(-c["fx"], 0, c["width"] - c["cx0"], spare[0]), form(c["fy"], 1, c["cy0"], spare[1]), form(-c["fy"], 1, c["height"] - c["cy0"], spare[1])]
    ahead = form(F.lit(0.0), 0, one, F.lit(-NEAREST))
    return sides[0] & sides[1] & sides[2] & sides[3] & ahead


def candidates(points: DataFrame, cameras: DataFrame, least_depth: float = 1e-5, levels: int = LEVELS) -> DataFrame:
    """Points with the columns of every camera whose frustum touches their cell.

    Nothing is paired beyond that: a camera starts with the scene's one box and
    takes its parts step by step, those that hold points and that its planes do
    not rule out.  Points with a null or non-finite coordinate are in no image.
    Four numbers of the scene's box reach the driver.
    """
    usable = points.where(finite(*AXES))
    box = usable.agg(*[F.min(a) for a in AXES], F.greatest(*[F.max(a) - F.min(a) for a in AXES])).first()
    corner, size = [x or 0.0 for x in box[:3]], (box[3] or 0.0) * (1 + 1e-12) or 1.0
    parts = 1 << levels
    cell = [F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col(a) - low) / (size / parts)))).cast("long").alias(f"__g{a}") for a, low in zip(AXES, corner)]
    placed = usable.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("point"), *cell)
    names = [f"__g{a}" for a in AXES]
    occupied = written(placed.select(*names).distinct(), "occupied-cells")
    seen = cameras.select("frame", F.struct(*CAMERA).alias("camera"), *[F.lit(0).cast("long").alias(n) for n in names])
    for level in range(STEP, levels + STEP, STEP):
        level = min(level, levels)
        halvings = STEP if level % STEP == 0 else level % STEP
        for n in names:
            seen = seen.withColumn(n, F.explode(F.sequence(F.col(n) * (1 << halvings), F.col(n) * (1 << halvings) + (1 << halvings) - 1)))
        side = F.lit(size / (1 << level))
        low = tuple(F.lit(start) + F.col(n) * side for n, start in zip(names, corner))
        held = occupied.select(*[F.shiftright(n, levels - level).alias(n) for n in names]).distinct()
        seen = seen.where(touches(low, side, least_depth)).join(held, names, "left_semi")
    return placed.join(seen, names).select("point.*", "frame", "camera.*")
