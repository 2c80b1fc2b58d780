"""Robust spatial summaries of groups of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import even_sample

AXES = ("x", "y", "z")
SAMPLE_LIMIT = 16_384
LEAST_RADIUS = 1e-5


def finite(*names: str) -> Column:
    ok = F.lit(True)
    for name in names:
        ok = ok & F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))
    return ok


def distance(*pairs: tuple[Column, Column]) -> Column:
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + (a - b) * (a - b)
    return F.sqrt(total)


def core_region(points: DataFrame, group: str, order: str, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """(group, cx, cy, cz, radius, eligible, sampled): median centre and 90 % radius of an even sample of each group's finite points.

    Fewer than 32 sampled points keep the whole distance.
    """
    usable = points.where(finite(*AXES)).select(group, order, *AXES)
    sizes = usable.groupBy(group).agg(F.count("*").alias("eligible"))
    sample = even_sample(usable, [order], limit, "floor", [group])
    centres = sample.groupBy(group).agg(*[F.percentile(c, F.lit(0.5)).alias(f"c{c}") for c in AXES])
    far = sample.join(centres, group).withColumn("d", distance(*[(F.col(c), F.col(f"c{c}")) for c in AXES]))
    fitted = far.groupBy(group, "cx", "cy", "cz").agg(F.count("*").alias("sampled"), F.percentile("d", F.array(F.lit(0.9), F.lit(1.0))).alias("q"))
    radius = F.greatest(F.lit(LEAST_RADIUS), F.when(F.col("sampled") >= 32, F.get("q", F.lit(0))).otherwise(F.get("q", F.lit(1))))
    return fitted.join(sizes, group).select(group, "cx", "cy", "cz", radius.alias("radius"), "eligible", "sampled")


def within_core(points: DataFrame, regions: DataFrame, group: str, multiplier: float = 1.25) -> DataFrame:
    """The points inside their group's core region, its radius times ``multiplier``."""
    if not 0.25 <= multiplier <= 4:
        raise ValueError("multiplier must lie in [0.25, 4]")
    d = distance(*[(F.col(c), F.col(f"c{c}")) for c in AXES])
    return points.join(regions, group).where(d <= F.col("radius") * multiplier)


def focus_bounds(points: DataFrame, group: str) -> DataFrame:
    """Bounds for framing a group: 5 % and 95 % quantiles from 64 finite points up, else the extremes; non-finite rows are counted apart."""
    ok = finite(*AXES)
    ends = [F.percentile(F.when(ok, F.col(c)), F.array(F.lit(0.0), F.lit(0.05), F.lit(0.95), F.lit(1.0))).alias(f"q{c}") for c in AXES]
    found = points.groupBy(group).agg(F.count_if(ok).alias("count"), F.count_if(~ok).alias("ignored"), *ends).where("count > 0")
    robust = F.col("count") >= 64
    bounds = []
    for c in AXES:
        q = lambda i, c=c: F.get(f"q{c}", F.lit(i))
        bounds += [F.when(robust, q(1)).otherwise(q(0)).alias(f"min_{c}"), F.when(robust, q(2)).otherwise(q(3)).alias(f"max_{c}")]
    return found.select(group, *bounds, "count", "ignored", robust.alias("robust"))


def focus_sphere(points: DataFrame, group: str) -> DataFrame:
    """Mean centre and half the box diagonal of each group's points."""
    agg = [F.avg(c).alias(f"c{c}") for c in AXES] + [(F.max(c) - F.min(c)).alias(f"s{c}") for c in AXES]
    boxes = points.groupBy(group).agg(*agg)
    return boxes.select(group, "cx", "cy", "cz", (F.sqrt(sum((F.col(f"s{c}") * F.col(f"s{c}") for c in AXES), F.lit(0.0))) / 2).alias("radius"))


def bounding_box(points: DataFrame, *by: str) -> DataFrame:
    """Extremes, visible and finite counts of (groups of) points with a boolean ``visible``."""
    ok = finite(*AXES)
    ends = [f(F.when(ok, F.col(c))).alias(f"{f.__name__}_{c}") for c in AXES for f in (F.min, F.max)]
    return points.groupBy(*by).agg(*ends, F.count_if(ok).alias("loaded"), F.count_if(ok & F.col("visible")).alias("visible"))


def nearest_within(queries: DataFrame, points: DataFrame, radius: float, query_id: str = "query_id", point_id: str = "point_id") -> DataFrame:
    """Each query's nearest point at most ``radius`` away, ties to the least id: an equi-join on grid cells and their neighbours.

    Queries enter the 27 cells around theirs, points their own, so each pair meets once.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = queries.select(F.col(query_id), *[F.col(c).alias(f"q{c}") for c in AXES], *[cell(c).alias(f"g{c}") for c in AXES])
    for c in AXES:
        near = near.withColumn(f"g{c}", F.explode(F.array(*[F.col(f"g{c}") + d for d in (-1, 0, 1)])))
    stored = points.select(F.col(point_id), *AXES, *[cell(c).alias(f"g{c}") for c in AXES])
    d = distance(*[(F.col(c), F.col(f"q{c}")) for c in AXES])
    pairs = near.join(stored, ["gx", "gy", "gz"]).withColumn("distance", d).where(F.col("distance") <= radius)
    best = pairs.groupBy(query_id).agg(F.min(F.struct("distance", point_id)).alias("m"))
    return best.select(query_id, F.col(f"m.{point_id}").alias(point_id), F.col("m.distance").alias("distance"))
