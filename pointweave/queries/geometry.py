"""Regions, projection, visibility, ordering and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering, projection, regions
from .common import CELLS, VECTORS, cells, collector, r6, table, vectors

QUERIES, query = collector()

CORE = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY point_id) - 1 AS o, count(*) OVER (PARTITION BY label) AS n FROM {v}),
picks AS (SELECT label, floor(i * (n - 1)::DOUBLE / ({k} - 1)) AS o FROM (SELECT DISTINCT label, n FROM p), range({k}) t(i) WHERE n > {k}),
s AS (SELECT p.* FROM p WHERE n <= {k} UNION ALL SELECT p.* FROM p JOIN picks USING (label, o)),
c AS (SELECT label, quantile_cont(x, .5) AS cx, quantile_cont(y, .5) AS cy, quantile_cont(z, .5) AS cz FROM s GROUP BY label),
d AS (SELECT label, cx, cy, cz, n, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS d FROM s JOIN c USING (label)),
fit AS (SELECT label, cx, cy, cz, greatest(1e-5, CASE WHEN count(*) >= 32 THEN quantile_cont(d, .9) ELSE max(d) END) AS radius, any_value(n) AS eligible, count(*) AS sampled FROM d GROUP BY label, cx, cy, cz)
"""


def _core_columns():
    return ["label", *[r6(c).alias(c) for c in ("cx", "cy", "cz", "radius")], "eligible", "sampled"]


CORE_SELECT = "SELECT label, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) + 0.0 AS cz, round(radius, 6) + 0.0 AS radius, eligible, sampled FROM fit"


@query(CORE.format(v=VECTORS, k=16384) + CORE_SELECT)
def core_region(spark, sf):
    return regions.core_region(vectors(spark, sf), "label", "point_id").select(*_core_columns())


@query(CORE.format(v=VECTORS, k=33) + CORE_SELECT)
def core_region_sampled(spark, sf):
    return regions.core_region(vectors(spark, sf), "label", "point_id", limit=33).select(*_core_columns())


@query(CORE.format(v=VECTORS, k=16384) + f"SELECT label, count(*) AS inside FROM {VECTORS} JOIN fit USING (label) WHERE sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) <= radius * 1.25 GROUP BY label")
def core_points(spark, sf):
    points = vectors(spark, sf)
    return regions.within_core(points, regions.core_region(points, "label", "point_id"), "label").groupBy("label").agg(F.count("*").alias("inside"))


BOXES = "(SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y, l_discount AS z, l_linestatus = 'O' AS visible FROM lineitem)"


def _boxes(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"), (F.col("l_linestatus") == "O").alias("visible"))


@query(
    "SELECT flag, "
    + ", ".join(f"round(CASE WHEN count(*) >= 64 THEN quantile_cont({c}, {q}) ELSE {f}({c}) END, 6) AS {f}_{c}" for c in "xyz" for f, q in (("min", 0.05), ("max", 0.95)))
    + f", count(*) AS count, 0::BIGINT AS ignored, count(*) >= 64 AS robust FROM {BOXES} GROUP BY flag"
)
def focus_bounds(spark, sf):
    names = [f"{f}_{c}" for c in "xyz" for f in ("min", "max")]
    return regions.focus_bounds(_boxes(spark, sf), "flag").select("flag", *[F.round(c, 6).alias(c) for c in names], "count", "ignored", "robust")


@query(f"SELECT flag, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(avg(z), 4) AS cz, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) / 2, 4) AS radius FROM {BOXES} GROUP BY flag")
def focus_sphere(spark, sf):
    return regions.focus_sphere(_boxes(spark, sf), "flag").select("flag", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "cz", "radius")])


@query(f"SELECT flag, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*) AS loaded, count_if(visible)::BIGINT AS visible FROM {BOXES} GROUP BY flag")
def bounding_box(spark, sf):
    return regions.bounding_box(_boxes(spark, sf), "flag")


@query(f"""
WITH pairs AS (SELECT q.point_id AS query_id, p.point_id, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2) AS distance FROM {VECTORS} q JOIN {VECTORS} p ON q.point_id % 20 = 0 AND p.point_id % 20 <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS r FROM pairs WHERE distance <= 0.1)
SELECT query_id, point_id, round(distance, 6) AS distance FROM ranked WHERE r = 1""")
def nearest_point(spark, sf):
    points = vectors(spark, sf)
    asked = points.where("point_id % 20 = 0").withColumnRenamed("point_id", "query_id")
    return regions.nearest_within(asked, points.where("point_id % 20 <> 0"), 0.1).select("query_id", "point_id", F.round("distance", 6).alias("distance"))


#: Two views: one along z from two units away, one turned by 90 degrees.
CAMERA_ROWS = [("front", 80.0, 80.0, 32.0, 32.0, 64, 64, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.5), ("side", 90.0, 70.0, 30.0, 34.0, 64, 64, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.05, -0.02, 0.4)]
CAMERA_NAMES = ["frame", "fx", "fy", "cx0", "cy0", "width", "height", *[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2"]
CAMERAS = "(VALUES " + ", ".join("('" + r[0] + "', " + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r[1:]) + ")" for r in CAMERA_ROWS) + f") c({', '.join(CAMERA_NAMES)})"
SEEN = f"""
WITH cam AS (SELECT * FROM {CAMERAS}),
q AS (SELECT p.*, c.*, r00*x + r01*y + r02*z + t0 AS camx, r10*x + r11*y + r12*z + t1 AS camy, r20*x + r21*y + r22*z + t2 AS camz FROM {VECTORS} p, cam c),
seen AS (SELECT *, fx * camx / greatest(camz, 1e-5) + cx0 AS u, fy * camy / greatest(camz, 1e-5) + cy0 AS v, camz AS depth, 0.01 * (point_id % 10) AS opacity FROM q),
ok AS (SELECT *, floor(u)::BIGINT AS px, floor(v)::BIGINT AS py FROM seen WHERE depth > 1e-6 AND u >= 0 AND u < width AND v >= 0 AND v < height)
"""


def _seen(spark, sf, project=projection.project):
    cameras = spark.createDataFrame(CAMERA_ROWS, CAMERA_NAMES)
    return project(vectors(spark, sf), cameras).withColumn("opacity", F.lit(0.01) * (F.col("point_id") % 10))


@query(SEEN + "SELECT frame, point_id, round(u, 4) + 0.0 AS u, round(v, 4) + 0.0 AS v, round(depth, 6) + 0.0 AS depth FROM seen")
def project_points(spark, sf):
    return _seen(spark, sf).select("frame", "point_id", (F.round("u", 4) + 0.0).alias("u"), (F.round("v", 4) + 0.0).alias("v"), r6("depth").alias("depth"))


@query(SEEN + ", w AS (SELECT *, row_number() OVER (PARTITION BY frame, px, py ORDER BY depth, point_id) AS r FROM ok WHERE opacity >= 0.05) SELECT frame, px, py, point_id FROM w WHERE r = 1")
def visible_point_grid(spark, sf):
    return projection.visible_grid(_seen(spark, sf, projection.project_inside)).select("frame", "px", "py", "point_id")


@query(SEEN + """, e AS (SELECT frame, point_id, depth, greatest(0, least(round_even(u, 0), width - 1))::BIGINT AS px, greatest(0, least(round_even(v, 0), height - 1))::BIGINT AS py FROM ok WHERE opacity >= 0.02),
f AS (SELECT *, min(depth) OVER (PARTITION BY frame, px, py) AS front FROM e) SELECT frame, point_id, px, py FROM f WHERE depth <= front + 0.01 + 0.02 * greatest(depth, 0)""")
def visible_points(spark, sf):
    return projection.visible_points(_seen(spark, sf, projection.project_inside)).select("frame", "point_id", "px", "py")


@query(f"WITH w AS (SELECT *, row_number() OVER (PARTITION BY frame, px, py ORDER BY depth, point_id) AS r FROM {CELLS}) SELECT frame, px, py, point_id, depth FROM w WHERE r = 1")
def zbuffer_winner(spark, sf):
    return projection.pixel_winners(cells(spark, sf), "frame", "px", "py")


@query(f"WITH f AS (SELECT *, min(depth) OVER (PARTITION BY frame, px, py) AS front FROM {CELLS}) SELECT frame, px, py, point_id, front FROM f WHERE depth <= front + (0.01 + 0.02 * greatest(depth, 0.0))")
def visible_with_tolerance(spark, sf):
    return projection.visible_with_tolerance(cells(spark, sf), "frame", "px", "py").select("frame", "px", "py", "point_id", "front")


MASKS = f"(SELECT DISTINCT frame, 'm' || px % 3 AS mask_id, px, py FROM {CELLS} WHERE (px + py) % 4 <> 0)"


def _masks(spark, sf):
    return cells(spark, sf).where("(px + py) % 4 <> 0").select("frame", F.concat(F.lit("m"), (F.col("px") % 3).cast("string")).alias("mask_id"), "px", "py").distinct()


@query(f"WITH w AS (SELECT *, row_number() OVER (PARTITION BY frame, px, py ORDER BY depth, point_id) AS r FROM {CELLS}) SELECT DISTINCT m.frame, mask_id, point_id FROM w JOIN {MASKS} m ON w.frame = m.frame AND w.px = m.px AND w.py = m.py WHERE r = 1 AND point_id % 3 = 0")
def mask_support(spark, sf):
    winners = projection.pixel_winners(cells(spark, sf), "frame", "px", "py")
    return projection.mask_support(winners, _masks(spark, sf), 750_000)


@query(f"""
WITH m AS (SELECT * FROM {MASKS}),
n AS (SELECT a.frame, a.mask_id, a.px, a.py, count(*) AS set FROM m a JOIN m b ON a.frame = b.frame AND a.mask_id = b.mask_id AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 GROUP BY ALL)
SELECT frame, mask_id, px, py, round(set / ((least(60, px + 2) - greatest(0, px - 1)) * (least(12, py + 2) - greatest(0, py - 1))), 6) AS coverage FROM n""")
def mask_window_coverage(spark, sf):
    masks = _masks(spark, sf)
    frames = masks.select("frame").distinct().select("frame", F.lit(60).alias("width"), F.lit(12).alias("height"))
    return projection.window_coverage(masks, frames, masks).select("frame", "mask_id", "px", "py", F.round("coverage", 6).alias("coverage"))


@query(f"""
WITH f AS (SELECT point_id, depth, min(depth) OVER (PARTITION BY frame, px, py) AS front, (px % 10) / 9.0 AS coverage FROM {CELLS})
SELECT point_id, round(greatest(0.35, least(coverage, 1.0)) * (1 - 0.75 * greatest(0.0, least(greatest(0.0, depth - front) / greatest(0.01 + 0.02 * greatest(depth, 0.0), 1e-8), 1.0))), 6) AS evidence FROM f""")
def mask_evidence(spark, sf):
    seen = projection.visible_with_tolerance(cells(spark, sf), "frame", "px", "py", absolute=1e300)
    value = projection.evidence((F.col("px") % 10) / 9.0, F.col("depth"), F.col("front"))
    return seen.select("point_id", F.round(value, 6).alias("evidence"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_discount AS a, l_quantity AS q, coalesce(sum(ln(1 - l_discount + 1e-8)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM lineitem)
SELECT l_orderkey, round(sum(a * exp(passed) * q), 5) AS color, round(sum(a * exp(passed)), 6) AS coverage FROM s GROUP BY l_orderkey""")
def alpha_composite(spark, sf):
    lit = projection.composite(table(spark, sf, "lineitem"), "l_orderkey", order=["l_linenumber", "l_partkey", "l_suppkey"], alpha="l_discount", values={"color": "l_quantity"})
    return lit.select("l_orderkey", F.round("color", 5).alias("color"), F.round("coverage", 6).alias("coverage"))


@query(SEEN + "SELECT point_id, round(sqrt((u - 30) ** 2 + (v - 31) ** 2) + 4 * depth, 5) AS score FROM seen WHERE frame = 'front' AND sqrt((u - 30) ** 2 + (v - 31) ** 2) < 17 ORDER BY sqrt((u - 30) ** 2 + (v - 31) ** 2) + 4 * depth, point_id LIMIT 1")
def screen_pick(spark, sf):
    return projection.screen_pick(_seen(spark, sf).where("frame = 'front'"), 30.0, 31.0).select("point_id", F.round("score", 5).alias("score"))


PICKS = """
WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders),
p AS (SELECT DISTINCT ({rule})::BIGINT AS ordinal FROM n, range(97) t(i))
SELECT o_orderkey, ordinal FROM o JOIN p USING (ordinal)"""
STEP = "((n - 1)::DOUBLE / 96)"


def _picked(rule):
    return lambda spark, sf: ordering.even_sample(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 97, rule)


for _name, _rule, _sql in (
    ("even_sample_truncated", "truncate", f"CASE WHEN i = 96 THEN n - 1 ELSE floor(i * {STEP}) END"),
    ("even_sample_nearest", "nearest", f"CASE WHEN i = 96 THEN n - 1 ELSE round_even(i * {STEP}, 0) END"),
    ("even_sample_floor", "floor", "floor((i * (n - 1))::DOUBLE / 96)"),
    ("even_sample_stride", "stride", "floor(i * n / 97.0::DOUBLE)"),
):
    _run = _picked(_rule)
    _run.__name__ = _name
    query(PICKS.format(rule=_sql))(_run)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) WHERE o % 8 = 0")
def held_out_eighth(spark, sf):
    return ordering.every_nth(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


CHUNKS = """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders),
c AS (SELECT (ordinal // 4000)::BIGINT AS chunk, min(ordinal) AS "offset", count(*) AS count, min(o_orderkey) AS first, max(o_orderkey) AS last FROM o GROUP BY 1)
"""


@query(CHUNKS + 'SELECT chunk, "offset", count, first, last FROM c')
def chunk_manifest(spark, sf):
    return ordering.chunk_manifest(table(spark, sf, "orders"), ["o_orderkey"], 4000)


@query(CHUNKS + ', k AS (SELECT * FROM c WHERE chunk <> 1), e AS (SELECT chunk, "offset", lag("offset" + count, 1, 0) OVER (ORDER BY chunk) AS expected FROM k) SELECT chunk, "offset", expected FROM e WHERE "offset" <> expected')
def chunk_contiguity(spark, sf):
    chunks = ordering.chunk_manifest(table(spark, sf, "orders"), ["o_orderkey"], 4000).where("chunk <> 1")
    return ordering.contiguity_errors(chunks).select("chunk", "offset", "expected")


@query(f"SELECT point_id, row_number() OVER (ORDER BY depth, point_id) - 1 AS ordinal FROM {CELLS}")
def depth_order(spark, sf):
    return ordering.with_ordinal(cells(spark, sf).select("depth", "point_id"), ["depth", "point_id"]).select("point_id", "ordinal")


@query("SELECT l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 32")
def top_detections(spark, sf):
    x = table(spark, sf, "lineitem")
    return ordering.top_per_group(x, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 32).select("l_orderkey", "l_linenumber", "rank")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def newest_projects(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100)


@query()
def weighted_sample(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return ordering.weighted_sample(x, 500, F.col("l_quantity"), "l_orderkey", "l_linenumber")
