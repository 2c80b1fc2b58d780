"""Evaluation tables and their summaries, and checks of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import metrics as m
from ..operators import reviews, validation
from .common import CELLS, cells, collector, r6, table

QUERIES, query = collector()

SETS = "t AS (SELECT lang AS label, source AS image, doc_id AS pixel FROM documents JOIN labels USING (doc_id) WHERE quality = 1), p AS (SELECT lang AS label, source AS image, doc_id AS pixel FROM documents WHERE n_chars % 3 <> 0)"
OVERLAP = f"WITH {SETS}, o AS (SELECT label, image, count_if(t.pixel IS NOT NULL AND p.pixel IS NOT NULL)::BIGINT AS intersection, count(*) AS \"union\" FROM t FULL JOIN p USING (label, image, pixel) GROUP BY ALL), r AS (SELECT *, intersection / \"union\" AS iou FROM o)"


def _overlap(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("label"), F.col("source").alias("image"), F.col("doc_id").alias("pixel"), "n_chars")
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("pixel"))
    return m.overlap(d.join(good, "pixel", "left_semi"), d.where("n_chars % 3 <> 0"), "label", "image")


@query(OVERLAP + ' SELECT label, image, intersection, "union", round(iou, 6) AS iou FROM r')
def mask_overlap(spark, sf):
    return _overlap(spark, sf).withColumn("iou", F.round("iou", 6))


@query(OVERLAP + ' SELECT label, sum(intersection)::BIGINT AS intersection, sum("union")::BIGINT AS "union", round(avg(iou), 6) AS mean_view_iou, count(iou) AS views, round(sum(intersection) / sum("union"), 6) AS iou FROM r GROUP BY label')
def iou_macro(spark, sf):
    return m.iou_macro(_overlap(spark, sf)).withColumns({"iou": F.round("iou", 6), "mean_view_iou": F.round("mean_view_iou", 6)})


@query(OVERLAP + ', c AS (SELECT label, sum(intersection) / sum("union") AS iou FROM r GROUP BY label) SELECT round(avg(iou), 6) AS miou, count(iou) AS labels FROM c')
def mean_iou(spark, sf):
    return m.mean_iou(_overlap(spark, sf)).withColumn("miou", F.round("miou", 6))


@query(OVERLAP + " SELECT label, image, round(avg(iou), 6) AS iou FROM r GROUP BY GROUPING SETS ((label), (image), ())")
def iou_by_group(spark, sf):
    return m.group_means(_overlap(spark, sf), ["label", "image"], "iou").select("label", "image", F.round("iou", 6).alias("iou"))


@query("SELECT l_returnflag AS view, count(*) AS pixels, round(avg((l_discount - l_tax) ** 2), 8) AS mse, round(-10 * log10(greatest(avg((l_discount - l_tax) ** 2), 1e-12)), 5) AS psnr FROM lineitem GROUP BY 1")
def psnr_by_group(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("view"), F.col("l_discount").alias("truth"), F.col("l_tax").alias("image"))
    return m.psnr_by(x, "view").select("view", "pixels", F.round("mse", 8).alias("mse"), F.round("psnr", 5).alias("psnr"))


MASK = f"(SELECT DISTINCT frame, px, py FROM {CELLS} WHERE px % 13 <> 0 AND py <> 7)"


def _mask(spark, sf):
    return cells(spark, sf).where("px % 13 <> 0 AND py <> 7").select("frame", "px", "py").distinct()


@query(f"WITH k AS (SELECT * FROM {MASK}), f AS (SELECT a.frame, a.px, a.py FROM k a JOIN k b ON a.frame = b.frame AND abs(a.px - b.px) <= 2 AND abs(a.py - b.py) <= 2 GROUP BY ALL HAVING count(*) = 25) SELECT * FROM k EXCEPT SELECT * FROM f")
def inner_boundary(spark, sf):
    return m.inner_boundary(_mask(spark, sf), "frame")


@query(f"SELECT frame, 'm' || px % 3 AS mask_id, count(*) AS area, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1, bool_or(px = 0 OR py = 0 OR px = 49 OR py = 11) AS touches, round(count(*) / 600, 6) AS fraction FROM {MASK} GROUP BY ALL")
def mask_statistics(spark, sf):
    masks = _mask(spark, sf).withColumn("mask_id", F.concat(F.lit("m"), (F.col("px") % 3).cast("string")))
    sizes = masks.select("frame").distinct().select("frame", F.lit(50).alias("width"), F.lit(12).alias("height"))
    return m.mask_statistics(masks, sizes).withColumn("fraction", F.round("fraction", 6))


@query(f"WITH b AS (SELECT frame, 'c' || px % 4 AS class, py * 100 + px AS pixel, max(alpha) AS c FROM {CELLS} GROUP BY ALL) SELECT frame, class, count(*) AS area, round(avg(c), 6) AS confidence FROM b GROUP BY ALL")
def class_targets(spark, sf):
    pixels = cells(spark, sf).select("frame", F.concat(F.lit("c"), (F.col("px") % 4).cast("string")).alias("class"), (F.col("py") * 100 + F.col("px")).alias("pixel"), F.col("alpha").alias("confidence"))
    return m.class_targets(pixels).withColumn("confidence", F.round("confidence", 6))


@query("SELECT lower(p_brand) AS label, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS sources, count(DISTINCT p_size) AS views FROM part GROUP BY 1")
def class_catalog(spark, sf):
    p = table(spark, sf, "part").select(F.lower("p_brand").alias("label"), F.col("p_type").alias("raw_label"), F.col("p_size").alias("frame"))
    return m.class_catalog(p)


@query("SELECT event_type, count(*) AS count, count_if(user_id % 3 = 0)::BIGINT AS inferred, count_if(user_id % 3 = 1)::BIGINT AS unknown, round(avg(value), 5) AS mean_confidence FROM events GROUP BY 1")
def object_statistics(spark, sf):
    source = F.when(F.col("user_id") % 3 == 0, "inferred").when(F.col("user_id") % 3 == 2, "observed")
    rows = table(spark, sf, "events").select("event_type", F.col("value").alias("confidence"), source.alias("source"))
    return m.object_statistics(rows, "event_type").withColumn("mean_confidence", F.round("mean_confidence", 5))


@query("WITH p AS (SELECT l_suppkey, (l_partkey % 101) / 101.0 AS u, (l_orderkey % 89) / 89.0 AS v FROM lineitem) SELECT l_suppkey, count(DISTINCT floor(u * 8) * 8 + floor(v * 8)) / 64 AS occupied, round(avg((u < 0.05 OR u > 0.95 OR v < 0.05 OR v > 0.95)::INT), 6) AS edge FROM p GROUP BY 1")
def cell_coverage(spark, sf):
    x = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 101 / 101.0).alias("u"), (F.col("l_orderkey") % 89 / 89.0).alias("v"))
    return m.cell_coverage(x, "l_suppkey").withColumn("edge", F.round("edge", 6))


@query("""
WITH p AS (SELECT l_orderkey, l_quantity::DOUBLE AS u, max(l_extendedprice::DOUBLE) AS hi, min(l_extendedprice::DOUBLE) AS lo FROM lineitem GROUP BY ALL),
spans AS (SELECT p.l_orderkey, p.u, (p.u - a.u) / (b.u - a.u) AS w, a.hi AS ah, b.hi AS bh, a.lo AS al, b.lo AS bl, p.hi, p.lo FROM p JOIN p a ON a.l_orderkey = p.l_orderkey AND a.u < p.u JOIN p b ON b.l_orderkey = p.l_orderkey AND p.u < b.u),
under AS (SELECT l_orderkey, u, bool_or(hi <= ah + w * (bh - ah)) AS dips, bool_or(lo >= al + w * (bl - al)) AS rises FROM spans GROUP BY ALL),
marked AS (SELECT p.*, coalesce(dips, false) AS dips, coalesce(rises, false) AS rises FROM p LEFT JOIN under ON under.l_orderkey = p.l_orderkey AND under.u = p.u),
top AS (SELECT l_orderkey, (lead(u) OVER w - u) * (lead(hi) OVER w + hi) / 2 AS part FROM marked WHERE NOT dips WINDOW w AS (PARTITION BY l_orderkey ORDER BY u)),
bottom AS (SELECT l_orderkey, (lead(u) OVER w - u) * (lead(lo) OVER w + lo) / 2 AS part FROM marked WHERE NOT rises WINDOW w AS (PARTITION BY l_orderkey ORDER BY u)),
sides AS (SELECT l_orderkey, coalesce(part, 0) AS part FROM top UNION ALL SELECT l_orderkey, -coalesce(part, 0) FROM bottom)
SELECT l_orderkey, round(sum(part) * 200)::BIGINT AS twice_area_cents FROM sides GROUP BY 1""")
def hull_areas(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("u"), F.col("l_extendedprice").alias("v"))
    return reviews.hull_area(x, "l_orderkey").select("l_orderkey", F.round(F.col("area") * 200).cast("long").alias("twice_area_cents"))


@query("WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT count(*) AS eligible, count_if(n > 0)::BIGINT AS visited, count_if(n = 0)::BIGINT AS uncovered, min(n) AS least_visits FROM c")
def supervision_coverage(spark, sf):
    return m.supervision_coverage(table(spark, sf, "customer").select(F.col("c_custkey").alias("view")), table(spark, sf, "orders").select(F.col("o_custkey").alias("view")))


@query("""
WITH mem AS (SELECT DISTINCT o_custkey AS point, 'k' || o_orderkey % 5 AS class FROM orders), n AS (SELECT c_custkey AS point, count(class) AS n FROM customer LEFT JOIN mem ON point = c_custkey GROUP BY 1),
e AS (SELECT * FROM (VALUES ('k1', 'k0'), ('k2', 'k0'), ('k3', 'k2')) t(child, parent))
SELECT round(avg((n = 0)::INT), 6) AS unknown, round(avg((n > 1)::INT), 6) AS multilabel, (SELECT count(*) FROM mem JOIN e ON child = class WHERE NOT EXISTS (FROM mem x WHERE x.point = mem.point AND x.class = e.parent)) AS violations FROM n""")
def membership_diagnostics(spark, sf):
    o = table(spark, sf, "orders")
    members = o.select(F.col("o_custkey").alias("point"), F.concat(F.lit("k"), (F.col("o_orderkey") % 5).cast("string")).alias("class")).distinct()
    edges = spark.createDataFrame([("k1", "k0"), ("k2", "k0"), ("k3", "k2")], "child string, parent string")
    points = table(spark, sf, "customer").select(F.col("c_custkey").alias("point"))
    return m.membership_diagnostics(members, points, edges).withColumns({"unknown": F.round("unknown", 6), "multilabel": F.round("multilabel", 6)})


@query("""
WITH x AS (SELECT l_returnflag AS class, 0.01 + (l_partkey % 98) / 100.0 AS p, (l_quantity > 25)::INT AS y FROM lineitem)
SELECT class, round((avg(CASE WHEN y > 0 THEN -ln(p) END) + avg(CASE WHEN y = 0 THEN -ln(1 - p) END)) / 2, 6) AS bce, round(1 - (2 * sum(p * y) + 1e-6) / (sum(p) + sum(y) + 1e-6), 6) AS dice FROM x GROUP BY 1""")
def segmentation_loss(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("class"), (0.01 + F.col("l_partkey") % 98 / 100.0).alias("p"), (F.col("l_quantity") > 25).cast("int").alias("y"))
    return m.segmentation_loss(x).select("class", F.round("bce", 6).alias("bce"), F.round("dice", 6).alias("dice"))


@query("SELECT l_suppkey AS view, count_if(l_quantity > 5)::BIGINT AS anchors, round(median(CASE WHEN l_quantity > 5 THEN 1 / (l_quantity - 5) END), 6) AS median_inverse_depth, max(CASE WHEN l_quantity > 5 THEN l_tax END) AS worst_residual FROM lineitem GROUP BY 1")
def depth_anchors(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("view"), (F.col("l_quantity") - 5).alias("depth"), F.col("l_tax").alias("residual"))
    return m.depth_anchors(x).withColumn("median_inverse_depth", F.round("median_inverse_depth", 6))


@query("SELECT l_partkey AS point, round(avg(l_discount), 6) AS color, round(avg(l_tax), 6) AS error, count(*) AS observations FROM lineitem GROUP BY 1")
def point_means(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("point"), F.col("l_discount").alias("color"), F.col("l_tax").alias("error"))
    return m.mean_observation(x, "point", "color", "error").withColumns({"color": F.round("color", 6), "error": F.round("error", 6)})


@query("""
WITH x AS (SELECT vec_id, embedding, (embedding[4] + 1) / 2 AS opacity FROM embeddings),
b AS (SELECT count(*) AS n, count_if(opacity > 0.6)::BIGINT AS o, count_if(NOT (embedding[5] > 0 AND embedding[6] > 0 AND embedding[7] > 0))::BIGINT AS s, count_if(NOT (embedding[8] BETWEEN 0 AND 1 AND embedding[9] BETWEEN 0 AND 1 AND embedding[10] BETWEEN 0 AND 1))::BIGINT AS c FROM x)
SELECT rule, broken, n AS rows FROM b, LATERAL (VALUES ('position', 0::BIGINT), ('scale', s), ('rotation', 0::BIGINT), ('color', c), ('opacity', o), ('sh', 0::BIGINT)) v(rule, broken)""")
def scene_rule_report(spark, sf):
    e = table(spark, sf, "embeddings")
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    opacity = (F.get("embedding", F.lit(3)).cast("double") + 1) / 2
    rows = e.select(part(1, 3).alias("position"), part(5, 3).alias("scale"), part(11, 4).alias("rotation"), part(8, 3).alias("color"), F.when(opacity > 0.6, opacity + 1).otherwise(opacity).alias("opacity"), F.lit(None).cast("array<double>").alias("sh"), F.lit(0).alias("sh_degree"))
    return validation.rule_report(rows, validation.scene_rules())


FILES = "(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'vendor/' WHEN 2 THEN '../' WHEN 3 THEN 'a/node_modules/' ELSE '' END || 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.JSON' WHEN 2 THEN '.exe' ELSE '' END AS path FROM documents)"


@query(f"""
WITH f AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix FROM {FILES}),
r AS (SELECT path, suffix, CASE WHEN path LIKE '../%' THEN 'unsafe_path' WHEN path LIKE 'vendor/%' OR path LIKE '%/node_modules/%' THEN 'excluded_tree' WHEN suffix NOT IN ('.py', '.json') THEN 'suffix' END AS reason FROM f)
SELECT path, reason IS NULL AS included, coalesce(reason, 'suffix:' || suffix) AS reason FROM r""")
def archive_selection(spark, sf):
    i = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src/", "vendor/", "../", "a/node_modules/", "", "")]), (i % 6 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".py", ".JSON", ".exe", "")]), (i % 4 + 1).cast("int"))
    files = table(spark, sf, "documents").select(F.concat(folder, F.lit("f"), i.cast("string"), suffix).alias("path"))
    return validation.classify_files(files, "path", (".py", ".json"), ("vendor", "node_modules"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.5 ELSE least(greatest(value, 10.0), 90.0) END AS confidence, least(CASE WHEN event_id % 9 <> 0 THEN value / 100 END, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.49 END) AS bounded FROM events")
def confidence_clamp(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 9 != 0, F.col("value").cast("string")).otherwise("n/a")
    source = F.when(F.col("event_type") == "click", "observed").otherwise("inferred")
    value = F.when(F.col("event_id") % 9 != 0, F.col("value") / 100)
    bounded = F.when(value.isNull(), F.when(source == "observed", 1.0).otherwise(0.49)).otherwise(validation.clamp_provenance(value, source))
    return e.select("event_id", validation.clamp_or(raw, 0.5, 10.0, 90.0).alias("confidence"), bounded.alias("bounded"))


@query("SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS opacity, round(greatest(0, least(1, 0.5 + 0.28209479177387814 * embedding[2]::DOUBLE)), 6) AS red, round(ln(greatest(1e-6, least(1 - 1e-6, abs(embedding[3]::DOUBLE))) / (1 - greatest(1e-6, least(1 - 1e-6, abs(embedding[3]::DOUBLE))))), 5) AS raw FROM embeddings")
def point_activation(spark, sf):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", r6(numeric.sigmoid(at(0))).alias("opacity"), r6(numeric.base_color(at(1))).alias("red"), F.round(numeric.logit(F.abs(at(2))), 5).alias("raw"))


ROTATION = """
WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z FROM embeddings), n AS (SELECT vec_id, w / l AS w, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(w*w + x*x + y*y + z*z) AS l FROM q))
SELECT vec_id, round(1 - 2 * (y*y + z*z), 5) + 0.0 AS r00, round(2 * (x*y - w*z), 5) + 0.0 AS r01, round(2 * (y*z + w*x), 5) + 0.0 AS r21 FROM n"""


@query(ROTATION)
def quaternion_matrix(spark, sf):
    q = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    matrix = table(spark, sf, "embeddings").select("vec_id", numeric.quaternion_matrix(q).alias("r"))
    return matrix.select("vec_id", *[(F.round(F.get("r", F.lit(i)), 5) + 0.0).alias(n) for i, n in ((0, "r00"), (1, "r01"), (7, "r21"))])


@query("""
WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z FROM embeddings)
SELECT vec_id, round(abs(w) / l, 5) AS qw, round(sign(w) * x / l, 5) + 0.0 AS qx, round(sign(w) * y / l, 5) + 0.0 AS qy, round(sign(w) * z / l, 5) + 0.0 AS qz FROM (SELECT *, sqrt(w*w + x*x + y*y + z*z) AS l FROM q)""")
def rotation_quaternion(spark, sf):
    q = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    back = table(spark, sf, "embeddings").select("vec_id", numeric.quaternion_matrix(q).alias("r")).select("vec_id", numeric.matrix_quaternion(F.col("r")).alias("q"))
    return back.select("vec_id", *[(F.round(F.get("q", F.lit(i)), 5) + 0.0).alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))])


HARMONICS = """
WITH d AS (SELECT vec_id, embedding, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), u AS (SELECT *, a / l AS x, b / l AS y, c / l AS z FROM (SELECT *, sqrt(a*a + b*b + c*c) AS l FROM d))
SELECT vec_id, round(greatest(0, 0.5 + 0.28209479177387814 * embedding[11]::DOUBLE - 0.4886025119029199 * y * embedding[12]::DOUBLE + 0.4886025119029199 * z * embedding[13]::DOUBLE - 0.4886025119029199 * x * embedding[14]::DOUBLE), 5) + 0.0 AS red FROM u"""


@query(HARMONICS)
def harmonic_color(spark, sf):
    direction = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    color = numeric.sh_color(F.slice("embedding", 11, 12), direction, 1)
    return table(spark, sf, "embeddings").select("vec_id", (F.round(F.get(color, F.lit(0)), 5) + 0.0).alias("red"))


@query()
def ssim_by_view(spark, sf):
    pixels = cells(spark, sf).groupBy(F.col("frame").alias("view"), "px", "py").agg(F.avg("alpha").alias("truth"), F.max("alpha").alias("image"))
    return m.ssim_by_view(pixels)
