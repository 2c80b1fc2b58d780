"""Cameras, gates, declared relations and schedules on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import cameras as c
from ..operators import gates as g
from .common import collector, table

QUERIES, query = collector()

POSE = "WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z, embedding[5]::DOUBLE AS tx, embedding[6]::DOUBLE AS ty, embedding[7]::DOUBLE AS tz FROM embeddings), n AS (SELECT vec_id, w / l AS w, x / l AS x, y / l AS y, z / l AS z, tx, ty, tz FROM (SELECT *, sqrt(w*w + x*x + y*y + z*z) AS l FROM q))"


@query(POSE + " SELECT vec_id, round(-((1 - 2*(y*y + z*z)) * tx + 2*(x*y + w*z) * ty + 2*(x*z - w*y) * tz), 5) + 0.0 AS x, round(-(2*(x*y - w*z) * tx + (1 - 2*(x*x + z*z)) * ty + 2*(y*z + w*x) * tz), 5) + 0.0 AS y, true AS rigid FROM n")
def camera_inverse(spark, sf):
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", numeric.quaternion_matrix(part(1, 4)).alias("r"), part(5, 3).alias("t"))
    _, moved = c.rigid_inverse([F.get("r", F.lit(i)) for i in range(9)], [F.get("t", F.lit(i)) for i in range(3)])
    return rows.select("vec_id", (F.round(moved[0], 5) + 0.0).alias("x"), (F.round(moved[1], 5) + 0.0).alias("y"), c.is_rigid(F.col("r")).alias("rigid"))


@query("SELECT event_id, round((event_id % 64 - 32) / 80.0::DOUBLE * floor(value), 5) + 0.0 AS x, round((event_id % 48 - 24) / 90.0::DOUBLE * floor(value), 5) + 0.0 AS y FROM events")
def back_projection(spark, sf):
    k = F.col("event_id")
    x, y, _ = c.back_project(k % 64, k % 48, F.floor("value"), F.lit(80.0), F.lit(90.0), F.lit(32), F.lit(24))
    return table(spark, sf, "events").select("event_id", (F.round(x, 5) + 0.0).alias("x"), (F.round(y, 5) + 0.0).alias("y"))


@query("SELECT n_nationkey AS frame, px, py FROM nation, range(3 + n_nationkey % 4) a(px), range(2 + n_nationkey % 3) b(py)")
def pixel_grid(spark, sf):
    k = F.col("n_nationkey")
    return c.pixel_grid(table(spark, sf, "nation").select(k.alias("frame"), (3 + k % 4).alias("width"), (2 + k % 3).alias("height"))).select("frame", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_totalprice > 100000) WHERE r = 1")
def first_valid_camera(spark, sf):
    return c.first_valid(table(spark, sf, "orders"), "o_custkey", "o_orderkey", F.col("o_totalprice") > 100000, "o_totalprice")


@query("""
WITH i AS (SELECT doc_id AS name, n_chars AS width, sha256(text) AS sha FROM documents WHERE doc_id % 7 <> 0), k AS (SELECT doc_id AS name, n_chars + (doc_id % 11 = 0)::INT AS width, sha256(text || CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE '' END) AS sha, CASE WHEN doc_id % 17 <> 0 THEN 500.0 END AS fx FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(i.name, k.name) AS name, CASE WHEN k.name IS NULL THEN 'missing' WHEN i.name IS NULL THEN 'unknown_image' WHEN k.width <> i.width THEN 'size' WHEN k.sha <> i.sha THEN 'hash' ELSE 'focal' END AS problem FROM i FULL JOIN k ON i.name = k.name WHERE k.name IS NULL OR i.name IS NULL OR k.width <> i.width OR k.sha <> i.sha OR k.fx IS NULL""")
def calibration_check(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    images = d.where("doc_id % 7 <> 0").select(i.alias("name"), F.col("n_chars").alias("width"), F.lit(1).alias("height"), F.sha2("text", 256).alias("sha256"))
    text = F.concat("text", F.when(i % 13 == 0, "x").otherwise(""))
    found = d.where("doc_id % 5 <> 0").select(i.alias("name"), (F.col("n_chars") + (i % 11 == 0).cast("int")).alias("width"), F.lit(1).alias("height"), F.sha2(text, 256).alias("sha256"), F.when(i % 17 != 0, 500.0).alias("fx"), F.lit(500.0).alias("fy"))
    return c.calibration_problems(images, found)


@query("WITH m AS (SELECT l_suppkey AS pair, median(l_quantity) AS median FROM lineitem GROUP BY 1) SELECT s_suppkey AS pair, round((s_suppkey % 10) / 50.0 / median, 8) AS ratio, coalesce((s_suppkey % 10) / 50.0 / median >= 0.005, false) AS accepted FROM supplier LEFT JOIN m ON pair = s_suppkey")
def pair_gate(spark, sf):
    points = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("depth"))
    bases = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pair"), (F.col("s_suppkey") % 10 / 50.0).alias("baseline"))
    return c.pair_gate(points, bases).withColumn("ratio", F.round("ratio", 8))


@query("SELECT vec_id * 16 + i AS address, embedding[i + 1] AS value FROM embeddings, range(12) t(i) WHERE i < 4 + vec_id % 9")
def harmonic_bank(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("source_index"), F.expr("slice(embedding, 1, cast(4 + vec_id % 9 as int))").alias("sh"))
    return c.harmonic_bank(e, 16)


@query("""
WITH a AS (SELECT o_orderkey AS origin, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders),
b AS (SELECT origin, row_number() OVER (ORDER BY blk, p) - 1 AS p FROM (SELECT 0 AS blk, * FROM a UNION ALL SELECT 1, * FROM a WHERE p % 10 = 0)),
s AS (SELECT origin, row_number() OVER (ORDER BY blk, p) - 1 AS p FROM (SELECT 0 AS blk, * FROM b WHERE p % 9 <> 1 UNION ALL SELECT 1, * FROM b WHERE p % 9 = 1 UNION ALL SELECT 2, * FROM b WHERE p % 9 = 1))
SELECT row_number() OVER (ORDER BY p) - 1 AS position, origin FROM s WHERE p % 4 <> 3""")
def lineage_growth(spark, sf):
    from ..operators.ordering import with_ordinal

    start = with_ordinal(table(spark, sf, "orders").select(F.col("o_orderkey").alias("origin")), ["origin"], name="position")
    ids = spark.range(table(spark, sf, "orders").count() * 3).withColumnRenamed("id", "position")
    steps = [("clone", ids.where("position % 10 = 0")), ("split", ids.where("position % 9 = 1")), ("prune", ids.where("position % 4 = 3"))]
    return c.lineage_steps(start, steps)


@query("""
WITH j AS (SELECT o_custkey % 40 AS scene, CASE WHEN o_orderkey % 501 = 0 THEN 'open' ELSE 'complete' END AS status, o_custkey % 40 % 3 + (o_orderkey % 777 = 0)::INT AS split, 10 + (o_orderkey % 901 = 0)::INT AS width FROM orders),
s AS (SELECT scene, count_if(status <> 'complete') AS o, count(DISTINCT split) AS s, count(DISTINCT width) AS w FROM j GROUP BY 1)
SELECT scene, problem FROM s, LATERAL (VALUES ('incomplete', o > 0), ('split', s <> 1), ('image_size', w <> 1)) v(problem, bad) WHERE bad""")
def render_gates(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    scene = F.col("o_custkey") % 40
    jobs = o.select(scene.alias("scene"), F.when(k % 501 == 0, "open").otherwise("complete").alias("status"), (scene % 3 + (k % 777 == 0).cast("int")).alias("split"), (10 + (k % 901 == 0).cast("int")).alias("width"), F.lit(5).alias("height"), F.lit("n").alias("names"))
    return g.render_gates(jobs)


@query("""
WITH s AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS frame, 'k' || l_linenumber AS class, l_suppkey AS point FROM lineitem),
e AS (SELECT * FROM (VALUES ('k1', 'k2'), ('k3', 'k1')) t(child, parent)), d AS (SELECT child, parent, f.frame FROM e, (SELECT DISTINCT frame FROM s) f)
SELECT d.child, d.parent, c.point, count(DISTINCT d.frame) AS frames FROM d JOIN s c ON c.frame = d.frame AND c.class = d.child JOIN s p ON p.frame = d.frame AND p.class = d.parent AND p.point = c.point GROUP BY ALL HAVING count(DISTINCT d.frame) >= 2""")
def geometry_support(spark, sf):
    x = table(spark, sf, "lineitem")
    support = x.select(F.date_format("l_shipdate", "yyyy-MM").alias("frame"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("class"), F.col("l_suppkey").alias("point")).distinct()
    edges = spark.createDataFrame([("k1", "k2"), ("k3", "k1")], "child string, parent string")
    declared = support.select("frame").distinct().join(F.broadcast(edges))  # two edges
    return g.geometry_support(support, edges, declared)


@query("""
WITH o AS (SELECT p_partkey AS id, p_name AS label, CASE WHEN p_partkey % 3 = 0 THEN p_partkey - 1 END AS parent_id FROM part), u AS (SELECT * FROM o WHERE label IN (SELECT label FROM o GROUP BY label HAVING count(*) = 1)),
m AS (SELECT c.label AS child, p.label AS parent FROM u c JOIN u p ON p.id = c.parent_id), a AS (SELECT p_name AS child, p_brand AS parent FROM part WHERE p_size < 5),
r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY rk, parent) AS r FROM (SELECT *, 'manual' AS source, 1 AS rk FROM m UNION ALL SELECT *, 'automatic', 2 FROM a))
SELECT child, parent, source FROM r WHERE r = 1""")
def manual_hierarchy(spark, sf):
    p = table(spark, sf, "part")
    objects = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") - 1).alias("parent_id"))
    return g.manual_edges(objects, p.where("p_size < 5").select(F.col("p_name").alias("child"), F.col("p_brand").alias("parent")))


@query("""
WITH r AS (SELECT o_custkey % 50 AS frame, o_orderkey AS region, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 40 END AS object_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 60 END AS parent FROM orders),
k AS (SELECT frame, object_id, any_value(region) AS parent_region FROM r WHERE object_id IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
SELECT r.frame, region, parent_region FROM r LEFT JOIN k ON k.frame = r.frame AND k.object_id = r.parent WHERE r.parent IS NOT NULL""")
def parent_regions(spark, sf):
    k = F.col("o_orderkey")
    regions = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("frame"), k.alias("region"), F.when(k % 3 == 0, k % 40).alias("object_id"), F.when(k % 4 == 0, k % 60).alias("parent_object_id"))
    return g.parent_regions(regions)


@query("WITH r AS (SELECT o_orderkey AS run, o_custkey AS scene, o_orderstatus AS sha, CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'priority' END AS mode, o_orderkey % 3 AS seed FROM orders) SELECT a.scene, a.run AS baseline, b.run AS priority FROM r a JOIN r b ON a.scene = b.scene AND a.sha = b.sha AND a.seed = b.seed AND a.mode = 'baseline' AND b.mode = 'priority'")
def evidence_pairs(spark, sf):
    k = F.col("o_orderkey")
    runs = table(spark, sf, "orders").select(k.alias("run"), F.col("o_custkey").alias("scene"), F.col("o_orderstatus").alias("input_sha256"), F.lit("s").alias("split"), (k % 3).alias("seed"), F.when(k % 2 == 0, "baseline").otherwise("priority").alias("mode"))
    return g.evidence_pairs(runs)


@query("WITH c AS (SELECT l_suppkey AS image, l_returnflag AS label, count(*) AS n, count_if(l_quantity > 25) AS f FROM lineitem GROUP BY ALL) SELECT image, sum(n)::BIGINT AS masks, sum(f)::BIGINT AS filled, string_agg(label || ':' || n, ',' ORDER BY label || ':' || n) AS labels FROM c GROUP BY image")
def image_statistics(spark, sf):
    masks = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("label"), F.greatest(F.lit(0.0), F.col("l_quantity") - 25).alias("area"))
    return g.image_statistics(masks)


@query("SELECT l_suppkey AS image, l_returnflag AS label, sum(l_quantity) AS area, round(avg(l_discount), 6) AS confidence, string_agg(DISTINCT 'm' || l_linenumber, ',' ORDER BY 'm' || l_linenumber) AS mask_ids FROM lineitem GROUP BY ALL")
def target_summary(spark, sf):
    masks = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("area"), F.col("l_discount").alias("confidence"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("mask_id"))
    return g.target_summary(masks).withColumn("confidence", F.round("confidence", 6))


@query("SELECT s_suppkey AS image, round(coalesce(n, 0) / 5000, 6) AS fraction FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) ON l_suppkey = s_suppkey WHERE s_suppkey % 8 <> 0")
def priority_coverage(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image"), F.lit(5000).alias("pixels"))
    pixels = table(spark, sf, "lineitem").where("l_discount > 0.05").select(F.col("l_suppkey").alias("image"), F.col("l_partkey").alias("pixel"))
    return g.priority_union(pixels, s, s.where("image % 8 <> 0").select("image")).withColumn("fraction", F.round("fraction", 6))


@query("SELECT l_suppkey AS frame, l_partkey AS pixel, round(max(1 + 2.5 * l_discount), 6) AS weight FROM lineitem GROUP BY ALL")
def priority_weights(spark, sf):
    pixels = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("frame"), F.col("l_partkey").alias("pixel"), F.col("l_discount").alias("mask"))
    return g.weight_map(pixels, 2.5).withColumn("weight", F.round("weight", 6))


@query("SELECT event_id AS point_id, value AS gradient FROM events WHERE value >= 50 ORDER BY value DESC, event_id LIMIT 200")
def growth_picks(spark, sf):
    return g.growth_picks(table(spark, sf, "events").select(F.col("event_id").alias("point_id"), F.col("value").alias("gradient")), 200, 50.0)


@query("SELECT count(*) AS loaded, (SELECT string_agg('SH' || d, '/' ORDER BY d) FROM (SELECT DISTINCT user_id % 6 AS d FROM events WHERE user_id % 6 <= 3)) AS degrees, count_if(user_id % 6 > 3)::BIGINT AS fixed FROM events")
def scene_display(spark, sf):
    return g.display_info(table(spark, sf, "events").select((F.col("user_id") % 6).cast("int").alias("sh_degree")))


@query("SELECT l_orderkey AS query, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AS contiguous FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def token_contiguity(spark, sf):
    tokens = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("position"), (F.col("l_quantity") > 10).alias("attended"))
    return g.contiguous_tokens(tokens)


@query("SELECT event_id, round(least(0.49, 0.25 + 0.08 * ln(value)), 6) AS score FROM events WHERE event_id % 70 < 64 AND event_id % 50 < 48 AND user_id % 5 <> 0 AND value > 3")
def map_confidence(spark, sf):
    k = F.col("event_id")
    samples = table(spark, sf, "events").select("event_id", (k % 70).alias("x"), (k % 50).alias("y"), F.lit(64).alias("width"), F.lit(48).alias("height"), (F.col("user_id") % 5 != 0).alias("valid"), F.col("value").alias("confidence"))
    return g.map_confidence(samples).select("event_id", F.round("score", 6).alias("score"))


@query("SELECT 'n_chars' AS \"column\", (SELECT count(*) FROM documents WHERE doc_id % 9 = 0) + (SELECT count(*) FROM documents WHERE doc_id % 4 = 1 AND doc_id % 9 <> 0) AS changed UNION ALL SELECT 'lang', (SELECT count(*) FROM documents WHERE doc_id % 9 = 0)")
def frozen_columns(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    after = d.where("doc_id % 9 <> 0").withColumn("n_chars", F.when(i % 4 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return g.frozen_columns(d, after, "doc_id", "n_chars", "lang")


@query()
def balanced_schedule(spark, sf):
    views = table(spark, sf, "events").select((F.col("user_id") % 20).alias("frame"), F.col("event_type").alias("class")).distinct()
    return g.balanced_schedule(views, 2)
