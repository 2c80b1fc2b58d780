"""Gates, retrieval, declared relations and packages over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions import text as t
from ..operators import admission as a
from ..operators import cameras, ordering, relations, retrieval, validation
from ..operators import reviews as v
from ..sources import evidence, ledger, packages
from .common import collector, table

QUERIES, query = collector()


def _chain(*rules: tuple[str, str]) -> str:
    """SQL of the first rule that does not hold."""
    return "CASE " + " ".join(f"WHEN NOT coalesce({ok}, false) THEN '{name}'" for name, ok in rules) + " END"


@query("SELECT vec_id, " + _chain(("position", "true"), ("color", "vec_id % 5 <> 0"), ("confidence", "vec_id % 7 / 10.0 <= 0.490001"), ("source", "label % 3 <> 1"), ("observed", "vec_id % 11 <> 0"), ("in_frame", "vec_id % 13 < 10")) + " AS problem FROM embeddings")
def learned_points(spark, sf):
    i = F.col("vec_id")
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("position"),
        F.array(F.lit(0.5), F.lit(1.0), F.when(i % 5 == 0, 1.5).otherwise(0.0)).alias("color"),
        (i % 7 / 10.0).alias("confidence"),
        F.when(F.col("label") % 3 == 1, "observed").otherwise("inferred").alias("source"),
        F.when(i % 11 != 0, F.create_map(F.lit("0"), F.array((i % 13).cast("double"), F.lit(3.0)))).otherwise(F.create_map().cast("map<string, array<double>>")).alias("seen"),
    )
    size = F.create_map(F.lit("0"), F.lit(10.0))
    return rows.select("vec_id", a.learned_point_problem(size, size).alias("problem"))


@query("SELECT vec_id, " + _chain(("position", "true"), ("scale", "vec_id % 6 <> 0"), ("color", "true"), ("opacity", "vec_id % 9 <= 5"), ("rotation", "vec_id % 10 <> 3"), ("confidence", "true")) + " AS problem, CASE WHEN vec_id % 4 = 0 THEN 0.25 ELSE least(0.49, vec_id % 7 / 8.0) END::DOUBLE AS confidence, 'inferred' AS source FROM embeddings")
def completion_rows(spark, sf):
    i = F.col("vec_id")
    three = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        three.alias("position"),
        F.array(F.lit(1.0), F.lit(2.0), (i % 6).cast("double")).alias("scale"),
        F.when(i % 10 == 3, F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("rotation"),
        F.array(*[F.lit(0.5)] * 3).alias("color"),
        (i % 9 / 5.0).alias("opacity"),
        F.when(i % 4 != 0, i % 7 / 8.0).alias("confidence"),
    )
    return a.completed(rows).select("vec_id", "problem", "confidence", "source")


@query("""
WITH o AS (SELECT o_custkey AS frame, o_orderkey % 100 AS class_index, o_orderkey % 41 / 40.0 AS confidence, o_orderkey % 59 / 50.0 AS greatest FROM orders),
f AS (SELECT frame, count_if(class_index > 97) AS c, count_if(greatest > 1) AS g, count(*) - count(DISTINCT class_index) AS d FROM o GROUP BY frame)
SELECT frame, CASE WHEN c > 0 THEN 'class_range' WHEN g > 0 THEN 'targets' WHEN d > 0 THEN 'class_twice' END AS problem FROM f""")
def observation_problems(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("frame"), (k % 100).alias("class_index"), (k % 41 / 40.0).alias("confidence"), F.lit(0.0).alias("least"), (k % 59 / 50.0).alias("greatest"))
    return a.observation_problems(rows, 98)


@query("""
WITH d AS (SELECT doc_id AS name, n_chars AS width FROM documents),
c AS (SELECT name, name % 5 <> 0 AND name % 11 <> 0 AS same_grid, name % 7 <> 0 AS centered FROM d)
SELECT name, same_grid, centered, CASE WHEN name % 3 = 0 THEN NULL WHEN NOT same_grid THEN 'pixel_grid' WHEN name % 13 = 0 THEN 'full_size' END AS problem FROM c""")
def mask_grids(spark, sf):
    i = F.col("name")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.col("n_chars").cast("long").alias("width"))
    wide = F.col("width").cast("double")
    now = d.select("name", F.lit("PINHOLE").alias("model"), "width", F.lit(10).alias("height"), F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.when(i % 7 == 0, wide).otherwise(wide / 2).alias("cx"), F.lit(5.0).alias("cy"))
    before = now.where(i % 11 != 0).withColumn("fx", F.when(i % 5 == 0, 501.0).otherwise(F.col("fx") + 1e-7))
    grid = a.same_pixel_grid(now, before)
    masks = d.where(i % 3 != 0).select("name", (F.col("width") + (i % 13 == 0).cast("int")).alias("width"), F.lit(10).alias("height"))
    problems = a.mask_grid_problems(now.join(grid, "name"), masks)
    return grid.join(problems, "name", "left").select("name", "same_grid", "centered", "problem")


FILES = ["scene.PLY", "scene.json", "a.jsonl", "b.txt"]
PACKS = ["s.zip", "s.tar", None]


@query(f"""
WITH f AS (SELECT p_partkey AS id, {FILES}[p_partkey % 5 + 1] AS g, {['s.zip', 's.tar']}[p_partkey % 3 + 1] AS s, p_size > 25 AS only_geometry FROM part)
SELECT id, CASE WHEN g IS NULL THEN 'geometry' WHEN g = 'b.txt' THEN 'geometry_suffix' WHEN g = 'scene.PLY' AND NOT only_geometry AND s IS NULL THEN 'semantics_missing' WHEN s = 's.tar' THEN 'semantics_suffix' WHEN s IS NOT NULL AND g <> 'scene.PLY' THEN 'semantics_pairing' END AS problem FROM f""")
def import_requirements(spark, sf):
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), a.import_problem(pick(FILES, k % 5), pick(PACKS, k % 3), F.col("p_size") > 25).alias("problem"))


@query("SELECT id, CASE WHEN kind = 'txt' OR kind = '' THEN NULL WHEN b <= lim THEN kind END AS reader, CASE WHEN kind IN ('txt', '') THEN 'suffix' WHEN b > lim THEN 'bytes' END AS problem FROM (SELECT *, CASE kind WHEN 'ply' THEN 1073741824 WHEN 'json' THEN 268435456 ELSE 4294967296 END AS lim FROM (SELECT p_partkey AS id, ['ply', 'json', 'jsonl', 'txt', ''][p_partkey % 5 + 1] AS kind, p_size * 100000000::BIGINT AS b FROM part))")
def import_routes(spark, sf):
    k = F.col("p_partkey")
    path = F.get(F.array(*[F.lit(x) for x in ("a/b.PLY", "b.json", "x.y.jsonl", "c.txt", "noending")]), (k % 5).cast("int"))
    return table(spark, sf, "part").select(k.alias("id"), packages.import_route(path, F.col("p_size").cast("long") * 100_000_000).alias("r")).select("id", "r.reader", "r.problem")


@query("WITH o AS (SELECT o_custkey AS scene_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'object' ELSE 'scene' END AS level FROM orders) SELECT scene_id, bool_or(level <> 'scene') AS semantic FROM o GROUP BY 1")
def scenes_with_objects(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("scene_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "object").otherwise("scene").alias("level"))
    return a.has_objects(o)


@query("SELECT doc_id, lang FROM documents")
def plain_points(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("object_id"), F.array("doc_id").alias("semantic_ids"), F.lit(0.5).alias("semantic_confidence"))
    return a.without_semantics(d)


@query("""SELECT o_orderkey AS run, """ + _chain(("iterations", "o_orderkey % 17 <> 0"), ("timing", "o_totalprice > 2000"), ("points", "o_orderkey % 19 <> 0"), ("views", "o_orderkey % 23 <> 0"), ("metric", "o_orderkey % 29 <> 0"), ("split", "o_orderkey % 31 <> 0")) + " AS problem FROM orders")
def result_evidence(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k.alias("run"),
        F.when(k % 17 == 0, 100).otherwise(7000).alias("iterations"),
        F.greatest(F.lit(0.0), F.col("o_totalprice") - 2000).alias("wall_seconds"),
        (k % 19).alias("points"),
        F.when(k % 23 == 0, 36).otherwise(37).alias("views"),
        F.lit(37).alias("expected_views"),
        F.when(k % 29 == 0, float("nan")).otherwise(0.5).alias("metric"),
        F.when(k % 31 == 0, 2).otherwise(0).alias("shared_views"),
    )
    return rows.select("run", a.evidence_problem(F.lit(7000)).alias("problem"))


@query("""
WITH r AS (SELECT o_custkey AS scene, o_orderpriority AS mode, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT c_custkey AS scene, m AS mode FROM customer, (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NEVER')) v(m))
SELECT coalesce(r.scene, e.scene) AS scene, coalesce(r.mode, e.mode) AS mode, CASE WHEN n IS NULL THEN 'missing' WHEN e.scene IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM r FULL JOIN e ON r.scene = e.scene AND r.mode = e.mode WHERE n IS NULL OR e.scene IS NULL OR n > 1""")
def result_combinations(spark, sf):
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("scene"), F.col("o_orderpriority").alias("mode"))
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("scene"), F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("9-NEVER"))).alias("mode"))
    return a.missing_combinations(done, expected, "scene", "mode")


@query("SELECT o_orderkey AS run_id, " + _chain(("identity", "o_orderkey % 13 <> 0"), ("status", "o_orderstatus = 'F'"), ("training_data", "o_orderkey % 3 <> 0"), ("backend", "o_orderkey % 4 <> 1"), ("model", "o_orderkey % 5 < 3"), ("masks", "o_orderkey % 7 <> 0")) + " AS problem FROM orders")
def run_admission(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k.alias("run_id"),
        F.when(k % 13 == 0, -1).otherwise(k).alias("record_id"),
        F.col("o_custkey").alias("project"),
        F.col("o_custkey").alias("record_project"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        (k % 3).alias("images"),
        F.lit(2).alias("cameras"),
        F.when(k % 4 == 1, "mps").when(k % 4 == 2, "upstream_CUDA_3dgs").otherwise("original_3dgs").alias("backend"),
        F.when(k % 5 < 3, "/p/runs/a/point.PLY").when(k % 5 == 3, "/p/runs/../x.ply").otherwise("/q/x.ply").alias("ply_path"),
        (k % 7).alias("masks"),
    )
    return rows.select("run_id", a.run_problem(F.lit("/p/runs")).alias("problem"))


@query("SELECT p_partkey AS id, " + _chain(("min_shared_points", "p_size % 5 <> 0"), ("min_parent_views", "p_size > 1"), ("max_descriptors", "true"), ("shares", "p_size <= 45"), ("min_containment", "p_size >= 10"), ("min_parent_area_ratio", "p_partkey % 6 <> 0"), ("min_descriptor_cosine", "true"), ("source_hash", "p_partkey % 4 <> 3")) + " AS problem FROM part")
def config_rules(spark, sf):
    n = F.col("p_size")
    one = lambda c: F.lit(0.5).alias(c)
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        (n % 5).alias("min_shared_points"),
        n.alias("min_parent_views"),
        F.lit(8).alias("max_descriptors"),
        (n / 45.0).alias("min_support_overlap"),
        *[one(c) for c in ("min_support_iou", "ambiguity_margin", "feature_weight", "descriptor_split_cosine")],
        F.when(n >= 10, 0.9).otherwise(0.89).alias("min_containment"),
        F.when(F.col("p_partkey") % 6 == 0, 0.5).otherwise(1.5).alias("min_parent_area_ratio"),
        F.lit(-0.5).alias("min_descriptor_cosine"),
        F.when(F.col("p_partkey") % 4 == 3, "ab").when(F.col("p_partkey") % 4 == 2, F.sha2("p_name", 256)).alias("source_ply_sha256"),
    )
    return rows.select("id", a.config_problem().alias("problem"))


@query("WITH s AS (SELECT o_custkey AS region, list(o_orderkey - 3) AS ids FROM orders GROUP BY 1) SELECT region, CASE WHEN list_min(ids) < 0 THEN 'negative' WHEN region % 5 = 0 THEN 'unbound' WHEN list_max(ids) >= region * 60 THEN 'range' END AS problem FROM s")
def support_ids(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("region")).agg(F.collect_list(F.col("o_orderkey") - 3).alias("ids"))
    return s.select("region", a.support_problem(F.col("ids"), F.when(F.col("region") % 5 != 0, F.col("region") * 60)).alias("problem"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'classes' WHEN p_name = p_brand OR p_partkey % 7 = 0 THEN 'repeated' WHEN p_partkey % 3 = 0 THEN 'order' END AS problem FROM part")
def class_orders(spark, sf):
    k = F.col("p_partkey")
    classes = F.array("p_name", F.when(k % 4 == 0, " ").when(k % 7 == 0, F.col("p_name")).otherwise(F.col("p_brand")))
    return table(spark, sf, "part").select(k.alias("id"), a.class_order_problem(classes, F.when(k % 3 == 0, F.reverse(classes)).otherwise(classes)).alias("problem"))


@query("SELECT o_orderkey AS id, " + _chain(("indices", "o_orderkey % 12 < 10 AND o_custkey % 11 < 10"), ("distinct", "o_orderkey % 12 <> o_custkey % 11"), ("relation", "o_orderkey % 5 <> 0"), ("source", "o_orderkey % 13 <> 0")) + " AS problem FROM orders")
def relation_edges(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("id"), (k % 12).alias("parent_idx"), (F.col("o_custkey") % 11).alias("child_idx"), F.when(k % 5 == 0, " ").otherwise("part_of").alias("relation"), F.when(k % 13 == 0, "").when(k % 2 == 0, "model").alias("source"))
    return rows.select("id", a.edge_problem(F.lit(10)).alias("problem"))


@query("""
WITH x AS (SELECT o_custkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, o_orderkey AS k FROM orders),
y AS (SELECT s, p, p > s % 3 AND NOT (s % 4 = 0 AND p = 4) AS attended, k FROM x),
g AS (SELECT s, count_if(attended) AS n, max(p) FILTER (attended) - min(p) FILTER (attended) + 1 AS span, count_if(attended AND k % 41 = 0) AS other, count_if(NOT attended AND k % 3 = 0) AS unpadded FROM y GROUP BY s)
SELECT s AS sequence, CASE WHEN n = 0 THEN 'attended' WHEN n <> span THEN 'contiguous' WHEN other > 0 THEN 'ids' WHEN unpadded > 0 THEN 'padding' END AS problem FROM g""")
def token_rules(spark, sf):
    from pyspark.sql import Window

    k, s, p = F.col("o_orderkey"), F.col("sequence"), F.col("position")
    x = table(spark, sf, "orders").select(F.col("o_custkey").alias("sequence"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("position"), "o_orderkey")
    rows = x.withColumns({"attended": (p > s % 3) & ~((s % 4 == 0) & (p == 4)), "expected": k})
    rows = rows.withColumn("token", F.when(F.col("attended"), F.when(k % 41 == 0, -1).otherwise(k)).when(k % 3 == 0, k).otherwise(0))
    return a.token_problems(rows, 0)


@query("WITH o AS (SELECT o_custkey % 50 AS scene_id, o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 31 = 0 THEN 'scene' ELSE 'object' END AS level, CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS parent_id FROM orders) SELECT scene_id, CASE WHEN count(*) FILTER (level = 'scene' AND parent_id IS NULL) = 1 THEN min(id) FILTER (level = 'scene' AND parent_id IS NULL) END AS root FROM o GROUP BY 1")
def scene_roots(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("scene_id"), k.cast("string").alias("id"), F.when(k % 31 == 0, "scene").otherwise("object").alias("level"), F.when(k % 2 == 0, "x").alias("parent_id"))
    return a.scene_root(o)


@query("WITH s AS (SELECT o_custkey AS scene, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1), k AS (SELECT o_custkey AS scene, list(o_orderkey::VARCHAR) AS known FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) SELECT scene, array_to_string(list_filter(ids, lambda i: list_contains(coalesce(known, []), i)), ',') AS ids FROM s LEFT JOIN k USING (scene)")
def restored_selection(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("scene"), F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")
    saved = o.groupBy("scene").agg(F.transform(F.array_sort(F.collect_list("n")), lambda n: n.cast("string")).alias("ids"))
    return a.restored(saved, o.where("o_orderstatus <> 'O'"), "scene").select("scene", F.array_join("ids", ",").alias("ids"))


@query("""
WITH d AS (SELECT vec_id, label AS image, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS o, count(*) OVER (PARTITION BY label) AS n, embedding FROM embeddings),
picks AS (SELECT DISTINCT image, CASE WHEN n <= 5 THEN o ELSE floor(k * (n - 1)::DOUBLE / 4)::BIGINT END AS o FROM d, range(5) t(k)),
q AS (SELECT d.* FROM d JOIN picks USING (image, o)),
m AS (SELECT q.vec_id AS q, q.image, d.image AS near, d.vec_id AS t, list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS far FROM q, d),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, q ORDER BY far, near, t) AS r FROM m) WHERE r <= 12),
v AS (SELECT image, near, count(DISTINCT q) AS votes FROM b WHERE image <> near GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY votes DESC, near) AS r FROM v) WHERE r <= 3)
SELECT DISTINCT least(image, near)::BIGINT AS i, greatest(image, near)::BIGINT AS j FROM k""")
def image_retrieval(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("image"), F.col("vec_id").alias("place"), F.col("embedding").alias("vector"))
    return retrieval.retrieval_pairs(e, queries=5, most=3)


@query("SELECT a AS i, b AS j, n AS matches FROM (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY ALL) ORDER BY n DESC, a, b LIMIT 160")
def capped_pairs(spark, sf):
    pairs = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.count("*").alias("matches"))
    return retrieval.capped_pairs(pairs)


@query("SELECT l_orderkey AS point, n AS track_length FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, l_orderkey LIMIT 500")
def longest_tracks(spark, sf):
    points = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("point")).agg(F.count("*").alias("track_length"))
    return retrieval.longest_tracks(points, 500)


@query("SELECT doc_id AS image FROM documents ORDER BY doc_id DESC LIMIT 24")
def last_anchors(spark, sf):
    return retrieval.last_anchors(table(spark, sf, "documents").select(F.col("doc_id").alias("image")), "image")


@query("""
WITH e AS (SELECT o_orderkey % 700 AS inliers, o_orderkey % 3 = 0 AS valid FROM orders), r AS (SELECT count(*) AS n FROM documents WHERE lang = 'en')
SELECT count(*) AS images, count(DISTINCT text) AS distinct_images, count(*) - count(DISTINCT text) AS duplicates, round((SELECT n FROM r) / count(*), 6) AS connected_ratio, (SELECT max(inliers) FROM e WHERE valid)::BIGINT AS max_inliers FROM documents""")
def capture_summary(spark, sf):
    d = table(spark, sf, "documents")
    edges = table(spark, sf, "orders").select((F.col("o_orderkey") % 700).alias("inliers"), (F.col("o_orderkey") % 3 == 0).alias("valid"))
    found = retrieval.capture_summary(d.select(F.col("doc_id").alias("image"), F.sha2("text", 256).alias("sha256")), edges, d.where("lang = 'en'").select(F.col("doc_id").alias("node")))
    return found.withColumn("connected_ratio", F.round("connected_ratio", 6))


@query("""
WITH p AS (SELECT p_name AS name FROM part WHERE p_size > 5 EXCEPT SELECT p_name FROM part WHERE p_size < 15), o AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS o, count(*) OVER () AS n FROM p),
k AS (SELECT round_even(i * ((SELECT any_value(n) FROM o) - 1)::DOUBLE / 9, 0)::BIGINT AS o FROM range(10) t(i)) SELECT DISTINCT name FROM o JOIN k USING (o)""")
def extra_views(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("name"), "p_size")
    return retrieval.extra_views(p.where("p_size > 5"), p.where("p_size < 15"), 10)


@query("WITH l AS (SELECT DISTINCT p_type AS label FROM part), r AS (SELECT DISTINCT p_brand AS child, p_type AS parent FROM part WHERE p_size = 7) SELECT label, false AS added FROM l UNION SELECT child, true FROM r WHERE child NOT IN (SELECT label FROM l)")
def vocabulary(spark, sf):
    p = table(spark, sf, "part")
    known = p.where("p_size = 7").select(F.col("p_brand").alias("child"), F.col("p_type").alias("parent"), F.lit("part_of").alias("relation")).distinct()
    return relations.expand_vocabulary(p.select(F.col("p_type").alias("label")), known)


REGIONS = "(SELECT DISTINCT l_returnflag AS frame, 'r' || l_linenumber AS region, CASE l_linenumber WHEN 1 THEN 'wheel' WHEN 2 THEN 'car' WHEN 3 THEN 'coffee' WHEN 4 THEN 'coffee mug' WHEN 5 THEN 'car' ELSE 'tree' END AS label FROM lineitem)"
SHOWN = "(SELECT DISTINCT l_returnflag AS frame, 'r' || l_linenumber AS region, CASE WHEN l_linenumber IN (1, 3) THEN l_suppkey % 50 ELSE l_suppkey END AS pixel FROM lineitem WHERE l_linenumber <> 5 OR l_suppkey % 50 < 20)"


@query(f"""
WITH r AS (SELECT * FROM {REGIONS}), x AS (SELECT * FROM {SHOWN}), z AS (SELECT frame, region, count(*) AS size FROM x GROUP BY ALL), s AS (SELECT r.*, size FROM r JOIN z USING (frame, region)),
k AS (SELECT * FROM (VALUES ('wheel', 'car', 'part_of'), ('coffee', 'coffee mug', 'contents_of')) v(child, parent, relation)),
p AS (SELECT c.frame, c.region, w.region AS whole, k.relation, count(*) / c.size AS share FROM s c JOIN k ON k.child = c.label JOIN s w ON w.frame = c.frame AND w.label = k.parent JOIN x a ON a.frame = c.frame AND a.region = c.region JOIN x b ON b.frame = w.frame AND b.region = w.region AND b.pixel = a.pixel GROUP BY c.frame, c.region, w.region, k.relation, c.size),
u AS (SELECT frame, region, min(whole) AS parent, min(relation) AS relation FROM p WHERE share >= 0.9 GROUP BY ALL HAVING count(*) = 1)
SELECT frame, region, parent, relation FROM u UNION ALL SELECT frame, region, 'scene-observed-collection', 'member_of' FROM s WHERE label NOT IN (SELECT child FROM k)""")
def containing_parents(spark, sf):
    x, n = table(spark, sf, "lineitem"), F.col("l_linenumber")
    region = F.concat(F.lit("r"), n.cast("string"))
    label = F.when(n == 1, "wheel").when(n.isin(2, 5), "car").when(n == 3, "coffee").when(n == 4, "coffee mug").otherwise("tree")
    regions = x.select(F.col("l_returnflag").alias("frame"), region.alias("region"), label.alias("label")).distinct()
    pixel = F.when(n.isin(1, 3), F.col("l_suppkey") % 50).otherwise(F.col("l_suppkey"))
    shown = x.where((n != 5) | (F.col("l_suppkey") % 50 < 20)).select(F.col("l_returnflag").alias("frame"), region.alias("region"), pixel.alias("pixel")).distinct()
    return relations.containing_parents(regions, shown, relations.relation_table(spark))


TRACKED = "(SELECT DISTINCT strftime(l_shipdate, '%Y') AS frame, 't' || l_linenumber AS track, CASE WHEN l_linenumber < 4 THEN l_suppkey % 40 ELSE l_suppkey % (40 + 20 * (l_linenumber - 3)) END AS pixel FROM lineitem)"
DECLARED = "(SELECT DISTINCT strftime(l_shipdate, '%Y') AS frame, 't' || (l_linenumber % 3 + 1) AS child, 't' || (l_linenumber % 4 + 4) AS parent, CASE WHEN l_linenumber = 7 AND year(l_shipdate) > 1996 THEN 'member_of' ELSE 'part_of' END AS relation FROM lineitem)"


@query(f"""
WITH x AS (SELECT * FROM {TRACKED}), d AS (SELECT * FROM {DECLARED}), z AS (SELECT frame, track, count(*) AS area FROM x GROUP BY ALL),
p AS (SELECT child, parent, count(DISTINCT relation) AS kinds, min(relation) AS relation FROM d GROUP BY ALL),
m AS (SELECT p.child, p.parent, c.frame, c.area AS ca, w.area AS pa, (SELECT count(*) FROM x a JOIN x b USING (frame, pixel) WHERE a.frame = c.frame AND a.track = p.child AND b.track = p.parent) AS inside, EXISTS (FROM d WHERE d.frame = c.frame AND d.child = p.child AND d.parent = p.parent) AS said FROM p JOIN z c ON c.track = p.child JOIN z w ON w.track = p.parent AND w.frame = c.frame),
g AS (SELECT child, parent, count(*) AS valid, count_if(said AND inside / ca >= 0.9 AND pa / ca >= 1.5)::BIGINT AS support FROM m GROUP BY ALL)
SELECT child, parent, valid, support, CASE WHEN kinds = 1 THEN relation ELSE 'conflicting' END AS relation, kinds = 1 AND support >= 2 AND support * 2 > valid AS met FROM p JOIN g USING (child, parent)""")
def declared_containment(spark, sf):
    x, n = table(spark, sf, "lineitem"), F.col("l_linenumber")
    frame, name = F.date_format("l_shipdate", "yyyy"), lambda c: F.concat(F.lit("t"), c.cast("string"))
    pixel = F.when(n < 4, F.col("l_suppkey") % 40).otherwise(F.col("l_suppkey") % (40 + 20 * (n - 3)))
    pixels = x.select(frame.alias("frame"), name(n).alias("track"), pixel.alias("pixel")).distinct()
    relation = F.when((n == 7) & (F.year("l_shipdate") > 1996), "member_of").otherwise("part_of")
    declared = x.select(frame.alias("frame"), name(n % 3 + 1).alias("child"), name(n % 4 + 4).alias("parent"), relation.alias("relation")).distinct()
    return relations.declared_containment(declared, pixels.select("frame", "track"), pixels, ratio=1.5)


@query("WITH m AS (SELECT p_partkey % 40 AS child, unnest([lower(p_brand), (p_partkey % 25)::VARCHAR]) AS parent FROM part), n AS (SELECT n_nationkey::VARCHAR AS id, n_name AS label FROM nation) SELECT DISTINCT coalesce(c.label, child::VARCHAR) AS child, coalesce(p.label, parent) AS parent FROM m LEFT JOIN n c ON c.id = m.child::VARCHAR LEFT JOIN n p ON p.id = m.parent")
def explicit_edges(spark, sf):
    k = F.col("p_partkey")
    mapping = table(spark, sf, "part").select((k % 40).alias("child"), F.array("p_brand", (k % 25).cast("string")).alias("parents"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return relations.explicit_edges(mapping, names, t.normalize_ascii_label)


@query("WITH c AS (SELECT p_partkey AS i, list_distinct([p_brand, p_name, p_type]) AS names FROM part), x AS (SELECT i, unnest(names) AS label FROM c), w AS (SELECT DISTINCT p_type AS label FROM part UNION SELECT 'nothing') SELECT w.label, count(i) AS n, coalesce(sum(i), 0)::BIGINT AS total FROM w LEFT JOIN x USING (label) GROUP BY 1")
def label_columns(spark, sf):
    p = table(spark, sf, "part")
    classes = p.select(F.col("p_partkey").alias("index"), F.col("p_type").alias("display_label"), F.array("p_brand", "p_name").alias("source_labels"))
    wanted = p.select(F.col("p_type").alias("label")).union(spark.createDataFrame([("nothing",)], "label string"))
    found = relations.label_columns(classes, wanted)
    return found.select("label", F.size("columns").cast("long").alias("n"), F.aggregate("columns", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


RAW = "(SELECT DISTINCT o_custkey AS item, 'k' || o_orderkey % 5 AS class FROM orders)"
CLOSED = f"(SELECT item, class FROM {RAW} UNION SELECT item, 'k0' FROM {RAW} WHERE class IN ('k1', 'k2') UNION SELECT item, 'k9' FROM {RAW} WHERE class = 'k3')"


def _memberships(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_custkey").alias("item"), F.concat(F.lit("k"), (F.col("o_orderkey") % 5).cast("string")).alias("class")).distinct()
    above = raw.select("item", F.when(F.col("class").isin("k1", "k2"), "k0").when(F.col("class") == "k3", "k9").alias("class")).where("class IS NOT NULL")
    return raw, raw.union(above).distinct()


@query(f"WITH r AS (SELECT * FROM {RAW}), c AS (SELECT * FROM {CLOSED}) SELECT c.class, count_if(EXISTS (FROM r WHERE r.item = c.item AND r.class = c.class))::BIGINT AS raw, count(*) AS closed, count_if(item % 4 = 0)::BIGINT AS preview FROM c GROUP BY 1")
def class_counts(spark, sf):
    raw, closed = _memberships(spark, sf)
    return relations.class_counts(raw, closed, table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("item")))


@query(f"WITH r AS (SELECT * FROM {RAW}), c AS (SELECT * FROM {CLOSED}), a AS (SELECT * FROM c EXCEPT SELECT * FROM r) SELECT (SELECT count(*) FROM r) AS raw, (SELECT count(*) FROM c) AS closed, (SELECT count(*) FROM a) AS added, (SELECT count(DISTINCT item) FROM a) AS changed_items")
def membership_changes(spark, sf):
    return relations.membership_changes(*_memberships(spark, sf))


@query("WITH m AS (SELECT o_custkey AS item, lower(o_orderpriority) AS label, 0.9 * (o_orderkey % 9 / 8.0)::DOUBLE + 0.05 AS p FROM orders) SELECT item, label, round(greatest(0.05, max(p)), 6) AS p FROM m WHERE label IN ('1-urgent', '2-high') GROUP BY ALL")
def label_priors(spark, sf):
    members = table(spark, sf, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("class_label"), (F.col("o_orderkey") % 9 / 8.0).alias("member"))
    labels = spark.createDataFrame([("1-urgent",), ("2-high",), ("absent",)], "label string")
    return relations.label_priors(members, labels, t.normalize_ascii_label).withColumn("p", F.round("p", 6))


@query("SELECT DISTINCT p_name AS label FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 40)")
def empty_labels(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("label"), (F.col("p_size") > 40).alias("on"))
    return relations.empty_labels(p, p)


@query("WITH l AS (SELECT DISTINCT p_brand AS label FROM part), a AS (SELECT * FROM (VALUES ('Brand#11', 'red thing'), ('Brand#12', 'Red  Thing.'), ('Brand#13', '--'), ('nobody', 'x')) v(label, query)), f AS (SELECT coalesce(l.label, a.label) AS label, rtrim(coalesce(query, l.label), '.') AS query, l.label IS NOT NULL AS known FROM l FULL JOIN a ON l.label = a.label), i AS (SELECT *, lower(regexp_replace(query, '\\s+', ' ', 'g')) AS id FROM f) SELECT label, query, CASE WHEN NOT known THEN 'unknown_label' WHEN query = '--' THEN 'no_words' WHEN (SELECT count(*) FROM i j WHERE j.id = i.id AND j.known) > 1 THEN 'shared_phrase' END AS problem FROM i")
def detector_vocabulary(spark, sf):
    aliases = spark.createDataFrame([("Brand#11", "red thing"), ("Brand#12", "Red  Thing."), ("Brand#13", "--"), ("nobody", "x")], "label string, query string")
    return t.detector_vocabulary(table(spark, sf, "part").select(F.col("p_brand").alias("label")), aliases)


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN 0 END::INT AS begin, CASE WHEN p_partkey % 4 <> 0 THEN length(p_brand) END::INT AS end, CASE WHEN p_partkey % 4 <> 0 THEN length(p_brand) + 2 END::INT AS begin_2 FROM part")
def prompt_spans(spark, sf):
    p = table(spark, sf, "part")
    prompt = F.concat(F.upper("p_brand"), F.when(F.col("p_partkey") % 4 == 0, "; ").otherwise(". "), F.col("p_type"), F.lit(" ."))
    found = p.select("p_partkey", t.prompt_spans(prompt, F.array("p_brand", "p_type")).alias("s"))
    return found.select("p_partkey", F.get("s", F.lit(0))["begin"].alias("begin"), F.get("s", F.lit(0))["end"].alias("end"), F.get("s", F.lit(1))["begin"].alias("begin_2"))


@query("SELECT DISTINCT p_type AS text, CASE WHEN p_type = 'ECONOMY' THEN 'cheap' WHEN p_type LIKE 'PROMO%' THEN 'offer' || substr(p_type, 6) WHEN p_type LIKE '% %' THEN split_part(p_type, ' ', 2) || '/' || split_part(p_type, ' ', 1) ELSE p_type END AS shown FROM part")
def translated(spark, sf):
    texts = table(spark, sf, "part").select(F.col("p_type").alias("text")).distinct()
    dictionary = spark.createDataFrame([("ECONOMY", "cheap")], "text string, shown string")
    patterns = spark.createDataFrame([(r"(\S+) (\S+).*", "$2/$1", 2), (r"PROMO(.*)", "offer$1", 1)], "pattern string, template string, rank int")
    return t.translated(texts, dictionary, patterns)


#: Two cameras a unit apart see points at known places; a shift of the second ray moves the point.
@query("SELECT vec_id, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, 5 + embedding[3]::DOUBLE AS z FROM embeddings)")
def triangulated(spark, sf):
    e = table(spark, sf, "embeddings")
    x, y, z = (F.get("embedding", F.lit(i)).cast("double") + (5 if i == 2 else 0) for i in range(3))
    eye = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)])
    point = numeric.triangulated([x / z, y / z], [(x - 1) / z, y / z], eye, F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.0)))
    return e.select("vec_id", point.alias("p")).select("vec_id", *[(F.round(F.col("p")[i], 5) + 0.0).alias(c) for i, c in enumerate("xyz")])


@query("SELECT doc_id, round(64.0 / greatest(n_chars, 100), 9) AS scale, floor((64 - round_even(n_chars * (64.0::DOUBLE / greatest(n_chars, 100)), 0)) / 2)::BIGINT AS x0, floor((64 - round_even(100 * (64.0::DOUBLE / greatest(n_chars, 100)), 0)) / 2)::BIGINT AS y0 FROM documents")
def fit_rectangle(spark, sf):
    d = table(spark, sf, "documents")
    scale, x0, y0, _, _ = numeric.fit_rectangle(F.col("n_chars"), F.lit(100), 64)
    return d.select("doc_id", F.round(scale, 9).alias("scale"), x0.alias("x0"), y0.alias("y0"))


@query("SELECT p_partkey, p_size * 1.0::DOUBLE AS fx, p_size * 2.0::DOUBLE AS fy, CASE WHEN p_size > 20 THEN p_size::DOUBLE / 4 END AS safe, CASE WHEN p_size > 20 THEN least(greatest(p_size::DOUBLE / 4, 0), 10) ELSE 0.5 END::DOUBLE AS bounded FROM part")
def small_numbers(spark, sf):
    from ..operators.validation import clamp_or

    n = F.col("p_size").cast("double")
    fx, fy, _, _ = numeric.rescale_intrinsics([n * 2, n * 2, n, n], F.lit(0.5), F.lit(1.0))
    value = F.when(n > 20, n / 4).otherwise(float("nan"))
    return table(spark, sf, "part").select("p_partkey", fx.alias("fx"), fy.alias("fy"), numeric.json_safe(value).alias("safe"), clamp_or(value.cast("string"), 0.5, 0.0, 10.0).alias("bounded"))


@query("SELECT vec_id, CASE WHEN vec_id % 9 >= 6 THEN 'a' WHEN vec_id % 7 >= 4 THEN 'b' END AS problem FROM embeddings")
def pixel_maps(spark, sf):
    i = F.col("vec_id")
    pixels = F.create_map(F.lit("a"), F.array((i % 9).cast("double"), F.lit(1.0)), F.lit("b"), F.array(F.lit(0.0), (i % 7).cast("double")))
    size = F.create_map(F.lit("a"), F.lit(6.0), F.lit("b"), F.lit(4.0))
    return table(spark, sf, "embeddings").select("vec_id", numeric.pixel_map_problem(pixels, size, size).alias("problem"))


@query("SELECT p_partkey, p_size BETWEEN 10 AND 20 AS accepted, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'scene-' || p_size END AS name FROM (SELECT * FROM part) WHERE true")
def scene_names(spark, sf):
    n = F.col("p_size")
    name = F.when(n.between(10, 20), F.concat(F.lit("room "), n.cast("string"))).when(n < 10, F.concat(F.lit("a/"), n.cast("string"))).otherwise(F.when(n % 2 == 0, "NUL.txt").otherwise("dot."))
    return table(spark, sf, "part").select("p_partkey", t.valid_scene_name(name).alias("accepted"), F.when(n % 3 != 0, F.concat(F.lit("scene-"), n.cast("string"))).alias("name"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{\"n\": ' || doc_id || '}' END AS held, CASE WHEN n_chars % 2 = 0 THEN printf('%.1f%%', round(n_chars % 1000 / 10.0, 1)) ELSE '—' END AS share FROM documents")
def report_texts(spark, sf):
    i, n = F.col("doc_id"), F.col("n_chars")
    body = F.concat(F.lit('{"n": '), i.cast("string"), F.lit("}"))
    raw = F.when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("["), i.cast("string"), F.lit("]")))
    return table(spark, sf, "documents").select("doc_id", t.fenced_json(raw).alias("held"), t.percent(F.when(n % 2 == 0, n % 1000 / 1000.0)).alias("share"))


@query("SELECT d.doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) d WHERE o % 8 = 0 OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def held_out_and_annotated(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    marked = table(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("marked"))
    return ordering.every_nth(d.join(marked, "doc_id", "left"), ["doc_id"], also=F.col("marked")).select("doc_id")


@query("SELECT doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'changed' WHEN doc_id % 7 = 0 THEN 'missing' END AS problem FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 OR doc_id % 7 = 0 AND doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id % 35 = 0")
def review_images(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    path = F.concat(F.lit("/data/a/"), i.cast("string"))
    stored = v.image_identity(d.select(path.alias("path"), F.sha2("text", 256).alias("sha256")))
    now = v.image_identity(d.where(i % 7 != 0).select(path.alias("path"), F.sha2(F.when(i % 5 == 0, "x").otherwise(F.col("text")), 256).alias("sha256")))
    return v.review_problems(stored, now).withColumn("name", F.col("name").cast("long"))


@query("SELECT o_orderkey AS id, 'http://h/' || o_custkey || '.png' AS url FROM orders")
def public_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/srv/x/"), F.col("o_custkey").cast("string"), F.lit(".png")).alias("path"), F.lit("/srv").alias("folder"))
    return v.public_columns(o, F.lit("http://h"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'right_alone' WHEN vec_id % 3 = 0 THEN 'left_alone' ELSE 'value' END AS problem FROM embeddings WHERE (vec_id % 5 = 0) <> (vec_id % 3 = 0) OR (vec_id % 5 <> 0 AND vec_id % 3 <> 0 AND vec_id % 11 = 0)")
def pixel_proof(spark, sf):
    e, i = table(spark, sf, "embeddings"), F.col("vec_id")
    return v.pixel_differences(e.where(i % 5 != 0).select(i, F.col("label").alias("value")), e.where(i % 3 != 0).select(i, F.when(i % 11 != 0, F.col("label")).alias("value")), "vec_id")


@query("SELECT vec_id, round(embedding[1]::DOUBLE - 1, 6) + 0.0 AS x, round(embedding[3]::DOUBLE - 3, 6) + 0.0 AS y, round(-(embedding[2]::DOUBLE - 2), 6) + 0.0 AS z FROM embeddings")
def world_points(spark, sf):
    e = table(spark, sf, "embeddings")
    point = F.array(*[F.get("embedding", F.lit(i)).cast("double") for i in range(3)])
    turn = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in ((1, 0, 0), (0, 0, -1), (0, 1, 0))])
    placed = e.select("vec_id", v.to_world(point, turn, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("p"))
    return placed.select("vec_id", *[(F.round(F.col("p")[i], 6) + 0.0).alias(c) for i, c in enumerate("xyz")])


@query("""
WITH k AS (SELECT o_orderkey AS keypoint, o_custkey % 10 AS image, (o_orderkey % 97) * 1.5::DOUBLE AS x, (o_orderkey % 89) * 1.5::DOUBLE AS y FROM orders), t AS (SELECT c_custkey AS point, c_custkey % 10 AS image, (c_custkey % 53) * 2.7::DOUBLE AS x, (c_custkey % 47) * 2.9::DOUBLE AS y FROM customer),
b AS (SELECT k.image, keypoint, point, sqrt((k.x - t.x) * (k.x - t.x) + (k.y - t.y) * (k.y - t.y)) AS d FROM k JOIN t ON k.image = t.image AND abs(k.x - t.x) <= 2 AND abs(k.y - t.y) <= 2),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, keypoint ORDER BY d, point) AS r FROM b WHERE d <= 2) WHERE r = 1)
SELECT image, keypoint, point, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY image, point ORDER BY d, keypoint) AS q FROM n) WHERE q <= 4""")
def assigned_keypoints(spark, sf):
    k = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("image"), F.col("o_orderkey").alias("keypoint"), (F.col("o_orderkey") % 97 * 1.5).alias("x"), (F.col("o_orderkey") % 89 * 1.5).alias("y"))
    t_ = table(spark, sf, "customer").select((F.col("c_custkey") % 10).alias("image"), F.col("c_custkey").alias("point"), (F.col("c_custkey") % 53 * 2.7).alias("x"), (F.col("c_custkey") % 47 * 2.9).alias("y"))
    return v.assign_keypoints(k, t_).withColumn("distance", F.round("distance", 6))


@query("SELECT l_orderkey AS pixel, CASE WHEN l_linenumber < 3 THEN 'a' ELSE 'b' END AS label, max(l_discount)::DOUBLE AS score, max(l_discount) >= 0.05 AS on FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL")
def category_masks(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pixel"), F.col("l_linenumber").cast("long").alias("class"), F.col("l_discount").cast("double").alias("score"))
    columns = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 5)], "label string, class long")
    return v.category_masks(x, columns, "pixel", least=0.05)


@query("SELECT l_orderkey * 10 + l_linenumber AS point_id, max((l_partkey % 3 = 0)::INT) OVER (PARTITION BY l_orderkey * 10 + l_linenumber)::DOUBLE AS member FROM lineitem")
def member_samples(spark, sf):
    x = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), "l_partkey")
    return v.member_samples(x.select("point_id"), x.where("l_partkey % 3 = 0"))


@query("SELECT o_orderpriority AS pass, count(*) AS images, sum(o_orderkey % 100)::BIGINT AS total, max(o_orderkey % 100) AS slowest, sum(o_custkey % 4)::BIGINT AS masks FROM orders GROUP BY 1")
def pass_latency(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("pass"), (F.col("o_orderkey") % 100).alias("seconds"), (F.col("o_custkey") % 4).alias("masks"))
    return v.pass_latency(o)


@query("""
WITH o AS (SELECT c_custkey AS source_index, row_number() OVER (ORDER BY c_custkey) - 1 AS o, count(*) OVER () AS n FROM customer), k AS (SELECT CASE WHEN i = 39 THEN (SELECT any_value(n) FROM o) - 1 ELSE floor(i * (((SELECT any_value(n) FROM o) - 1)::DOUBLE / 39))::BIGINT END AS o FROM range(40) t(i)),
c AS (SELECT o_custkey AS source_index, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS classes FROM orders GROUP BY 1)
SELECT source_index, coalesce(classes, '') AS classes FROM o JOIN k USING (o) LEFT JOIN c USING (source_index)""")
def preview_classes(spark, sf):
    points = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_index"))
    members = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_index"), F.col("o_orderpriority").alias("class"))
    return v.preview_with_classes(points, members, 40).select("source_index", F.array_join("classes", ",").alias("classes"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'size' WHEN greatest((p_size % 10 - 0.5) / 100, (4 - 0.5) / 80) > least((p_size % 10 + 0.5) / 100, (4 + 0.5) / 80) THEN 'aspect' END AS problem FROM part")
def mask_aspects(spark, sf):
    return table(spark, sf, "part").select("p_partkey", v.full_frame_problem(F.col("p_size") % 10, F.lit(4), F.lit(100), F.lit(80)).alias("problem"))


@query("SELECT o_orderkey AS mask, CASE WHEN o_orderkey % 5 = 0 THEN 'label' WHEN o_orderpriority = '1-URGENT' THEN 'level' WHEN o_orderkey % 11 > 9 THEN 'confidence' WHEN o_orderkey % 3 = 0 THEN 'hash' END AS rule FROM orders WHERE o_orderkey % 5 = 0 OR o_orderpriority = '1-URGENT' OR o_orderkey % 11 > 9 OR o_orderkey % 3 = 0")
def mask_upload(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("mask"), F.when(k % 5 == 0, " ").otherwise("chair").alias("label"), F.when(F.col("o_orderpriority") == "1-URGENT", "none").otherwise("part").alias("level"), (k % 11 / 9.0).alias("confidence"), F.when(k % 3 == 0, "ff").when(k % 3 == 1, F.sha2("o_orderstatus", 256)).alias("source_image_sha256"))
    order = F.create_map(*[F.lit(x) for i, n in enumerate(validation.mask_rules()) for x in (n, i)])
    found = validation.broken(rows, validation.mask_rules(), "mask").groupBy("mask").agg(F.min_by("rule", order[F.col("rule")]).alias("rule"))
    return found


@query("""
WITH i AS (SELECT vec_id AS name, 640 + vec_id % 300 AS width, 480 + vec_id % 700 AS height, CASE WHEN label > 2 THEN label * 9.0 END AS f35 FROM embeddings),
k AS (SELECT *, CASE WHEN f35 IS NULL THEN 0.9 * greatest(width, height) ELSE f35 * sqrt(width * width + height * height) / sqrt(1872) END AS focal FROM i)
SELECT name AS image_name, CASE WHEN name % 9 = 0 THEN 'user_calibrated' WHEN f35 IS NULL THEN 'heuristic' ELSE 'exif_35mm_approximate' END AS intrinsics_source,
round(CASE WHEN name % 9 = 0 THEN 500 ELSE focal END, 6)::DOUBLE AS fx, round(CASE WHEN name % 9 = 0 THEN 1 ELSE width / 2 END, 6)::DOUBLE AS cx, round(CASE WHEN name % 9 = 0 THEN 2 ELSE height / 2 END, 6)::DOUBLE AS cy FROM k""")
def camera_templates(spark, sf):
    i = F.col("vec_id")
    rows = table(spark, sf, "embeddings").select(i.alias("name"), (640 + i % 300).alias("width"), (480 + i % 700).alias("height"), F.when(F.col("label") > 2, F.col("label") * 9.0).alias("focal_35mm"), F.lit("").alias("source_sha256"))
    row = lambda *x: F.array(*map(F.lit, x))
    known = rows.where("name % 9 = 0").select("name", F.array(row(500.0, 0.0, 1.0), row(0.0, 500.0, 2.0), row(0.0, 0.0, 1.0)).alias("K"))
    out = evidence.camera_template(evidence.with_intrinsics(rows), known)
    return out.select("image_name", "intrinsics_source", *[F.round(F.col("K")[y][x], 6).alias(n) for n, y, x in (("fx", 0, 0), ("cx", 0, 2), ("cy", 1, 2))])


@query("""
WITH i AS (SELECT source AS project, 'd' || (doc_id - (doc_id % 17 = 16)::INT) AS name, sha256(text) AS sha256, doc_id FROM documents),
s AS (SELECT source AS project, 'd' || doc_id AS name, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS have, doc_id % 13 = 0 AS resized FROM documents WHERE doc_id % 11 <> 0),
c AS (SELECT *, count(*) OVER (PARTITION BY project, name) AS times FROM i),
p AS (SELECT DISTINCT c.project, c.name, CASE WHEN times > 1 THEN 'repeated' WHEN s.name IS NULL THEN 'missing' WHEN NOT coalesce(have = sha256, false) THEN 'changed' WHEN resized THEN 'size' END AS problem FROM c LEFT JOIN s ON s.project = c.project AND s.name = c.name)
SELECT project, name, problem FROM p WHERE problem IS NOT NULL
UNION ALL SELECT project, NULL, 'count' FROM i GROUP BY project HAVING count(*) NOT BETWEEN 2 AND 300""")
def project_reload(spark, sf):
    """Sources as projects: some of their documents came back changed, resized or not at all, and some names are given twice."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(F.col("source").alias("project"), "doc_id", "text")
    name = lambda n: F.concat(F.lit("d"), n.cast("string")).alias("name")
    images = d.select("project", name(i - (i % 17 == 16).cast("int")), F.sha2("text", 256).alias("sha256"), F.lit(4).alias("width"), F.lit(3).alias("height"))
    text = F.when(i % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    stored = d.where(i % 11 != 0).select("project", name(i), F.sha2(text, 256).alias("sha256"), F.when(i % 13 == 0, 5).otherwise(4).alias("width"), F.lit(3).alias("height"))
    return ledger.reload_problems(images, stored)


@query("""
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE + 2 AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d, embedding[5]::DOUBLE + 2 AS e, embedding[6]::DOUBLE AS f, embedding[7]::DOUBLE AS g, embedding[8]::DOUBLE AS h, embedding[9]::DOUBLE + 2 AS i, embedding[10]::DOUBLE AS x, embedding[11]::DOUBLE AS y, embedding[12]::DOUBLE AS z FROM embeddings),
w AS (SELECT *, a * (e * i - f * h) + b * (f * g - d * i) + c * (d * h - e * g) AS det, vec_id % 4 AS form FROM v)
SELECT vec_id, CASE WHEN form = 3 THEN 'pose' WHEN vec_id % 10 = 9 THEN 'intrinsics' END AS problem,
round(CASE form WHEN 0 THEN (e * i - f * h) / det WHEN 3 THEN NULL ELSE a END, 6) AS first,
round(CASE form WHEN 0 THEN -((f * g - d * i) / det * x + (a * i - c * g) / det * y + (c * d - a * f) / det * z) WHEN 3 THEN NULL ELSE y END, 6) AS second_move,
CASE WHEN vec_id % 10 = 9 THEN -1 WHEN vec_id % 2 = 0 THEN 7 ELSE 5 END::DOUBLE AS fy, CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 3 END::DOUBLE AS cx FROM w""")
def camera_forms(spark, sf):
    i = F.col("vec_id")
    at = lambda n, plus=0: F.get("embedding", F.lit(n)).cast("double") + float(plus)
    turn = [at(n, 2 * (n % 4 == 0)) for n in range(9)]
    whole = F.array(*turn[:3], at(9), *turn[3:6], at(10), *turn[6:], at(11), *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        F.when(i % 4 == 0, whole).alias("camera_to_world"),
        F.when(i % 4 == 1, whole).alias("world_to_camera"),
        F.when(i % 4 == 2, F.array(*turn)).alias("R"),
        F.array(at(9), at(10), at(11)).alias("t"),
        F.when(i % 2 == 0, F.array(*[F.lit(float(x)) for x in (6, 0, 4, 0, 7, 2, 0, 0, 1)])).alias("K"),
        F.when(i % 10 == 9, -1.0).otherwise(5.0).alias("fx"),
        F.lit(3.0).alias("cx"),
        F.lit(2.0).alias("cy"),
    )
    out = cameras.camera_form(rows)
    return out.select("vec_id", "problem", F.round(F.col("matrix")[0], 6).alias("first"), F.round(F.col("matrix")[7], 6).alias("second_move"), F.col("focal")[1].alias("fy"), F.col("centre")[0].alias("cx"))
