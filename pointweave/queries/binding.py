"""Guarded joins, audits, manifests, splits and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binding as b
from ..operators import metrics
from .common import collector, table

QUERIES, query = collector()

#: Every document is a camera; pairs of neighbours share a file name, every ninth another's path too.
FILE = "(doc_id - doc_id % 3 // 2) || '.png'"
CAMERAS = f"(SELECT doc_id AS camera, CASE WHEN doc_id % 9 = 2 THEN 'all' ELSE source END || '/' || {FILE} AS path FROM documents)"
MASKS = f"(SELECT doc_id AS mask, CASE WHEN doc_id % 2 = 0 THEN source || '/' || {FILE} ELSE 'copy/' || {FILE} END AS ref FROM documents)"


def _paths(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat((F.col("doc_id") - F.floor(F.col("doc_id") % 3 / 2)).cast("string"), F.lit(".png"))
    cameras = d.select(F.col("doc_id").alias("camera"), F.concat_ws("/", F.when(F.col("doc_id") % 9 == 2, "all").otherwise(F.col("source")), name).alias("path"))
    masks = d.select(F.col("doc_id").alias("mask"), F.concat_ws("/", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("copy"), name).alias("ref"))
    return cameras, masks


@query(f"""
WITH c AS (SELECT * FROM {CAMERAS}), m AS (SELECT * FROM {MASKS}),
e AS (SELECT path, any_value(camera) AS camera FROM c GROUP BY path HAVING count(*) = 1),
n AS (SELECT split_part(path, '/', 2) AS name, any_value(camera) AS camera FROM c GROUP BY 1 HAVING count(*) = 1)
SELECT mask, coalesce(e.camera, n.camera) AS camera FROM m LEFT JOIN e ON e.path = m.ref LEFT JOIN n ON n.name = split_part(m.ref, '/', 2)""")
def mask_camera_join(spark, sf):
    cameras, masks = _paths(spark, sf)
    return b.by_path_or_name(masks, cameras).select("mask", "camera")


@query(f"""
WITH c AS (SELECT DISTINCT path FROM {CAMERAS}), m AS (SELECT mask, CASE WHEN mask % 5 = 0 THEN split_part(ref, '/', 2) ELSE ref END AS ref FROM {MASKS}),
n AS (SELECT split_part(path, '/', 2) AS name, any_value(path) AS path FROM c GROUP BY 1 HAVING count(*) = 1)
SELECT mask, coalesce(c.path, CASE WHEN ref NOT LIKE '%/%' THEN n.path END) AS image FROM m LEFT JOIN c ON c.path = ref LEFT JOIN n ON n.name = ref""")
def reference_to_image(spark, sf):
    cameras, masks = _paths(spark, sf)
    refs = masks.withColumn("ref", F.when(F.col("mask") % 5 == 0, b.basename(F.col("ref"))).otherwise(F.col("ref")))
    return b.to_one_image(refs, cameras.select("path").distinct()).select("mask", "image")


@query("SELECT d.doc_id AS source_index, l.quality, l.toxic, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN labels l USING (doc_id)")
def sidecar_bind(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source_index"))
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "source_index")
    same = {"count": 3, "sha256": "a" * 64}
    return b.bind_sidecar(docs, labels, same, same)


@query("SELECT d.doc_id AS source_index, quality FROM documents d JOIN labels l USING (doc_id)")
def lineage_bind(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source_index"))
    return b.bind_total(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("source_index"), "quality"))[0]


@query("SELECT doc_id AS source_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lineage_missing(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source_index"))
    return b.bind_total(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("source_index"), "quality"))[1]


@query("""
WITH o AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 1)
SELECT coalesce(o.doc_id, n.doc_id) AS source_index, CASE WHEN n.doc_id IS NULL THEN 'dropped' WHEN o.doc_id IS NULL THEN 'fresh' ELSE 'carried' END AS outcome FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def state_migrate(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("source_index"))
    return b.migrate_state(d.where("source_index % 3 <> 0"), d.where("source_index % 4 <> 1"))


@query("""
WITH o AS (SELECT p_brand || '-' || p_type AS label, any_value(p_partkey) AS old FROM part WHERE p_size < 8 GROUP BY 1 HAVING count(*) = 1), n AS (SELECT p_brand || '-' || p_type AS label, any_value(p_partkey) AS new FROM part WHERE p_size > 40 GROUP BY 1 HAVING count(*) = 1)
SELECT label, new, old FROM n JOIN o USING (label)""")
def category_migrate(spark, sf):
    p = table(spark, sf, "part").withColumn("label", F.concat_ws("-", "p_brand", "p_type"))
    old = p.where("p_size < 8").select("label", F.col("p_partkey").alias("old"))
    new = p.where("p_size > 40").select("label", F.col("p_partkey").alias("new"))
    return b.migrate_by_label(old, new).select("label", "new", "old")


@query("""
WITH d AS (SELECT doc_id AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 <> 3), a AS (SELECT doc_id AS path, CASE WHEN doc_id % 10 = 7 THEN sha256(text || '!') ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id % 10 <> 5)
SELECT coalesce(d.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN d.path IS NULL THEN 'undeclared' ELSE 'changed' END AS problem FROM d FULL JOIN a ON a.path = d.path WHERE a.path IS NULL OR d.path IS NULL OR a.sha256 <> d.sha256""")
def hash_manifest_diff(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "path")
    declared = d.where("path % 10 <> 3").select("path", F.sha2("text", 256).alias("sha256"))
    actual = d.where("path % 10 <> 5").select("path", F.sha2(F.when(F.col("path") % 10 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return b.manifest_diff(declared, actual, "path", "sha256")


@query("""
(SELECT *, 'left' AS side FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 1))
UNION ALL (SELECT *, 'right' AS side FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 1 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 0))""")
def bag_difference(spark, sf):
    d = table(spark, sf, "documents")
    return b.set_difference(d.where("doc_id % 2 = 0").select("lang", "source"), d.where("doc_id % 2 = 1").select("lang", "source"))


@query("""
WITH s AS (SELECT doc_id::VARCHAR AS name, sha256(text) AS sha, CASE WHEN doc_id % 8 = 0 THEN 'test' ELSE 'train' END AS part FROM documents),
u AS (SELECT 'name' AS key, name AS value, part FROM s UNION ALL SELECT 'sha', sha, part FROM s)
SELECT key, value, string_agg(DISTINCT part, ',' ORDER BY part) AS parts FROM u GROUP BY key, value HAVING count(DISTINCT part) > 1""")
def split_hygiene(spark, sf):
    d = table(spark, sf, "documents")
    split = d.select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha"), F.when(F.col("doc_id") % 8 == 0, "test").otherwise("train").alias("part"))
    return b.split_overlap(split, "name", "sha")


@query("SELECT d.doc_id AS name, d.doc_id % 8 <> 0 AND l.doc_id IS NOT NULL AS selected, CASE WHEN d.doc_id % 8 = 0 THEN 'held_out' WHEN l.doc_id IS NULL THEN 'not_allowed' ELSE 'selected' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def view_selection(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("name"))
    return b.select_views(d, table(spark, sf, "labels").select(F.col("doc_id").alias("name")), d.where("name % 8 = 0"))


EDGES = "(SELECT DISTINCT p_brand AS child, p_type AS parent, CASE WHEN p_size % 2 = 0 THEN 'part_of' ELSE 'member_of' END AS relation FROM part WHERE {w})"


@query(f"""
WITH a AS (SELECT * FROM {EDGES.format(w='p_size < 20')}), o AS (SELECT * FROM {EDGES.format(w='p_size BETWEEN 10 AND 40')})
SELECT a.*, EXISTS (FROM o WHERE o.child = a.child AND o.parent = a.parent AND o.relation = a.relation) AS accepted,
CASE WHEN EXISTS (FROM o WHERE o.child = a.child AND o.parent = a.parent AND o.relation = a.relation) THEN NULL WHEN EXISTS (FROM o WHERE o.child = a.child AND o.parent = a.parent) THEN 'relation_differs' ELSE 'unobserved' END AS reason FROM a""")
def approved_edges(spark, sf):
    p = table(spark, sf, "part")
    edges = lambda w: p.where(w).select(F.col("p_brand").alias("child"), F.col("p_type").alias("parent"), F.when(F.col("p_size") % 2 == 0, "part_of").otherwise("member_of").alias("relation")).distinct()
    return b.approved_edges(edges("p_size < 20"), edges("p_size BETWEEN 10 AND 40"), "child", "parent")


@query("SELECT doc_id, source, 'old' AS origin FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT doc_id, 'label', 'new' FROM labels WHERE quality = 0")
def replace_records(spark, sf):
    old = table(spark, sf, "documents").select("doc_id", "source", F.lit("old").alias("origin"))
    new = table(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit("label").alias("source"), F.lit("new").alias("origin"))
    return b.replace_by_key(old, new, "doc_id")


@query("SELECT doc_id FROM documents WHERE lower(lang) IN ('fr', 'src3') OR lower(source) IN ('fr', 'src3')")
def priority_masks(spark, sf):
    wanted = spark.createDataFrame([("FR",), ("Src3",)], "value string")
    return b.any_key(table(spark, sf, "documents").select("doc_id", "lang", "source"), wanted, "lang", "source").select("doc_id")


@query("SELECT DISTINCT p_name AS label FROM part WHERE p_size < 10 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45)")
def uncovered_labels(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_name", "label")
    return b.uncovered(p.where("p_size < 10"), p.where("p_size > 45"))


PAIRS = "(SELECT DISTINCT l_orderkey AS a, l_partkey * 1000000 + l_suppkey AS b FROM lineitem)"


@query(f"WITH p AS (SELECT * FROM {PAIRS}), c AS (SELECT *, count(*) OVER (PARTITION BY a) AS x, count(*) OVER (PARTITION BY b) AS y FROM p) SELECT a, b FROM c WHERE x = 1 AND y = 1")
def one_to_one_pairs(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("b"))
    return b.one_to_one(p)


@query("""
WITH x AS (SELECT o_custkey AS view, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), y AS (SELECT o_custkey AS view, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(x.view, y.view) AS view, y.n - x.n AS n_delta, round(y.top - x.top, 4) AS top_delta, x.view IS NOT NULL AND y.view IS NOT NULL AS matched FROM x FULL JOIN y ON x.view = y.view""")
def paired_views(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda k: o.where(f"o_orderkey % 2 = {k}").groupBy(F.col("o_custkey").alias("view")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return b.paired_delta(side(0), side(1), ["view"], "n", "top").withColumn("top_delta", F.round("top_delta", 4))


@query("SELECT d.doc_id, coalesce(l.quality * 0.5, 0.05)::DOUBLE AS p FROM documents d LEFT JOIN labels l USING (doc_id)")
def prior_join(spark, sf):
    prior = table(spark, sf, "labels").select("doc_id", (F.col("quality") * F.lit(0.5)).alias("p"))
    return b.with_prior(table(spark, sf, "documents").select("doc_id"), prior, ["doc_id"])


@query("SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 <> 0 THEN d.n_chars END, s.n_chars + 1) AS n_chars, d.doc_id % 3 = 0 AND s.doc_id IS NOT NULL AS changed FROM documents d LEFT JOIN (SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0) s USING (doc_id)")
def metadata_backfill(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("n_chars"))
    return b.backfill(rows, d.where("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") + 1).alias("n_chars")), "doc_id", "n_chars")


@query("""
WITH r AS (SELECT doc_id AS position, CASE WHEN doc_id % 13 <> 0 THEN 'r' || doc_id % 250 END AS id, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE source END AS title FROM documents),
v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS k FROM r WHERE id IS NOT NULL AND length(trim(id)) > 0 AND length(trim(title)) > 0)
SELECT id, title, position FROM v WHERE k = 1 ORDER BY position LIMIT 100""")
def result_registry(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    rows = d.select(i.alias("position"), F.when(i % 13 != 0, F.concat(F.lit("r"), (i % 250).cast("string"))).alias("id"), F.when(i % 17 == 0, " ").otherwise(F.col("source")).alias("title"))
    return b.registry(rows).select("id", "title", "position")


@query("SELECT s AS source, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = k) AS n FROM (VALUES (0, 'unknown'), (1, 'observed'), (2, 'inferred')) t(k, s)")
def lineage_counts(spark, sf):
    return b.lineage_counts(table(spark, sf, "orders").select((F.col("o_orderkey") % 2).alias("code")))


@query("SELECT count(*) AS documents, count(DISTINCT sha256(text)) AS unique_documents, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents")
def dedupe_manifest(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("h"))
    return d.agg(F.count("*").alias("documents"), F.count_distinct("h").alias("unique_documents")).withColumn("duplicates", F.col("documents") - F.col("unique_documents"))


@query("SELECT doc_id, text_hash FROM (SELECT doc_id, sha256(text) AS text_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_occurrences(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return b.first_by(d, ["text_hash"], "doc_id")


@query("SELECT doc_id, p AS provenance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE p WHEN 'manual' THEN 1 WHEN 'label' THEN 2 ELSE 3 END) AS r FROM (SELECT doc_id, 'detector' AS p FROM documents UNION ALL SELECT doc_id, 'label' FROM labels UNION ALL SELECT doc_id, 'manual' FROM labels WHERE toxic = 1)) WHERE r = 1")
def provenance_precedence(spark, sf):
    labels = table(spark, sf, "labels")
    rows = table(spark, sf, "documents").select("doc_id", F.lit("detector").alias("provenance")).union(labels.select("doc_id", F.lit("label"))).union(labels.where("toxic = 1").select("doc_id", F.lit("manual")))
    return b.prefer(rows, ["doc_id"], "provenance", ["manual", "label", "detector"], "doc_id")


@query()
def content_fingerprint(spark, sf):
    return metrics.fingerprint(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT scene, mode, round(avg(d), 5) AS mean_delta, count_if(d > 0)::BIGINT AS positive, count(DISTINCT h) = 1 AS one_hash FROM (SELECT l_returnflag AS scene, l_linestatus AS mode, l_extendedprice - 30 * l_quantity * l_linenumber AS d, l_linestatus AS h FROM lineitem) GROUP BY ALL")
def delta_summary(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene"), F.col("l_linestatus").alias("mode"), (F.col("l_extendedprice") - 30 * F.col("l_quantity") * F.col("l_linenumber")).alias("d"))
    out = x.groupBy("scene", "mode").agg(F.avg("d").alias("mean_delta"), F.count_if(F.col("d") > 0).alias("positive"), (F.count_distinct("mode") == 1).alias("one_hash"))
    return out.withColumn("mean_delta", F.round("mean_delta", 5))


