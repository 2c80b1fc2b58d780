"""Commands, selections, visibility and undo."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import editing as e
from ..operators import graph
from .common import TREE, collector, table, tree

QUERIES, query = collector()

#: Requests and the actions that a reader expects.
REQUESTS = ["隐藏所有椅子", "show all chairs", "只显示椅子", "取消加强椅子", "please delete the old table", "zoom in on lamp", "undo", "find red sofa", "restore all", "prioritize window", "a plain label"]
EXPECTED = ["hide", "show", "isolate", "priority", "delete", "focus", "undo", "search", "show", "priority", "search"]

OBJECTS = f"(SELECT id, parent_id, label, level, CASE WHEN level = 'object' THEN ['alias ' || lower(label)] ELSE [] END AS aliases, true AS visible, false AS deleted, id LIKE 'c%' AND length(id) = 3 AS priority FROM {TREE})"
PICKED = "WITH RECURSIVE o AS (SELECT * FROM {o}), s AS (SELECT id FROM o WHERE {w} UNION SELECT o.id FROM o JOIN s ON o.parent_id = s.id)"
ALIASED = "len(list_filter(list_concat([lower(label), lower(id)], aliases), lambda n: {c})) > 0"


def _objects(spark, sf):
    aliases = F.when(F.col("level") == "object", F.array(F.concat(F.lit("alias "), F.lower("label")))).otherwise(F.array().cast("array<string>"))
    flags = [F.lit(True).alias("visible"), F.lit(False).alias("deleted"), (F.startswith("id", F.lit("c")) & (F.length("id") == 3)).alias("priority")]
    return tree(spark, sf).select("id", "parent_id", "label", "level", aliases.alias("aliases"), *flags)


def _after(spark, sf, text):
    command = e.Command.parse(text)
    objects = _objects(spark, sf)
    return e.apply_to_objects(objects, e.resolve(objects, command), command).select("id", "visible", "deleted", "priority")


#: The queries that a reader expects of the same requests.
NAMED_IN = ["椅子", "chairs", "椅子", "椅子", "old table", "lamp", "", "red sofa", "all", "window", "a plain label"]


@query("SELECT request, action, name AS query, action <> 'priority' OR request NOT LIKE '%取消%' AS priority FROM (VALUES " + ", ".join(f"('{q}', '{a}', '{n}')" for q, a, n in zip(REQUESTS, EXPECTED, NAMED_IN)) + ") v(request, action, name)")
def command_parse(spark, sf):
    asked = spark.createDataFrame([(q,) for q in REQUESTS], "request string")
    return asked.select("request", t.command(F.col("request")).alias("c")).select("request", "c.action", "c.query", "c.priority")


#: Priority requests and the labels that a reader expects of them, in order.
WANTED = {"优先重建小熊、熊耳朵,杯子": ["stuffed bear", "bear ear", "cup"], "重点：椅子; Red  Lamp。": ["chair", "red lamp"], "熊, 小熊, bear": ["stuffed bear", "bear"], " ,,": []}


@query("SELECT request, unnest(labels) AS label, generate_subscripts(labels, 1) AS place FROM (VALUES " + ", ".join(f"('{q}', {w}::VARCHAR[])" for q, w in WANTED.items()) + ") v(request, labels)")
def request_labels(spark, sf):
    asked = spark.createDataFrame([(q,) for q in WANTED], "request string")
    named = asked.select("request", F.posexplode(t.request_labels(F.col("request"))))
    return named.select("request", "col.label", (F.col("pos") + 1).cast("long").alias("place"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{a}')" for q, a in zip(REQUESTS, EXPECTED)) + ") v(request, action)")
def command_action(spark, sf):
    asked = spark.createDataFrame([(q,) for q in REQUESTS], "request string")
    return asked.select("request", t.command_action(F.col("request")).alias("action"))


NAMED = ALIASED.format(c="contains(n, 'nation_3') OR contains(n, 'customer#000000012')")


def _named_query():
    return "nation_3, customer#000000012"


@query(PICKED.format(o=OBJECTS, w=NAMED) + " SELECT id AS node FROM s")
def command_select(spark, sf):
    return e.resolve(_objects(spark, sf), e.Command("search", _named_query()))


@query(PICKED.format(o=OBJECTS, w=NAMED) + " SELECT o.id, s.id IS NULL AS visible, deleted, priority FROM o LEFT JOIN s ON s.id = o.id")
def command_hide(spark, sf):
    return _after(spark, sf, f"hide {_named_query()}")


@query(PICKED.format(o=OBJECTS, w=NAMED) + " SELECT o.id, s.id IS NULL AS visible, s.id IS NOT NULL AS deleted, priority FROM o LEFT JOIN s ON s.id = o.id")
def command_delete(spark, sf):
    return _after(spark, sf, f"delete {_named_query()}")


@query(PICKED.format(o=OBJECTS, w=NAMED) + " SELECT o.id, s.id IS NOT NULL OR level = 'scene' AS visible, deleted, priority FROM o LEFT JOIN s ON s.id = o.id")
def command_isolate(spark, sf):
    return _after(spark, sf, f"isolate {_named_query()}")


@query(PICKED.format(o=OBJECTS, w="true") + " SELECT o.id, true AS visible, false AS deleted, priority FROM o")
def command_show_all(spark, sf):
    return _after(spark, sf, "show all")


@query(PICKED.format(o=OBJECTS, w=NAMED) + " SELECT o.id, visible, deleted, s.id IS NULL AND priority AS priority FROM o LEFT JOIN s ON s.id = o.id")
def command_deprioritize(spark, sf):
    return _after(spark, sf, f"deprioritize {_named_query()}")


@query(f"""
WITH RECURSIVE o AS (SELECT * FROM {OBJECTS}), h AS (SELECT id, parent_id FROM o WHERE len(list_filter(list_concat([lower(label)], aliases), lambda n: contains(n, '00001'))) > 0),
up AS (SELECT id, parent_id FROM h UNION SELECT o.id, o.parent_id FROM o JOIN up ON o.id = up.parent_id)
SELECT DISTINCT id AS node FROM up""")
def catalog_search(spark, sf):
    return e.search_with_ancestors(_objects(spark, sf), "00001")


MEMBER = "(SELECT o_orderkey AS item, 'c' || o_custkey AS node FROM orders WHERE o_orderkey % 4 <> 0)"
ALL_MEMBERS = f"""
WITH RECURSIVE t AS (SELECT * FROM {TREE}), up AS (SELECT id AS node, parent_id AS ancestor FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT up.node, t.parent_id FROM up JOIN t ON t.id = up.ancestor WHERE t.parent_id IS NOT NULL),
m AS (SELECT item, node FROM {MEMBER} UNION SELECT item, ancestor FROM {MEMBER} JOIN up USING (node)),
p AS (SELECT o_orderkey AS item, o_orderkey % 50 = 0 AS hidden, CASE o_orderkey % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'inferred' END AS source FROM orders)
"""


def _visible(spark, sf):
    o = table(spark, sf, "orders")
    source = F.when(F.col("o_orderkey") % 3 == 0, "observed").when(F.col("o_orderkey") % 3 == 1, "inferred")
    points = o.select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 50 == 0).alias("hidden"), source.alias("source"))
    direct = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("item"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"))
    edges = tree(spark, sf).where("parent_id IS NOT NULL").select(F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    return points, graph.close_membership(direct, graph.closure(edges))


def _nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(ALL_MEMBERS + "SELECT item, NOT hidden AND (NOT EXISTS (FROM m WHERE m.item = p.item) OR NOT EXISTS (FROM m WHERE m.item = p.item AND node IN ('r2', 'n4'))) AS visible FROM p")
def visibility_hidden(spark, sf):
    points, members = _visible(spark, sf)
    return e.visible_items(points, members, _nodes(spark, "r2", "n4"))


@query(ALL_MEMBERS + "SELECT item, NOT hidden AND coalesce(source, 'unknown') = 'observed' AND EXISTS (FROM m WHERE m.item = p.item AND node IN ('r1', 'n2')) AND NOT EXISTS (FROM m WHERE m.item = p.item AND node = 'n3') AS visible FROM p")
def visibility_isolated(spark, sf):
    points, members = _visible(spark, sf)
    return e.visible_items(points, members, _nodes(spark, "n3", "__unlabeled__"), _nodes(spark, "r1", "n2"), "observed")


#: A log a user: events in their order, of which every fifth type is an undo.
@query("""
SELECT user_id AS scene, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20""")
def undo_stack(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("scene"), F.col("event_id").alias("seq"))
    return e.undo_stack(log)


FOLD = """
WITH RECURSIVE l AS (SELECT user_id AS scene, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'view' THEN 'search' ELSE 'hide' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT scene, 0::BIGINT AS k, []::BIGINT[] AS held, 0::BIGINT AS open FROM (SELECT DISTINCT scene FROM l)
UNION ALL SELECT l.scene, l.k, CASE WHEN l.action = 'hide' THEN list_append(f.held, l.seq) WHEN l.action = 'undo' AND f.open > 0 THEN f.held[:-2] ELSE f.held END,
CASE l.action WHEN 'hide' THEN least(f.open + 1, 20) WHEN 'undo' THEN greatest(f.open - 1, 0) ELSE f.open END FROM f JOIN l ON l.scene = f.scene AND l.k = f.k + 1),
fin AS (SELECT scene, arg_max(held, k) AS held FROM f GROUP BY scene)
SELECT scene, unnest(held) AS seq FROM fin"""


@query(FOLD)
def command_log_fold(spark, sf):
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "search").otherwise("hide")
    log = table(spark, sf, "events").select(F.col("user_id").alias("scene"), F.col("event_id").alias("seq"), action.alias("action"))
    return e.fold_log(log).select("scene", "seq")


@query(r"SELECT p_partkey, regexp_replace(trim(regexp_replace(lower('  ' || p_type || ' - ' || p_brand), '\s+', ' ', 'g')), ' ?- ?', '-', 'g') AS label FROM part")
def normalize_label_ascii(spark, sf):
    raw = F.concat(F.lit("  "), F.col("p_type"), F.lit(" - "), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", t.normalize_ascii_label(raw).alias("label"))


@query(r"SELECT p_partkey, regexp_replace(trim(regexp_replace(lower('  ' || p_type || ' - ' || p_brand), '\s+', ' ', 'g')), ' ?- ?', '-', 'g') AS label FROM part")
def normalize_label(spark, sf):
    raw = F.concat(F.lit("  "), F.col("p_type"), F.lit(" – "), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", t.normalize_label(raw).alias("label"))


@query("SELECT doc_id, 'class-' || substr(sha256(source), 1, 12) AS class_id, 'obj-' || substr(sha1(source || lang), 1, 12) AS object_id FROM documents")
def hashed_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", t.short_id("class-", F.col("source"), 12).alias("class_id"), t.short_id("obj-", F.concat("source", "lang"), 12, "sha1").alias("object_id"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ' h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ' min' WHEN s >= 60 THEN (s // 60)::VARCHAR || ' min ' || lpad((s % 60)::VARCHAR, 2, '0') || ' s' ELSE s::VARCHAR || ' s' END AS shown FROM (SELECT event_id, (event_id * 37 % 9000)::BIGINT AS s FROM events)")
def duration_text(spark, sf):
    return table(spark, sf, "events").select("event_id", t.duration_text((F.col("event_id") * 37 % 9000).cast("double")).alias("shown"))


@query("""
SELECT p_partkey, coalesce(CASE WHEN list_contains(k, p_type) THEN p_type END, (SELECT x FROM (SELECT unnest(k) AS x) WHERE contains(p_type, x) OR contains(x, p_type) ORDER BY length(x) DESC, x DESC LIMIT 1)) AS label
FROM part, (SELECT ['steel', 'promo', 'brushed', 'economy', 'a', 'standard'] AS k)""".replace("p_type", "lower(p_type)"))
def canonical_label(spark, sf):
    known = F.array(*[F.lit(x) for x in ("steel", "promo", "brushed", "economy", "a", "standard")])
    return table(spark, sf, "part").select("p_partkey", t.canonical_label(F.col("p_type"), known).alias("label"))
