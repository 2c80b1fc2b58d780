"""Trees, closures, components and containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .common import TREE, collector, r6, table, tree

QUERIES, query = collector()

CLOSED = f"""
WITH RECURSIVE t AS (SELECT * FROM {TREE}),
up AS (SELECT id AS node, parent_id AS ancestor, 1 AS steps FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT up.node, t.parent_id, up.steps + 1 FROM up JOIN t ON t.id = up.ancestor WHERE t.parent_id IS NOT NULL)
"""


def _edges(spark, sf):
    return tree(spark, sf).where("parent_id IS NOT NULL").select(F.col("id").alias("child"), F.col("parent_id").alias("parent"))


@query(CLOSED + "SELECT node, ancestor, steps FROM up")
def ancestor_closure(spark, sf):
    return graph.closure(_edges(spark, sf))


@query(CLOSED + "SELECT DISTINCT node FROM (SELECT node FROM up WHERE ancestor IN ('r1', 'n3') UNION ALL SELECT id FROM t WHERE id IN ('r1', 'n3'))")
def descendants(spark, sf):
    picked = tree(spark, sf).where("id IN ('r1', 'n3')").select(F.col("id").alias("node"))
    return graph.descendants(picked, _edges(spark, sf))


MEMBER = "(SELECT o_orderkey AS item, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_custkey % 25 ELSE 'c' || o_custkey END AS node FROM orders)"


def _members(spark, sf):
    o = table(spark, sf, "orders")
    nation = F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string"))
    return o.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderkey") % 3 == 0, nation).otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("node"), "o_totalprice")


@query(CLOSED + f"SELECT DISTINCT item, node FROM (SELECT item, node FROM {MEMBER} UNION ALL SELECT item, ancestor FROM {MEMBER} JOIN up USING (node))")
def membership_closure(spark, sf):
    return graph.close_membership(_members(spark, sf).select("item", "node"), graph.closure(_edges(spark, sf)))


@query(CLOSED + f", p AS (SELECT item, node, (item % 97) / 97.0::DOUBLE AS p FROM {MEMBER} WHERE item % 11 <> 0) SELECT item, node, round(max(p), 6) AS p FROM (SELECT item, node, p FROM p UNION ALL SELECT item, ancestor, p FROM p JOIN up USING (node)) GROUP BY item, node")
def probability_closure(spark, sf):
    p = F.when(F.col("item") % 11 != 0, F.col("item") % 97 / 97.0)
    scores = _members(spark, sf).select("item", "node", p.alias("p"))
    return graph.close_probability(scores, graph.closure(_edges(spark, sf))).select("item", "node", r6("p").alias("p"))


#: A functional graph with cycles over all orders: within sixteen neighbours each key points to another by a fixed rule.
LOOPS = "(SELECT DISTINCT o_orderkey::BIGINT AS child, o_orderkey - o_orderkey % 16 + ((o_orderkey % 16) * 7 + 3) % 16 AS parent FROM orders WHERE o_orderkey % 4 <> 1)"
REACH = f"WITH RECURSIVE e AS (SELECT * FROM {LOOPS}), up AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT up.node, e.parent FROM up JOIN e ON e.child = up.ancestor)"


def _loops(spark, sf):
    """Orders without a parent, a fourth, are roots or leaves of the graph."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").where(k % 4 != 1).select(k.alias("child"), (k - k % 16 + ((k % 16) * 7 + 3) % 16).alias("parent")).distinct()


@query(REACH + " SELECT DISTINCT node FROM up WHERE node = ancestor")
def cycle_members(spark, sf):
    return graph.on_cycles(graph.closure(_loops(spark, sf)))


@query(REACH + " SELECT child, parent FROM e WHERE NOT EXISTS (FROM up WHERE up.node = e.parent AND up.ancestor = e.child)")
def without_cycles(spark, sf):
    return graph.without_cycles(_loops(spark, sf))


#: Orders of one customer's neighbourhood on one day of the month: many small components and all rows.
LINKS = "(SELECT DISTINCT o_custkey * 31 + day(o_orderdate) AS a, (o_custkey + o_orderkey % 2) * 31 + day(o_orderdate) AS b FROM orders)"
COMPS = f"WITH RECURSIVE e AS (SELECT a, b FROM {LINKS} UNION SELECT b, a FROM {LINKS}), r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached), comp AS (SELECT node, min(reached) AS component FROM r GROUP BY node)"


def _links(spark, sf):
    day = F.dayofmonth("o_orderdate")
    return table(spark, sf, "orders").select((F.col("o_custkey") * 31 + day).alias("a"), ((F.col("o_custkey") + F.col("o_orderkey") % 2) * 31 + day).alias("b")).distinct()


@query(COMPS + " SELECT node, component FROM comp")
def connected_components(spark, sf):
    return graph.connected_components(_links(spark, sf))


@query(COMPS + ", n AS (SELECT component, count(*) AS n FROM comp GROUP BY component) SELECT node FROM comp WHERE component = (SELECT component FROM n ORDER BY n DESC, component LIMIT 1)")
def largest_component(spark, sf):
    links = _links(spark, sf)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return graph.largest_component(nodes, links)


PIXELS = "(SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS frame, CASE WHEN l_linenumber = 1 THEN p_brand ELSE p_type END AS class, l_suppkey AS pixel FROM lineitem JOIN part ON p_partkey = l_partkey)"
PAIRED = f"""
WITH x AS (SELECT * FROM {PIXELS}), n AS (SELECT frame, class, count(*) AS area FROM x GROUP BY ALL),
i AS (SELECT c.frame, c.class AS child, p.class AS parent, count(*) AS inside FROM x c JOIN x p ON c.frame = p.frame AND c.pixel = p.pixel AND c.class <> p.class GROUP BY ALL),
pairs AS (SELECT i.*, u.area AS child_area, v.area AS parent_area, inside / u.area >= 0.9 AND v.area / u.area >= 1.5 AS supports FROM i JOIN n u ON u.frame = i.frame AND u.class = child JOIN n v ON v.frame = i.frame AND v.class = parent)
"""
SUPPORTED = PAIRED + """,
met AS (SELECT c.frame, c.class AS child, p.class AS parent FROM n c JOIN n p ON c.frame = p.frame AND c.class <> p.class),
sup AS (SELECT child, parent, count(*) AS valid, count_if(coalesce(supports, false))::BIGINT AS support, sum(floor(coalesce(inside / child_area, 0) * 1000000000.0::DOUBLE)::BIGINT) / count(*) / 1000000000.0::DOUBLE AS mean_containment, min(coalesce(inside / child_area, 0)) AS min_containment FROM met LEFT JOIN pairs USING (frame, child, parent) GROUP BY ALL)
"""


def _pixels(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return x.select(F.date_format("l_shipdate", "yyyy-MM").alias("frame"), F.when(F.col("l_linenumber") == 1, F.col("p_brand")).otherwise(F.col("p_type")).alias("class"), F.col("l_suppkey").alias("pixel")).distinct()


def _support(spark, sf):
    pixels = _pixels(spark, sf)
    return graph.containment_support(graph.containment_pairs(pixels), pixels.select("frame", "class").distinct())


@query(PAIRED + "SELECT frame, child, parent, inside, child_area, parent_area, supports FROM pairs")
def containment_pairs(spark, sf):
    return graph.containment_pairs(_pixels(spark, sf)).select("frame", "child", "parent", "inside", "child_area", "parent_area", "supports")


@query(SUPPORTED + "SELECT child, parent, valid, support, floor(mean_containment * 1000000.0::DOUBLE)::BIGINT AS mean_millionths, floor(min_containment * 1000000.0::DOUBLE)::BIGINT AS min_millionths, support >= 2 AND support * 2 > valid AS sufficient FROM sup")
def containment_support(spark, sf):
    return _support(spark, sf).select("child", "parent", "valid", "support", F.floor(F.col("mean_containment") * 1e6).alias("mean_millionths"), F.floor(F.col("min_containment") * 1e6).alias("min_millionths"), "sufficient")


@query("WITH e AS (SELECT DISTINCT p_brand || '/' || p_size % 10 AS child, p_type AS parent FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY child) AS k FROM e) SELECT child, parent FROM c WHERE k = 1")
def unique_parents(spark, sf):
    child = F.concat_ws("/", "p_brand", (F.col("p_size") % 10).cast("string"))
    return graph.unique_parents(table(spark, sf, "part").select(child.alias("child"), F.col("p_type").alias("parent")).distinct())


PARTS = "(SELECT DISTINCT CASE WHEN l_linenumber <= 2 THEN 'o' || l_suppkey % 7 ELSE 'p' || l_partkey % 60 END AS object, CASE WHEN l_linenumber <= 2 THEN l_suppkey ELSE (l_partkey % 60) + 60 * (l_suppkey % 2) END AS point FROM lineitem)"


@query(f"""
WITH s AS (SELECT * FROM {PARTS}), n AS (SELECT object, count(*) AS size FROM s GROUP BY object),
sh AS (SELECT a.object AS part, b.object AS parent, count(*) AS shared FROM s a JOIN s b ON a.point = b.point AND a.object LIKE 'p%' AND b.object LIKE 'o%' GROUP BY ALL),
r AS (SELECT part, parent, shared / u.size AS share, row_number() OVER (PARTITION BY part ORDER BY shared / u.size DESC, v.size, parent DESC) AS r FROM sh JOIN n u ON u.object = part JOIN n v ON v.object = parent)
SELECT p.object AS part, coalesce(parent, 'scene') AS parent FROM (SELECT DISTINCT object FROM s WHERE object LIKE 'p%') p LEFT JOIN r ON r.part = p.object AND r = 1 AND share >= 0.3""")
def part_parents(spark, sf):
    x, small = table(spark, sf, "lineitem"), F.col("l_linenumber") <= 2
    name = F.when(small, F.concat(F.lit("o"), (F.col("l_suppkey") % 7).cast("string"))).otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 60).cast("string")))
    point = F.when(small, F.col("l_suppkey")).otherwise(F.col("l_partkey") % 60 + 60 * (F.col("l_suppkey") % 2))
    supports = x.select(name.alias("object"), point.alias("point")).distinct()
    objects = supports.select("object", F.when(F.startswith("object", F.lit("o")), "object").otherwise("part").alias("level")).distinct()
    return graph.part_parents(supports, objects, 0.3)


@query(CLOSED + ", listed AS (SELECT node, string_agg(ancestor, '/' ORDER BY steps DESC) AS above, max(steps) AS depth FROM up GROUP BY node) SELECT id AS node, coalesce(above || '/', '') || id AS path, coalesce(depth, 0)::INT AS depth FROM t LEFT JOIN listed ON node = id")
def tree_listing(spark, sf):
    nodes = tree(spark, sf).select(F.col("id").alias("node"), F.col("parent_id").alias("parent"))
    return graph.tree_order(nodes).select("node", F.array_join("path", "/").alias("path"), "depth")


@query(CLOSED + ", f AS (SELECT id AS node, id IN ('r2', 'n5', 'c7') AS flag FROM t) SELECT f.node, flag OR EXISTS (FROM up JOIN f g ON g.node = up.ancestor WHERE up.node = f.node AND g.flag) AS flagged FROM f")
def hidden_by_ancestor(spark, sf):
    flags = tree(spark, sf).select(F.col("id").alias("node"), F.col("id").isin("r2", "n5", "c7").alias("flag"))
    return graph.effective_flag(flags, graph.closure(_edges(spark, sf)))
