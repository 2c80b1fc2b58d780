"""Components, closures and cycles of object graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import settled
from .skew import meet, pair_cells


BILLION = 1_000_000_000.0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component) of all nodes with an edge; a component is named by its least node.

    Every round takes the least name among neighbours, then the name's own name,
    so the number of rounds grows with the logarithm of the longest chain.
    """
    both = settled(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct())
    names = settled(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("name")).withColumnRenamed("x", "node"))
    for _ in range(most_rounds):
        around = both.join(names, both["y"] == names["node"]).groupBy("x").agg(F.min("name").alias("near"))
        nearer = names.join(around, names["node"] == around["x"]).select("node", F.least("name", "near").alias("name"))
        jump = nearer.select(F.col("node").alias("via"), F.col("name").alias("top"))
        moved = nearer.join(jump, nearer["name"] == jump["via"], "left").select("node", F.least("name", F.coalesce("top", "name")).alias("name"))
        moved = settled(moved)
        changed = moved.alias("m").join(names.alias("n"), "node").where("m.name <> n.name").isEmpty()
        names = moved
        if changed:
            return names.withColumnRenamed("name", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of the largest component, of equal ones that with the least node; nodes without edges are components."""
    comps = connected_components(edges)
    full = nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = full.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct(F.col("n"), (-F.col("component")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("component"))
    return full.join(best, "component").select("node")


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", depth: int | None = None, most_rounds: int = 64) -> DataFrame:
    """(node, ancestor, steps) over all paths, of at most ``depth`` steps if given, cycles included once; steps is the shortest way.

    Paths double in length every round until no pair is new, so the rounds are the logarithm of the depth.
    """
    known = edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps")).distinct()
    size = -1
    for _ in range(most_rounds):
        known = settled(known)
        now = known.count()
        if now == size:
            return known
        size = now
        longer = known.alias("p").join(known.alias("q"), F.col("p.ancestor") == F.col("q.node")).select("p.node", "q.ancestor", (F.col("p.steps") + F.col("q.steps")).alias("steps"))
        if depth is not None:
            longer = longer.where(F.col("steps") <= depth)
        known = known.union(longer).groupBy("node", "ancestor").agg(F.min("steps").alias("steps"))
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")


def with_self(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure with every node as its own ancestor."""
    own = nodes.select("node", F.col("node").alias("ancestor"))
    return closed.select("node", "ancestor").union(own).distinct()


def on_cycles(closed: DataFrame) -> DataFrame:
    """Nodes that are among their own ancestors."""
    return closed.where(F.col("node") == F.col("ancestor")).select("node").distinct()


def without_cycles(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Edges whose two ends do not lie on one cycle; of a cycle every edge goes, none is chosen."""
    closed = closure(edges, child, parent)
    back = closed.select(F.col("node").alias(parent), F.col("ancestor").alias(child))
    return edges.join(back, [child, parent], "left_anti")


def descendants(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the selected nodes and all below them."""
    below = closure(edges).join(selected.select(F.col("node").alias("ancestor")), "ancestor").select("node")
    return selected.select("node").union(below).distinct()


def close_membership(members: DataFrame, closed: DataFrame) -> DataFrame:
    """(item, node): members and the ancestors of what they belong to."""
    above = members.join(closed, "node").select("item", F.col("ancestor").alias("node"))
    return members.select("item", "node").union(above).distinct()


def close_probability(scores: DataFrame, closed: DataFrame) -> DataFrame:
    """(item, node, p): a parent's probability is at least that of each of its descendants; null is unknown and stays out."""
    known = scores.where(F.col("p").isNotNull() & ~F.isnan("p"))
    above = known.join(closed, "node").select("item", F.col("ancestor").alias("node"), "p")
    return known.select("item", "node", "p").union(above).groupBy("item", "node").agg(F.max("p").alias("p"))


def unique_parents(candidates: DataFrame, child: str = "child") -> DataFrame:
    """Candidates that are their child's only one."""
    return candidates.withColumn("__n", F.count("*").over(Window.partitionBy(child))).where("__n = 1").drop("__n")


def tree_order(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, path, depth) of a forest (node, parent), for a depth-first listing by path."""
    closed = closure(nodes.select(F.col("node").alias("child"), "parent"), depth=depth)
    ups = closed.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("s"), F.col("ancestor").alias("a")))).alias("ups"))
    path = F.concat(F.coalesce(F.transform("ups", lambda u: u["a"].cast("string")), F.array().cast("array<string>")), F.array(F.col("node").cast("string")))
    listed = nodes.join(ups, "node", "left").withColumn("path", path)
    return listed.select("node", "path", (F.size("path") - 1).alias("depth"))


def effective_flag(flags: DataFrame, closed: DataFrame) -> DataFrame:
    """(node, flagged): whether a node or any ancestor of it is flagged."""
    above = closed.join(flags.select(F.col("node").alias("ancestor"), F.col("flag").alias("up")), "ancestor").groupBy("node").agg(F.bool_or("up").alias("up"))
    return flags.join(above, "node", "left").select("node", (F.col("flag") | F.coalesce("up", F.lit(False))).alias("flagged"))


def containment_pairs(pixels: DataFrame, least: float = 0.9, ratio: float = 1.5) -> DataFrame:
    """(frame, child, parent, inside, child_area, parent_area, supports) of classes whose masks meet in a frame.

    ``pixels`` is a set of (frame, class, pixel).
    """
    areas = pixels.groupBy("frame", "class").agg(F.count("*").alias("area"))
    cells = pair_cells(pixels.select("frame", "class", "pixel"), ["frame", "pixel"])
    met = cells.alias("c").join(cells.alias("p"), meet(["frame", "pixel"], "c", "p") & (F.col("c.class") != F.col("p.class")))
    inside = met.groupBy(F.col("c.frame").alias("frame"), F.col("c.class").alias("child"), F.col("p.class").alias("parent")).agg(F.count("*").alias("inside"))
    for side in ("child", "parent"):
        inside = inside.join(areas.select("frame", F.col("class").alias(side), F.col("area").alias(f"{side}_area")), ["frame", side])
    supports = (F.col("inside") / F.col("child_area") >= least) & (F.col("parent_area") / F.col("child_area") >= ratio)
    return inside.withColumn("supports", supports)


def containment_support(pairs: DataFrame, observed: DataFrame, least_views: int = 2) -> DataFrame:
    """Per (child, parent): valid, support, mean and least containment, and whether the evidence suffices.

    ``observed`` (frame, class) says where each class was seen, so a shared frame
    without common pixels counts as one with containment zero.  The mean is over
    whole billionths, so it does not depend on the order of the sum.
    """
    cells = pair_cells(observed.select("frame", "class"), ["frame"])
    seen = cells.alias("c").join(cells.alias("p"), meet(["frame"], "c", "p") & (F.col("c.class") != F.col("p.class")))
    shared = seen.select(F.col("c.frame").alias("frame"), F.col("c.class").alias("child"), F.col("p.class").alias("parent"))
    full = shared.join(pairs, ["frame", "child", "parent"], "left")
    held = F.coalesce(F.col("inside") / F.col("child_area"), F.lit(0.0))
    agg = full.groupBy("child", "parent").agg(F.count("*").alias("valid"), F.count_if(F.coalesce("supports", F.lit(False))).alias("support"), (F.sum(F.floor(held * BILLION)) / F.count("*") / BILLION).alias("mean_containment"), F.min(held).alias("min_containment"))
    return agg.withColumn("sufficient", (F.col("support") >= least_views) & (F.col("support") * 2 > F.col("valid")))


def part_parents(supports: DataFrame, objects: DataFrame, least: float = 0.8) -> DataFrame:
    """(part, parent): the object that holds most of a part's points, ``least`` of them at least; else ``scene``.

    Equal shares go to the object of fewer points, then to the greater id.
    """
    sizes = supports.groupBy("object").agg(F.count("*").alias("size"))
    leveled = supports.join(objects.select("object", "level"), "object")
    parts, wholes = leveled.where("level = 'part'"), leveled.where("level = 'object'")
    shared = parts.alias("a").join(wholes.alias("b"), "point").groupBy(F.col("a.object").alias("part"), F.col("b.object").alias("parent")).agg(F.count("*").alias("shared"))
    rated = shared.join(sizes.select(F.col("object").alias("part"), F.col("size").alias("own")), "part").join(sizes.select(F.col("object").alias("parent"), "size"), "parent")
    share = F.col("shared") / F.col("own")
    w = Window.partitionBy("part").orderBy(share.desc(), "size", F.col("parent").desc())
    best = rated.withColumn("share", share).withColumn("r", F.row_number().over(w)).where(f"r = 1 AND share >= {least}")
    named = objects.where("level = 'part'").select(F.col("object").alias("part")).join(best.select("part", "parent"), "part", "left")
    return named.select("part", F.coalesce("parent", F.lit("scene")).alias("parent"))


def coverage_of(column: Column, domain: int) -> Column:
    """Share of a known domain that occurs."""
    return F.count_distinct(column) / F.lit(float(domain))
