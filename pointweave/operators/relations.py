"""Declared relations of classes and tracks, and the memberships that follow from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Named parts, what each belongs to and how.
RELATIONS = {
    "bear nose": ("stuffed bear", "part_of"), "bear ear": ("stuffed bear", "part_of"),
    "mug handle": ("coffee mug", "part_of"), "coffee": ("coffee mug", "contents_of"),
    "chair back": ("chair", "part_of"), "chair leg": ("chair", "part_of"),
    "door handle": ("door", "part_of"), "car window": ("car", "part_of"),
    "wheel": ("car", "part_of"), "bottle cap": ("bottle", "part_of"),
    "lamp shade": ("lamp", "part_of"), "table leg": ("table", "part_of"),
}
COLLECTION, COLLECTION_LABEL = "scene-observed-collection", "scene objects"
#: Levels of regions, the coarsest first; a parent must be of a coarser level of the same family.
FINE, COARSE = ("l", "m", "s"), ("scene", "coarse", "object", "part")


def relation_table(spark, relations: Mapping[str, tuple[str, str]] = RELATIONS) -> DataFrame:
    return spark.createDataFrame([(child, parent, kind) for child, (parent, kind) in relations.items()], "child string, parent string, relation string")


def expand_vocabulary(labels: DataFrame, relations: DataFrame) -> DataFrame:
    """(label, added): the labels, and the parts of those among them that are not there themselves."""
    have = labels.select("label").distinct()
    parts = relations.join(have, relations["parent"] == have["label"], "left_semi").select(F.col("child").alias("label")).distinct()
    return have.withColumn("added", F.lit(False)).unionByName(parts.join(have, "label", "left_anti").withColumn("added", F.lit(True)))


def containing_parents(regions: DataFrame, pixels: DataFrame, relations: DataFrame, least: float = 0.9) -> DataFrame:
    """(frame, region, parent, relation): what each region (frame, region, label) is part of.

    A named part belongs to the one region of its whole's label that holds
    ``least`` of its pixels (frame, region, pixel); none, or more than one, leave
    it out.  Any other region with pixels is a member of the frame's collection.
    """
    sizes = pixels.groupBy("frame", "region").agg(F.count("*").alias("size"))
    seen = regions.join(sizes, ["frame", "region"])
    parts = seen.join(F.broadcast(relations), seen["label"] == relations["child"]).drop("child")
    wholes = seen.select("frame", F.col("region").alias("whole"), F.col("label").alias("parent"))
    asked = parts.join(wholes, ["frame", "parent"]).select("frame", "region", "whole", "relation", "size")
    mine = asked.join(pixels, ["frame", "region"])
    held = mine.join(pixels.select("frame", F.col("region").alias("whole"), "pixel"), ["frame", "whole", "pixel"]).groupBy("frame", "region", "whole", "relation", "size").agg(F.count("*").alias("inside"))
    inside = held.where(F.col("inside") / F.col("size") >= least).groupBy("frame", "region").agg(F.count("*").alias("n"), F.min("whole").alias("parent"), F.min("relation").alias("relation"))
    plain = seen.join(F.broadcast(relations), seen["label"] == relations["child"], "left_anti").select("frame", "region", F.lit(COLLECTION).alias("parent"), F.lit("member_of").alias("relation"))
    return inside.where("n = 1").select("frame", "region", "parent", "relation").unionByName(plain)


def declared_containment(declared: DataFrame, tracks: DataFrame, pixels: DataFrame, least: float = 0.9, ratio: float = 1.5, views: int = 2) -> DataFrame:
    """(child, parent, valid, support, relation, met) of every declared pair of tracks.

    ``declared`` (frame, child, parent, relation) names tracks, ``tracks`` (frame,
    track) says where each was seen, ``pixels`` is a set of (frame, track, pixel).
    A frame supports a pair if it declares it and the child's pixels lie in the
    parent's; only frames that hold both count.  Relations must agree.
    """
    pairs = declared.groupBy("child", "parent").agg(F.count_distinct("relation").alias("kinds"), F.min("relation").alias("relation"))
    areas = pixels.groupBy("frame", "track").agg(F.count("*").alias("area"))
    child = areas.select("frame", F.col("track").alias("child"), F.col("area").alias("child_area"))
    parent = areas.select("frame", F.col("track").alias("parent"), F.col("area").alias("parent_area"))
    seen = tracks.select("frame", "track").distinct()
    shared = pairs.join(seen.withColumnRenamed("track", "child"), "child").join(seen.withColumnRenamed("track", "parent"), ["frame", "parent"])
    met = shared.select("frame", "child", "parent").join(pixels.withColumnRenamed("track", "child"), ["frame", "child"]).join(pixels.withColumnRenamed("track", "parent"), ["frame", "parent", "pixel"])
    inside = met.groupBy("frame", "child", "parent").agg(F.count("*").alias("inside"))
    said = declared.select("frame", "child", "parent", F.lit(True).alias("said")).distinct()
    full = shared.join(child, ["frame", "child"]).join(parent, ["frame", "parent"]).join(inside, ["frame", "child", "parent"], "left").join(said, ["frame", "child", "parent"], "left")
    ok = F.coalesce("said", F.lit(False)) & (F.coalesce("inside", F.lit(0)) / F.col("child_area") >= least) & (F.col("parent_area") / F.col("child_area") >= ratio)
    agg = full.groupBy("child", "parent").agg(F.count("*").alias("valid"), F.count_if(ok).alias("support"))
    joined = pairs.join(agg, ["child", "parent"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("valid", "support")})
    enough = (F.col("kinds") == 1) & (F.col("support") >= views) & (F.col("support") * 2 > F.col("valid"))
    return joined.select("child", "parent", "valid", "support", F.when(F.col("kinds") == 1, F.col("relation")).otherwise("conflicting").alias("relation"), enough.alias("met"))


def explicit_edges(mapping: DataFrame, names: DataFrame, fold) -> DataFrame:
    """(child, parent): a mapping (child, parents) as one set of edges; ids become their labels, other names are folded by ``fold``."""
    edges = mapping.select(F.col("child").cast("string").alias("c"), F.explode("parents").alias("p"))
    label = lambda side: names.select(F.col("id").cast("string").alias(side), F.col("label").alias(f"{side}_label"))
    named = edges.join(label("c"), "c", "left").join(label("p"), "p", "left")
    return named.select(F.coalesce("c_label", fold(F.col("c"))).alias("child"), F.coalesce("p_label", fold(F.col("p"))).alias("parent")).distinct()


def label_columns(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, columns): for each wanted label the indices of the classes (index, display_label, source_labels) that go by it."""
    names = F.array_distinct(F.concat(F.coalesce("source_labels", F.array().cast("array<string>")), F.array(F.coalesce("display_label", F.lit("")))))
    named = classes.select("index", F.explode(names).alias("label"))
    found = named.join(wanted.select("label").distinct(), "label").groupBy("label").agg(F.array_sort(F.collect_set("index")).alias("columns"))
    return wanted.select("label").distinct().join(found, "label", "left").select("label", F.coalesce("columns", F.array().cast("array<bigint>")).alias("columns"))


def class_counts(raw: DataFrame, closed: DataFrame, preview: DataFrame) -> DataFrame:
    """(class, raw, closed, preview) memberships of each class: as given, closed over ancestors, and of preview rows.

    ``raw`` and ``closed`` are sets of (item, class), ``preview`` of (item).
    """
    marked = raw.select("item", "class", F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(closed.select("item", "class", F.lit(0).alias("r"), F.lit(1).alias("c")))
    shown = marked.join(preview.select("item", F.lit(1).alias("shown")).distinct(), "item", "left")
    return shown.groupBy("class").agg(F.sum("r").alias("raw"), F.sum("c").alias("closed"), F.sum(F.col("c") * F.coalesce("shown", F.lit(0))).alias("preview"))


def membership_changes(raw: DataFrame, closed: DataFrame) -> DataFrame:
    """One row: memberships before and after, how many were added and how many items they changed."""
    added = closed.select("item", "class").join(raw.select("item", "class"), ["item", "class"], "left_anti")
    sums = added.agg(F.count("*").alias("added"), F.count_distinct("item").alias("changed_items"))
    return raw.agg(F.count("*").alias("raw")).join(closed.agg(F.count("*").alias("closed"))).join(sums)  # a row each


def label_priors(members: DataFrame, labels: DataFrame, fold, least: float = 0.05) -> DataFrame:
    """(item, label, p): the probability to start from, of every item and label that a class of the same folded name holds.

    ``members`` (item, class_label, member) with the membership's share; the
    greatest of several classes counts, and items without one start at ``least``.
    """
    named = members.select("item", fold(F.col("class_label")).alias("label"), (0.9 * F.col("member").cast("double") + 0.05).alias("p"))
    return named.join(labels.select("label").distinct(), "label").groupBy("item", "label").agg(F.greatest(F.lit(least), F.max("p")).alias("p"))


def empty_labels(required: DataFrame, pixels: DataFrame) -> DataFrame:
    """(label): required labels of which no mask (label, on: whether a pixel is set) has a pixel."""
    return required.select("label").distinct().join(pixels.where("on").select("label"), "label", "left_anti")
