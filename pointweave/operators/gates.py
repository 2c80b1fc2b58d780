"""Evidence gates, declared relations, schedules and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .binding import prefer, unique_keys


def render_gates(jobs: DataFrame) -> DataFrame:
    """(scene, problem) of scenes whose jobs cannot be compared: unfinished, several splits, sizes or name sets."""
    sums = jobs.groupBy("scene").agg(
        F.count_if(F.col("status") != "complete").alias("open"),
        F.count_distinct("split").alias("splits"),
        F.count_distinct("width", "height").alias("sizes"),
        F.count_distinct("names").alias("names"),
    )
    rules = F.array(F.when(F.col("open") > 0, "incomplete"), F.when(F.col("splits") != 1, "split"), F.when(F.col("sizes") != 1, "image_size"), F.when(F.col("names") != 1, "names"))
    return sums.select("scene", F.explode(F.array_compact(rules)).alias("problem"))


def geometry_support(support: DataFrame, edges: DataFrame, declared: DataFrame, least: int = 2) -> DataFrame:
    """(child, parent, point, frames): points inside both regions of a declared edge in ``least`` of its frames."""
    shown = edges.join(declared, ["child", "parent"])
    c = support.select("frame", F.col("class").alias("child"), "point")
    p = support.select("frame", F.col("class").alias("parent"), "point")
    both = shown.join(c, ["frame", "child"]).join(p, ["frame", "parent", "point"])
    return both.groupBy("child", "parent", "point").agg(F.count_distinct("frame").alias("frames")).where(F.col("frames") >= least)


def manual_edges(objects: DataFrame, automatic: DataFrame) -> DataFrame:
    """(child, parent, source) by labels: parents named by hand where both labels are unique, before automatic ones; one a child."""
    known = unique_keys(objects, "label")
    parents = known.select(F.col("id").alias("parent_id"), F.col("label").alias("parent"))
    by_hand = known.where("parent_id IS NOT NULL").join(parents, "parent_id").select(F.col("label").alias("child"), "parent", F.lit("manual").alias("source"))
    rows = by_hand.unionByName(automatic.select("child", "parent", F.lit("automatic").alias("source")))
    return prefer(rows, ["child"], "source", ["manual", "automatic"], "parent")


def parent_regions(regions: DataFrame) -> DataFrame:
    """(frame, region, parent_region): a frame's declared parent object as the only region that carries it there."""
    carriers = unique_keys(regions.where("object_id IS NOT NULL").select("frame", F.col("object_id").alias("parent_object_id"), F.col("region").alias("parent_region")), "frame", "parent_object_id")
    return regions.where("parent_object_id IS NOT NULL").join(carriers, ["frame", "parent_object_id"], "left").select("frame", "region", "parent_region")


def evidence_pairs(runs: DataFrame) -> DataFrame:
    """(scene, baseline, priority) of runs that differ in their mode alone: same hash, split and seed."""
    keys = ["scene", "input_sha256", "split", "seed"]
    side = lambda mode: runs.where(F.col("mode") == mode).select(*keys, F.col("run").alias(mode))
    return side("baseline").join(side("priority"), keys).select("scene", "baseline", "priority")


def image_statistics(masks: DataFrame) -> DataFrame:
    """(image, masks, filled, labels) with labels as 'label:count' in order."""
    per = masks.groupBy("image", "label").agg(F.count("*").alias("n"), F.count_if(F.col("area") > 0).alias("filled"))
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "label", F.col("n").cast("string")))), ",")
    return per.groupBy("image").agg(F.sum("n").alias("masks"), F.sum("filled").alias("filled"), pairs.alias("labels"))


def target_summary(masks: DataFrame) -> DataFrame:
    """(image, label, area, confidence, mask_ids) of each class's masks in an image."""
    ids = F.array_join(F.array_sort(F.collect_set("mask_id")), ",")
    return masks.groupBy("image", "label").agg(F.sum("area").alias("area"), F.avg("confidence").alias("confidence"), ids.alias("mask_ids"))


def priority_union(pixels: DataFrame, sizes: DataFrame, training: DataFrame) -> DataFrame:
    """(image, fraction): share of each training image's pixels under any priority mask; images without one have zero."""
    covered = pixels.join(training, "image", "left_semi").select("image", "pixel").distinct().groupBy("image").agg(F.count("*").alias("n"))
    return sizes.join(training, "image", "left_semi").join(covered, "image", "left").select("image", (F.coalesce("n", F.lit(0)) / F.col("pixels")).alias("fraction"))


def weight_map(pixels: DataFrame, strength: float = 1.0) -> DataFrame:
    """(frame, pixel, weight): the largest 1 + strength * mask over all priority masks; strength lies in [0, 10]."""
    s = max(0.0, min(10.0, strength))
    return pixels.groupBy("frame", "pixel").agg(F.max(1 + s * F.col("mask")).alias("weight"))


def growth_picks(points: DataFrame, budget: int, least_gradient: float) -> DataFrame:
    """Points whose gradient passes, steepest first, as many as the budget allows; ties by id."""
    return points.where(F.col("gradient") >= least_gradient).orderBy(F.col("gradient").desc(), "point_id").limit(budget)


def display_info(points: DataFrame) -> DataFrame:
    """(loaded, degrees, fixed): rows, their distinct harmonics degrees, rows of fixed colour."""
    ok = F.coalesce(F.col("sh_degree").between(0, 3), F.lit(False))
    degrees = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(ok, F.col("sh_degree")))), lambda d: F.concat(F.lit("SH"), d.cast("string"))), "/")
    return points.agg(F.count("*").alias("loaded"), degrees.alias("degrees"), F.count_if(~ok).alias("fixed"))


def contiguous_tokens(tokens: DataFrame) -> DataFrame:
    """(query, contiguous): whether a query's attended tokens are one run from its first position."""
    return tokens.where("attended").groupBy("query").agg((F.max("position") - F.min("position") + 1 == F.count("*")).alias("contiguous"))


def map_confidence(samples: DataFrame, least: float = 3.0) -> DataFrame:
    """Samples of a point map inside the frame, valid, finite and confident, with score min(.49, .25 + .08 ln c)."""
    c = F.col("confidence")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))
    ok = inside & F.col("valid") & ~F.isnan(c) & (c > least)
    return samples.where(ok).withColumn("score", F.least(F.lit(0.49), 0.25 + 0.08 * F.log(c)))


def balanced_schedule(views: DataFrame, sweeps: int, group: int = 3, seed: int = 0) -> DataFrame:
    """(sweep, step, frame, classes): per sweep each frame's classes in groups of ``group``, frames interleaved in an order by hash."""
    swept = views.withColumn("sweep", F.explode(F.sequence(F.lit(0), F.lit(sweeps - 1))))
    key = F.xxhash64(F.lit(seed), "sweep", "frame", "class")
    place = F.row_number().over(Window.partitionBy("sweep", "frame").orderBy(key, "class"))
    grouped = swept.withColumn("part", F.floor((place - 1) / group)).groupBy("sweep", "part", "frame").agg(F.array_sort(F.collect_list("class")).alias("classes"))
    step = F.row_number().over(Window.partitionBy("sweep").orderBy("part", F.xxhash64(F.lit(seed), "sweep", "frame"), "frame")) - 1
    return grouped.withColumn("step", step).select("sweep", "step", "frame", "classes")


def frozen_columns(before: DataFrame, after: DataFrame, key: str, *columns: str) -> DataFrame:
    """(column, changed) rows whose value differs between two states of one key set; a missing key counts as changed."""
    a = before.select(F.col(key).alias("k"), *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("in_a"))
    b = after.select(F.col(key).alias("k"), *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("in_b"))
    both = a.join(b, "k", "full_outer")
    lost = F.col("in_a").isNull() | F.col("in_b").isNull()
    counts = both.agg(*[F.count_if(lost | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in columns])).alias("x")).select("x.*")
