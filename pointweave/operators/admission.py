"""Rules that admit rows, files and runs; each is a column, and a table passes if ``validation.broken`` finds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validation import INFERRED_CONFIDENCE, finite_all, in_range

#: The most points and the largest scale that a completion may add, and the name it goes by.
MOST_ADDED = 50_000
LARGEST_SCALE = 1e4
COMPLETION = "external_completion_provider"
#: The least containment, area ratio and views of a hierarchy, and what depends on meaning.
LEAST_CONTAINMENT, LEAST_AREA_RATIO, LEAST_VIEWS = 0.9, 1.5, 2
SEMANTIC_COLUMNS = ("object_id", "semantic_ids", "semantic_path", "semantic_probabilities", "semantic_confidence")
HASH = "^[0-9a-f]{64}$"


def first_broken(**rules: Column) -> Column:
    """The name of the first rule that does not hold, null if all do; an unknown result does not hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])


def learned_point_problem(width: Column, height: Column) -> Column:
    """Why a learned point (position, color, confidence, source, seen: map of frame to pixel) is refused.

    ``width`` and ``height`` are maps of frame to size.
    """
    inside = F.forall(F.map_entries("seen"), lambda e: (F.size(e["value"]) == 2) & finite_all(e["value"]) & (e["value"][0] >= 0) & (e["value"][0] < F.try_element_at(width, e["key"])) & (e["value"][1] >= 0) & (e["value"][1] < F.try_element_at(height, e["key"])))
    return first_broken(
        position=(F.size("position") == 3) & finite_all(F.col("position")),
        color=(F.size("color") == 3) & finite_all(F.col("color")) & F.forall("color", lambda c: c.between(0, 1)),
        confidence=in_range(F.col("confidence"), 0, INFERRED_CONFIDENCE + 1e-6),
        source=F.col("source") == "inferred",
        observed=F.size(F.map_keys("seen")) > 0,
        in_frame=inside,
    )


def rigid(rotation: Column, tolerance: float = 0.01) -> Column:
    """Whether a 3 by 3 matrix, an array of rows, is a rotation: orthonormal rows and determinant one."""
    r = [[rotation[i][j] for j in range(3)] for i in range(3)]
    ok = finite_all(F.flatten(rotation))
    for i in range(3):
        for j in range(i, 3):
            ok = ok & (F.abs(sum(r[i][k] * r[j][k] for k in range(3)) - float(i == j)) <= tolerance)
    det = sum(r[0][i] * (r[1][(i + 1) % 3] * r[2][(i + 2) % 3] - r[1][(i + 2) % 3] * r[2][(i + 1) % 3]) for i in range(3))
    return ok & (det >= 1 - tolerance)


def completed(rows: DataFrame) -> DataFrame:
    """Rows (position, scale, rotation, color, opacity, confidence) of a completion with ``problem``, bounds kept.

    Rotations get length one, a confidence is .25 if missing and .49 at most, and
    every row is marked inferred.
    """
    length = F.sqrt(F.aggregate("rotation", F.lit(0.0), lambda s, x: s + x * x))
    confidence = F.coalesce(F.col("confidence"), F.lit(0.25))
    problem = first_broken(
        position=(F.size("position") == 3) & finite_all(F.col("position")),
        scale=(F.size("scale") == 3) & finite_all(F.col("scale")) & F.forall("scale", lambda x: (x > 0) & (x <= LARGEST_SCALE)),
        color=(F.size("color") == 3) & finite_all(F.col("color")) & F.forall("color", lambda x: x.between(0, 1)),
        opacity=in_range(F.col("opacity"), 0, 1),
        rotation=(F.size("rotation") == 4) & finite_all(F.col("rotation")) & (length >= 1e-8),
        confidence=finite_all(F.array(confidence)),
    )
    turned = F.when(length >= 1e-8, F.transform("rotation", lambda x: x / length)).otherwise(F.col("rotation"))
    bounded = F.least(F.lit(INFERRED_CONFIDENCE), F.greatest(F.lit(0.0), confidence))
    return rows.withColumns({"problem": problem, "rotation": turned, "confidence": bounded, "source": F.lit("inferred"), "provenance": F.lit(COMPLETION)})


def observation_problems(observations: DataFrame, classes: int, rows: str | None = None) -> DataFrame:
    """(frame, problem) of observations (frame, class_index, confidence, least, greatest: the range of targets), null where all is well.

    A frame with any broken row, a class twice, or a number of rows unlike the one
    that all of them state in the column ``rows``, if that is given, is named once,
    by the first rule.
    """
    rules = {"class_range": F.col("class_index").between(0, classes - 1), "confidence": in_range(F.col("confidence"), 0, 1), "targets": in_range(F.col("least"), 0, 1) & in_range(F.col("greatest"), 0, 1)}
    bad = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    stated = F.coalesce((F.min(rows) == F.count("*")) & (F.max(rows) == F.count("*")) & (F.count(rows) == F.count("*")), F.lit(False)) if rows else F.lit(True)
    frames = observations.groupBy("frame").agg(*bad, (F.count("class_index") - F.count_distinct("class_index")).alias("class_twice"), F.when(stated, 0).otherwise(1).alias("row_count"))
    return frames.select("frame", first_broken(**{name: F.col(name) == 0 for name in (*rules, "class_twice", "row_count")}).alias("problem"))


def mask_grid_problems(cameras: DataFrame, masks: DataFrame) -> DataFrame:
    """(name, problem) of cameras (name, same_grid, width, height) that have a mask (name, width, height)."""
    m = masks.select("name", F.col("width").alias("__w"), F.col("height").alias("__h"))
    problem = first_broken(pixel_grid=F.col("same_grid"), full_size=(F.col("width") == F.col("__w")) & (F.col("height") == F.col("__h")))
    return cameras.join(m, "name").select("name", problem.alias("problem"))


def same_pixel_grid(now: DataFrame, before: DataFrame, relative: float = 1e-7, absolute: float = 1e-6) -> DataFrame:
    """(name, same_grid, centered) of registered cameras (name, model, width, height, fx, fy, cx, cy) against the original ones."""
    keys = ["model", "width", "height", "fx", "fy", "cx", "cy"]
    joined = now.join(before.select("name", *[F.col(c).alias(f"__{c}") for c in keys]), "name", "left")
    pinhole = F.col("__model").isin("PINHOLE", "SIMPLE_PINHOLE")
    same = pinhole & (F.col("width") == F.col("__width")) & (F.col("height") == F.col("__height"))
    for c in ("fx", "fy", "cx", "cy"):
        same = same & (F.abs(F.col(f"__{c}") - F.col(c)) <= absolute + relative * F.abs(F.col(c)))
    centered = (F.abs(F.col("cx") - F.col("width") / 2) <= absolute) & (F.abs(F.col("cy") - F.col("height") / 2) <= absolute)
    return joined.select("name", F.coalesce(same, F.lit(False)).alias("same_grid"), centered.alias("centered"))


def import_problem(geometry: Column, semantics: Column, geometry_only: Column) -> Column:
    """Why a choice of files cannot be imported: the first requirement that it misses, null if none."""
    suffix = lambda c, kinds: F.lower(c).rlike(rf"\.(?:{kinds})$")
    ply, package = suffix(geometry, "ply"), semantics.isNotNull()
    return first_broken(
        geometry=geometry.isNotNull(),
        geometry_suffix=suffix(geometry, "ply|json|jsonl"),
        semantics_missing=~ply | geometry_only | package,
        semantics_suffix=~package | suffix(semantics, "zip"),
        semantics_pairing=~package | ply,
    )


def has_objects(objects: DataFrame, scene: str = "scene_id") -> DataFrame:
    """(scene, semantic): whether any object of a scene is more than the scene itself."""
    return objects.groupBy(scene).agg(F.coalesce(F.bool_or(F.col("level") != "scene"), F.lit(False)).alias("semantic"))


def without_semantics(points: DataFrame) -> DataFrame:
    """Points as plain colour: every column that carries meaning is dropped."""
    return points.drop(*SEMANTIC_COLUMNS)


def evidence_problem(iterations: Column) -> Column:
    """Why a result (iterations, wall_seconds, points, views, expected_views, metric, shared_views) is no evidence of a completed run."""
    return first_broken(
        iterations=F.col("iterations") == iterations,
        timing=in_range(F.col("wall_seconds"), 1e-12, 1e300),
        points=F.col("points") > 0,
        views=F.col("views") == F.col("expected_views"),
        metric=finite_all(F.array("metric")),
        split=F.col("shared_views") == 0,
    )


def missing_combinations(results: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """(keys, problem): combinations that are expected and missing, done and not expected, or done more than once."""
    done = results.groupBy(*keys).agg(F.count("*").alias("__n"))
    wanted = expected.select(*keys).distinct().withColumn("__wanted", F.lit(True))
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__wanted").isNull(), "unexpected").when(F.col("__n") > 1, "repeated")
    return wanted.join(done, list(keys), "full_outer").withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "problem")


def run_problem(root: Column) -> Column:
    """Why a run (run_id, record_id, project, record_project, status, images, cameras, backend, ply_path, masks) may not be refined.

    ``root`` is the folder of the project's runs, which must hold the model.
    """
    path = F.col("ply_path")
    return first_broken(
        identity=(F.col("record_id") == F.col("run_id")) & (F.col("record_project") == F.col("project")),
        status=F.col("status") == "completed",
        training_data=(F.col("images") > 0) & (F.col("cameras") > 0),
        backend=(F.col("backend") == "original_3dgs") | F.contains(F.lower("backend"), F.lit("cuda")),
        model=F.startswith(path, F.concat(root, F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)") & F.lower(path).endswith(".ply"),
        masks=F.col("masks") > 0,
    )


def config_problem() -> Column:
    """Why a grouping configuration, one row of its settings, is invalid."""
    share = lambda c: in_range(F.col(c).cast("double"), 0, 1)
    return first_broken(
        min_shared_points=F.col("min_shared_points") >= 1,
        min_parent_views=F.col("min_parent_views") >= LEAST_VIEWS,
        max_descriptors=F.col("max_descriptors") >= 1,
        shares=share("min_support_overlap") & share("min_support_iou") & share("ambiguity_margin") & share("feature_weight") & share("descriptor_split_cosine"),
        min_containment=in_range(F.col("min_containment"), LEAST_CONTAINMENT, 1),
        min_parent_area_ratio=in_range(F.col("min_parent_area_ratio"), 1, 1e300),
        min_descriptor_cosine=in_range(F.col("min_descriptor_cosine"), -1, 1),
        source_hash=F.col("source_ply_sha256").isNull() | F.col("source_ply_sha256").rlike(HASH),
    )


def support_problem(ids: Column, bound: Column) -> Column:
    """Why a region's point ids are invalid: negative, beyond the bound cloud, or of no cloud at all."""
    some = F.size(ids) > 0
    return first_broken(negative=~some | (F.array_min(ids) >= 0), unbound=~some | bound.isNotNull(), range=~some | (F.array_max(ids) < bound))


def class_order_problem(classes: Column, declared: Column) -> Column:
    """Why declared membership columns do not follow a catalog's classes."""
    return first_broken(
        classes=(F.size(classes) > 0) & F.forall(classes, lambda c: c.isNotNull() & (F.length(F.trim(c)) > 0)),
        repeated=F.size(F.array_distinct(classes)) == F.size(classes),
        order=classes == declared,
    )


def edge_problem(count: Column) -> Column:
    """Why a relation (parent_idx, child_idx, relation, source) among ``count`` classes is invalid."""
    known = lambda c: F.col(c).between(0, count - 1)
    return first_broken(
        indices=known("parent_idx") & known("child_idx"),
        distinct=F.col("parent_idx") != F.col("child_idx"),
        relation=F.length(F.trim("relation")) > 0,
        source=F.length(F.trim(F.coalesce("source", F.lit("unknown")))) > 0,
    )


def token_problems(tokens: DataFrame, pad: int) -> DataFrame:
    """(sequence, problem) of tokens (sequence, position, token, expected, attended).

    Ids must be the expected ones, attended positions one run without gaps, and
    all others the pad id.
    """
    on = F.when(F.col("attended"), F.col("position"))
    sums = tokens.groupBy("sequence").agg(
        F.count_if(F.col("attended") & ~F.col("token").eqNullSafe(F.col("expected"))).alias("other"),
        (F.max(on) - F.min(on) + 1).alias("span"),
        F.count(on).alias("n"),
        F.count_if(~F.col("attended") & (F.col("token") != pad)).alias("unpadded"),
    )
    return sums.select("sequence", first_broken(attended=F.col("n") > 0, contiguous=F.col("span") == F.col("n"), ids=F.col("other") == 0, padding=F.col("unpadded") == 0).alias("problem"))


def edge_digests(support: DataFrame, *keys: str) -> DataFrame:
    """(keys, frames, digest): each edge's rows (frame, value) as one hash of their list in order of frame, however they are dealt.

    An edge's list is as long as its frames are many.
    """
    lists = support.groupBy(*keys).agg(F.count("*").alias("frames"), F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("__list"))
    return lists.select(*keys, "frames", F.sha2(F.to_json("__list"), 256).alias("digest"))


def scene_root(objects: DataFrame, scene: str = "scene_id") -> DataFrame:
    """(scene, root): the one object of level scene without a parent; null unless there is exactly one."""
    roots = objects.where((F.col("level") == "scene") & F.col("parent_id").isNull()).groupBy(scene).agg(F.count("*").alias("__n"), F.min("id").alias("__id"))
    return objects.select(scene).distinct().join(roots, scene, "left").select(scene, F.when(F.col("__n") == 1, F.col("__id")).alias("root"))


def restored(saved: DataFrame, objects: DataFrame, scene: str = "scene_id") -> DataFrame:
    """(scene, ids): a saved selection's ids that still name objects, in their order."""
    known = objects.groupBy(scene).agg(F.collect_set("id").alias("__known"))
    kept = F.filter("ids", lambda i: F.array_contains(F.coalesce("__known", F.array().cast("array<string>")), i))
    return saved.join(known, scene, "left").select(scene, kept.alias("ids"))

