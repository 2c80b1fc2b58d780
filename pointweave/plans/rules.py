"""Planning of captures and trainings as columns over one row a capture.

Inputs are rows of image_count, unique_image_count, connected_ratio,
max_pair_inliers, view_span (null if unknown), mode, ... as each rule says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quality modes.
MODES = (
    ("fast", 7000, 4, 48, 64, 1.0),
    ("balanced", 15000, 2, 80, 96, 6.25),
    ("fine", 22000, 1, 120, 128, 23.3),
)
MODE_COLUMNS = "mode string, iterations int, resolution int, preview_steps int, preview_size int, preview_factor double"
#: Semantic profiles of the modes.
PROFILES = (
    ("fast", 400, 192, 1, "sampled", 12, "multilevel"),
    ("balanced", 1200, 256, 2, "sampled", 24, "multilevel"),
    ("fine", 2400, 384, 3, "all", 24, "multilevel"),
)
PROFILE_COLUMNS = "mode string, semantic_steps int, train_size int, minimum_sweeps int, view_mode string, max_views int, granularity string"
GIB = 1 << 30
BYTES_A_PARAMETER = 24
REFERENCE_PIXELS = 988 * 730
STALE_AFTER = 45


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODES), MODE_COLUMNS)


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), PROFILE_COLUMNS)


def by_mode(mode: Column, table: tuple, column: int) -> Column:
    """A mode's entry of a fixed table."""
    out = F.when(mode == table[0][0], F.lit(table[0][column]))
    for row in table[1:]:
        out = out.when(mode == row[0], F.lit(row[column]))
    return out


def is_extreme() -> Column:
    return F.col("unique_image_count") <= 2


def is_sparse() -> Column:
    return is_extreme() | (F.col("unique_image_count") < 12) | (F.col("connected_ratio") < 0.75) | F.coalesce(F.col("view_span") < 90, F.lit(False))


def strategy() -> Column:
    return F.when(is_extreme(), "two_view_completion").when(is_sparse(), "sparse_regularized").otherwise("standard_3dgs")


def blockers() -> Column:
    """Why learned geometry cannot take a capture: too few or many views, duplicates, a calibration it would ignore."""
    rules = F.array(
        F.when(~F.col("image_count").between(2, 12), "view_count"),
        F.when(F.col("unique_image_count") != F.col("image_count"), "duplicate_views"),
        F.when(F.col("calibrated"), "calibration"),
    )
    return F.array_join(F.array_compact(rules), ",")


def shared_initialization() -> Column:
    """Whether photos are initialised by the shared path and not by the external one."""
    n = F.col("image_count")
    wanted = F.col("geometry_backend").isin("sfm", "dust3r") | (F.col("completion") == "learned_visible") | F.col("calibrated")
    return (F.col("backend") != "original_3dgs") | is_sparse() | wanted | n.between(2, 6) | (~F.col("colmap") & (n <= 80))


def make_plan(captures: DataFrame) -> DataFrame:
    """A plan's decisions for every capture.

    Columns read beside the counts: mode, device, original_3dgs, colmap,
    learned_ready, geometry_backend, completion, calibrated, semantics.
    """
    n, unique = F.col("image_count"), F.col("unique_image_count")
    planned = captures.withColumn("backend", F.when((F.col("device") == "cuda") & F.col("original_3dgs"), "original_3dgs").otherwise("torch_preview"))
    planned = planned.withColumns({"extreme": is_extreme(), "sparse": is_sparse(), "strategy": strategy(), "blockers": blockers(), "shared": shared_initialization()})
    usable = F.col("learned_ready") & (F.col("blockers") == "")
    classical = F.col("max_pair_inliers") >= 16
    capacity = F.when(F.col("shared"), n <= 80).otherwise(F.col("colmap"))
    planned = planned.withColumn("can_attempt_classical", classical & capacity)
    weak = (n <= 6) & (F.col("connected_ratio") < 0.75)
    asked = (F.col("geometry_backend") == "dust3r") | (F.col("completion") == "learned_visible") | ((F.col("completion") == "auto") & (F.col("extreme") | weak | (~classical & (F.col("geometry_backend") == "auto"))))
    status = F.when(asked & usable, "ready").when(asked, "unavailable").when(F.col("completion") == "none", "not_requested").otherwise("automatic_if_needed")
    auto = F.col("can_attempt_classical") | ((F.col("geometry_backend") == "auto") & (F.col("completion") != "none") & usable)
    can = (unique >= 2) & F.when(F.col("geometry_backend") == "dust3r", usable).otherwise(auto)
    speed = F.when(F.col("device") == "mps", 1.0).when(F.col("device") == "cuda", 0.7).when(F.col("device") == "cpu", 1.6).otherwise(2.0)
    trained = by_mode(F.col("mode"), MODES, 1) / 30 * F.pow(F.greatest(F.lit(0.6), n / 80), F.lit(0.25))
    seconds = F.when(F.col("backend") == "original_3dgs", trained).otherwise(0.75 * by_mode(F.col("mode"), MODES, 5) * speed)
    overhead = F.greatest(F.lit(3.0), n * 1.2) + F.when(F.col("semantics"), n * 8).otherwise(0)
    return planned.withColumns({
        "completion_status": status,
        "can_reconstruct": can,
        "initialization": F.when(F.col("shared"), "shared_photo_initialization").otherwise("colmap_photo_initialization"),
        "least_seconds": F.rint(seconds * 0.5 + overhead).cast("long"),
        "most_seconds": F.rint(seconds * 2.5 + overhead).cast("long"),
    })


def estimate_training(captures: DataFrame) -> DataFrame:
    """Interval of compute seconds: low and high, null where no trainer is available.

    Columns: unique_image_count, pixels (mean, null if unknown), mode, gpu,
    steps_per_second (null if not measured), semantics, priority, completion,
    connected_ratio, cloud, original_3dgs.
    """
    mode = F.col("mode")
    iterations, resolution, steps = by_mode(mode, MODES, 1), by_mode(mode, MODES, 2), by_mode(mode, PROFILES, 1)
    n = F.greatest(F.lit(2), F.col("unique_image_count"))
    pixels = F.coalesce(F.col("pixels").cast("double"), F.lit(float(REFERENCE_PIXELS)))
    load = F.pow(F.greatest(F.lit(0.5), pixels / REFERENCE_PIXELS), F.lit(0.65)) * F.pow(2 / resolution, F.lit(1.2)) * F.pow(F.greatest(F.lit(0.8), n / 6), F.lit(0.35))
    measured, known = F.col("steps_per_second"), F.contains(F.lower("gpu"), F.lit("a100"))
    rgb = F.when(measured.isNotNull(), iterations / measured).when(known, 205 * iterations / 15000 * load).otherwise(iterations / 30 * load)
    semantic = F.when(F.col("semantics"), 34 + 19.5 * steps / 1200 * F.greatest(F.lit(1.0), n / 6) + F.when(F.col("priority"), 0.15 * rgb).otherwise(0.0)).otherwise(0.0)
    completion = F.when((F.col("completion") != "none") & ((n <= 2) | (F.col("connected_ratio") < 0.75)), 60.0).otherwise(0.0)
    base = rgb + semantic + completion + F.greatest(F.lit(10.0), n * 1.5)
    low = F.when(measured.isNotNull(), 0.7).when(known, 0.65).otherwise(0.4)
    high = F.when(measured.isNotNull(), 1.8).when(known, 2.5).otherwise(3.0)
    available = F.col("cloud") | F.col("original_3dgs")
    basis = F.when(measured.isNotNull(), "measured").when(known, "reference_gpu").otherwise("uncalibrated_gpu")
    bound = lambda f: F.when(available, F.greatest(F.lit(15), F.rint(base * f)).cast("long"))
    return captures.withColumns({"available": available, "low": bound(low), "high": bound(high), "basis": F.when(available, basis)})


def cloud_triage(captures: DataFrame) -> DataFrame:
    """What can be said before a remote worker has looked: shape of the capture and whether a task can be exported."""
    return captures.withColumns({"can_export": F.col("unique_image_count") >= 2, "extreme": is_extreme(), "sparse": is_sparse(), "strategy": strategy()})


def recommend(captures: DataFrame) -> DataFrame:
    """blocked, completion, sparse or direct."""
    u = F.col("unique_image_count")
    kind = F.when(u < 2, "blocked").when((u <= 2) | (F.col("connected_ratio") < 0.75), "completion").when((u < 12) | F.coalesce(F.col("view_span") < 90, F.lit(False)), "sparse").otherwise("direct")
    return captures.withColumn("kind", kind)


def resolve_profile(configs: DataFrame) -> DataFrame:
    """Settings of a configuration: with budget ``mode`` the profile's own, with ``manual`` the given ones or defaults."""
    mode, own = F.col("mode"), F.col("budget") == "mode"
    pick = lambda name, column, default: F.when(own, by_mode(mode, PROFILES, column)).otherwise(F.coalesce(F.col(name), F.lit(default) if default is not None else by_mode(mode, PROFILES, column)))
    auto = lambda name, column: F.when(F.coalesce(F.col(name), F.lit("auto")) == "auto", by_mode(mode, PROFILES, column)).otherwise(F.col(name))
    return configs.withColumns({
        "semantic_steps": pick("semantic_steps", 1, 1200),
        "train_size": pick("train_size", 2, 256),
        "minimum_sweeps": pick("minimum_sweeps", 3, 0),
        "max_views": pick("max_views", 5, None),
        "view_mode": auto("view_mode", 4),
        "granularity": auto("granularity", 6),
    })


def memory_budget(rows: DataFrame) -> DataFrame:
    """Dense semantic state against free memory: needed, limit and fits.

    ``rows`` has points, classes, free_bytes (null if unknown) and requested_bytes
    (null for none).  The limit is three quarters of what is free, 32 GiB at most,
    8 GiB if unknown; a request can only lower it.
    """
    automatic = F.when(F.col("free_bytes").isNull(), F.lit(8 * GIB)).otherwise(F.least(F.lit(32 * GIB), F.floor(F.col("free_bytes") * 3 / 4)))
    needed = F.col("points") * F.col("classes") * BYTES_A_PARAMETER
    limit = F.least(automatic, F.coalesce("requested_bytes", automatic))
    return rows.withColumns({"needed_bytes": needed.cast("long"), "limit_bytes": limit.cast("long")}).withColumn("fits", F.col("needed_bytes") <= F.col("limit_bytes"))


def admit(jobs: DataFrame, most: int = 4) -> DataFrame:
    """(project, admitted, reason) for a new job of each project: none active of its own, fewer than ``most`` in all."""
    active = F.col("status").isin("queued", "running")
    own = jobs.groupBy("project").agg(F.count_if(active).alias("own"))
    total = jobs.agg(F.count_if(active).alias("total"))
    reason = F.when(F.col("own") > 0, "project_busy").when(F.col("total") >= most, "queue_full")
    return own.crossJoin(total).select("project", reason.isNull().alias("admitted"), F.coalesce(reason, F.lit("admitted")).alias("reason"))


def recover_interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what was queued or running has failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def intrinsics(images: DataFrame) -> DataFrame:
    """(fx, fy, cx, cy, source) of each image: calibrated, else from its metadata, else .9 of its longer side."""
    fallback = 0.9 * F.greatest("width", "height")
    f = F.coalesce("calibrated_f", "exif_f", fallback)
    source = F.when(F.col("calibrated_f").isNotNull(), "user_calibrated").when(F.col("exif_f").isNotNull(), "exif_35mm_approximate").otherwise("heuristic")
    return images.withColumns({"fx": f, "fy": f, "cx": F.col("width") / 2, "cy": F.col("height") / 2, "intrinsics_source": source})


def execution_controls(states: DataFrame) -> DataFrame:
    """Which actions a client may offer."""
    cloud = F.col("target") == "cloud"
    local = F.col("cuda_semantics") & F.col("device").isin("auto", "cuda")
    return states.withColumns({
        "can_export": cloud & ~F.col("busy") & (F.col("photos") >= 2),
        "can_reconstruct": ~cloud & ~F.col("busy") & F.coalesce("plan_ok", F.lit(False)),
        "can_refine": ~cloud & ~F.col("busy") & local & F.col("owned_run"),
        "iterative": cloud | local,
    })


def freshness(progress: DataFrame, now: Column, most: int = STALE_AFTER) -> DataFrame:
    """Progress rows whose age is out of [0, ``most``] seconds become stale and lose their estimate."""
    age = now - F.col("updated_at")
    stale = (age < 0) | (age > most)
    return progress.withColumns({"phase": F.when(stale, "stale").otherwise(F.col("phase")), "eta": F.when(~stale, F.col("eta")), "rate": F.when(~stale, F.col("rate"))})
