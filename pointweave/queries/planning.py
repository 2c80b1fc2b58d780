"""Plans, estimates, budgets, admission and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import rules
from ..streaming import progress
from .common import collector, table

QUERIES, query = collector()

#: Captures from nations: how many customers stand for photos, and which features a nation's key has.
CAPTURES = """(SELECT n_nationkey AS id, k.n AS image_count, greatest(1, k.n - n_nationkey % 3) AS unique_image_count, (n_nationkey % 10) / 10.0::DOUBLE AS connected_ratio, (n_nationkey % 4) * 8 AS max_pair_inliers,
CASE WHEN n_nationkey % 5 = 0 THEN 60.0 + n_nationkey END::DOUBLE AS view_span, ['fast', 'balanced', 'fine'][n_nationkey % 3 + 1] AS mode, ['cuda', 'mps', 'cpu'][n_nationkey % 3 + 1] AS device, n_nationkey % 2 = 0 AS original_3dgs, n_nationkey % 7 = 0 AS colmap, n_nationkey % 3 <> 1 AS learned_ready,
['auto', 'sfm', 'dust3r', 'auto'][n_nationkey % 4 + 1] AS geometry_backend, ['auto', 'none', 'learned_visible', 'auto', 'auto'][n_nationkey % 5 + 1] AS completion, n_nationkey % 11 = 0 AS calibrated, n_nationkey % 2 = 1 AS semantics
FROM nation JOIN (SELECT c_nationkey, (count(*) % 17)::BIGINT AS n FROM customer GROUP BY 1) k ON c_nationkey = n_nationkey)"""


def _captures(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg((F.count("*") % 17).alias("n"))
    k = F.col("n_nationkey")
    pick = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), k % len(names) + 1)
    return table(spark, sf, "nation").join(counts, F.col("c_nationkey") == k).select(
        k.alias("id"),
        F.col("n").alias("image_count"),
        F.greatest(F.lit(1), F.col("n") - k % 3).alias("unique_image_count"),
        (k % 10 / 10.0).alias("connected_ratio"),
        (k % 4 * 8).alias("max_pair_inliers"),
        F.when(k % 5 == 0, 60.0 + k).alias("view_span"),
        pick("fast", "balanced", "fine").alias("mode"),
        pick("cuda", "mps", "cpu").alias("device"),
        (k % 2 == 0).alias("original_3dgs"),
        (k % 7 == 0).alias("colmap"),
        (k % 3 != 1).alias("learned_ready"),
        pick("auto", "sfm", "dust3r", "auto").alias("geometry_backend"),
        pick("auto", "none", "learned_visible", "auto", "auto").alias("completion"),
        (k % 11 == 0).alias("calibrated"),
        (k % 2 == 1).alias("semantics"),
    )


MODES = "CASE mode WHEN 'fast' THEN {0} WHEN 'balanced' THEN {1} ELSE {2} END"
SHAPE = f"""
WITH c AS (SELECT *, unique_image_count <= 2 AS extreme, unique_image_count <= 2 OR unique_image_count < 12 OR connected_ratio < 0.75 OR coalesce(view_span < 90, false) AS sparse, CASE WHEN device = 'cuda' AND original_3dgs THEN 'original_3dgs' ELSE 'torch_preview' END AS backend FROM {CAPTURES}),
d AS (SELECT *, CASE WHEN extreme THEN 'two_view_completion' WHEN sparse THEN 'sparse_regularized' ELSE 'standard_3dgs' END AS strategy,
array_to_string([x FOR x IN [CASE WHEN image_count NOT BETWEEN 2 AND 12 THEN 'view_count' END, CASE WHEN unique_image_count <> image_count THEN 'duplicate_views' END, CASE WHEN calibrated THEN 'calibration' END] IF x IS NOT NULL], ',') AS blockers,
backend <> 'original_3dgs' OR sparse OR geometry_backend IN ('sfm', 'dust3r') OR completion = 'learned_visible' OR calibrated OR image_count BETWEEN 2 AND 6 OR (NOT colmap AND image_count <= 80) AS shared, max_pair_inliers >= 16 AS classical FROM c),
e AS (SELECT *, learned_ready AND blockers = '' AS usable, classical AND CASE WHEN shared THEN image_count <= 80 ELSE colmap END AS can_attempt_classical,
geometry_backend = 'dust3r' OR completion = 'learned_visible' OR (completion = 'auto' AND (extreme OR (image_count <= 6 AND connected_ratio < 0.75) OR (NOT classical AND geometry_backend = 'auto'))) AS asked,
CASE WHEN backend = 'original_3dgs' THEN {MODES.format(7000, 15000, 22000)} / 30 * pow(greatest(0.6, image_count / 80), 0.25) ELSE 0.75 * {MODES.format(1.0, 6.25, 23.3)} * CASE device WHEN 'mps' THEN 1.0 WHEN 'cuda' THEN 0.7 WHEN 'cpu' THEN 1.6 ELSE 2.0 END END AS seconds,
greatest(3.0, image_count * 1.2) + CASE WHEN semantics THEN image_count * 8 ELSE 0 END AS overhead FROM d)
"""


@query(SHAPE + """SELECT id, strategy, sparse, blockers, can_attempt_classical, CASE WHEN asked AND usable THEN 'ready' WHEN asked THEN 'unavailable' WHEN completion = 'none' THEN 'not_requested' ELSE 'automatic_if_needed' END AS completion_status,
unique_image_count >= 2 AND CASE WHEN geometry_backend = 'dust3r' THEN usable ELSE can_attempt_classical OR (geometry_backend = 'auto' AND completion <> 'none' AND usable) END AS can_reconstruct,
CASE WHEN shared THEN 'shared_photo_initialization' ELSE 'colmap_photo_initialization' END AS initialization, round_even(seconds * 0.5 + overhead, 0)::BIGINT AS least_seconds, round_even(seconds * 2.5 + overhead, 0)::BIGINT AS most_seconds FROM e""")
def plan_rules(spark, sf):
    return rules.make_plan(_captures(spark, sf)).select("id", "strategy", "sparse", "blockers", "can_attempt_classical", "completion_status", "can_reconstruct", "initialization", "least_seconds", "most_seconds")


TRAIN = f"""
WITH c AS (SELECT *, CASE WHEN id % 4 <> 3 THEN 300000 + id * 40000 END::DOUBLE AS pixels, CASE WHEN id % 6 = 0 THEN 20.0 + id END AS sps, ['NVIDIA A100', 'RTX'][id % 2 + 1] AS gpu, id % 3 = 0 AS cloud FROM {CAPTURES}),
l AS (SELECT *, greatest(2, unique_image_count) AS n, {MODES.format(7000, 15000, 22000)} AS it, {MODES.format(4, 2, 1)} AS res, {MODES.format(400, 1200, 2400)} AS steps FROM c),
w AS (SELECT *, pow(greatest(0.5, coalesce(pixels, 721240) / 721240), 0.65) * pow(2 / res, 1.2) * pow(greatest(0.8, n / 6), 0.35) AS load FROM l),
g AS (SELECT *, CASE WHEN sps IS NOT NULL THEN it / sps WHEN gpu LIKE '%A100%' THEN 205 * it / 15000 * load ELSE it / 30 * load END AS rgb FROM w),
b AS (SELECT *, rgb + CASE WHEN semantics THEN 34 + 19.5 * steps / 1200 * greatest(1.0, n / 6) + CASE WHEN calibrated THEN 0.15 * rgb ELSE 0 END ELSE 0 END + CASE WHEN completion <> 'none' AND (n <= 2 OR connected_ratio < 0.75) THEN 60 ELSE 0 END + greatest(10.0, n * 1.5) AS base FROM g)
SELECT id, cloud OR original_3dgs AS available, CASE WHEN cloud OR original_3dgs THEN greatest(15, round_even(base * CASE WHEN sps IS NOT NULL THEN 0.7 WHEN gpu LIKE '%A100%' THEN 0.65 ELSE 0.4 END, 0))::BIGINT END AS low,
CASE WHEN cloud OR original_3dgs THEN greatest(15, round_even(base * CASE WHEN sps IS NOT NULL THEN 1.8 WHEN gpu LIKE '%A100%' THEN 2.5 ELSE 3.0 END, 0))::BIGINT END AS high FROM b"""


@query(TRAIN)
def estimate_training(spark, sf):
    i = F.col("id")
    rows = _captures(spark, sf).withColumns({
        "pixels": F.when(i % 4 != 3, (300000 + i * 40000).cast("double")),
        "steps_per_second": F.when(i % 6 == 0, 20.0 + i),
        "gpu": F.when(i % 2 == 0, "NVIDIA A100").otherwise("RTX"),
        "cloud": i % 3 == 0,
        "priority": F.col("calibrated"),
    })
    return rules.estimate_training(rows).select("id", "available", "low", "high")


@query(SHAPE + "SELECT id, unique_image_count >= 2 AS can_export, extreme, sparse, strategy FROM d")
def cloud_triage(spark, sf):
    return rules.cloud_triage(_captures(spark, sf)).select("id", "can_export", "extreme", "sparse", "strategy")


@query(f"SELECT id, CASE WHEN unique_image_count < 2 THEN 'blocked' WHEN unique_image_count <= 2 OR connected_ratio < 0.75 THEN 'completion' WHEN unique_image_count < 12 OR coalesce(view_span < 90, false) THEN 'sparse' ELSE 'direct' END AS kind FROM {CAPTURES}")
def photo_recommendation(spark, sf):
    return rules.recommend(_captures(spark, sf)).select("id", "kind")


@query(f"""
WITH c AS (SELECT id, mode, id % 2 = 0 AS own, CASE WHEN id % 3 = 0 THEN 100 + id END AS given FROM {CAPTURES})
SELECT id, CASE WHEN own THEN {MODES.format(400, 1200, 2400)} ELSE coalesce(given, 1200) END::INT AS semantic_steps, CASE WHEN own THEN {MODES.format(192, 256, 384)} ELSE coalesce(given, 256) END::INT AS train_size, CASE WHEN own THEN {MODES.format(1, 2, 3)} ELSE coalesce(given, 0) END::INT AS minimum_sweeps, CASE WHEN own THEN {MODES.format(12, 24, 24)} ELSE coalesce(given, {MODES.format(12, 24, 24)}) END::INT AS max_views, CASE WHEN id % 5 = 0 THEN 'all' ELSE {MODES.format("'sampled'", "'sampled'", "'all'")} END AS view_mode FROM c""")
def semantic_profile(spark, sf):
    i = F.col("id")
    given = F.when(i % 3 == 0, 100 + i).cast("int")
    configs = _captures(spark, sf).select("id", "mode", F.when(i % 2 == 0, "mode").otherwise("manual").alias("budget"), *[given.alias(c) for c in ("semantic_steps", "train_size", "minimum_sweeps", "max_views")], F.when(i % 5 == 0, "all").otherwise("auto").alias("view_mode"), F.lit("auto").alias("granularity"))
    return rules.resolve_profile(configs).select("id", "semantic_steps", "train_size", "minimum_sweeps", "max_views", "view_mode")


@query("""
WITH c AS (SELECT c_custkey AS id, (1 + c_custkey % 3000) * 1000 AS points, 1 + c_custkey % 200 AS classes, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 60)::BIGINT * 1073741824 END AS free, CASE WHEN c_custkey % 5 = 0 THEN 4294967296 END AS req FROM customer),
l AS (SELECT *, CASE WHEN free IS NULL THEN 8589934592 ELSE least(34359738368, free * 3 // 4) END AS auto FROM c)
SELECT id, (points * classes * 24)::BIGINT AS needed_bytes, least(auto, coalesce(req, auto))::BIGINT AS limit_bytes, points * classes * 24 <= least(auto, coalesce(req, auto)) AS fits FROM l""")
def memory_budget(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), ((1 + k % 3000) * 1000).alias("points"), (1 + k % 200).alias("classes"), F.when(k % 4 != 0, k % 60 * rules.GIB).alias("free_bytes"), F.when(k % 5 == 0, F.lit(4 * rules.GIB)).alias("requested_bytes"))
    return rules.memory_budget(rows).select("id", "needed_bytes", "limit_bytes", "fits")


@query("""
WITH j AS (SELECT o_custkey AS project, o_orderstatus = 'O' AND o_orderkey % 700 = 0 AS active FROM orders), o AS (SELECT project, count_if(active) AS own FROM j GROUP BY 1)
SELECT project, NOT (own > 0 OR (SELECT count_if(active) FROM j) >= 4) AS admitted, CASE WHEN own > 0 THEN 'project_busy' WHEN (SELECT count_if(active) FROM j) >= 4 THEN 'queue_full' ELSE 'admitted' END AS reason FROM o""")
def queue_admission(spark, sf):
    active = (F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 700 == 0)
    jobs = table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.when(active, "running").otherwise("done").alias("status"))
    return rules.admit(jobs)


@query("SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 7 = 0 THEN 800.0 END, CASE WHEN p_size % 3 = 0 THEN 35.0 * sqrt((100 + p_size) ** 2 + 200 ** 2) / sqrt(1872) END, 0.9 * greatest(100 + p_size, 200)) AS f, CASE WHEN p_size % 7 = 0 THEN 'user_calibrated' WHEN p_size % 3 = 0 THEN 'exif_35mm_approximate' ELSE 'heuristic' END AS intrinsics_source FROM part")
def intrinsics_fallback(spark, sf):
    from ..functions.numeric import focal_from_35mm

    s = F.col("p_size")
    width, height = 100 + s, F.lit(200)
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), width.alias("width"), height.alias("height"), F.when(s % 7 == 0, 800.0).alias("calibrated_f"), F.when(s % 3 == 0, focal_from_35mm(F.lit(35.0), width, height)).alias("exif_f"))
    return rules.intrinsics(images).select("id", F.col("fx").alias("f"), "intrinsics_source")


#: Samples a user: every event moves the counter by its share of work, seconds apart by event ids.
SAMPLES = "(SELECT user_id AS job_id, event_id / 40.0::DOUBLE AS ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 37 AS iteration, 1000 + (user_id % 3) * 0 AS total FROM events)"
TRACKED = f"""
WITH s AS (SELECT * FROM {SAMPLES}),
l AS (SELECT *, lag(iteration) OVER w AS p, lag(ts) OVER w AS a FROM s WINDOW w AS (PARTITION BY job_id ORDER BY ts, iteration)),
f AS (SELECT *, p IS NULL OR iteration < p OR ts - a > 45 AS fresh FROM l),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY job_id ORDER BY ts, iteration) AS run, CASE WHEN NOT fresh AND ts > a THEN (iteration - p) / (ts - a) END AS observed FROM f),
m AS (SELECT *, count(observed) OVER k AS n, min(observed) OVER k AS lo, max(observed) OVER k AS hi, median(observed) OVER k AS med, min(ts) OVER (PARTITION BY job_id, run) AS first FROM r WINDOW k AS (PARTITION BY job_id, run ORDER BY ts, iteration ROWS 4 PRECEDING)),
t AS (SELECT *, coalesce(ts - first >= 2 AND n >= 3 AND lo > 0 AND hi <= 1.5 * lo, false) AS stable FROM m)
SELECT job_id, iteration, round(ts, 4) AS "at", run::BIGINT AS run, stable, CASE WHEN stable THEN round(med, 5) END AS rate, CASE WHEN stable THEN round((total - iteration) / med, 3) END AS eta FROM t"""


@query(TRACKED)
def eta_tracker(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    samples = e.select(F.col("user_id").alias("job_id"), (F.col("event_id") / 40.0).alias("at"), (n % 37).cast("long").alias("iteration"), F.lit(1000).cast("long").alias("total"))
    found = progress.track(samples)
    return found.select("job_id", "iteration", F.round("at", 4).alias("at"), "run", "stable", F.round("rate", 5).alias("rate"), F.round("eta", 3).alias("eta"))


@query("SELECT event_id, round(avg(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) * (event_id % 100), 3) AS eta FROM events")
def recent_step_eta(spark, sf):
    e = table(spark, sf, "events").withColumns({"left": F.col("event_id") % 100, "seconds": F.floor("value")})
    return progress.recent_step_eta(e, "user_id", "event_id", "seconds", "left").select("event_id", F.round("eta", 3).alias("eta"))


@query("SELECT event_id, CASE WHEN 5000 - event_id < 0 OR 5000 - event_id > 45 THEN 'stale' ELSE 'training' END AS phase, CASE WHEN 5000 - event_id BETWEEN 0 AND 45 THEN value END AS eta FROM events")
def progress_freshness(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_id").cast("double").alias("updated_at"), F.lit("training").alias("phase"), F.col("value").alias("eta"), F.col("value").alias("rate"))
    return rules.freshness(rows, F.lit(5000.0)).select("event_id", "phase", "eta")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE 'done' END AS status FROM orders")
def interrupted_recovery(spark, sf):
    s = F.col("o_orderstatus")
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(s == "O", "queued").when(s == "P", "running").otherwise("done").alias("status"))
    return rules.recover_interrupted(jobs)


@query("SELECT c_custkey AS id, c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 4 >= 2 AS can_export, c_custkey % 2 = 1 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AS can_reconstruct, c_custkey % 2 = 0 OR (c_custkey % 7 = 0 AND c_custkey % 3 <> 2) AS iterative FROM customer")
def execution_controls(spark, sf):
    k = F.col("c_custkey")
    states = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 2 == 0, "cloud").otherwise("local").alias("target"), F.when(k % 3 == 0, "auto").when(k % 3 == 1, "cuda").otherwise("cpu").alias("device"), (k % 5 == 0).alias("busy"), (k % 4).alias("photos"), (k % 3 != 0).alias("plan_ok"), (k % 7 == 0).alias("cuda_semantics"), F.lit(True).alias("owned_run"))
    return rules.execution_controls(states).select("id", "can_export", "can_reconstruct", "iterative")
