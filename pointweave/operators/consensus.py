"""A similarity transform between two frames of points, agreed on by most tracks and checked on tracks held out.

Each scene's tracks are numbered once in the order of a hash; the first fifth is
held out.  Minimal samples are rows: numbers of three training tracks a trial,
drawn by hashes, meet their tracks in one join.  All trials' transforms of a
scene are one bounded array that its tracks are tried against, and every count,
mean and moment is a grouped aggregate, so no scene lies in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import written
from .ordering import exact_quantiles, with_ordinal
from .regions import finite

TRIALS, SEED = 128, 7
#: Fixed values of the rules that accept an alignment.
LEAST_TRACKS, LEAST_INLIERS, LEAST_SHARE = 16, 12, 0.6
HELD_OUT, LEAST_HELD_OUT, HELD_OUT_SHARE = 5, 4, 0.75
TOLERANCE, LEAST_EXTENT = 0.04, 0.05
LEAST_SCALE, MOST_SCALE = 1e-4, 1e4
REASONS = ("insufficient_shared_alignment_tracks", "inconsistent_similarity_alignment", "degenerate_similarity_alignment", "heldout_alignment_or_pointmap_consistency_failed")

SOURCE, TARGET = ("sx", "sy", "sz"), ("tx", "ty", "tz")
ROTATION = tuple(f"r{i}{j}" for i in range(3) for j in range(3))
MODEL = ("scale", *ROTATION, "m0", "m1", "m2")


def similarity(cross: np.ndarray, spread: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rows of MODEL from moments about the means: cross = mean(t s'), spread = mean(s s'); NaN where points lie on a line or the scale is wild.

    The closed form: the rotation from the singular vectors of the cross moments,
    mirrored back if need be; the scale from their singular values.
    """
    out = np.full((len(cross), len(MODEL)), np.nan)
    lengths = np.sqrt(np.maximum(np.linalg.eigvalsh(spread)[:, ::-1], 0))
    usable = np.flatnonzero(np.isfinite(cross).all((1, 2)) & (lengths[:, 1] >= np.maximum(1e-4 * lengths[:, 0], 1e-8)))
    if not len(usable):
        return out
    u, values, vt = np.linalg.svd(cross[usable])
    sign = np.ones((len(usable), 3))
    sign[:, 2] = np.sign(np.linalg.det(u @ vt))
    rotation = u * sign[:, None, :] @ vt
    scale = (values * sign).sum(1) / np.trace(spread[usable], axis1=1, axis2=2)
    moved = target[usable] - scale[:, None] * np.einsum("nij,nj->ni", rotation, source[usable])
    rows = np.concatenate([scale[:, None], rotation.reshape(-1, 9), moved], axis=1)
    rows[~((scale > LEAST_SCALE) & (scale < MOST_SCALE))] = np.nan
    out[usable] = rows
    return out


def _fit(moments: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and MODEL, null where degenerate, from columns n, means and sums of products about them."""
    names = [f"c{i}{j}" for i in range(3) for j in range(3)] + [f"v{i}{j}" for i in range(3) for j in range(3)]
    kinds = ", ".join(f"`{k}` {moments.schema[k].dataType.simpleString()}" for k in keys)

    def solve(batches):
        for pdf in batches:
            n = pdf["n"].to_numpy()[:, None, None]
            cross, spread = (pdf[part].to_numpy(np.float64).reshape(-1, 3, 3) / n for part in (names[:9], names[9:]))
            rows = similarity(cross, spread, *(pdf[[f"{c}_mean" for c in side]].to_numpy(np.float64) for side in (SOURCE, TARGET)))
            fitted = pd.DataFrame(rows, columns=list(MODEL)).astype(object).where(~np.isnan(rows), None)
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), fitted], axis=1)

    return moments.mapInPandas(solve, f"{kinds}, " + ", ".join(f"{c} double" for c in MODEL))


def _moments(points: DataFrame, *keys: str) -> DataFrame:
    """Counts, means, and sums of products about the means, a row a group of ``keys``: two passes, so nothing cancels."""
    means = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in (*SOURCE, *TARGET)])
    about = lambda c: F.col(c) - F.col(f"{c}_mean")
    sums = [F.sum(about(t) * about(s)).alias(f"c{i}{j}") for i, t in enumerate(TARGET) for j, s in enumerate(SOURCE)]
    sums += [F.sum(about(a) * about(b)).alias(f"v{i}{j}") for i, a in enumerate(SOURCE) for j, b in enumerate(SOURCE)]
    return points.join(means, list(keys)).groupBy(*keys, "n", *[f"{c}_mean" for c in (*SOURCE, *TARGET)]).agg(*sums)


def error(model: Column | None = None) -> Column:
    """Distance of the transformed source from the target; the transform is a struct, or columns."""
    m = lambda name: F.col(name) if model is None else model[name]
    total = F.lit(0.0)
    for i, t in enumerate(TARGET):
        moved = m("scale") * sum((m(f"r{i}{j}") * F.col(s) for j, s in enumerate(SOURCE)), F.lit(0.0)) + m(f"m{i}")
        total = total + (moved - F.col(t)) * (moved - F.col(t))
    return F.sqrt(total)


def _draws(train: DataFrame, scene: str, trials: int, seed: int) -> DataFrame:
    """(scene, trial, number): three different training numbers a trial, drawn by hashes of scene, trial and seed."""
    drawn = train.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    pick = lambda k: F.pmod(F.xxhash64(F.lit(seed), scene, "trial", F.lit(k)), F.col("train") - k)
    drawn = drawn.withColumns({"a": pick(0), "b": pick(1), "c": pick(2)}).withColumn("b", F.col("b") + F.when(F.col("b") >= F.col("a"), 1).otherwise(0))
    for bound in (F.least, F.greatest):  # the third steps over the lower of the two, then over the upper
        drawn = drawn.withColumn("c", F.col("c") + F.when(F.col("c") >= bound("a", "b"), 1).otherwise(0))
    return drawn.select(scene, "trial", F.explode(F.array("a", "b", "c")).alias("number"))


def align(samples: DataFrame, scene: str, trials: int = TRIALS, seed: int = SEED) -> DataFrame:
    """A row a scene: status, reason, tracks, train, inliers, held_out, extent, threshold, median_error, agreeing, median_disagreement and MODEL.

    ``samples`` has ``scene``, track, frame, a source point (sx, sy, sz) and its
    track's target (tx, ty, tz).  A track needs two frames; its source is their
    mean.  The transform that most training tracks agree with, ties to the least
    sum of their errors, then to the first trial, is fitted again to all that
    agree, and is accepted if held-out tracks and the single samples agree too.
    A rejected scene has the first reason that holds and no transform.

    Cases: rows with a null or non-finite coordinate, or a null track or frame,
    are left out; of several samples of a track and frame the least counts; a
    track's target is its least one; a scene whose every row is left out has no
    row; an empty table gives none.
    """
    usable = samples.where(finite(*SOURCE, *TARGET) & F.col("track").isNotNull() & F.col("frame").isNotNull())
    least = lambda names: F.min(F.struct(*names))
    single = usable.groupBy(scene, "track", "frame").agg(least(SOURCE).alias("s"), least(TARGET).alias("t"))
    tracks = single.groupBy(scene, "track").agg(F.count("*").alias("frames"), *[F.avg(f"s.{c}").alias(c) for c in SOURCE], F.min("t").alias("t"))
    tracks = tracks.withColumn("shared", F.col("frames") >= 2).select(scene, "track", "shared", *SOURCE, *[F.col(f"t.{c}").alias(c) for c in TARGET])
    scenes = tracks.groupBy(scene).agg(F.count_if("shared").alias("tracks"), F.sqrt(sum((F.var_pop(F.when(F.col("shared"), F.col(c))) for c in TARGET), F.lit(0.0))).alias("extent"))
    held = F.greatest(F.lit(LEAST_HELD_OUT), F.floor(F.col("tracks") / HELD_OUT))
    scenes = scenes.withColumns({"extent": F.greatest(F.col("extent"), F.lit(LEAST_EXTENT)), "held_out": held}).withColumns({"threshold": TOLERANCE * F.col("extent"), "train": F.col("tracks") - F.col("held_out")})
    scenes = written(scenes.withColumns({"extent": F.coalesce("extent", F.lit(LEAST_EXTENT)), "threshold": F.coalesce("threshold", F.lit(TOLERANCE * LEAST_EXTENT))}), "consensus-scenes")
    enough = scenes.where(F.col("tracks") >= LEAST_TRACKS)
    shuffled = tracks.where("shared").withColumn("drawn", F.xxhash64(F.lit(seed), scene, "track"))
    numbered = with_ordinal(shuffled, ["drawn", "track"], [scene]).join(enough.select(scene, "held_out", "train", "threshold"), scene)
    numbered = written(numbered.withColumn("number", F.col("ordinal") - F.col("held_out")).drop("drawn", "shared", "ordinal"), "consensus-tracks")
    train = numbered.where("number >= 0")

    drawn = _draws(enough.select(scene, "train"), scene, trials, seed).join(train.select(scene, "number", *SOURCE, *TARGET), [scene, "number"])
    fits = _fit(_moments(drawn, scene, "trial"), scene, "trial").where("scale IS NOT NULL")
    fits = written(fits, "consensus-trials")
    models = fits.groupBy(scene).agg(F.collect_list(F.struct("trial", *MODEL)).alias("models"))  # TRIALS at most
    tried = train.join(models, scene).withColumn("errors", F.transform("models", lambda m: F.struct(m["trial"].alias("trial"), error(m).alias("error"))))
    agreeing = tried.select(scene, "threshold", F.explode("errors").alias("e")).where(F.col("e.error") <= F.col("threshold"))
    scored = agreeing.groupBy(scene, F.col("e.trial").alias("trial")).agg(F.count("*").alias("agree"), F.sum("e.error").alias("errors"))
    best = scored.groupBy(scene).agg(F.max(F.struct("agree", -F.col("errors"), -F.col("trial"))).alias("best")).select(scene, F.col("best.agree").alias("inliers"), (-F.col("best.col3")).alias("trial"))
    chosen = written(best.join(fits, [scene, "trial"]), "consensus-best")

    inliers = train.join(chosen, scene).where(error() <= F.col("threshold")).select(scene, "track", *SOURCE, *TARGET)
    agreed = inliers.join(enough.join(best, scene).where((F.col("inliers") >= LEAST_INLIERS) & (F.col("inliers") >= LEAST_SHARE * F.col("train"))).select(scene), scene)
    final = written(_fit(_moments(agreed, scene), scene), "consensus-models")
    apart = numbered.where("number < 0").join(final, scene).withColumn("error", error())
    checks = apart.groupBy(scene).agg(F.avg((F.col("error") <= F.col("threshold")).cast("double")).alias("agreeing"))
    middle = exact_quantiles(apart.select(scene, "error"), [scene], "error", [0.5]).select(scene, F.col("value").alias("median_error"))
    looked = inliers.select(scene, "track").unionByName(numbered.where("number < 0").select(scene, "track"))
    points = single.select(scene, "track", "s.*").join(tracks.select(scene, "track", *TARGET), [scene, "track"]).join(looked, [scene, "track"]).join(final, scene)
    worst = points.groupBy(scene, "track").agg(F.max(error()).alias("disagreement"))
    spread = exact_quantiles(worst.select(scene, "disagreement"), [scene], "disagreement", [0.5]).select(scene, F.col("value").alias("median_disagreement"))

    table = scenes
    for part in (best.select(scene, "inliers"), final, checks, middle, spread):
        table = table.join(part, scene, "left")
    count = F.coalesce("inliers", F.lit(0))
    steady = (F.col("median_error") <= F.col("threshold")) & (F.col("agreeing") >= HELD_OUT_SHARE) & (F.col("median_disagreement") <= F.col("threshold"))
    rules = (F.col("tracks") < LEAST_TRACKS, (count < LEAST_INLIERS) | (count < LEAST_SHARE * F.col("train")), F.col("scale").isNull(), ~F.coalesce(steady, F.lit(False)))
    reason = F.coalesce(*[F.when(rule, F.lit(name)) for rule, name in zip(rules, REASONS)])
    judged = table.withColumn("reason", reason)
    shown = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in MODEL]
    return judged.select(scene, F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status"), "reason", "tracks", "train", count.alias("inliers"), "held_out", "extent", "threshold", "median_error", "agreeing", "median_disagreement", *shown)
