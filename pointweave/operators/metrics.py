"""Evaluation: image error, mask overlap, coverage and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ERROR = 1e-12
WINDOW, SIGMA = 11, 1.5
INNER = 2


def psnr(mse: Column) -> Column:
    """Peak signal-to-noise ratio in dB of a mean squared error of unit-range values; null for no pixels."""
    return F.when(mse.isNotNull(), -10 * F.log10(F.greatest(mse, F.lit(LEAST_ERROR))))


def psnr_by(pixels: DataFrame, *by: str, truth: str = "truth", image: str = "image") -> DataFrame:
    """(by, pixels, mse, psnr) over rows with both values; ``by`` may be a view, a label's region or both."""
    d = F.col(truth) - F.col(image)
    return pixels.groupBy(*by).agg(F.count(d).alias("pixels"), F.avg(d * d).alias("mse")).withColumn("psnr", psnr(F.col("mse")))


def _smooth(a: np.ndarray) -> np.ndarray:
    x = np.arange(WINDOW) - WINDOW // 2
    g = np.exp(-(x**2) / (2 * SIGMA**2))
    g /= g.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(lambda v: np.convolve(v, g, "valid"), axis, a)
    return a


def ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Structural similarity of each window centre of two unit-range images (11 by 11, Gaussian of 1.5)."""
    c1, c2 = 0.01**2, 0.03**2
    ma, mb = _smooth(a), _smooth(b)
    va, vb, cov = _smooth(a * a) - ma**2, _smooth(b * b) - mb**2, _smooth(a * b) - ma * mb
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))


def ssim_by_view(pixels: DataFrame, view: str = "view") -> DataFrame:
    """(view, ssim, centres) from (view, px, py, truth, image[, inside]); a view is one image, so it fits a task.

    With ``inside``, centres outside it do not count; views below the window's size have a null value.
    """
    kind = pixels.schema[view].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["py"].max()) + 1, int(pdf["px"].max()) + 1
        grids = np.zeros((3, h, w))
        grids[2] = "inside" not in pdf
        at = pdf["py"].to_numpy(int), pdf["px"].to_numpy(int)
        for k, c in enumerate(("truth", "image", "inside")):
            if c in pdf:
                grids[k][at] = pdf[c].to_numpy(float)
        value, n = None, 0
        if h >= WINDOW and w >= WINDOW:
            half = WINDOW // 2
            held = grids[2][half : h - half, half : w - half] > 0
            n = int(held.sum())
            value = float(ssim(grids[0], grids[1])[held].mean()) if n else None
        return pd.DataFrame({view: [pdf[view].iloc[0]], "ssim": [value], "centres": [n]})

    return pixels.groupBy(view).applyInPandas(one, f"{view} {kind}, ssim double, centres long")


def overlap(truth: DataFrame, predicted: DataFrame, *by: str) -> DataFrame:
    """(by, intersection, union, iou) of two pixel sets with columns ``by`` and pixel; iou is null if both are empty."""
    a = truth.select(*by, "pixel").distinct().withColumn("t", F.lit(1))
    b = predicted.select(*by, "pixel").distinct().withColumn("p", F.lit(1))
    both = a.join(b, [*by, "pixel"], "full_outer").groupBy(*by)
    sums = both.agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("intersection"), F.count("*").alias("union"))
    return sums.withColumn("iou", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")))


def iou_macro(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per label: pooled intersection over pooled union, and the mean of the views' own values; null values stay out."""
    pooled = rows.groupBy(label).agg(F.sum("intersection").alias("intersection"), F.sum("union").alias("union"), F.avg("iou").alias("mean_view_iou"), F.count("iou").alias("views"))
    return pooled.withColumn("iou", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")))


def mean_iou(rows: DataFrame, label: str = "label") -> DataFrame:
    """The unweighted mean of the labels' pooled values."""
    return iou_macro(rows, label).agg(F.avg("iou").alias("miou"), F.count("iou").alias("labels"))


def group_means(rows: DataFrame, groups: Sequence[str], *metrics: str) -> DataFrame:
    """Means by each of the groups alone and over all, in one pass; nulls stay out."""
    means = [F.avg(m).alias(m) for m in metrics]
    return rows.groupingSets([[F.col(g)] for g in groups] + [[]], *[F.col(g) for g in groups]).agg(*means, F.grouping_id().alias("grouping"))


def inner_boundary(pixels: DataFrame, *by: str, radius: int = INNER) -> DataFrame:
    """Pixels of a mask (by, px, py) whose square neighbourhood of ``radius`` leaves the mask: what erosion takes away.

    Each pixel votes for its neighbours by an equi-join; (2 radius + 1) ** 2 votes mean it is inside.
    """
    steps = F.array(*[F.lit(d) for d in range(-radius, radius + 1)])
    votes = pixels.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    votes = votes.select(*by, (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py"))
    full = votes.groupBy(*by, "px", "py").count().where(F.col("count") == (2 * radius + 1) ** 2).drop("count")
    return pixels.join(full, [*by, "px", "py"], "left_anti")


def touches_border(pixels: DataFrame, sizes: DataFrame, frame: str = "frame", *by: str) -> DataFrame:
    """(frame, by, touches) whether a mask has a pixel on its image's border."""
    edge = (F.col("px") == 0) | (F.col("py") == 0) | (F.col("px") == F.col("width") - 1) | (F.col("py") == F.col("height") - 1)
    return pixels.join(sizes, frame).groupBy(frame, *by).agg(F.bool_or(edge).alias("touches"))


def mask_statistics(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(frame, mask_id, area, fraction, x0, y0, x1, y1, touches) of each mask."""
    edge = (F.col("px") == 0) | (F.col("py") == 0) | (F.col("px") == F.col("width") - 1) | (F.col("py") == F.col("height") - 1)
    agg = pixels.join(sizes, "frame").groupBy("frame", "mask_id", "width", "height").agg(F.count("*").alias("area"), *[f(c).alias(n) for f, c, n in ((F.min, "px", "x0"), (F.min, "py", "y0"), (F.max, "px", "x1"), (F.max, "py", "y1"))], F.bool_or(edge).alias("touches"))
    return agg.withColumn("fraction", F.col("area") / (F.col("width") * F.col("height"))).drop("width", "height")


def class_targets(pixels: DataFrame) -> DataFrame:
    """(frame, class, area, confidence) of each class's union of masks: its pixels' mean of their largest confidence.

    ``pixels`` has (frame, class, pixel, confidence).
    """
    best = pixels.groupBy("frame", "class", "pixel").agg(F.max("confidence").alias("c"))
    return best.groupBy("frame", "class").agg(F.count("*").alias("area"), F.avg("c").alias("confidence"))


def class_catalog(records: DataFrame, label: str = "label", raw: str = "raw_label", frame: str = "frame") -> DataFrame:
    """(label, sources, views): each class's spellings and the number of frames it is seen in."""
    return records.groupBy(label).agg(F.array_join(F.array_sort(F.collect_set(raw)), "|").alias("sources"), F.count_distinct(frame).alias("views"))


def object_statistics(points: DataFrame, by: str, confidence: str = "confidence", source: str = "source") -> DataFrame:
    """(by, count, inferred, unknown, mean_confidence) with non-finite confidences left out of the mean."""
    c = F.col(confidence)
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return points.groupBy(by).agg(F.count("*").alias("count"), F.count_if(F.col(source) == "inferred").alias("inferred"), F.count_if(F.coalesce(source, F.lit("unknown")) == "unknown").alias("unknown"), F.avg(F.when(ok, c)).alias("mean_confidence"))


def cell_coverage(points: DataFrame, by: str, cells: int = 8, border: float = 0.05) -> DataFrame:
    """(by, occupied, edge) from unit-square positions (u, v): share of cells with a point, and of points near the border."""
    cell = lambda c: F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor(F.col(c) * cells)))
    near = (F.col("u") < border) | (F.col("u") > 1 - border) | (F.col("v") < border) | (F.col("v") > 1 - border)
    return points.groupBy(by).agg((F.count_distinct(cell("u") * cells + cell("v")) / float(cells * cells)).alias("occupied"), F.avg(near.cast("double")).alias("edge"))


def supervision_coverage(views: DataFrame, visits: DataFrame) -> DataFrame:
    """(eligible, visited, uncovered, least_visits) of views against their visits."""
    counts = views.select("view").join(visits.groupBy("view").agg(F.count("*").alias("n")), "view", "left")
    n = F.coalesce("n", F.lit(0))
    return counts.agg(F.count("*").alias("eligible"), F.count_if(n > 0).alias("visited"), F.count_if(n == 0).alias("uncovered"), F.min(n).alias("least_visits"))


def membership_diagnostics(members: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """(unknown, multilabel, violations): shares of points with no and with several classes, and (point, child) without its parent class."""
    counts = points.select("point").join(members.groupBy("point").agg(F.count("*").alias("n")), "point", "left")
    n = F.coalesce("n", F.lit(0))
    shares = counts.agg(F.avg((n == 0).cast("double")).alias("unknown"), F.avg((n > 1).cast("double")).alias("multilabel"))
    needed = members.join(edges.select(F.col("child").alias("class"), "parent"), "class").select("point", F.col("parent").alias("class"))
    broken = needed.join(members, ["point", "class"], "left_anti").agg(F.count("*").alias("violations"))
    return shares.crossJoin(broken)


def segmentation_loss(rows: DataFrame, by: str = "class", p: str = "p", y: str = "y", eps: float = 1e-6) -> DataFrame:
    """(by, bce, dice): cross-entropy with both signs weighing the same, and one minus the Dice overlap."""
    q = F.greatest(F.lit(eps), F.least(F.col(p), F.lit(1 - eps)))
    pos, neg = F.when(F.col(y) > 0, -F.log(q)), F.when(F.col(y) <= 0, -F.log(1 - q))
    balanced = (F.coalesce(F.avg(pos), F.lit(0.0)) + F.coalesce(F.avg(neg), F.lit(0.0))) / (F.greatest(F.lit(1), F.when(F.count(pos) > 0, 1).otherwise(0) + F.when(F.count(neg) > 0, 1).otherwise(0)))
    dice = 1 - (2 * F.sum(F.col(p) * F.col(y)) + eps) / (F.sum(p) + F.sum(y) + eps)
    return rows.groupBy(by).agg(balanced.alias("bce"), dice.alias("dice"))


def depth_anchors(observations: DataFrame, by: str = "view", depth: str = "depth", residual: str = "residual") -> DataFrame:
    """(by, anchors, median_inverse_depth, worst_residual) of points in front of the camera."""
    ahead = F.col(depth) > 0
    return observations.groupBy(by).agg(F.count_if(ahead).alias("anchors"), F.percentile(F.when(ahead, 1 / F.col(depth)), F.lit(0.5)).alias("median_inverse_depth"), F.max(F.when(ahead, F.col(residual))).alias("worst_residual"))


def mean_observation(observations: DataFrame, by: str, *values: str) -> DataFrame:
    """Means over each point's training observations: colours or reprojection errors."""
    return observations.groupBy(by).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("observations"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """(digest, n): one SHA-256 of a bag of rows, whatever their order, without bringing the rows together.

    Row digests are added as 64-bit numbers modulo 2**64 in four lanes, and the sums hashed.
    """
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{k}") for k in range(4)]
    return rows.select(*lanes, F.count("*").alias("n")).select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"l{k}"), F.lit(0)).cast("string") for k in range(4)], "n"), 256).alias("digest"), "n")
