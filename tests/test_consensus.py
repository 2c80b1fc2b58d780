"""Alignment by consensus against a plain search, and why scenes are rejected."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import consensus, ordering

SCHEMA = "scene string, track long, frame string, sx double, sy double, sz double, tx double, ty double, tz double"


def turned(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q * [1, 1, -1]


def scene(name, rng, n=60, wrong=0, noise=0.001, frames=2, flat=False):
    """Samples of tracks whose targets are 2.5 times the turned source, moved; the last ``wrong`` tracks are off."""
    rotation, move = turned(rng), np.array([3.0, -1.0, 0.5])
    points = rng.normal(size=(n, 3)) * ([1, 0, 0] if flat else [1, 1, 1])
    targets = 2.5 * points @ rotation.T + move
    targets[n - wrong :] += rng.normal(size=(wrong, 3)) * 4
    rows = [(name, i, f"f{k}", *(points[i] + noise * rng.normal(size=3)).tolist(), *targets[i].tolist()) for i in range(n) for k in range(frames)]
    return rows, rotation, move


@pytest.fixture(scope="module")
def found(spark):
    rng = np.random.default_rng(5)
    good, rotation, move = scene("good", rng, wrong=5)
    rows = good + scene("few", rng, n=15)[0] + scene("one frame", rng, frames=1)[0] + scene("wild", rng, wrong=40)[0] + scene("line", rng, flat=True, noise=0)[0] + scene("noisy", rng, noise=0.25, frames=6)[0]
    rows += [("good", 0, "f0", *good[0][3:6], *good[0][6:]), ("good", 70, "f0", None, 1.0, 1.0, 1.0, 1.0, 1.0), ("good", 71, "f1", float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0), ("gone", None, "f1", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("models", F.lit("x"))
    return {r["scene"]: r for r in consensus.align(frame.repartition(5), "scene").collect()}, rotation, move, rows


def test_transform_is_found_among_outliers(found):
    by_scene, rotation, move, _ = found
    row = by_scene["good"]
    assert row["status"] == "accepted" and row["reason"] is None and row["tracks"] == 60 and row["held_out"] == 12 and row["train"] == 48
    assert abs(row["scale"] - 2.5) < 0.01
    assert np.allclose(np.array([row[c] for c in consensus.ROTATION]).reshape(3, 3), rotation, atol=0.01)
    assert np.allclose([row["m0"], row["m1"], row["m2"]], move, atol=0.02)


def test_refit_equals_all_inliers_of_a_plain_search(found):
    """The inliers are those of the transform of some minimal sample, and the final one is fitted to them all."""
    by_scene, *_, rows = found
    row = by_scene["good"]
    points = {}
    for _, track, frame, *xyz in rows[:120]:
        points.setdefault(track, []).append(xyz)
    mean = np.array([np.mean(v, axis=0) for _, v in sorted(points.items())])
    model = np.array([row[c] for c in consensus.MODEL])
    error = np.linalg.norm(model[0] * mean[:, :3] @ model[1:10].reshape(3, 3).T + model[10:] - mean[:, 3:], axis=1)
    assert (error <= row["threshold"]).sum() >= row["inliers"] and 30 <= row["inliers"] <= 48
    extent = np.linalg.norm(mean[:, 3:].std(0))
    assert abs(row["extent"] - extent) < 1e-9 and abs(row["threshold"] - 0.04 * extent) < 1e-9


def test_closed_form_equals_least_squares():
    rng = np.random.default_rng(0)
    s, rotation = rng.normal(size=(50, 3)), turned(rng)
    t = 0.3 * s @ rotation.T + [1, 2, 3]
    a, b = s - s.mean(0), t - t.mean(0)
    row = consensus.similarity((b.T @ a / 50)[None], (a.T @ a / 50)[None], s.mean(0)[None], t.mean(0)[None])[0]
    assert np.allclose(row, [0.3, *rotation.ravel(), 1, 2, 3])
    mirrored = t * [-1, 1, 1]
    b = mirrored - mirrored.mean(0)
    row = consensus.similarity((b.T @ a / 50)[None], (a.T @ a / 50)[None], s.mean(0)[None], mirrored.mean(0)[None])[0]
    assert np.linalg.det(row[1:10].reshape(3, 3)) > 0.99


def test_reasons(found):
    by_scene, *_ = found
    assert by_scene["few"]["reason"] == by_scene["one frame"]["reason"] == consensus.REASONS[0]
    assert by_scene["wild"]["reason"] == by_scene["line"]["reason"] == consensus.REASONS[1]
    assert by_scene["noisy"]["reason"] in consensus.REASONS[1:] and by_scene["noisy"]["scale"] is None
    assert set(by_scene) == {"good", "few", "one frame", "wild", "line", "noisy"}


def test_draws_are_three_different_numbers(spark):
    scenes = spark.createDataFrame([("a", 3), ("b", 40)], "scene string, train long")
    drawn = {}
    for r in consensus._draws(scenes, "scene", 60, 7).collect():
        drawn.setdefault((r["scene"], r["trial"]), set()).add(r["number"])
    assert len(drawn) == 120 and all(len(x) == 3 and min(x) >= 0 and max(x) < (3 if k[0] == "a" else 40) for k, x in drawn.items())


def test_quantiles_equal_percentiles(spark):
    rows = spark.range(997).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 11 > 0, F.sin("id")).alias("x")).where("g < 6 OR id < 20")
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {(r["g"], r["share"]): r["value"] for r in ordering.exact_quantiles(rows, ["g"], "x", shares).collect()}
    want = {(r["g"], s): v for r in rows.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect() for s, v in zip(shares, r["q"])}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
