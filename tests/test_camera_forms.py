"""Forms of cameras against numpy, and what makes one unusable."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import numeric
from pointweave.operators import cameras

SCHEMA = "name string, world_to_camera array<double>, camera_to_world array<double>, R array<double>, t array<double>, K array<double>, fx double, fy double, cx double, cy double"
GOOD = (None, 5.0, None, 1.0, 2.0)


def test_forms_agree_with_numpy(spark):
    rng = random.Random(4)
    whole = np.vstack([np.array([[rng.uniform(-2, 2) for _ in range(4)] for _ in range(3)]), [0, 0, 0, 1]])
    flat, singular, tilted = whole.ravel().tolist(), np.diag([1.0, 1.0, 0.0, 1.0]).ravel().tolist(), [*whole.ravel()[:12].tolist(), 0.0, 0.0, 1.0, 1.0]
    turn, move = whole[:3, :3].ravel().tolist(), whole[:3, 3].tolist()
    k = [6.0, 0.1, 4.0, 0.0, 7.0, 2.0, 0.0, 0.0, 1.0]
    rows = [
        ("direct", flat, singular, None, None, *GOOD),
        ("back", None, flat, turn, move, k, None, None, None, None),
        ("parts", None, None, turn, move, *GOOD),
        ("singular", None, singular, None, None, *GOOD),
        ("tilted", None, tilted, None, None, *GOOD),
        ("short", flat[:15], None, None, None, *GOOD),
        ("no_pose", None, None, turn, None, *GOOD),
        ("nan", [float("nan"), *flat[1:]], None, None, None, *GOOD),
        ("negative", flat, None, None, None, None, 5.0, -1.0, 1.0, 2.0),
        ("absent", flat, None, None, None, None, None, None, 1.0, 2.0),
        ("endless", flat, None, None, None, [float("inf"), *k[1:]], 5.0, 5.0, 1.0, 2.0),
    ]
    got = {r["name"]: r for r in cameras.camera_form(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {n: r["problem"] for n, r in got.items()} == dict(direct=None, back=None, parts=None, singular="pose", tilted="pose", short="pose", no_pose="pose", nan="pose", negative="intrinsics", absent="intrinsics", endless="intrinsics")
    assert got["back"]["matrix"] == pytest.approx(np.linalg.inv(whole).ravel().tolist(), abs=1e-9)
    assert got["direct"]["matrix"] == got["parts"]["matrix"] == flat
    assert got["back"]["focal"] == [6.0, 7.0] and got["back"]["centre"] == [4.0, 2.0] and got["parts"]["focal"] == [5.0, 5.0]


def test_missing_columns_are_problems_not_errors(spark):
    assert [r["problem"] for r in cameras.camera_form(spark.createDataFrame([("a",)], "name string")).collect()] == ["pose"]


def test_quaternions_of_half_turns_and_others(spark):
    """Half turns, where w is zero, and random rotations come back; the first component that is not zero is positive."""
    rng = random.Random(9)
    given = [(1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (0.0, 0.6, -0.8, 0.0), (1e-5, 0.0, 0.0, 1.0)]
    given += [tuple(rng.gauss(0, 1) for _ in range(4)) for _ in range(40)]
    rows = spark.createDataFrame([(i, list(q)) for i, q in enumerate(given)], "i long, q array<double>")
    got = {r["i"]: r["p"] for r in rows.select("i", numeric.quaternion_matrix(F.col("q")).alias("r")).select("i", numeric.matrix_quaternion(F.col("r")).alias("p")).collect()}
    for i, q in enumerate(given):
        first = next(x for x in q if x)
        want = np.array(q) / np.linalg.norm(q) * np.sign(first)
        assert got[i] == pytest.approx(want.tolist(), abs=1e-9)
    odd = spark.createDataFrame([([1.0, None] + [0.0] * 7,), (None,), ([1.0],)], "r array<double>")
    assert [r[0] for r in odd.select(numeric.matrix_quaternion(F.col("r"))).collect()] == [None] * 3
