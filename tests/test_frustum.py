"""The frustum index gives the rows of all pairs, without pairing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import frustum, projection

NAMES = ["frame", "fx", "fy", "cx0", "cy0", "width", "height", *[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2"]


def camera(name, rng, place, f=300.0):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    move = -q @ place
    return (name, f, 0.9 * f, 160.0, 118.5, 320, 240, *q.ravel().tolist(), *move.tolist())


@pytest.fixture(scope="module")
def views(spark):
    rng = np.random.default_rng(3)
    rows = [camera(f"c{k}", rng, rng.normal(size=3) * 4) for k in range(12)] + [camera("inside", rng, np.zeros(3), -80.0), camera("far", rng, np.array([1e6, 0, 0]))]
    return spark.createDataFrame(rows, NAMES)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.normal(size=(3000, 3)), rng.normal(size=(200, 3)) * 0.01, [[0, 0, 0]] * 3])
    rows = [(i, *p) for i, p in enumerate(xyz.tolist())] + [(9000, None, 0.0, 0.0), (9001, float("nan"), 0.0, 0.0), (9002, float("inf"), 0.0, 0.0)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double").withColumn("camera", F.lit("mine"))


def rows_of(df):
    return sorted(map(tuple, df.select("frame", "point_id", "u", "v", "depth", "camera").collect()))


def test_same_rows_as_all_pairs(cloud, views):
    got = rows_of(projection.project_inside(cloud, views))
    assert got == rows_of(projection.project(cloud, views).where(projection.inside_image())) and len(got) > 500


def test_most_pairs_are_never_made(cloud, views):
    made = frustum.candidates(cloud, views)
    inside, paired, whole = projection.project_inside(cloud, views).count(), made.count(), cloud.count() * views.count()
    assert inside <= paired < 0.5 * whole and paired < 3 * inside
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("levels", [1, 3, 6])
def test_depth_of_the_tree_changes_nothing(cloud, views, levels):
    inside = lambda df: projection._on_image(projection._in_camera(df), 1e-5).where(projection.inside_image())
    assert rows_of(inside(frustum.candidates(cloud, views, levels=levels))) == rows_of(projection.project_inside(cloud, views))


def test_flat_scenes_and_no_rows(spark, cloud, views):
    flat = cloud.where("point_id < 50").withColumns({"x": F.lit(0.5), "y": F.lit(-0.25), "z": F.lit(0.0)})
    assert rows_of(projection.project_inside(flat, views)) == rows_of(projection.project(flat, views).where(projection.inside_image()))
    assert projection.project_inside(cloud.limit(0), views).count() == 0 and projection.project_inside(cloud, views.limit(0)).count() == 0
