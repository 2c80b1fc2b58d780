"""Files: round trips, limits and refusals."""

import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.sources import evidence, ply, scene_files


def points(spark, n=7):
    rows = [(7 * i, [i * 1.0, -i * 0.5, 2.0], [0.1, 0.2, 0.3], [1.0, 0.0, 0.0, 0.0], [0.2, 0.5, 0.8], 0.25 + i / 100, 1, [0.01 * (i + k) for k in range(12)], "observed", 0.9, False, None, []) for i in range(n)]
    schema = scene_files.POINT.removeprefix("struct<").removesuffix(">").replace(": ", " ")
    return spark.createDataFrame(rows, schema)


def test_ply_round_trip(spark, tmp_path):
    source = points(spark)
    path = str(tmp_path / "a.ply")
    assert ply.write_points(source, path, degree=1) == 7
    header = ply.describe(path)
    assert (header.count, header.degree, header.format) == (7, 1, "ascii")
    got = ply.read_points(spark, path, rowsPerPartition="3").orderBy("source_index").collect()
    want = source.orderBy("source_index").collect()
    assert [r["source_index"] for r in got] == list(range(7))
    for a, b in zip(got, want):
        assert np.allclose(a["position"], b["position"]) and np.allclose(a["scale"], b["scale"]) and np.allclose(a["sh"], b["sh"]) and a["opacity"] == pytest.approx(b["opacity"], abs=1e-6)


def test_ply_binary_and_refusals(spark, tmp_path):
    names = list(ply.REQUIRED)
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 5\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
    data = np.arange(5 * len(names), dtype="<f4").reshape(5, -1) / 50
    path = tmp_path / "b.ply"
    path.write_bytes(head.encode() + data.tobytes())
    raw = ply.read_raw(spark, str(path), rowsPerPartition="2").orderBy("source_index").collect()
    assert [r["z"] for r in raw] == pytest.approx(data[:, 2].tolist())
    with pytest.raises(Exception, match="limit"):
        ply.read_raw(spark, str(path), maxPoints="3").count()
    for broken in (b"plx\n", head.replace("rot_3", "rot_9").encode(), head.replace("vertex 5", "vertex 0").encode(), b"ply\nformat ascii 1.0\n"):
        path.write_bytes(broken)
        with pytest.raises(ValueError):
            ply.describe(str(path))
    bad = points(spark).withColumn("opacity", F.lit(math.nan))
    with pytest.raises(ValueError, match="finite"):
        ply.write_points(bad, str(tmp_path / "c.ply"))


def test_lines_round_trip_in_chunks(spark, tmp_path):
    path = str(tmp_path / "scene.jsonl")
    source = points(spark, 5)
    assert scene_files.write_lines(source, {"metadata": {}}, path, size=2) == 5
    chunks = [json.loads(x) for x in open(path)][1:]
    assert [(c["offset"], c["count"]) for c in chunks] == [(0, 2), (2, 2), (4, 1)]
    got = scene_files.read_lines(spark, path).orderBy("ordinal").drop("ordinal").collect()
    assert got == source.orderBy("source_index").collect()


def test_long_lines_are_halved(spark):
    lines = scene_files.chunk_lines(points(spark, 5), size=5, most_bytes=900).orderBy("offset").collect()
    assert len(lines) > 1 and all(len(r["line"]) <= 900 for r in lines)
    assert sum(json.loads(r["line"])["count"] for r in lines) == 5


def test_broken_lines_are_refused(spark, tmp_path):
    path = str(tmp_path / "scene.jsonl")
    scene_files.write_lines(points(spark, 5), {}, path, size=2)
    lines = open(path).read().splitlines(keepends=True)
    for broken in (lines[:2] + lines[3:], lines[1:], lines[:3], lines[:3] + [lines[3].rstrip("\n")], lines + lines[-1:]):
        with open(path, "w") as f:
            f.writelines(broken)
        with pytest.raises(ValueError):
            scene_files.read_lines(spark, path)


def test_manifest_round_trip(spark, tmp_path):
    source = points(spark, 9)
    assert scene_files.write_manifest(source, {}, str(tmp_path), threshold=9) is None
    path = scene_files.write_manifest(source, {}, str(tmp_path), size=4, threshold=3)
    assert scene_files.read_manifest(spark, path).orderBy("ordinal").drop("ordinal").collect() == source.orderBy("source_index").collect()
    manifest = json.load(open(path))
    manifest["chunks"][0]["path"] = "../" + manifest["chunks"][0]["path"]
    with open(path, "w") as f:
        json.dump(manifest, f)
    with pytest.raises(ValueError):
        scene_files.read_manifest(spark, path)


def array_file(a):
    out = io.BytesIO()
    np.save(out, a)
    return bytearray(out.getvalue())


def test_masks_and_regions(spark):
    grid = np.zeros((4, 4), np.uint8)
    grid[1:3, 2] = 5
    files = spark.createDataFrame([("f", "m", array_file(grid))], "frame string, mask_id string, content binary")
    assert sorted(tuple(r) for r in evidence.mask_pixels(files).collect()) == [("f", "m", 2, 1), ("f", "m", 2, 2)]
    levels = np.stack([np.full((2, 2), -1), np.array([[0, 0], [1, -1]])])
    arrays = spark.createDataFrame([("a", array_file(levels)), ("b", bytearray(b"never opened"))], "frame string, content binary")
    split = spark.createDataFrame([("a", "train"), ("b", "test")], "frame string, part string")
    pixels, skipped = evidence.import_regions(arrays, split)
    assert pixels.count() == 3 and [tuple(r) for r in skipped.collect()] == [("b", "part:test")]


def test_model_files(spark, tmp_path):
    points3d = [(k, [k * 1.0, 2.0, 3.0], [1, 2, 3], 0.5 + k, [(1, 0), (2, k)]) for k in range(3)]
    evidence.write_model([(1, 1, 640, 480, [500.0, 500.0, 320.0, 240.0])], [(1, 1, "ä.png", [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0], [(1.0, 2.0, 7), (3.0, 4.0, -1)])], iter(points3d), 3, str(tmp_path))
    with pytest.raises(ValueError, match="3 points"):
        evidence.write_model([], [], iter(points3d), 4, str(tmp_path.parent))
    assert evidence.read_model(spark, str(tmp_path), "cameras").first()["params"] == [500.0, 500.0, 320.0, 240.0]
    image = evidence.read_model(spark, str(tmp_path), "images").first()
    assert (image["name"], image["points"]) == ("ä.png", 2)
    assert [tuple(r)[0:1] + (r["error"], r["image_ids"]) for r in evidence.read_model(spark, str(tmp_path), "points3D").orderBy("point_id").collect()] == [(k, 0.5 + k, [1, 2]) for k in range(3)]


def test_polygons_and_photo_limits(spark):
    square = spark.createDataFrame([("f", "x", 6, 6, [1.0, 4.0, 4.0, 1.0], [1.0, 1.0, 4.0, 4.0])], "frame string, label string, width int, height int, xs array<double>, ys array<double>")
    assert evidence.polygon_pixels(square).count() == 9
    photos = spark.createDataFrame([("a", 10, "h"), ("b", 31_000_000, "h")], "path string, bytes long, sha256 string")
    assert evidence.photo_limits(photos).first()["problem"] == "photo_bytes"
