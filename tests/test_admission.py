"""Gates, retrieval, packages and exports."""

import io
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import numeric
from pointweave.functions import text as t
from pointweave.operators import admission, neighbours, relations, retrieval, reviews
from pointweave.sources import packages, ply, scene_files
from pointweave.streaming import resume

from .test_sources import points


def test_rigid_matrices(spark):
    eye, flip, loose = ([[1.0, x, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, z]] for x, z in ((0.0, 1.0), (0.0, -1.0), (0.1, 1.0)))
    rows = spark.createDataFrame([(0, eye), (1, flip), (2, loose), (3, [[float("nan")] * 3] * 3)], "i int, m array<array<double>>")
    assert [bool(r[0]) for r in rows.orderBy("i").select(admission.rigid(F.col("m"))).collect()] == [True, False, False, False]


def test_edge_digests_do_not_depend_on_order(spark):
    rows = [("a", i, i / 7) for i in range(50)] + [("b", 1, 0.5)]
    frame = spark.createDataFrame(rows, "edge string, frame long, value double")
    one = {r["edge"]: (r["frames"], r["digest"]) for r in admission.edge_digests(frame, "edge").collect()}
    two = {r["edge"]: (r["frames"], r["digest"]) for r in admission.edge_digests(frame.repartition(7).orderBy(F.desc("value")), "edge").collect()}
    assert one == two and one["a"][0] == 50
    other = frame.withColumn("value", F.when(F.col("frame") == 7, 0.0).otherwise(F.col("value")))
    assert {r["edge"]: r["digest"] for r in admission.edge_digests(other, "edge").collect()}["a"] != one["a"][1]


def test_row_counts_of_observations(spark):
    rows = [("a", 0, 0.5, 2), ("a", 1, 0.5, 2), ("b", 0, 0.5, 2), ("c", 0, 0.5, None), ("d", 0, 0.5, 2), ("d", 0, 0.5, 2), ("e", 0, 0.5, 1)]
    frame = spark.createDataFrame(rows, "frame string, class_index int, confidence double, rows long").withColumns({"least": F.lit(0.0), "greatest": F.lit(1.0)})
    found = {r["frame"]: r["problem"] for r in admission.observation_problems(frame, 5, "rows").collect()}
    assert found == {"a": None, "b": "row_count", "c": "row_count", "d": "class_twice", "e": None}
    assert {r["frame"]: r["problem"] for r in admission.observation_problems(frame, 5).collect()}["b"] is None


def test_near_images_vote_for_each_other(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (40, 16))
    rows = [(int(i % 4), int(i), v.tolist()) for i, v in enumerate(base)] + [(int((i + 1) % 4), int(100 + i), (v + rng.normal(0, 0.02, 16)).tolist()) for i, v in enumerate(base)]
    frame = spark.createDataFrame(rows, "image long, place long, vector array<double>")
    for exact_rows in (10_000, 10):
        assert {tuple(r) for r in retrieval.retrieval_pairs(frame, exact_rows=exact_rows).collect()} >= {(0, 1), (1, 2), (2, 3), (0, 3)}


def test_index_finds_nine_tenths_of_neighbours(spark):
    """12 nearest of every tenth of 2,000 vectors by the index, against all pairs; and blocks change nothing."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    stored = e.select(F.col("vec_id").alias("near"), F.col("embedding").alias("vector"), "label")
    asked = stored.where("near % 10 = 0").withColumnRenamed("near", "query")
    cells = neighbours.fitted(stored, "label", "vector", 12, exact_rows=100)
    assert cells.probes < len(cells.centres) == 44
    found = {(r["query"], r["near"]) for r in neighbours.k_nearest(asked, stored, 12, cells).collect()}
    held = stored.orderBy("near").collect()
    matrix = np.array([r["vector"] for r in held], np.float64)
    d = ((matrix[::10][:, None, :] - matrix[None]) ** 2).sum(2)
    want = {(10 * i, int(j)) for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:12]}
    assert len(found) == len(want) == 2400 and len(found & want) >= 0.9 * len(want)
    exact = {(r["query"], r["near"]) for r in neighbours.k_nearest(asked, stored, 12, None).collect()}
    assert exact == want


def test_blocks_and_odd_vectors_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    rows = [(i, [float(i % 10), 1.0]) for i in range(60)] + [(100, None)]
    stored = spark.createDataFrame(rows, "near long, vector array<double>")
    found = neighbours.k_nearest(stored.where("near in (0, 100)").withColumnRenamed("near", "query"), stored, 8, None).collect()
    assert sorted((r["d"], r["near"]) for r in found) == [(0.0, i) for i in range(0, 60, 10)] + [(1.0, 1), (1.0, 11)]
    assert neighbours.k_nearest(stored.limit(0).withColumnRenamed("near", "query"), stored, 3, None).count() == 0


def test_votes_of_images_are_exact_beyond_ten_thousand(spark):
    """12,000 descriptors: the image of each query's own votes, against all pairs; an index finds some of them only."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id", "label", "embedding")
    moved = e.crossJoin(spark.range(6).withColumnRenamed("id", "k"))
    frame = moved.selectExpr("(label + 10 * (vec_id % 4)) AS image", "vec_id + 2000 * k AS place", "transform(embedding, (x, i) -> x + k * sin(vec_id * 7 + i) / 9) AS vector")
    rows = sorted((r["image"], r["place"], r["vector"]) for r in frame.collect())
    matrix = np.array([r[2] for r in rows], np.float64)
    images = {}
    for at, r in enumerate(rows):
        images.setdefault(r[0], []).append(at)
    want = set()
    for image, own in images.items():
        votes = {}
        for at in {own[k * (len(own) - 1) // 4] for k in range(5)}:
            for near in {rows[j][0] for j in np.argsort(((matrix - matrix[at]) ** 2).sum(1), kind="stable")[:12]} - {image}:
                votes[near] = votes.get(near, 0) + 1
        want |= {(min(image, near), max(image, near)) for near in sorted(votes, key=lambda n: (-votes[n], n))[:3]}
    assert len(rows) == 12_000 and {tuple(r) for r in retrieval.retrieval_pairs(frame, queries=5, most=3).collect()} == want


def test_ratio_matches_need_no_table_of_all_pairs(spark, monkeypatch):
    """The nearest two of each block give the matches of all pairs, and a descriptor brings two rows a block, not one a pair."""
    rng = np.random.default_rng(9)
    base = rng.normal(0, 1, (150, 6))
    vectors = np.concatenate([base, base + rng.normal(0, 0.2, base.shape), base[:20], base[:20]]).round(2)
    rows = [(int(i % 3) if i % 50 else None, int(i // 150 % 2), int(i), v.tolist()) for i, v in enumerate(vectors)] + [(1, 0, 900, None), (7, 0, 901, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "label int, side int, name long, vector array<float>")
    a, b = frame.alias("a"), frame.alias("b")
    far = F.sqrt(retrieval.squared_distance(F.col("a.vector"), F.col("b.vector")))
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.side") != F.col("b.side")) & far.isNotNull())
    want = sorted(map(tuple, retrieval.ratio_matches(pairs.select("a.side", F.col("a.name").alias("q"), F.col("b.name").alias("t"), far.alias("d")), 0.9).collect()))
    assert len(want) > 30
    for block in (4_096, 17):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
        near = retrieval.nearest_across(frame, "label")
        assert sorted(map(tuple, retrieval.ratio_matches(near, 0.9).collect())) == want
        assert near.count() <= 2 * len(rows) * (1 if block > 1000 else 12)


def test_closest_rows_whatever_they_hold():
    rng = np.random.default_rng(2)
    held = np.concatenate([rng.integers(0, 3, (300, 4)) + 1e6, np.full((40, 4), 7.0), [[np.inf] * 4, [1e200] * 4, [np.nan] * 4]])
    asked = np.concatenate([held[::9], rng.normal(1e6, 1, (20, 4)), held[-3:]])
    for k, root in ((2, True), (12, False), (500, False)):
        i, j, d = neighbours.closest(asked, held, k, root)
        with np.errstate(all="ignore"):
            apart = np.cumsum((asked[:, None] - held[None]) ** 2, axis=2)[:, :, -1]
        for q, row in enumerate(np.sqrt(apart) if root else apart):
            want = np.lexsort((np.arange(len(held)), row))[:k]
            assert j[i == q].tolist() == want.tolist() and np.array_equal(d[i == q], row[want], equal_nan=True)


def test_triangulation_of_a_turned_camera(spark):
    rng = random.Random(4)
    angle = 0.3
    turn = np.array([[np.cos(angle), 0, np.sin(angle)], [0, 1, 0], [-np.sin(angle), 0, np.cos(angle)]])
    shift = np.array([-0.5, 0.1, 0.2])
    rows = []
    for _ in range(20):
        p = np.array([rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(3, 6)])
        q = turn @ p + shift
        rows.append((p.tolist(), [p[0] / p[2], p[1] / p[2]], [q[0] / q[2], q[1] / q[2]]))
    frame = spark.createDataFrame([tuple(list(map(float, x)) for x in r) for r in rows], "p array<double>, a array<double>, b array<double>")
    matrix = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in turn])
    at = lambda c: [F.col(c)[0], F.col(c)[1]]
    got = frame.select("p", numeric.triangulated(at("a"), at("b"), matrix, F.array(*[F.lit(float(x)) for x in shift])).alias("q")).collect()
    assert all(np.allclose(r["p"], r["q"]) for r in got)


def test_prompt_spans(spark):
    rows = [("Red Car. wheel .", ["red car", "wheel"]), ("red car wheel.", ["red car", "wheel"]), ("red car. wheel. tree", ["red car", "wheel"]), (" a.. b", ["a.", "b"]), ("a", ["--"]), ("", ["a"]), (None, ["a"]), ("wheel. red car", ["red car", "wheel"])]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, l array<string>")
    got = [r[0] and [tuple(x) for x in r[0]] for r in frame.orderBy("i").select(t.prompt_spans("p", "l")).collect()]
    assert got == [[(0, 7), (9, 14)], None, None, [(1, 2), (5, 6)], None, None, None, None]


def test_built_in_relations(spark):
    labels = spark.createDataFrame([("stuffed bear",), ("car",), ("wheel",)], "label string")
    got = {(r["label"], r["added"]) for r in relations.expand_vocabulary(labels, relations.relation_table(spark)).collect()}
    assert got == {("stuffed bear", False), ("car", False), ("wheel", False), ("bear nose", True), ("bear ear", True), ("car window", True)}


def zipped(tmp_path, name, files, manifest=True, **odd):
    listed = [{"path": p, "bytes": len(c), "sha256": __import__("hashlib").sha256(c).hexdigest()} for p, c in files.items()]
    with zipfile.ZipFile(tmp_path / name, "w") as z:
        for p, c in files.items():
            z.writestr(p, c)
        for p, c in odd.get("extra", {}).items():
            z.writestr(p, c)
        if manifest:
            z.writestr("manifest.json", json.dumps({"files": odd.get("listed", listed)}))
    return str(tmp_path / name)


def problems(spark, path, **limits):
    found = packages.package_problems(packages.archive_members(spark, path), **limits)
    return sorted(((r["path"], r["problem"]) for r in found.collect()), key=str)


def test_packages(spark, tmp_path):
    good = zipped(tmp_path, "a.zip", {"x/a.json": b"{}", "b.npz": b"123"})
    assert problems(spark, good) == []
    files = {r["path"]: bytes(r["content"]) for r in packages.extracted(packages.archive_members(spark, good)).collect()}
    assert files == {"x/a.json": b"{}", "b.npz": b"123"}
    assert problems(spark, good, suffixes=(".json",)) == [("b.npz", "suffix")]
    assert problems(spark, good, most_files=1) == [(None, "files")] and problems(spark, good, most_bytes=3) == [(None, "bytes")]
    assert problems(spark, zipped(tmp_path, "b.zip", {"a": b"1"}, extra={"../up": b"x", "A": b"2"})) == [("../up", "undeclared"), ("../up", "unsafe_path"), ("A", "repeated"), ("A", "undeclared"), ("a", "repeated")]
    assert problems(spark, zipped(tmp_path, "c.zip", {"a": b"1"}, listed=[{"path": "a", "bytes": 1, "sha256": "0" * 64}, {"path": "gone", "bytes": 1, "sha256": "0" * 64}])) == [("a", "changed"), ("gone", "missing")]
    assert (None, "manifest") in problems(spark, zipped(tmp_path, "d.zip", {"a": b"1"}, manifest=False))
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    with zipfile.ZipFile(good, "a") as z:
        z.writestr(link, b"/etc/passwd")
    assert ("link", "link") in problems(spark, good)
    with pytest.raises(ValueError, match="link"):
        packages.extracted(packages.archive_members(spark, good))


def test_packages_are_built_whole(spark, tmp_path):
    rows = [("p", "a/b.json", b"{}"), ("p", "c.bin", b"\0" * 1000), ("q", "only", b"")]
    built = packages.build_packages(spark.createDataFrame(rows, "package string, path string, content binary")).collect()
    for r in built:
        (tmp_path / f"{r['package']}.zip").write_bytes(r["archive"])
        assert problems(spark, str(tmp_path / f"{r['package']}.zip")) == []
        with zipfile.ZipFile(io.BytesIO(r["archive"])) as z:
            assert {n: z.read(n) for n in z.namelist() if n != "manifest.json"} == {p: c for k, p, c in rows if k == r["package"]}
    with pytest.raises(Exception, match="unsafe"):
        packages.build_packages(spark.createDataFrame([("p", "/etc/x", b"")], "package string, path string, content binary")).collect()


def test_manifests_of_folders(spark, tmp_path):
    (tmp_path / "f" / "g").mkdir(parents=True)
    (tmp_path / "f" / "g" / "a.txt").write_bytes(b"abc")
    got = packages.file_manifest(spark, str(tmp_path / "f")).collect()
    assert [(r["path"], r["bytes"], r["sha256"][:8]) for r in got] == [("g/a.txt", 3, "ba7816bf")]


def test_imports_go_by_suffix(spark, tmp_path):
    source = points(spark, 9)
    ply.write_points(source, str(tmp_path / "s.ply"), degree=1)
    scene_files.write_lines(source, {"metadata": {}}, str(tmp_path / "s.jsonl"), size=4)
    assert packages.import_scene(spark, str(tmp_path / "s.ply")).count() == packages.import_scene(spark, str(tmp_path / "s.jsonl")).count() == 9
    (tmp_path / "s.json").write_text(json.dumps({"gaussians": [{"position": [1.0, 2.0, 3.0]}]}))
    assert packages.import_scene(spark, str(tmp_path / "s.json")).collect()[0]["position"] == [1.0, 2.0, 3.0]
    (tmp_path / "s.txt").write_text("x")
    with pytest.raises(ValueError, match="suffix"):
        packages.import_scene(spark, str(tmp_path / "s.txt"))
    with pytest.raises(ValueError, match="mode"):
        packages.import_scene(spark, str(tmp_path / "s.ply"), "huge")


def test_previews_keep_places(spark, tmp_path):
    path = str(tmp_path / "p.ply")
    ply.write_points(points(spark, 11), path, degree=1)
    got = sorted(r["source_index"] for r in ply.read_preview(spark, path, 4).collect())
    assert got == np.linspace(0, 10, 4).astype(int).tolist()
    assert ply.read_preview(spark, path, 50).count() == 11 and ply.read_preview(spark, path).count() == 11


def test_sidecars_are_bound(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("source_index"), (F.col("id") % 5).alias("initial_point_index"), (F.col("id") % 3).cast("int").alias("code"))
    folder = str(tmp_path / "side")
    assert packages.write_sidecar(rows, folder, "ab")["rows"] == 20
    assert packages.load_sidecar(spark, folder, "ab").count() == 20
    with pytest.raises(ValueError, match="another"):
        packages.load_sidecar(spark, folder, "cd")
    rows.limit(3).write.mode("append").parquet(f"{folder}/rows")
    with pytest.raises(ValueError, match="record"):
        packages.load_sidecar(spark, folder, "ab")
    for bad in (rows.withColumn("code", F.lit(7)), rows.union(rows.limit(1)), rows.where("source_index <> 4")):
        with pytest.raises(ValueError, match="every"):
            packages.write_sidecar(bad, str(tmp_path / "no"), "ab")


def test_exports_are_staged(spark, tmp_path):
    target = tmp_path / "out"
    export = packages.Export(spark, str(target))
    export.write(spark.range(5))
    assert not target.exists()
    export.finish()
    assert spark.read.parquet(str(target)).count() == 5
    again = packages.Export(spark, str(target))
    again.write(spark.range(2))
    with pytest.raises(FileExistsError):
        again.finish()
    small = packages.Export(spark, str(tmp_path / "small"), most_bytes=10)
    with pytest.raises(ValueError, match="limit"):
        small.write(spark.range(100))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_summaries_are_flat(spark, tmp_path):
    rows = spark.createDataFrame([("b", (1, 2.5)), ("a", (3, None))], "name string, m struct<n: int, v: double>")
    packages.write_summary(rows, str(tmp_path / "csv"), "name")
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_text().splitlines() == ["name,m.n,m.v", "a,3,", "b,1,2.5"]


def test_lines_arrive_as_a_stream(spark, tmp_path):
    source = points(spark, 7)
    (tmp_path / "in").mkdir()
    scene_files.write_lines(source, {"metadata": {}}, str(tmp_path / "in" / "a.jsonl"), size=3)
    run = scene_files.stream_lines(spark, str(tmp_path / "in")).select("ordinal", "position").writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r["ordinal"] for r in spark.read.json(str(tmp_path / "out")).collect()) == list(range(7))
    bad = json.dumps({"format": scene_files.CHUNK, "offset": 0, "count": 2, "gaussians": []})
    (tmp_path / "in" / "b.jsonl").write_text(bad + "\n")
    run = scene_files.stream_lines(spark, str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="chunk is invalid"):
        run.awaitTermination(120)


def test_hulls(spark):
    rng = random.Random(2)
    square = [("s", x, y) for x in (0.0, 1.0) for y in (0.0, 2.0)] + [("s", rng.random(), 2 * rng.random()) for _ in range(200)]
    line = [("l", i / 7, i / 7) for i in range(8)]
    turn = [("c", math.cos(k * 0.01), math.sin(k * 0.01)) for k in range(629)]
    frame = spark.createDataFrame([*square, *line, *turn, ("n", None, 1.0)], "g string, u double, v double")
    got = {r["g"]: r["area"] for r in reviews.hull_area(frame, "g").collect()}
    assert got["s"] == pytest.approx(2.0) and got["l"] == pytest.approx(0.0) and got["c"] == pytest.approx(math.pi, rel=1e-3) and "n" not in got


def test_streams_resume_with_their_settings_alone(spark, tmp_path):
    root = str(tmp_path / "s")
    first = resume.resume_folder(spark, root, {"a": 1, "b": [1, 2]})
    assert resume.resume_folder(spark, root, {"b": [1, 2], "a": 1}) == first
    with pytest.raises(ValueError, match="settings"):
        resume.resume_folder(spark, root, {"a": 2})


def test_anchors_and_annotations(spark, tmp_path):
    rows = [("a", 1, 2, 0.5), ("a", 3, 4, 0.25), ("b", 1, 1, float("nan")), ("b", 1, 1, 2.0), ("c", 0, 0, -1.0)]
    found = reviews.anchors_by_view(spark.createDataFrame(rows, "view string, px long, py long, inverse_depth double"), str(tmp_path / "anchors"))
    assert sorted(map(tuple, found.collect())) == [("a", 2, 0.25, 0.5), ("b", 1, 2.0, 2.0)]
    (tmp_path / "m.json").write_text(json.dumps({"f1": [{"label": "chair", "polygon": [[0, 0], [2, 0], [2, 2]]}], "f2": []}))
    (row,) = packages.read_annotations(spark, str(tmp_path / "m.json")).collect()
    assert tuple(row) == ("f1", "chair", [0.0, 2.0, 2.0], [0.0, 0.0, 2.0])
    assert reviews.not_too_near(spark.createDataFrame([(1,), (2,)], "query_id long"), spark.createDataFrame([(1, 0.0001), (2, 0.5)], "query_id long, distance double"), 1.0).count() == 1
