"""Counter-examples on tiny tables."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pointweave.functions import numeric, text
from pointweave.operators import association, binding, editing, graph, metrics, ordering, projection, regions, validation


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_pixel_winner_prefers_depth_then_id(spark):
    seen = spark.createDataFrame([("a", 1, 1, 2.0, 5), ("a", 1, 1, 1.0, 9), ("a", 1, 1, 1.0, 4), ("a", 2, 1, 3.0, 1)], "frame string, px int, py int, depth double, point_id long")
    assert values(projection.pixel_winners(seen, "frame", "px", "py"), "px", "point_id") == [(1, 4), (2, 1)]


def test_image_test_is_on_the_continuous_centre(spark):
    cameras = spark.createDataFrame([("f", 1.0, 1.0, 0.0, 0.0, 4, 4, *[1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 0.0, 0.0, 0.0)], ["frame", "fx", "fy", "cx0", "cy0", "width", "height", *[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2"])
    points = spark.createDataFrame([(1, -0.001, 1.0, 1.0), (2, 3.999, 1.0, 1.0), (3, 4.0, 1.0, 1.0), (4, 1.0, 1.0, 1.0)], "point_id long, x double, y double, z double")
    seen = projection.project(points, cameras).withColumn("opacity", F.lit(1.0))
    assert values(projection.visible_grid(seen), "point_id", "px") == [(2, 3), (4, 1)]
    # 3.999 rounds to 4 and is clipped to the last pixel.
    assert values(projection.visible_points(seen), "point_id", "px") == [(2, 3), (4, 1)]


def test_core_region_leaves_the_outlier_out(spark):
    rng = random.Random(1)
    rows = [(i, "a", rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2)) for i in range(100)] + [(100, "a", 100.0, 100.0, 100.0), (101, "a", math.nan, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, g string, x double, y double, z double")
    found = regions.core_region(points, "g", "id")
    row = found.first()
    assert row["eligible"] == 101 and row["radius"] < 0.5
    assert regions.within_core(points, found, "g").where("id = 100").isEmpty()


@pytest.mark.parametrize("rule", ["truncate", "nearest", "floor", "stride"])
def test_even_samples_follow_their_formula(spark, rule):
    for n, k in itertools.product((1, 2, 5, 33, 97), (1, 2, 7, 33)):
        step = (n - 1) / (k - 1) if k > 1 else 0
        picks = {
            "truncate": lambda i: n - 1 if i == k - 1 else math.floor(i * step),
            "nearest": lambda i: n - 1 if i == k - 1 else round(i * step),
            "floor": lambda i: math.floor(i * (n - 1) / (k - 1)),
            "stride": lambda i: math.floor(i * n / k),
        }[rule]
        expected = set(range(n)) if n <= k else {0} if k == 1 else {picks(i) for i in range(k)}
        got = spark.range(n).where(ordering.evenly(F.col("id"), F.lit(n), k, rule)).collect()
        assert {r["id"] for r in got} == expected, (rule, n, k)


def test_ordinals_cross_partitions(spark):
    rows = spark.createDataFrame([(i % 3, (i * 7919) % 1009) for i in range(1000)], "g long, k long").repartition(7)
    got = ordering.with_ordinal(rows, ["k"], ["g"], total="n").collect()
    for g in range(3):
        keys = sorted((r["k"], r["ordinal"]) for r in got if r["g"] == g)
        assert [o for _, o in keys] == list(range(len(keys))) and all(r["n"] == len(keys) for r in got if r["g"] == g)


def test_depth_order_refuses_nan(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, -1.0)], "i long, d double")
    assert [r["i"] for r in ordering.front_to_back(rows, "d", "i").collect()] == [3, 1, 2]
    with pytest.raises(Exception, match="finite"):
        ordering.front_to_back(spark.createDataFrame([(1, math.nan)], "i long, d double"), "d", "i").collect()


def region_rows(spark, rows):
    support = [(f"{f}/{r}", f, "object", p) for f, r, points in rows for p in points]
    return spark.createDataFrame(support, "key string, frame string, g string, point long")


def test_shared_points_match_and_labels_do_not(spark):
    rules = association.MatchRules(min_shared=3)
    same = association.score_pairs(association.support_overlap(region_rows(spark, [("a", "1", (1, 2, 3, 4)), ("b", "1", (1, 2, 3, 4))]), "g"), rules)
    assert association.mutual_best(same).count() == 1
    apart = association.support_overlap(region_rows(spark, [("a", "1", (1, 2, 3)), ("b", "1", (4, 5, 6))]), "g")
    assert apart.isEmpty()


def test_an_ambiguous_choice_is_no_choice(spark):
    rows = [("a", "1", range(10)), ("b", "1", range(10)), ("b", "2", range(10))]
    found = association.score_pairs(association.support_overlap(region_rows(spark, rows), "g"))
    assert found.count() == 2 and association.mutual_best(found).isEmpty()


def test_groups_hold_one_region_a_frame(spark):
    nodes = spark.createDataFrame([("a1", "a"), ("b1", "b"), ("a2", "a"), ("c1", "c"), ("d", "d")], "key string, frame string")
    links = spark.createDataFrame([("a1", "b1", 0.9), ("a2", "b1", 0.8), ("b1", "c1", 0.7), ("a2", "c1", 0.6)], "a string, b string, score double")
    groups, log = association.constrained_groups(nodes, links)
    assert values(groups, "key", "group") == [("a1", "a1"), ("a2", "a2"), ("b1", "a1"), ("c1", "a1"), ("d", "d")]
    assert values(log.where("NOT accepted"), "a", "b") == [("a2", "b1"), ("a2", "c1")]


def test_agreement_of_a_single_view_is_unknown(spark):
    members = spark.createDataFrame([("t", "a/1", "a", 1.0), ("t", "b/1", "b", 0.5), ("u", "c/1", "c", 1.0)], "track string, key string, frame string, confidence double")
    support = spark.createDataFrame([("a/1", 1), ("a/1", 2), ("b/1", 1), ("c/1", 7)], "key string, point long")
    visible = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "frame string, point long")
    got = {r["key"]: (r["agreement"], r["reliability"]) for r in association.leave_one_out(members, support, visible).collect()}
    assert got["a/1"][0] == 0.5 and got["b/1"][0] == 1.0 and got["c/1"] == (None, 0.35)


def test_components_and_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(500, 501)], "a long, b long")
    comps = graph.connected_components(chain)
    assert comps.where("component = 0").count() == 151 and comps.where("component = 500").count() == 2
    edges = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "x")], "child string, parent string")
    assert values(graph.without_cycles(edges), "child", "parent") == [("z", "x")]
    assert values(graph.on_cycles(graph.closure(edges)), "node") == [("x",), ("y",)]


def test_containment_needs_two_views(spark):
    pixels = [(f, c, p) for f in ("a", "b") for c, n in (("small", 4), ("large", 25)) for p in range(n)]
    pixels += [("c", "small", 0), ("c", "large", 900)]
    found = graph.containment_pairs(spark.createDataFrame(pixels, "frame string, class string, pixel long"))
    observed = spark.createDataFrame(sorted({(f, c) for f, c, _ in pixels}), "frame string, class string")
    rows = {(r["child"], r["parent"]): r for r in graph.containment_support(found, observed).collect()}
    assert rows["small", "large"]["sufficient"] and rows["small", "large"]["valid"] == 3 and rows["small", "large"]["min_containment"] == 0
    assert not rows["large", "small"]["sufficient"]


def test_union_confidence_is_the_mean_of_the_best(spark):
    rows = [("f", "x", p, 0.4) for p in range(4)] + [("f", "x", p, 0.9) for p in (3, 4, 5, 6)]
    row = metrics.class_targets(spark.createDataFrame(rows, "frame string, class string, pixel long, confidence double")).first()
    assert row["area"] == 7 and row["confidence"] == pytest.approx((3 * 0.4 + 4 * 0.9) / 7)


def test_metric_bounds(spark):
    pixels = spark.createDataFrame([("same", 0.5, 0.5), ("black", 0.0, 1.0), ("none", None, 0.1)], "view string, truth double, image double")
    got = {r["view"]: r["psnr"] for r in metrics.psnr_by(pixels, "view").collect()}
    assert got == {"same": 120.0, "black": 0.0, "none": None}
    rows = spark.createDataFrame([("x", 1, 2, 0.5), ("x", 9, 90, 0.1), ("y", 0, 4, 0.0)], "label string, intersection long, union long, iou double")
    pooled = {r["label"]: r["iou"] for r in metrics.iou_macro(rows).collect()}
    assert pooled["x"] == pytest.approx(10 / 92) and pooled["y"] == 0
    grid = spark.createDataFrame([("v", x, y, (x * y % 7) / 7, (x * y % 7) / 7) for x in range(12) for y in range(12)], "view string, px int, py int, truth double, image double")
    assert metrics.ssim_by_view(grid).first()["ssim"] == pytest.approx(1.0)


def test_sidecars_of_other_scenes_are_refused(spark):
    rows = spark.createDataFrame([(3,), (0,), (2,)], "source_index long")
    sidecar = spark.createDataFrame([(0, "x"), (3, "y")], "source_index long, label string")
    bound = binding.bind_sidecar(rows, sidecar, {"count": 4}, {"count": 4})
    assert values(bound, "source_index", "known") == [(0, True), (2, False), (3, True)]
    with pytest.raises(ValueError, match="count"):
        binding.bind_sidecar(rows, sidecar, {"count": 4}, {"count": 5})


def test_validators_name_the_rule(spark):
    schema = "id long, position array<double>, scale array<double>, rotation array<double>, color array<double>, opacity double, sh_degree int, sh array<double>"
    good = (1, [0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [1.0, 0.0, 0.0, 0.0], [0.0, 0.5, 1.0], 0.5, 0, [0.0, 0.0, 0.0])
    bad = [(2, [0.0, math.inf, 0.0], *good[2:]), (3, *good[1:2], [1.0, 0.0, 1.0], *good[3:]), (4, *good[1:5], math.nan, *good[6:]), (5, *good[1:7], [0.0]), (6, None, *good[2:])]
    rows = spark.createDataFrame([good, *bad], schema)
    assert values(validation.broken(rows, validation.scene_rules(), "id"), "id", "rule") == [(2, "position"), (3, "scale"), (4, "opacity"), (5, "sh"), (6, "position")]
    with pytest.raises(ValueError, match="position"):
        validation.check(rows, validation.scene_rules(), "id")


OBJECTS = [("scene", None, "room", "scene", []), ("t", "scene", "Table", "object", ["桌子"]), ("leg", "t", "leg", "part", []), ("c", "scene", "chair", "object", ["椅子"])]


def objects(spark):
    return spark.createDataFrame([(*o, True, False, False) for o in OBJECTS], "id string, parent_id string, label string, level string, aliases array<string>, visible boolean, deleted boolean, priority boolean")


def test_commands_parse(spark):
    def parse(request):
        c = spark.range(1).select(text.command(F.lit(request)).alias("c")).first()["c"]
        return c and tuple(c)

    assert parse("隐藏所有椅子") == ("hide", "椅子", True)
    assert parse("show all chairs") == ("show", "chairs", True)
    assert parse("只显示椅子") == ("isolate", "椅子", True)
    assert parse("取消加强椅子") == ("priority", "椅子", False)
    assert parse("undo")[0] == "undo"
    assert parse("  ") is None and parse("x" * 1001) is None
    with pytest.raises(ValueError):
        editing.Command.parse("  ")
    with pytest.raises(ValueError):
        editing.Command("format", "disk")


def test_edits_reach_parts_and_keep_rows(spark):
    base = objects(spark)
    command = editing.Command.parse("delete table")
    selected = editing.resolve(base, command)
    assert values(selected, "node") == [("leg",), ("t",)]
    after = editing.apply_to_objects(base, selected, command)
    assert values(after, "id", "visible", "deleted") == [("c", True, False), ("leg", False, True), ("scene", True, False), ("t", False, True)]
    isolated = editing.apply_to_objects(base, selected, editing.Command("isolate", "table"))
    assert values(isolated.where("visible"), "id") == [("leg",), ("scene",), ("t",)]
    points = spark.createDataFrame([(1, False, 1.0), (2, False, 1.0)], "item long, hidden boolean, weight double")
    members = spark.createDataFrame([(1, "leg"), (2, "c")], "item long, node string")
    assert values(editing.apply_to_points(points, members, selected, command), "item", "hidden") == [(1, True), (2, False)]


def test_undo_on_an_empty_history_does_nothing(spark):
    log = [("s", i, a) for i, a in enumerate(["undo", "hide", "hide", "undo", "undo", "undo", "show"])]
    kept = editing.fold_log(spark.createDataFrame(log, "scene string, seq int, action string"))
    assert values(kept, "seq") == [(6,)]


def test_the_history_keeps_so_many_commands(spark):
    log = [("s", i, "hide") for i in range(30)] + [("s", 30 + i, "undo") for i in range(25)] + [(None, 0, "show"), (None, 1, "search")]
    kept = editing.fold_log(spark.createDataFrame(log, "scene string, seq int, action string"))
    assert values(kept, "seq") == [(0,), *((i,) for i in range(10))]
    assert editing.fold_log(kept.where("false")).count() == 0


def test_requests_for_priority(spark):
    def labels(request):
        return [tuple(r) for r in spark.range(1).select(text.request_labels(F.lit(request)).alias("r")).first()["r"]]

    assert labels("请优先重建小熊、Red  Lamp；熊") == [("小熊", "stuffed bear", "dictionary"), ("Red  Lamp", "red lamp", "literal")]
    assert labels("a and b/c") == [("a and b/c", "a and b/c", "literal")] and labels("") == []
    assert len(labels(",".join(f"n{i}" for i in range(20)))) == 20
    for refused in (",".join(["same"] * 21), "x" * 1001):
        with pytest.raises(Exception, match="a request"):
            labels(refused)


def test_labels_and_numbers(spark):
    rows = spark.createDataFrame([("  Ｔａｂｌｅ – Top ", [1.0, 0.0, 0.0], 32.0)], "s string, v array<double>, f double")
    row = rows.select(text.normalize_label("s"), numeric.cosine(F.col("v"), F.col("v")), text.int_hash(F.lit("hello")), text.fenced_json(F.lit('```json\n{"a": 1}\n```')), numeric.sh_degree(F.lit(24))).first()
    assert tuple(row) == ("table-top", 1.0, 99162322, '{"a": 1}', 2)
