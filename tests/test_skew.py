"""Self-joins of hot keys, and exact hulls."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pointweave.operators import association, graph, reviews, skew


def pairs_of(cells, by, name):
    met = cells.alias("a").join(cells.alias("b"), skew.meet(by) & (F.col(f"a.{name}") < F.col(f"b.{name}")))
    return sorted(map(tuple, met.select(*[f"a.{c}" for c in by], f"a.{name}", f"b.{name}").collect()))


def test_each_pair_meets_once(spark):
    rows = [("hot", i) for i in range(90)] + [("cold", i) for i in range(5)] + [(None, 1), (None, 2)]
    frame = spark.createDataFrame(rows, "key string, id long")
    want = sorted((k, i, j) for k, n in (("hot", 90), ("cold", 5)) for i in range(n) for j in range(i + 1, n))
    for block in (7, 30, 1000):
        assert pairs_of(skew.pair_cells(frame, ["key"], block), ["key"], "id") == want


def test_no_cell_of_a_hot_key_is_large(spark):
    """A point of 10,000 regions: no cell has more than two blocks, so none has the 10^8 pairs of the whole."""
    frame = spark.range(10_000).select(F.lit(1).alias("point"), "id")
    sizes = skew.pair_cells(frame, ["point"], 500).groupBy("cell.low", "cell.high").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert sizes[0] < 1300 and sizes[1] == 20 * 21 / 2 and sizes[2] == 10_000 * 20


def test_operators_agree_whatever_the_blocks(spark, monkeypatch):
    rng = random.Random(3)
    support = [(f"k{k:03}", f"f{k % 9}", p) for k in range(60) for p in {1, *(rng.randrange(30) for _ in range(8))}]
    frame = spark.createDataFrame(support, "key string, frame string, point long")
    pixels = frame.select("frame", F.col("key").alias("class"), F.lit(1).alias("one"), (F.col("point") % 5).alias("pixel")).distinct()
    masks = frame.select(F.col("key").alias("mask"), "frame").distinct().select("mask", "frame", F.lit("m").alias("level"), F.substring("mask", 4, 1).alias("label"), F.when(F.col("mask") < "k010", F.substring("mask", 3, 1)).alias("object_id"))

    def found():
        overlap = association.support_overlap(frame)
        links = association.mask_links(frame.select(F.col("key").alias("mask"), "point"), masks, 0.1, 1)
        inside = graph.containment_pairs(pixels)
        return [sorted(map(str, x.collect())) for x in (overlap, links, inside)]

    want = found()
    assert all(want)
    monkeypatch.setattr(skew.pair_cells, "__defaults__", (4,))
    assert found() == want


def test_masks_that_share_much_are_compared_in_blocks(spark, monkeypatch):
    """Labels whose masks share many points make no row a pair and point; those that share few still meet at points."""
    rng = random.Random(12)
    names = [f"m{i:03}" for i in range(90)]
    held = {m: rng.sample(range(40), rng.randrange(1, 20)) if i % 2 else rng.sample(range(100 * (i % 30), 100 * (i % 30) + 30), 7) for i, m in enumerate(names[:88])}
    meta = {m: (i % 5 if i % 11 else None, "l" if i % 7 else None, f"x{i % 2}" if i % 13 else None, f"o{i % 3}" if i % 4 == 0 else None) for i, m in enumerate(names)}
    want = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            (fa, la, xa, oa), (fb, lb, xb, ob) = meta[a], meta[b]
            shared = len(set(held.get(a, ())) & set(held.get(b, ())))
            score = shared / max(1, min(len(held.get(a, ())), len(held.get(b, ()))))
            if la is None or la != lb:
                continue
            if oa is not None and oa == ob:
                want.append((a, b, shared, 2.0))
            elif not (oa and ob) and None not in (fa, fb) and fa != fb and xa is not None and xa == xb and shared >= 2 and score >= 0.3:
                want.append((a, b, shared, score))
    supports = spark.createDataFrame([(m, p) for m, own in held.items() for p in own], "mask string, point long")
    masks = spark.createDataFrame([(m, *meta[m]) for m in names], "mask string, frame long, level string, label string, object_id string")
    met, cells = [], association.pair_cells
    monkeypatch.setattr(association, "pair_cells", lambda rows, by: met.append(rows) or cells(rows, by))
    for block in (2_000, 7):
        monkeypatch.setattr(association, "BLOCK_MASKS", block, raising=False)
        assert sorted(map(tuple, association.mask_links(supports, masks, 0.3, 2).collect())) == want
        assert {r["label"] for rows in met for r in rows.select("label").distinct().collect()} == {"x0"}


def test_shared_points_are_counted_whatever_their_number():
    rng = random.Random(4)
    held = [sorted(rng.sample(range(3000), rng.randrange(40)) + rng.sample(range(3000, 3009), 5)) for _ in range(70)] + [[], []]
    row, point = association.np.array([(i, p) for i, own in enumerate(held) for p in own]).T
    for left, right in ((range(0, 40), range(40, 72)), (range(72), range(72)), (range(70, 72), range(3))):
        want = [[len(set(held[i]) & set(held[j])) for j in right] for i in left]
        assert association.shared_points(row, point, association.np.array(left), association.np.array(right)).tolist() == want


def exact_area(points):
    """Twice the hull's area by gift wrapping in fractions."""
    pts = sorted({(Fraction(x), Fraction(y)) for x, y in points})
    if len(pts) < 3:
        return 0.0
    ring, here = [], pts[0]
    while True:
        ring.append(here)
        best = next(p for p in pts if p != here)
        for p in pts:
            turn = (best[0] - here[0]) * (p[1] - here[1]) - (best[1] - here[1]) * (p[0] - here[0])
            far = (p[0] - here[0]) ** 2 + (p[1] - here[1]) ** 2 > (best[0] - here[0]) ** 2 + (best[1] - here[1]) ** 2
            if turn < 0 or turn == 0 and far:
                best = p
        here = best
        if here == pts[0]:
            break
    return float(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2)


def test_hulls_are_exact(spark):
    rng = random.Random(8)
    angle = math.radians(0.7)
    thin = [(x * math.cos(angle) - y * math.sin(angle), x * math.sin(angle) + y * math.cos(angle)) for x, y in ((0, 0), (1000, 0), (500, 1))]
    groups = {
        "thin": thin, "grid": [(float(x), float(y)) for x in range(9) for y in range(9)] * 3, "line": [(0.1 * i, 0.3 * i) for i in range(40)],
        "circle": [(math.cos(k), math.sin(k)) for k in range(500)], "cloud": [(rng.gauss(0, 1), rng.gauss(5, 1e-9)) for _ in range(3000)], "one": [(2.0, 3.0)] * 4, "two": [(0.0, 0.0), (1.0, 1.0)],
    }
    rows = [(g, u, v) for g, own in groups.items() for u, v in own] + [("grid", None, 1.0), ("grid", float("inf"), 1.0), ("gone", float("nan"), 0.0)]
    frame = spark.createDataFrame(rows, "g string, u double, v double").repartition(6)
    got = {r["g"]: r["area"] for r in reviews.hull_area(frame, "g").collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g] == pytest.approx(exact_area(own), rel=1e-9, abs=1e-12), g
    few = {(r["g"], r["u"], r["v"]) for r in reviews.hull_corners(frame, "g", at_once=30).collect()}
    assert few == {(r["g"], r["u"], r["v"]) for r in reviews.hull_corners(frame, "g").collect()}


def test_many_small_hulls_are_found_together(spark, monkeypatch):
    """Groups of a few points, as orders have: no call of Python a group, in either size of a task's hold; large ones go through sweeps and walks."""
    rng = random.Random(5)
    small = [(g, float(rng.randrange(1, 6)), round(rng.uniform(1, 9), 2)) for g in range(6000) for _ in range(rng.randrange(1, 8))]
    curve = [(-1, float(x), float(x * x)) for x in range(400)] + [(-1, 399.5, -9e5)] + [(-2, 0.1 * i, 0.3 * i) for i in range(60)] + [(None, 1e-200 * i, 1e-200 * i * i) for i in range(9)]
    frame = spark.createDataFrame(small + curve, "g long, u double, v double").repartition(5)
    calls = []
    monkeypatch.setattr(type(frame.groupBy("g")), "applyInPandas", lambda *a, **k: calls.append(a))
    want = {}
    for g, u, v in small + curve:
        want.setdefault(g, []).append((u, v))
    for at_once in (1, 100_000):
        got = {r["g"]: r["area"] for r in reviews.hull_area(frame, "g", at_once).collect()}
        assert set(got) == set(want) and not calls
        for g in [-1, -2, None, *range(0, 6000, 7)]:
            assert got[g] == pytest.approx(exact_area(want[g]), rel=1e-9, abs=1e-12), g
    corners = {}
    for r in reviews.hull_corners(frame, "g", 50).collect():
        corners.setdefault(r["g"], []).append((r["u"], r["v"]))
    for g in [-1, -2, None, *range(0, 6000, 11)]:
        assert sorted(corners[g]) == sorted(reviews.convex_hull(want[g]))
