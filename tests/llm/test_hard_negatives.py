"""Hard negatives against all pairs, and what the bounds leave out."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import hard_negatives as hn
from pointweave.llm import registry

SCHEMA = "vec_id long, embedding array<float>, label int, a string, n int"


def brute(rows, is_anchor):
    """All pairs in Python integers; rows are (id, vector, label)."""
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, v, y in ok:
        if not is_anchor(i) or (i, tuple(v), y) in seen:
            continue
        seen.add((i, tuple(v), y))
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z == y) for j, w, z in ok if j != i and len(w) == len(v)]
        for p, positive, _ in sorted(x for x in scored if x[2])[:5]:
            fit = sorted((n, j) for n, j, same in scored if not same and 50 * -p <= 100 * -n <= 95 * -p)[:3]
            out += [(i, positive, rank, j, -p, -n) for rank, (n, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(frame, every):
    found = hn.mine(frame, F.col("label"), F.col("vec_id") % every == 0)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 12))
    vectors = [(int(i), (centres[i % 4] + 0.6 * rng.normal(size=12)).round(3).tolist(), int(rng.integers(3))) for i in range(220)]
    odd = [(300, None, 1), (301, [0.5] * 12, None), (None, [0.5] * 12, 1), (302, [float("nan")] + [0.1] * 11, 1), (303, [None] + [0.1] * 11, 1), (304, [float("-inf")] * 12, 0), (305, [], 1), (310, [], 1), (307, [], 2), (309, [1.0, 2.0], 1), (320, [1.0, 2.5], 1), (311, [0.7, 1.5], 0)]
    return vectors + odd + vectors[10:14] + [vectors[20]] * 9 + [(30, vectors[31][1], 2), (30, vectors[30][1], 2)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 7) for i, v, y in rows], SCHEMA)


@pytest.mark.parametrize("block, queries", [(1 << 19, 1 << 18), (300, 90)])
def test_equals_all_pairs(spark, rows, monkeypatch, block, queries):
    monkeypatch.setattr(hn, "BLOCK_VALUES", block)
    monkeypatch.setattr(hn, "QUERY_VALUES", queries)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 150 and mined(frame(spark, rows), 10) == want


def test_ties_and_zero_and_negative_scores(spark):
    rows = [(i, [float(x) for x in v], y) for i, (v, y) in enumerate([((1, 0), 0), ((1, 0), 0), ((0.75, 0), 1), ((0.75, 0), 1), ((0.75, 0.5), 1), ((0.75, -1), 1), ((0, 1), 0), ((-1, 0), 0), ((0, 0), 2), ((0, 2), 2)])]
    want = brute(rows, lambda i: True)
    assert mined(frame(spark, rows), 1) == want and {r[3] for r in want if r[0] == 0 and r[1] == 1} == {2, 3, 4}
    assert mined(frame(spark, []), 1) == []


def test_large_numbers_are_exact_or_left_out(spark):
    rows = [(0, [1e6, 1.0], 0), (1, [1e6, 2.0], 0), (2, [0.9e6, 3.0], 1), (3, [1e30, 0.0], 0), (4, [-(2.0**70), 1.0], 1)]
    kept = [r for r in rows if r[0] < 3]
    assert mined(frame(spark, rows), 1) == brute(kept, lambda i: True) != []
    a = np.array([[1 << 40, -3], [5, 7]])
    assert hn.products(a, a, np.arange(2), np.arange(2)).tolist() == [(1 << 80) + 9, 74]


def test_bounds_hold_and_discard_early():
    """Vectors of a few strong directions: most pairs leave after leading parts, and none that counts."""
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    scale = 200 * 0.8 ** np.arange(64)
    ints = np.floor((rng.normal(size=(3000, 64)) * scale) @ basis).astype(np.int64)
    ids, labels = np.arange(3000), rng.integers(0, 5, 3000)
    block, work = hn.Block.build(ids, labels, ints), hn.Work()
    again = hn.Block.of(block.row() | {"dim": 64}, 64)
    assert all(np.array_equal(getattr(block, f), getattr(again, f)) for f in ("ids", "labels", "ints", "axes", "leading", "norms"))
    queries = np.arange(0, 3000, 50)
    found = hn.find_positives(ids[queries], labels[queries], ints[queries], again, work=work)
    exact = ints[queries] @ ints.T
    for q, i in enumerate(queries):
        same = [j for j in np.lexsort((ids, -exact[q])) if labels[j] == labels[i] and j != i][:5]
        assert found[1][found[0] == q].tolist() == same
    windows = [sorted(set(found[2][found[0] == q].tolist())) for q in range(len(queries))]
    negatives = hn.find_negatives(labels[queries], ints[queries], windows, again, work=work)
    for q, scores in enumerate(windows):
        for p in scores:
            fit = [j for j in np.lexsort((ids, -exact[q])) if labels[j] != labels[queries[q]] and 50 * p <= 100 * exact[q, j] <= 95 * p][:3]
            assert [i for k, s, i, _ in negatives if (k, s) == (q, p)] == fit
    assert work.made < 0.5 * work.whole


def test_sql_twin(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    twin = con.sql(registry.NEGATIVES_SQL)
    found = registry.op12_hard_negatives(spark, sf)
    assert twin.columns == found.columns and sorted(twin.fetchall()) == sorted(tuple(r) for r in found.collect())
