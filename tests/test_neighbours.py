import numpy as np
import pytest

from switchyard.operators import neighbours as N


def brute(rows, k, least):
    """(vec_id, rank, neighbour, similarity) by comparing all pairs of sound vectors."""
    sound = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for i, a in sound.items():
        near = []
        for j, b in sound.items():
            if i != j:
                s = round(float((a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max())) @ (b / np.abs(b).max() / np.linalg.norm(b / np.abs(b).max()))), 9)
                if s >= least:
                    near.append((-s, j))
        out += [(i, n + 1, j, round(-s, 8)) for n, (s, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, point string, cell int").repartition(5)
    found = N.nearest(df, **more).collect()
    assert all((r.decision == "duplicate") == (r.similarity > 0.88 and r.neighbour < r.vec_id) for r in found)
    return sorted((r.vec_id, r.rank, r.neighbour, round(r.similarity, 8)) for r in found)


def clustered(seed, n, dims):
    """Groups of near copies, exact copies, scaled copies and loners."""
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    while i < n:
        base = rng.normal(size=dims)
        for _ in range(int(rng.choice([1, 1, 2, 5, 20]))):
            v = base * rng.choice([1, 1, 3]) + rng.choice([0, 0.02, 0.2]) * rng.normal(size=dims)
            rows.append((i, v.tolist(), "x", 1))
            i += 1
    return rows


@pytest.mark.parametrize("k, least, cell, most", [(2, -1.0, 16, 100), (2, 0.88, 16, 100), (1, -1.0, 1000, 1), (5, 0.5, 8, 7)])
def test_nearest_equal_brute_force(spark, k, least, cell, most):
    rows = clustered(k, 240, 6)
    assert got(spark, rows, k=k, least=least, cell=cell, most=most) == brute([r[:2] for r in rows], k, least)


def test_parts_and_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("PART", 20), ("HELD", 40), ("HOT", 5)):
        monkeypatch.setattr(N, name, value)
    rows = clustered(9, 150, 4) + [(1000 + i, [1.0, 2.0, 3.0, 4.0], "x", 1) for i in range(80)]
    assert got(spark, rows, cell=10) == brute([r[:2] for r in rows], 2, -1.0)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (9, []), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e300, 1e300]), (12, [1e-300, 1e-300])]
    want = brute(rows, 2, -1.0)
    assert got(spark, [(*r, "x", 1) for r in rows + [(13, [1.0, 0.0, 0.0]), (1, [1.0, 0.0])]]) == want
    assert got(spark, []) == [] and got(spark, [(1, [1.0], "x", 1)]) == []


def test_pruning_leaves_far_cells_out(spark):
    """Tight groups far apart: points visit few of the cells."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(int(i), (centres[i % 40] + 0.01 * rng.normal(size=16)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pts = N.points(N.members(df)).checkpoint()
    heaps = N.neighbour_heaps(pts.select("point", "v"), cell=50)
    visits = heaps.count() - pts.count()
    assert visits < 10 * 2000  # 40 cells: without pruning 39 visits a point


def test_closest_pairs(spark):
    rows = clustered(2, 100, 5)
    review = N.nearest(spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>"))
    pairs = {(min(r.vec_id, r.neighbour), max(r.vec_id, r.neighbour), r.similarity) for r in review.collect()}
    want = sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))[:20]
    assert [tuple(r) for r in N.closest_pairs(review).collect()] == want
