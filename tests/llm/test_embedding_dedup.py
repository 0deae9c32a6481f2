import numpy as np
import pytest

from switchyard.llm import embedding_dedup as D

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, n_links string"


def brute(rows):
    ok = []
    for i, (v, e, label, *_) in enumerate(rows):
        good = v is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
        ok.append(np.array(e, np.float32).astype(float) if good else None)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= D.THRESHOLD - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], links[i], least.get(find(i)) if r[0] is not None else None) for i, r in enumerate(rows)), key=str)


def result(spark, rows):
    found = D.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    return sorted((tuple(r)[:3] for r in found), key=str)


def clouds(n, dim, groups, noise, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return [
        (i, (centres[i % groups] + noise * rng.standard_normal(dim)).astype(np.float32).tolist(), int(i % 2), i, None)
        for i in range(n)
    ]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0, 1, "x"), (2, [2.0, 0.0], 0, 1, "x"), (3, [1.0, 0.0], 0, 1, "x"), (3, [1.0, 0.0], 0, 1, "x"),
        (4, [1.0, 0.0], 1, 1, "x"), (5, [1.0, 0.0], None, 1, "x"), (6, None, 0, 1, "x"), (7, [0.0, 0.0], 0, 1, "x"),
        (8, [nan, 1.0], 0, 1, "x"), (9, [inf, 1.0], 0, 1, "x"), (10, [None, 1.0], 0, 1, "x"), (11, [], 0, 1, "x"),
        (12, [1.0, 0.0, 0.0], 0, 1, "x"), (None, [1.0, 0.0], 0, 1, "x"), (13, [0.95, 0.3], 0, 1, "x"), (14, [-1.0, 0.0], 0, 1, "x"),
    ]
    assert result(spark, rows) == brute(rows)


def test_components_whose_squares_leave_the_range_of_doubles(spark):
    rows = [(1, [1e200, 0.0], 0), (2, [1e-200, 0.0], 0), (3, [1.0, 0.1], 0), (4, [0.0, 1e-250], 0), (5, [0.0, -1e300], 0)]
    found = D.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True)]


def test_empty_table(spark):
    assert D.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cells_and_blocks_keep_the_links(spark, monkeypatch):
    """Many cells and split blocks: recall stays at 0.99 or more and no false link appears."""
    for name, value in (("CELL", 40), ("MEMBERS", 32), ("QUERIES", 64)):
        monkeypatch.setattr(D, name, value)
    rows = clouds(600, 32, 40, 0.2)
    got, want = result(spark, rows), brute(rows)
    total, found = sum(w[1] for w in want), sum(g[1] for g in got)
    assert total > 500 and 0.99 * total <= found <= total
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_calibrated_count():
    assert 15 <= D.least_count() < D.PROJECTIONS
    assert D.least_count(0.5) >= D.least_count(0.999)


def test_roots_match_components():
    rng = np.random.default_rng(5)
    rows = D.unit(np.array([r[1] for r in clouds(300, 16, 20, 0.2)], np.float32).ravel(), 16)
    ids = np.arange(300)
    links, roots = D.block_links(ids, rows, rows, ids, ids, np.ones(300, np.int64), 0.93)
    near = rows @ rows.T >= 0.93
    label = ids.copy()
    for _ in range(300):
        label = np.array([label[near[i]].min() for i in range(300)])
    assert np.array_equal(roots, label) and np.array_equal(links, near.sum(1) - 1)
