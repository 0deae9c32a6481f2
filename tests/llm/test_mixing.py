import random

import pytest

from odd_rows import ROWS, odd_documents
from switchyard.llm import mixing as M


def targets(sizes, weights=(5, 2, 1)):
    """Resharing by hand: the excess of full sources goes to the others by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[n] for n in full)
        share = sum(weight[n] for n in names if n not in full) or 1
        got = {n: 2 * sizes[n] if n in full else rest * weight[n] / share for n in names}
        over = {n for n in names if n not in full and got[n] > 2 * sizes[n]}
        if not over:
            return got
        full |= over


def seats_by_hand(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max(weights, key=lambda k: (weights[k] / (2 * got[k] + 1), -k))
        got[best] += 1
    return got


def test_apportion_gives_the_highest_quotients(spark):
    rng = random.Random(3)
    for trial in range(4):
        weights = {i: rng.choice([1, 2, 5, 100, 1000, 3]) * rng.random() for i in range(1, 12)}
        seats = rng.choice([3, 10, 57, 400])
        df = spark.createDataFrame([(0, i, w, seats) for i, w in weights.items()], "g int, i int, w double, s long")
        got = {r.i: r.quota for r in M.apportion(df, ["g"], "i", "w", "s").collect()}
        assert got == seats_by_hand(weights, seats)


def check(rows, found, tolerance):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = targets(sizes)
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target] = taken.get(r.target, 0) + r.taken
        assert min(abs(r.target - t) for t in want.values()) < 1e-6 * max(1, r.target)
    for t in want.values():
        same = sum(1 for x in want.values() if abs(x - t) < 1e-6)
        assert abs(sum(v for k, v in taken.items() if abs(k - t) < 1e-6) - same * t) <= tolerance * same


def test_sources_come_near_their_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 60), None, rng.choice(["a", "b", "c", "ä", None, "d", "A"]), *[None] * 5) for i in range(400)]
    found = M.mix_sources(odd_documents(spark, rows), block_words=8, shard_words=1500).collect()
    check(rows, found, 60)
    again = M.mix_sources(odd_documents(spark, list(reversed(rows))), block_words=8, shard_words=1500).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


@pytest.mark.parametrize("words", [1, 3, 9])
def test_small_sources_beside_a_large_one_come_near_their_targets(spark, words):
    """A thousand shards, so a shard holds a few words of a small source, or none."""
    rows = [(i, "w " * 40, None, "a", *[None] * 5) for i in range(3000)]
    rows += [(10_000 + i, "w " * words, None, "bcd"[i % 3], *[None] * 5) for i in range(1200)]
    found = M.mix_sources(odd_documents(spark, rows), shard_words=120).collect()
    sizes, taken = {"a": 120_000, **dict.fromkeys("bcd", 400 * words)}, dict.fromkeys("abcd", 0)
    source = {r[0]: r[3] for r in rows}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 32 * (1 + sizes[s] // (512 * 32)) for s in want), (taken, want)


def test_odd_rows(odd):
    ascii_words = [(r[0], (r[1] or ""), *r[2:]) for r in ROWS]
    check(ascii_words, M.mix_sources(odd).collect(), 64)


def test_empty_table(nothing):
    assert M.mix_sources(nothing).count() == 0


def test_only_empty_texts(spark):
    found = M.mix_sources(odd_documents(spark, [(1, None, *[None] * 7), (2, "", *[None] * 7)])).collect()
    assert [(r.size, r.taken, r.target) for r in found] == [(0, 0, 0.0)] * 2


def test_main_path_is_native(spark, odd):
    plan = M.mix_sources(odd)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
