import random
import re

import numpy as np
import pytest

from odd_rows import ROWS, odd_documents
from switchyard.llm import ngram_join as N
from switchyard.llm.components import components
from switchyard.llm.shingles import shingle_sets


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if a is not None and b is not None and both and 100 * both >= 80 * len(x | y) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def result(docs):
    return sorted(map(tuple, N.jaccard_components(docs).collect()), key=str)


def test_odd_rows_match_brute_force(odd):
    assert result(odd) == brute(ROWS)


def test_empty_table(nothing):
    assert result(nothing) == []


@pytest.mark.parametrize("tight", [False, True])
def test_random_copies_passages_and_chains(spark, monkeypatch, tight):
    """Near copies around the threshold, common passages, chains; also without any min-hash group."""
    if tight:  # the exact steps must find everything when grouping finds nothing
        monkeypatch.setattr(N, "LIKELY", N.HASHES + 1)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    rows = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text += passage
            rows.append((len(rows), " ".join(text), None, None, None, None, None, None, None))
            base = text if rng.random() < 0.5 else base
    rows += [(len(rows) + i, " ".join(passage + [f"end{i % 3}"]), *[None] * 7) for i in range(12)]
    assert result(odd_documents(spark, rows)) == brute(rows)


def test_shingle_sets_agree_with_words_across_batches():
    texts = ["A b\tC d e f", "a B c D E F", "a b c d e f g", "a b c", "A  B C", "", "  ", "é É x y z", "a b c d"]
    sets = list(shingle_sets([t.encode() for t in texts]))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            assert len(np.intersect1d(s, t)) == len(shingles(texts[i]) & shingles(texts[j]))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 200), (200, 250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
