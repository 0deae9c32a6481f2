import random
from collections import defaultdict

import numpy as np
import pytest

from switchyard.operators import places as P


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def brute(messages, names, threshold):
    out = defaultdict(lambda: [0, 0.0, None])
    for doc_id, text in messages:
        words = P.WORD.findall((text or "").lower())
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                w = " ".join(sorted(words[i : i + n]))
                for name_id, raw in names:
                    name = P.normalise((raw or "").lower())
                    score = 200.0 * lcs(w, name) / (len(w) + len(name)) if name else 0.0
                    if score >= threshold and name:
                        found = out[doc_id, name_id, name]
                        found[0] += 1
                        if (-score, w) < (-found[1], found[2] or ""):
                            found[1:] = [score, w]
    return {k: tuple(v) for k, v in out.items()}


def test_ratio_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcä ", k=rng.randint(0, 80))) for _ in range(2))
        assert P.indel_ratio(a, b) == (200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0)


@pytest.mark.parametrize("threshold", [60, 85, 100])
def test_every_matching_window_is_probed(threshold):
    rng = random.Random(threshold)
    for _ in range(3000):
        name = "".join(rng.choices("abc", k=rng.randint(1, 24)))
        window = list(name)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(window))
            window[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
        window = "".join(window)
        if not window or P.indel_ratio(window, name) < threshold:
            continue
        t = P.edits(len(window), len(name), threshold)
        text = P.Texts([name])
        keys = {int(text.key(s, n, len(window), len(name), k)[0]) for k, (s, n) in enumerate(P.segments(len(name), t + 1))}
        assert any(int(k[0]) in keys for k in P.Texts([window]).probes([len(name)], threshold)), (window, name)


def test_long_texts_are_cut_without_loss():
    words = [f"w{i % 7}" for i in range(101)]
    for step in (1, 2, 3, 50, 200):
        got = [w for part in P.cut_text(" ".join(words), step) for w in part]
        assert sorted(got) == sorted(P.windows(words))


NAMES = [(1, "Nuwara Eliya"), (2, "Galle"), (3, "Dehiwala-Mount Lavinia"), (4, "colombo"), (5, "COLOMBO"), (6, None), (7, " - "), (8, "Sri Jayawardenepura Kotte"),
         (9, "Kandy"), (9, "Kandy District")]
MESSAGES = [
    (1, "is there a branch near nuwaraeliya or Eliya Nuwara?"), (2, "galle, gale, gallle and Gall"), (3, "mount lavinia dehiwela"), (4, "Colomboo columbo colombo COLOMBO!"),
    (5, None), (6, ""), (7, "sri jayawardanapura kotte"), (8, "kandi kandy distrct"), (8, "kandy"), (None, "Kandy"), (10, "nothing here " * 50), (11, "x" * 5000),
]


@pytest.mark.parametrize("threshold", [70, 85])
def test_place_names_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(P, "STEP_WINDOWS", 20)
    messages = spark.createDataFrame(MESSAGES, "doc_id long, text string").repartition(3)
    names = spark.createDataFrame(NAMES, "name_id int, name string")
    got = {(r.doc_id, r.name_id, r.name): (r.hits, r.score, r.best) for r in P.place_names(messages, names, threshold=threshold).collect()}
    want = brute(MESSAGES, NAMES, threshold)
    assert got.keys() == want.keys() and len(got) > 8
    assert all(got[k] == (want[k][0], pytest.approx(want[k][1]), want[k][2]) for k in want)


def test_random_words_equal_brute_force(spark):
    rng = random.Random(5)
    parts = ["an", "ther", "ing", "on", "sh", "le", "wa", "é"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 5)))
    names = [(i, " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(60)]
    messages = [(i, " ".join(word() if rng.random() < 0.8 else rng.choice(names)[1] for _ in range(40))) for i in range(40)]
    docs, gazetteer = spark.createDataFrame(messages, "doc_id long, text string"), spark.createDataFrame(names, "name_id int, name string")
    got = {(r.doc_id, r.name_id, r.name): (r.hits, r.best) for r in P.place_names(docs, gazetteer).collect()}
    assert got == {k: (v[0], v[2]) for k, v in brute(messages, names, 85).items()}


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    names = spark.createDataFrame(NAMES, "name_id int, name string")
    assert P.place_names(none, names).count() == 0
    assert P.place_names(spark.createDataFrame(MESSAGES, "doc_id long, text string"), names.where("name_id > 99")).count() == 0
    assert np.any(P.known(np.full(1 << 22, 255, np.uint8), np.array([5], np.uint64)))


@pytest.mark.parametrize("threshold", [70, 85])
def test_an_index_too_large_to_go_along_gives_the_same(spark, monkeypatch, threshold):
    messages, names = spark.createDataFrame(MESSAGES, "doc_id long, text string"), spark.createDataFrame(NAMES, "name_id int, name string")
    small = P.place_names(messages, names, threshold=threshold)
    assert "window" not in small.columns and "windows-" not in "".join(small.inputFiles())  # no window but a match leaves a task
    monkeypatch.setattr(P, "INDEX_KEYS", 0)
    large = P.place_names(messages, names, threshold=threshold)
    assert "windows-" in "".join(large.inputFiles())
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_character_counts_bound_the_edits():
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdeü 1", k=rng.randint(1, 20))) for _ in range(200)]
    counts = P.class_counts(texts)
    for i, a in enumerate(texts):
        for j in rng.sample(range(200), 20):
            assert np.abs(counts[i] - counts[j]).sum() <= len(a) + len(texts[j]) - 2 * lcs(a, texts[j])
