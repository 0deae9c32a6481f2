import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from odd_rows import ROWS, odd_documents
from switchyard.llm import alignment as A

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
A_PATH, B_PATH = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "'s", "'S", "é", "ß", "中", "文", "1", "２", "½", "!", "<|endoftext|>", "<s>", "</s>",
         "<unk>", "<0x41>", "▁", "　", " ", "\u0085", "\x1c", "​", "😀", "\x00", "_", "-", "ing", "ation", "internationalisation", "0" * 40]


@pytest.fixture(scope="module")
def models():
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH), A.ByteLevel(open(A_PATH, "rb").read()).tokens


@pytest.fixture(scope="module")
def aligner():
    contents = open(A_PATH, "rb").read(), open(B_PATH, "rb").read()
    return A.Aligner(*contents, A.Pairs(A.ByteLevel(contents[0]).tokens, A.Pieces(contents[1]).tokens).keys)


def brute(models, text):
    """Tokens of both sides, and groups by walking both sides byte by byte."""
    a_model, b_model, a_tokens = models
    if not text:
        return None
    a = a_model.encode(" " + text, add_special_tokens=False).ids
    b = b_model.encode(text)
    b_bytes = []
    for i in b:
        p = b_model.id_to_piece(i)
        b_bytes.append(bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode())
    data = (" " + text).encode()
    if b"".join(a_tokens[i] for i in a) != data or b"".join(b_bytes) != data:
        return None
    groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            groups[-1][0].append(a[i])
            at_a, i = at_a + len(a_tokens[a[i]]), i + 1
        else:
            groups[-1][1].append(b[j])
            at_b, j = at_b + len(b_bytes[j]), j + 1
        if at_a == at_b:
            groups.append(([], []))
    return a, b, groups[:-1]


def named(groups):
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest()


def corpus_brute(models, rows):
    found = [(doc_id, brute(models, text)) for doc_id, text in rows]
    count = Counter((a[-1], b[-1]) for _, f in found if f for a, b in f[2])
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc_id, f in found:
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in f[2]]
        best = sum(count[p] == highest[p[1]] for p in links)
        out.append((doc_id, len(f[0]), len(f[1]), len(f[2]), len(links), best, sum(count[p] for p in links), named(f[2])))
    return out


def test_every_text_matches_a_walk_over_both_sides(models, aligner):
    rng = random.Random(3)
    texts = [None, ""] + ["".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(1500)]
    texts += ["a" * 5000, " " * 3000, "\n" * 3000 + "x", "é" * 999, "<|endoftext|>" * 20, "▁", " ", "the " * 3000]
    texts += [chr(c) + " " + chr(c) + "a" + chr(c) * 2 + " 1" + chr(c) for c in range(1, 0x3100, 3)]
    for text, (n_a, n_b, n_groups, name, links) in zip(texts, aligner.align(texts)):
        want = brute(models, text)
        if want is None:
            assert (n_a, n_b, n_groups, name, len(links)) == (0, 0, 0, "", 0)
            continue
        assert (n_a, n_b, n_groups, name) == (len(want[0]), len(want[1]), len(want[2]), named(want[2])), repr(text)
        keys = aligner.pairs.keys[links]
        assert list(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist())) == [(a[-1], b[-1]) for a, b in want[2]]


def test_long_white_space_takes_the_library(models, aligner):
    text = "x" + " " * 2_000_000 + "y"
    (n_a, *_, name, _), = aligner.align([text])
    assert n_a == len(models[0].encode(" " + text, add_special_tokens=False).ids) and name


def test_cuts_of_random_ends():
    rng = np.random.default_rng(1)
    for share in (0.02, 0.3, 0.9):
        for _ in range(100):
            n = int(rng.integers(1, 300))
            a = np.unique(np.append(np.flatnonzero(rng.random(n) < share), n))
            b = np.unique(np.append(np.flatnonzero(rng.random(n) < share), n))
            got = A.shared_cuts(a, b, np.array([len(a) - 1]))
            assert a[got].tolist() == np.intersect1d(a, b).tolist()


def test_odd_rows_and_counts_of_the_whole_table(spark, odd, nothing, models):
    got = sorted(map(tuple, A.align_corpus(odd, A_PATH, B_PATH).collect()), key=str)
    assert got == sorted(corpus_brute(models, [(r[0], r[1]) for r in ROWS]), key=str)
    assert A.align_corpus(nothing, A_PATH, B_PATH).count() == 0


def test_many_parts_count_together(spark, models):
    words = "alpha beta internationalisation gamma, delta? 12345 über naïve\n".split(" ")
    rows = [(i, " ".join(words[i % 5 : i % 7 + 2] * (i % 3 + 1)), *[None] * 7) for i in range(200)]
    docs = odd_documents(spark, rows).repartition(7)
    got = sorted(map(tuple, A.align_corpus(docs, A_PATH, B_PATH).collect()), key=str)
    assert got == sorted(corpus_brute(models, [(r[0], r[1]) for r in rows]), key=str)
