import hashlib
import os
import random

import pytest

from odd_rows import ROWS
from switchyard.llm import bpe as B

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(B.Vocabulary(PATH))


PARTS = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "'s", "'S", "'ll", "é", "ß", "中", "文", "1", "２", "½", "!", "<|endoftext|>",
         "<|endoftext", "|>", "　", " ", "\u0085", "\x1c", "​", "😀", "\x00", "_", "-", "ing", "ation"]


def test_ids_and_text_match_the_library(reference, encoder):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(6000)]
    texts += ["", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 50 + "x", "é" * 999]
    texts += [chr(c) + " " + chr(c) + "a" + chr(c) * 2 + " 1" + chr(c) for c in range(0, 0x3100)]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        ids = B.encode_ids(encoder, some)
        want = [e.ids for e in reference.encode_batch(some, add_special_tokens=False)]
        assert ids == want
        assert [B.decode_ids(encoder.v, i) for i in ids] == [reference.decode(i, skip_special_tokens=False) for i in want]
    assert encoder.exact > 0


def test_memo_may_be_tiny(reference):
    small = B.Encoder(B.Vocabulary(PATH), memo=5)
    texts = ["the quick brown foxes jumped", "the lazy doggo", "quick quick jumpered " * 20] * 3
    for t in texts:
        assert B.encode_ids(small, [t])[0] == reference.encode(t, add_special_tokens=False).ids


def test_odd_rows_and_empty_table(odd, nothing, reference):
    found = B.encode(odd, PATH).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert len(found) == len(ROWS)
    for r in found:
        ids = reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert B.encode(nothing, PATH).count() == 0
