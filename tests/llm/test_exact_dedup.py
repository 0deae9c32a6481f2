import hashlib
import random
import re

from odd_rows import ROWS, odd_documents
from switchyard.llm import common
from switchyard.llm import exact_dedup as E


def brute(rows):
    groups = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        groups.setdefault(key, []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    out = []
    for key, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(key.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), i == 0, digest) for i, m in enumerate(members)]
    return sorted(out, key=str)


def test_odd_rows_match_brute_force(odd):
    assert sorted(map(tuple, E.exact_duplicates(odd).collect()), key=str) == brute(ROWS)


def test_stage_keeps_one_row_of_each_group_with_all_columns(odd):
    kept = E.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(b[0]) for b in brute(ROWS) if b[3])


def test_more_copies_of_a_row_than_one_array_lists(spark, monkeypatch):
    monkeypatch.setattr(common, "STRIDE", 16)
    rows = [(None, "a b", *[None] * 7)] * 33 + [(4, "ab", *[None] * 7)] * 16 + [(5, "c", *[None] * 7)] * 17
    assert sorted(map(tuple, E.exact_duplicates(odd_documents(spark, rows)).collect()), key=str) == brute(rows)


def test_empty_table(nothing):
    assert E.exact_duplicates(nothing).count() == 0
    assert E.drop_exact_duplicates(nothing).count() == 0


def test_trie_holds_owners_and_spills_by_subtree():
    rng = random.Random(4)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(3000)]
    want = {}
    for i, k in enumerate(keys):
        points, owner, copies = want.get(k, (0, 1 << 60, 0))
        want[k] = (points, owner, copies + 1) if (-points, owner) < (-(i % 3), i) and copies else (i % 3, i, copies + 1)
    trie, got = E.OwnerTrie(budget=2000), {}
    for i, k in enumerate(keys):
        trie.insert(k, i % 3, i)
        for part in trie.spill() if trie.total > trie.budget else ():
            _merge(got, part)
    for part in trie.drain():
        _merge(got, part)
    assert got == want


def _merge(got, part):
    key, points, owner, copies = part
    old = got.get(key)
    best = min(((-points, owner), (-old[0], old[1]))) if old else (-points, owner)
    got[key] = (-best[0], best[1], copies + (old[2] if old else 0))


def test_shared_prefix():
    a = b"x" * 1000 + b"a" + b"y" * 10
    for n in (0, 1, 15, 16, 17, 999, 1000):
        b = a[:n] + b"?" + a[n + 1 :]
        assert E.shared_prefix(a, 0, b, 0, len(a)) == n
    assert E.shared_prefix(a, 3, a, 3, 50) == 50
