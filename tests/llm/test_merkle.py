import hashlib

import pytest
from pyspark.sql import functions as F

from odd_rows import ROWS, odd_documents
from switchyard.llm import merkle as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h("".join(low[i : i + 3])) for i in range(0, len(low), 3)])
    return levels


def path(levels, pos, node):
    """Siblings of a position, and the top that follows from ``node`` there."""
    proof = ""
    for level in levels[:-1]:
        run = level[pos // 3 * 3 : pos // 3 * 3 + 3]
        at = pos % 3
        proof += "".join(run[:at] + run[at + 1 :])
        node = h("".join(run[:at] + [node] + run[at + 1 :]))
        pos //= 3
    return proof, node


def brute(rows, tamper):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars) rows."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = lambda t: h("".join(map(field, (doc_id, source, lang, n_chars, t))))
        shown = text.replace("\n", "") if text is not None and tamper(doc_id) else text
        groups.setdefault(source, []).append((doc_id, leaf(text), leaf(shown)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = climb([r[1] for r in groups[s]])
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, leaf, shown) in enumerate(groups[s]):
            low, node = path(trees[s], i, shown)
            high, node = path(top, k, node)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h(low + high), node, node == top[-1][0]))
    return sorted(out, key=str)


def found(docs, tampered):
    shown = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted(map(tuple, M.verify(M.manifest(docs, presented={"text": shown})).collect()), key=str)


def test_odd_rows(odd):
    got = found(odd, F.col("doc_id") % 2 == 1)
    want = brute([r[:5] for r in ROWS], lambda d: d is not None and d % 2 == 1)
    assert got == want and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_many_blocks_of_a_hot_source(spark, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    rows = [(i * 7 % 211, f"text {i}\n", "en", "hot" if i % 3 else f"s{i % 13}", i, None, "x", 1, "d") for i in range(211)]
    rows += [(None, "again", None, None, None, *[None] * 4)] * 30
    got = found(odd_documents(spark, rows).repartition(5), F.col("doc_id") < 50)
    assert got == brute([r[:5] for r in rows], lambda d: d is not None and d < 50)


def test_every_size_of_a_tree():
    for n in range(1, 90):
        nodes = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        tree = M.Subtree(M.depth(n))
        for x in nodes:
            tree.append(x)
        tree.finish()
        levels = climb([x.hex() for x in nodes])
        assert tree.top.hex() == levels[-1][0]
        for i, x in enumerate(nodes):
            proof, _ = path(levels, i, x.hex())
            assert b"".join(a + b for a, b in M.steps(tree.witnesses[i])).hex() == proof
            assert M.fold(x, bytes(tree.witnesses[i])) == tree.top


def test_one_row_and_no_rows(spark, nothing):
    (row,) = found(odd_documents(spark, [(3, None, None, None, None, *[None] * 4)]), F.lit(True))
    assert row == (3, row[1], row[1], row[1], h(""), row[1], True) and row[1] == h("1:3----")
    assert M.verify(M.manifest(nothing)).count() == 0
