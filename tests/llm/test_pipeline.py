import os
import re

import pytest

import corpus_pipeline as P
from odd_rows import ROWS, odd_documents
from switchyard.llm import exact_dedup, langid, mixing
from test_exact_dedup import brute as exact_brute
from test_ngram_join import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_stage_names_and_order():
    assert [n for n, _ in P.STAGES] == ["language", "exact", "near", "mix", "tokens"]


def test_each_stage_against_brute_force(spark, odd, tmp_path):
    docs, rows = odd, list(ROWS)
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = [tuple(r) for r in docs.collect()]
        if name == "language":
            want = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
        elif name == "exact":
            stays = [b[0] for b in exact_brute(rows) if b[3]]
            assert sorted(str(r[0]) for r in got) == sorted(map(str, stays))
            want = got
        elif name == "near":
            gone = {d for d, _, c in near_brute(rows) if d is not None and d != c}
            want = [r for r in rows if r[0] not in gone]
        elif name == "mix":
            mixed = {r.doc_id: r for r in mixing.mix_sources(odd_documents(spark, rows)).collect()}
            want = []
            for r in rows:
                m = mixed[r[0]]
                want += [r] * (int(m.taken / m.size + 0.5) if m.size else 1)
        else:
            assert sorted(str(g[0]) for g in got) == sorted(str(r[0]) for r in rows) and all(g[1] > 0 for g in got)
            continue
        assert sorted(map(str, got)) == sorted(map(str, want)), name
        assert docs.columns == odd.columns
        rows = got


def test_empty_table_passes_through(spark, nothing):
    docs = nothing
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 100
