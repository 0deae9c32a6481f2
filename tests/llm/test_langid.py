import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd_rows import ROWS
from switchyard.llm import langid as L

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = L.predict(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_odd_rows(odd):
    found = L.predict(odd, L.fit(odd)).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (5, 6, 7, 12)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in found) and by_id[5].score == 0
    assert all(r.lang_pred in ("und", "en", "fr", "de") for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    kept = L.keep_identified(odd, L.fit(odd))
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.lang_pred != "und")


def test_labels_of_held_out_rows_teach_nothing(odd):
    out = {str(r[0]) for r in ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2}
    spoiled = odd.withColumn("lang", F.when(F.col("doc_id").cast("string").isin(list(out)), "zz").otherwise(F.col("lang")))
    a, b = L.fit(odd), L.fit(spoiled)
    assert a.members == b.members and np.array_equal(a.weights, b.weights)


def test_nothing_learned(nothing, odd):
    model = L.fit(nothing)
    assert L.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in L.predict(odd, model).collect()} == {"und"}
    kept = L.keep_identified(odd, model)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in ROWS if r[0] not in (5, 6, 7, 12))


def test_families_come_first():
    rng = np.random.default_rng(1)
    names = ["de", "en", "fr", "es", "xx"]
    texts = {n: [bytes(rng.choice(list(f"{n}abc {n}{n}".encode()), 200).tolist()) for _ in range(20)] for n in names}
    model = L.train(np.array([L.features(t) for n in names for t in texts[n]]), [n for n in names for _ in texts[n]])
    assert model.families == ["germanic", "romance", "xx"]
    assert [p for p in model.pairs if p[0]] == [("germanic", "de", "en"), ("romance", "es", "fr")]
    got = model.predict([t.decode() for n in names for t in texts[n]])[0]
    assert np.mean([g == n for g, n in zip(got, [n for n in names for _ in range(20)])]) > 0.95


def test_a_repeated_id_sends_no_more_than_the_sample(spark, monkeypatch):
    rows = [(1, f"hello there number {'abcdefgh'[i % 8]}", "en") for i in range(900)]
    rows += [(i, "bonjour à tous", "fr") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    sent, plain = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: sent.append(plain(self)) or sent[-1])
    model = L.fit(docs, sample=20)
    taught = [r for found in sent for r in found if "value" in r]
    assert 0 < len(taught) <= 2 * 20 and model.families == ["germanic", "romance"]
