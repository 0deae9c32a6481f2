import numpy as np
import pyarrow as pa

from switchyard.operators import word_vectors as wv


def test_rows_are_added_up_to_the_limit_however_often_they_repeat():
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.integers(0, 40, 100), np.repeat([3, 7], [30, wv.ROOM])])
    values, table = rng.normal(size=(len(rows), 5)).astype(np.float32), rng.normal(size=(41, 5)).astype(np.float32)
    want = table.astype(float)
    for r in set(rows.tolist()):
        here = values[rows == r].astype(float)
        want[r] += here.sum(axis=0) * min(1.0, wv.ROOM / len(here))
    wv._add(table, rows, values)
    assert np.allclose(table, want, atol=1e-5)


def test_weights_are_packed_whole_also_in_slices(monkeypatch):
    monkeypatch.setattr(wv, "PACKED", 3)
    weights = np.arange(28, dtype=np.float32).reshape(7, 4)
    packed = wv._pack(weights)
    assert [len(x) for x in packed] == [3, 3, 1] and all(x.type == pa.binary() for x in packed)
    assert (np.concatenate([wv._unpack(x, 4) for x in packed]) == weights).all()
    assert (wv._unpack(packed[1].slice(1), 4) == weights[4:6]).all()
    assert wv._unpack(wv._pack(weights[:0])[0], 4).shape == (0, 4)


def test_means_over_shards_run_across_batches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"w{w}", s, int(rng.integers(0, 5)), rng.normal(size=4).astype(np.float32)) for w in range(9) for s in range(1 + 3 * w)]
    df = spark.createDataFrame([(w, s, h, bytearray(v.tobytes())) for w, s, h, v in rows], "word string, shard int, here long, state binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r["word"]: np.frombuffer(r["state"], np.float32) for r in wv._mean(df.repartition(3), 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 9
    for w in got:
        some = [(max(1, h), v.astype(float)) for x, _, h, v in rows if x == w]
        assert np.allclose(got[w], sum(h * v for h, v in some) / sum(h for h, _ in some), atol=1e-6)
