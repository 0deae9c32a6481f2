from pyspark.sql import functions as F

from switchyard.operators import routing
from switchyard.session import scratch_path
from switchyard.streaming import messages as st

SCHEMA = "id long, text string, score double, ts timestamp_ntz"


def write(spark, path, rows):
    df = spark.createDataFrame([(i, t, s) for i, t, s, _ in rows], "id long, text string, score double")
    days = spark.createDataFrame([(i, d) for i, _, _, d in rows], "id long, day int")
    ts = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, day)")
    df.join(days, "id").select("id", "text", "score", ts.alias("ts")).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_resumes(spark):
    path, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    write(spark, path, [(1, "ශාඛාව", 0.1, 0), (2, "a", 0.9, 0)])

    def run():
        stream = st.read_stream(spark, path, spark.read.parquet(path).schema)
        st.append_available(st.route_stream(stream), out, check)

    run()
    run()
    assert spark.read.parquet(out).count() == 2
    write(spark, path, [(3, "b", 0.2, 1)])
    run()
    want = routing.route(spark.read.parquet(path)).select("id", "routed_label").collect()
    got = spark.read.parquet(out).select("id", "routed_label").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3


def test_stream_dedup_across_batches_and_drops_late_rows(spark):
    path, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))

    def run():
        stream = st.read_stream(spark, path, spark.read.parquet(path).schema)
        st.append_available(st.dedup_stream(stream, ["text"], delay="2 days"), out, check)

    write(spark, path, [(1, "a", 0.0, 5), (2, "a", 0.0, 5), (3, "b", 0.0, 5)])
    run()
    write(spark, path, [(4, "a", 0.0, 6), (5, "c", 0.0, 20)])
    run()
    write(spark, path, [(6, "late", 0.0, 1), (7, "d", 0.0, 20)])
    run()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]


def test_share_is_emitted_for_closed_windows_only(spark):
    path, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    write(spark, path, [(1, "x", 0.9, 0), (2, "x", 0.1, 0), (3, "x", 0.1, 1), (4, "x", 0.1, 3)])
    stream = routing.route(st.read_stream(spark, path, spark.read.parquet(path).schema))
    st.append_available(st.routed_share(stream, "1 day"), out, check)
    # Watermark: day 3 minus ten minutes, so only the windows of days 0 and 1 are closed.
    rows = spark.read.parquet(out).orderBy("start").collect()
    assert [(r["to_strong"], r["to_cheap"], r["strong_share"]) for r in rows] == [(1, 1, 0.5), (0, 1, 0.0)]
