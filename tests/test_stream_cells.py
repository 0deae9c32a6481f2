from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from switchyard.operators import cells as batch
from switchyard.operators import cleaning
from switchyard.streaming import cells as S
from switchyard.streaming import messages as st

SCHEMA = "doc_id long, text string, language string, industry string, scenario string, ts timestamp"
DAY = datetime(2024, 1, 1)
ROWS = [
    (i, t, lang, "bank", "simple", DAY) for i, (t, lang) in enumerate(
        [(" a ", "en"), ("a", "en"), ("b", "en"), ("", "en"), (None, "en"), ("a", "si"), ("c", "en"), ("d", "en"), ("b\n", "en"), ("x", "fr"),
         ("e", "si"), ("e", "si"), ("f", "en")]
    )
]
PLAN = [("en", "bank", "simple", 3), ("si", "bank", "simple", 5), ("ta", "bank", "simple", 2)]


@pytest.fixture
def plan(spark):
    return spark.createDataFrame(PLAN, "language string, industry string, scenario string, target_count int")


def run(spark, path, out, checkpoint, plan, wait=10_000_000):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = st.read_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
        st.append_available(S.fill_cells(stream, plan, wait), out, checkpoint)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cells_fill_up_and_go_on_after_a_restart(spark, tmp_path, plan):
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    for part in (ROWS[:7], ROWS[7:]):  # the second run goes on from the checkpoint
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(paths[0])
        run(spark, *paths, plan)
    taken = spark.read.parquet(paths[1]).where("kind = 'row'").select("cell_id", "text").collect()
    assert sorted(map(tuple, taken)) == [("en__bank__simple", t) for t in "abc"] + [("si__bank__simple", t) for t in "ae"]
    state = {r.cell_id: r for r in S.state_of_cells(spark, paths[2]).collect()}
    en, si = state["en__bank__simple"], state["si__bank__simple"]
    assert (en.seen, en.empty, en.dupes, en.kept, en.late, en.missing) == (9, 2, 1, 3, 3, 0)
    assert (si.seen, si.empty, si.dupes, si.kept, si.late, si.missing) == (3, 0, 1, 2, 0, 3)
    # The batch gap table of the rows that were taken.
    names = ["language", "industry", "scenario"]
    split = F.split("cell_id", "__")
    rows = spark.read.parquet(paths[1]).where("kind = 'row'").select(*[split[i].alias(n) for i, n in enumerate(names)])
    want = sorted(map(tuple, batch.gaps(plan, rows).collect()))
    assert sorted(map(tuple, S.gaps_of_stream(spark, paths[2], plan).collect())) == want and len(want) == 2


def test_without_a_limit_it_is_the_batch_dedup(spark, tmp_path, plan):
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    rows = spark.createDataFrame(ROWS, SCHEMA)
    rows.repartition(3).write.parquet(paths[0])
    wide = plan.withColumn("target_count", F.lit(1000))
    run(spark, *paths, wide)
    got = sorted(map(tuple, spark.read.parquet(paths[1]).where("kind = 'row'").select("cell_id", "text").collect()))
    once = cleaning.dedup_within_cells(rows.where("language <> 'fr'"))
    cell = F.concat_ws("__", "language", "industry", "scenario")
    assert got == sorted(map(tuple, once.select(cell, "text").collect()))


def test_a_waiting_cell_reports_its_gap(spark, tmp_path, plan):
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    spark.createDataFrame(ROWS[5:6], SCHEMA).coalesce(1).write.mode("append").parquet(paths[0])
    run(spark, *paths, plan, wait=60_000)
    later = [(*ROWS[2][:5], DAY + timedelta(days=1))]  # moves the watermark past the first cell's time
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(paths[0])
    run(spark, *paths, plan, wait=60_000)
    gaps = [tuple(r) for r in spark.read.parquet(paths[1]).where("kind = 'gap'").select("cell_id", "missing").collect()]
    assert gaps == [("si__bank__simple", 4)]


def test_a_session_with_the_default_state_store_will_do(spark, tmp_path, plan):
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(paths[0])
    before = spark.conf.get(S.STORE[0])
    spark.conf.set(S.STORE[0], "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        run(spark, *paths, plan)
        assert {r.cell_id: r.kept for r in S.state_of_cells(spark, paths[2]).collect()} == {"en__bank__simple": 3, "si__bank__simple": 2}
    finally:
        spark.conf.set(S.STORE[0], before)
