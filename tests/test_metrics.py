import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchyard.operators import metrics, thresholds
from switchyard.plans.running import percentiles, running_totals


def scored(n=400, seed=5, hot=0.34):
    """A third of the rows share one score."""
    rng = random.Random(seed)
    return [(i, rng.randint(0, 1), 0.5 if rng.random() < hot else round(rng.random(), 2)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label int, score double").repartition(5)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_running_totals_equal_a_plain_scan(spark, buckets):
    rows = scored()
    got = running_totals(frame(spark, rows), [], "score", {"n": F.lit(1)}, buckets).collect()
    for r in got:
        assert r["cum_n"] == sum(s <= r["score"] for _, _, s in rows)
        assert r["n"] == sum(s == r["score"] for _, _, s in rows)


def test_running_totals_keep_null_groups(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0)], "g string, score double")
    got = {(r["g"], r["score"]): r["cum_n"] for r in running_totals(rows, ["g"], "score", {"n": F.lit(1)}, 2).collect()}
    assert got == {(None, 1.0): 1, (None, 2.0): 2, ("a", 1.0): 1}


def test_more_buckets_than_values_and_text_order(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "v string")
    got = {r["v"]: r["cum_n"] for r in running_totals(rows, [], "v", {"n": F.lit(1)}, 700).collect()}
    assert got == {"a": 2, "b": 3, "c": 4}


def test_null_groups_are_kept(spark):
    rows = [(i, i % 2, i / 10, int(i > 4), None if i < 6 else "a") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, label int, score double, pred int, g string")
    assert {r["g"]: r["n"] for r in metrics.latency_stats(df, "score", ["g"]).collect()} == {None: 6, "a": 6}
    assert {r["g"] for r in metrics.roc_curve(df, ["g"]).collect()} == {None, "a"}
    found = {r["g"]: r for r in metrics.evaluate(df, ["g"]).collect()}
    assert found.keys() == {None, "a"} and found[None]["tp"] + found[None]["fn"] == 3
    missed = df.withColumn("pred", F.lit(0))
    assert {r["g"] for r in metrics.false_negatives(missed, "g").collect()} == {None, "a"}


def test_evaluate_reads_the_predictions_once(spark, tmp_path):
    rows = [("e", i, i % 2, 1, i / 10) for i in range(10)]
    spark.createDataFrame(rows, "experiment_id string, doc_id long, label int, pred int, score double").write.parquet(str(tmp_path / "p"))
    plan = metrics.evaluate(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().toString()
    assert "FileScan" not in plan  # counted before, in one job


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_percentiles_equal_numpy(spark, n):
    rng = random.Random(n)
    values = [rng.choice([1.5, rng.gauss(0, 100)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = percentiles(df, "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, buckets=4).first()
    assert got["n"] == n
    for k, p in (("p50", 50), ("p95", 95), ("p99", 99)):
        assert got[k] == pytest.approx(np.percentile(values, p))
    assert got["mean"] == pytest.approx(np.mean(values)) and got["max"] == max(values)


def test_auc_with_ties_and_log_loss(spark):
    rows = scored()
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(frame(spark, rows)).first()["roc_auc"] == pytest.approx(want)
    eps = metrics.EPSILON
    clip = [(y, min(max(s, eps), 1 - eps)) for _, y, s in rows]
    loss = -sum(math.log(s) if y else math.log(1 - s) for y, s in clip) / len(clip)
    assert metrics.log_loss(frame(spark, rows)).first()["log_loss"] == pytest.approx(loss)


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(frame(spark, [(1, 1, 0.5), (2, 1, 0.7)])).first()["roc_auc"] is None


def test_quality_edges(spark):
    rows = spark.createDataFrame([(0, 0, 0, 4), (4, 0, 0, 0), (0, 3, 2, 0), (5, 1, 2, 4)], "tp long, fp long, fn long, tn long")
    got = metrics.with_quality(rows).collect()
    assert (got[0]["f1_macro"], got[0]["mcc"], got[0]["recall_1"]) == (1.0, 0.0, 0.0)
    assert (got[1]["f1_macro"], got[1]["precision_0"]) == (1.0, 0.0)
    assert got[2]["mcc"] == -1.0
    assert got[3]["mcc"] == pytest.approx((5 * 4 - 1 * 2) / math.sqrt(6 * 7 * 5 * 6))


@pytest.mark.parametrize("mode", ["router", "safe_default"])
def test_threshold_curve_equals_brute_force(spark, mode):
    rows = scored()
    got = {r["threshold"]: r for r in thresholds.threshold_curve(frame(spark, rows), mode).collect()}
    assert sorted(got) == list(thresholds.SWEEP) == [round(0.3 + 0.05 * i, 2) for i in range(13)]
    for t in thresholds.SWEEP:
        def pred(s):
            if mode == "router":
                return int(s >= t)
            return int(s >= 0.5) if s >= t else 1
        tp = sum(y == 1 and pred(s) == 1 for _, y, s in rows)
        fp = sum(y == 0 and pred(s) == 1 for _, y, s in rows)
        assert (got[t]["tp"], got[t]["fp"]) == (tp, fp)
        assert got[t]["tp"] + got[t]["fp"] + got[t]["fn"] + got[t]["tn"] == len(rows)
    recalls = [got[t]["recall_1"] for t in thresholds.SWEEP]
    if mode == "router":
        assert recalls == sorted(recalls, reverse=True)
    else:
        assert set(recalls[4:]) == {1.0}


def test_best_threshold_falls_back_to_recall(spark):
    curve = spark.createDataFrame(
        [(0.3, 0.8, 0.5), (0.4, 0.8, 0.6), (0.5, 0.89996, 0.4)], "threshold double, recall_1 double, precision_1 double"
    )
    assert thresholds.best_threshold(curve, 0.9).first()["threshold"] == 0.5  # 0.9000 as reported
    assert thresholds.best_threshold(curve, 0.95).first()["threshold"] == 0.5
    assert thresholds.best_threshold(curve.where("threshold < 0.5"), 0.95).first()["threshold"] == 0.4
    assert thresholds.best_threshold(curve, 0.7).first()["threshold"] == 0.5
