"""Classifier quality from long prediction tables.

Everything is derived from additive counts: rows are counted once per (experiment, label, prediction, score) with
map-side aggregation, and every metric is computed from those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard import schema as S
from switchyard.functions.numeric import ratio
from switchyard.plans.running import percentiles, running_totals
from switchyard.plans.sizing import broadcast_within, join_groups
from switchyard.session import shared_dir

# Fixed value: probabilities are clipped by the double epsilon before the logarithm.
EPSILON = 2.220446049250313e-16


def confusion(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn per group; all four are always present."""
    unit = F.lit(1) if weight is None else weight

    def cell(label: int, pred: int) -> Column:
        hit = (F.col("label") == label) & (F.col("pred") == pred)
        return F.coalesce(F.sum(F.when(hit, unit)), F.lit(0))

    return df.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")
    )


def quality() -> dict[str, Column]:
    """Quality metrics as expressions over the four counts."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    f1_1 = ratio(2 * tp, 2 * tp + fp + fn)
    f1_0 = ratio(2 * tn, 2 * tn + fp + fn)
    # Only classes seen in labels or predictions enter the macro mean.
    seen_1 = F.when(tp + fp + fn > 0, 1.0).otherwise(0.0)
    seen_0 = F.when(tn + fp + fn > 0, 1.0).otherwise(0.0)
    margins = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return {
        "recall_1": ratio(tp, tp + fn),
        "precision_1": ratio(tp, tp + fp),
        "recall_0": ratio(tn, tn + fp),
        "precision_0": ratio(tn, tn + fn),
        "f1_macro": ratio(f1_1 * seen_1 + f1_0 * seen_0, seen_1 + seen_0),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(margins)),
    }


def accuracy() -> Column:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return ratio(tp + tn, tp + fp + fn + tn)


def with_quality(counts: DataFrame) -> DataFrame:
    return counts.select("*", *[c.alias(n) for n, c in quality().items()])


def _loss() -> Column:
    p = F.greatest(F.lit(EPSILON), F.least(F.lit(1.0 - EPSILON), F.col("score")))
    return F.when(F.col("label") == 1, -F.ln(p)).otherwise(-F.ln(1.0 - p))


def log_loss(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(_loss()).alias("log_loss"))


def _score_steps(df: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    unit = F.lit(1).cast("long") if weight is None else weight
    pos = F.when(F.col("label") == 1, unit).otherwise(F.lit(0))
    return running_totals(df, by, "score", {"pos": pos, "neg": unit - pos})


def roc_auc(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Rank statistic with averaged ties; null when a class is missing."""
    below = F.col("cum_neg") - F.col("neg")
    gain = F.col("pos") * (below + F.col("neg") / 2.0)
    totals = _score_steps(df, by, weight).groupBy(*by).agg(
        F.sum(gain).alias("_gain"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    pairs = F.col("_p").cast("double") * F.col("_n").cast("double")
    return totals.select(*by, F.when(pairs > 0, F.col("_gain") / pairs).alias("roc_auc"))


def roc_curve(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr) when everything scoring at least ``score`` is predicted 1, for every distinct score."""
    steps = _score_steps(df, by)
    sizes = steps.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    placed = join_groups(steps, broadcast_within(sizes) if by else sizes, by)
    tp = F.col("_p") - F.col("cum_pos") + F.col("pos")
    fp = F.col("_n") - F.col("cum_neg") + F.col("neg")
    return placed.select(
        *by, "score", tp.alias("tp"), fp.alias("fp"),
        ratio(fp, F.col("_n")).alias("fpr"), ratio(tp, F.col("_p")).alias("tpr"),
    )


def evaluate(df: DataFrame, by: Sequence[str] = ("experiment_id",)) -> DataFrame:
    """All eight quality metrics per experiment from (experiment, label, pred, score) rows."""
    by = list(by)
    shared_dir(df.sparkSession)
    # The predictions (often a model's fresh scores) are read here and nowhere else.
    cells = df.groupBy(*by, "label", "pred", "score").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    n = F.col("_n")
    counts = with_quality(confusion(cells, by, n))
    loss = cells.where("score is not null").groupBy(*by).agg((F.sum(_loss() * n) / F.sum(n)).alias("log_loss"))
    return join_groups(join_groups(counts, roc_auc(cells, by, n), by), loss, by)


def latency_stats(df: DataFrame, value: str = "latency_ms", by: Sequence[str] = ()) -> DataFrame:
    """mean, p50, p95, p99 (linear interpolation) and max, exact at any size."""
    stats = percentiles(df, value, {"p50": 0.50, "p95": 0.95, "p99": 0.99}, by)
    return stats.select(
        *by, "n", F.col("mean").alias("mean_ms"),
        *[F.col(c).alias(f"{c}_ms") for c in ("p50", "p95", "p99", "max")],
    )


def production_gate(df: DataFrame, threshold: float = S.RECALL_GATE) -> DataFrame:
    return df.withColumn("passes", F.col("recall_1") >= threshold)


def false_negatives(df: DataFrame, by: str, samples: int = 5, order: str = "doc_id") -> DataFrame:
    """Missed positives per category: their number and the first few by id.

    Counting is a separate aggregate, and ``row_number() <= n`` is cut before the shuffle.
    """
    missed = df.where((F.col("label") == 1) & (F.col("pred") == 0))
    totals = missed.groupBy(by).agg(F.count(F.lit(1)).alias("missed"))
    rank = F.row_number().over(W.partitionBy(by).orderBy(order))
    few = missed.select(by, order).withColumn("rank", rank).where(F.col("rank") <= samples)
    return join_groups(few, totals, [by])
