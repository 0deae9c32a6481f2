"""Stored summaries that merge: quantile sketches of latencies, score bins for ROC-AUC.

Per day (or any other part) one small row per group is written; any span of days is answered from those rows alone, the
messages are not read again.  Quantiles come from KLL sketches (built into Spark, combined on the map side): the value
returned for p has a rank within ``RANK_ERROR`` of p, in 99 of 100 sketches.  ROC-AUC comes from counts per label and score bin:
pairs in different bins are ordered exactly, pairs in one bin count half, so the error is at most half the share of such pairs,
which is returned with it.

Defined cases: null values and scores are left out; a group without values has no row; without both labels AUC is null, as is its bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.plans.sizing import join_groups

#: Size of a sketch, and the rank error that goes with it (published bound for a single quantile).
K, RANK_ERROR = 800, 0.005
#: Score bins over [0, 1].
BINS = 1000


def latency_sketches(df: DataFrame, value: str, by: Sequence[str], day: str, k: int = K) -> DataFrame:
    """by, day, sketch (binary), total, largest: one row per group and day."""
    known = df.where(F.col(value).isNotNull())
    number = F.col(value).cast("double")
    return known.groupBy(*by, day).agg(
        F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"), F.sum(number).alias("total"), F.max(number).alias("largest")
    )


def merged_quantiles(sketches: DataFrame, probs: Mapping[str, float], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """by, n, mean, the named quantiles, max: sketches of any days put together."""
    merged = sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("total").alias("total"), F.max("largest").alias("max")
    )
    n = F.kll_sketch_get_n_double("sketch")
    picks = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return merged.select(*by, n.alias("n"), (F.col("total") / n).alias("mean"), *picks, "max")


def rank_errors(df: DataFrame, value: str, quantiles: DataFrame, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by and, per named quantile, how far its exact rank is from the one asked for (0 if equal values span it)."""
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    met = join_groups(known, quantiles.select(*by, *probs), by)
    counts = [c for n in probs for c in (F.avg((F.col("_v") < F.col(n)).cast("int")).alias(f"_low_{n}"), F.avg((F.col("_v") <= F.col(n)).cast("int")).alias(f"_high_{n}"))]
    off = [F.greatest(F.col(f"_low_{n}") - p, p - F.col(f"_high_{n}"), F.lit(0.0)).alias(n) for n, p in probs.items()]
    return met.groupBy(*by).agg(*counts).select(*by, *off)


def score_bins(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score", bins: int = BINS) -> DataFrame:
    """by, bin, ones, zeros: scores in [0, 1]; 1 belongs to the last bin."""
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(score) * bins))).cast("int")
    return df.where(F.col(score).isNotNull()).groupBy(*by, place.alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros")
    )


def binned_auc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, auc, error_bound, ones, zeros from score bins of any days put together (a group has ``bins`` rows at most)."""
    merged = counts.groupBy(*by, "bin").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    below = F.coalesce(F.sum("zeros").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = merged.withColumn("_below", below)
    won = F.sum(F.col("ones").cast("double") * F.col("_below"))
    tied = F.sum(F.col("ones").cast("double") * F.col("zeros"))
    totals = placed.groupBy(*by).agg(won.alias("_won"), tied.alias("_tied"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    pairs = F.col("ones").cast("double") * F.col("zeros")
    return totals.select(
        *by, F.try_divide(F.col("_won") + F.col("_tied") / 2, pairs).alias("auc"), F.try_divide(F.col("_tied") / 2, pairs).alias("error_bound"),
        "ones", "zeros",
    )
