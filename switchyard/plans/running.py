"""Running totals and order statistics without a one-task window.

``sum() over (order by x)`` sorts a whole group in one task.  Here equal values are first merged
with map-side aggregation, the distinct values are range-partitioned into as many buckets as wanted, each
bucket is scanned by its own task, and the (few) bucket totals supply the offsets.  Results are
exact: the ranges only decide where the cuts fall.  The bucketed counts are checkpointed, so the input is
read once and the buckets stay as they are when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.functions.numeric import ratio
from switchyard.plans.sizing import broadcast_within, join_groups
from switchyard.session import shared_dir


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct (by, order): its totals ``name`` and inclusive running ``cum_name``."""
    shared_dir(df.sparkSession)
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = df.groupBy(*by, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ranged = merged.repartitionByRange(buckets, *by, order)
    bucketed = ranged.withColumn("_bucket", F.spark_partition_id()).checkpoint()
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*by, "_bucket")
        .agg(*[F.sum(n).alias(n) for n in sums])
        .select(*by, "_bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums])
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = join_groups(bucketed, broadcast_within(offsets), [*by, "_bucket"])
    return joined.select(
        *by, order, *sums,
        *[(F.col(f"_off_{n}") + F.sum(n).over(inside)).alias(f"cum_{n}") for n in sums],
    )


def percentiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Exact linearly interpolated percentiles, mean, max and row count of ``value`` per group."""
    known = df.where(F.col(value).isNotNull())
    steps = running_totals(known, by, value, {"n": F.lit(1)}, buckets)
    sizes = steps.groupBy(*by).agg(
        F.max("cum_n").alias("_total"),
        F.sum(F.col(value) * F.col("n")).alias("_sum"),
        F.max(value).alias("_max"),
    )
    placed = join_groups(steps, broadcast_within(sizes) if by else sizes, by)
    first, total = F.col("cum_n") - F.col("n"), F.col("_total")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("cum_n")), F.col(value).cast("double")))

    picks = []
    for name, p in probs.items():
        spot = (total - 1) * F.lit(float(p))
        picks += [
            at(F.floor(spot)).alias(f"_lo_{name}"),
            at(F.ceil(spot)).alias(f"_hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_w_{name}"),
        ]
    found = placed.groupBy(*by).agg(
        F.max("_total").alias("n"), F.max("_sum").alias("_sum"), F.max("_max").alias("max"), *picks
    )
    return found.select(
        *by, "n",
        ratio(F.col("_sum"), F.col("n")).alias("mean"),
        *[
            (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_w_{k}")).alias(k)
            for k in probs
        ],
        "max",
    )
