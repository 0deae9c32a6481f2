"""Train / val / test assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.plans.sizing import broadcast_within, join_groups
from switchyard.session import shared_dir

SPLITS = ("train", "val", "test")
# Cumulative shares in tenths: 80 / 10 / 10.
TRAIN_TENTHS, VAL_TENTHS = 8, 9


def shuffle_key(row_id: Column, seed: int = 42) -> Column:
    """Seeded pseudo-random hex key of a row id."""
    return F.md5(F.concat_ws("|", F.lit(seed), row_id))


def hash_split(df: DataFrame, row_id: str = "doc_id", seed: int = 42) -> DataFrame:
    """Approximate 80/10/10: a pure function of the id, no shuffle, stable as data grows."""
    tenth = F.conv(F.substring(shuffle_key(F.col(row_id), seed), 1, 8), 16, 10).cast("long") % 10
    name = F.when(tenth < TRAIN_TENTHS, "train").when(tenth < VAL_TENTHS, "val").otherwise("test")
    return df.withColumn("split", name)


def stratified_split(
    df: DataFrame,
    strata: Sequence[str] = ("label", "scenario"),
    row_id: str = "doc_id",
    seed: int = 42,
    prefix: int = 4,
) -> DataFrame:
    """Exact 80/10/10 inside every stratum, by rank of a seeded hash; null is a stratum like any other.

    Same rows as ``row_number() over (partition by stratum order by hash, id)``, but no stratum is
    ever sorted whole: hash prefixes (``16**prefix`` per stratum) are counted with map-side
    aggregation, the two quota ranks are located in one prefix each, and only the keys of those
    prefixes are ranked.  The rows themselves get their split from a join with two cut keys per
    stratum, without a shuffle while the strata are few.
    """
    strata = list(strata)
    keyed = df.select(*strata, shuffle_key(F.col(row_id), seed).alias("_key"), F.col(row_id).alias("_id"))
    shared_dir(df.sparkSession)
    keyed = keyed.withColumn("_prefix", F.substring("_key", 1, prefix)).checkpoint()  # keys only, read three times
    upto = W.partitionBy(*strata).orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*strata)
    counts = keyed.groupBy(*strata, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    ranked = counts.select(
        *strata, "_prefix",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto).alias("_until"),
        F.sum("_n").over(whole).alias("_size"),
    )
    quota = {name: F.floor(F.col("_size") * tenths / 10) for name, tenths in
             (("_train", TRAIN_TENTHS), ("_val", VAL_TENTHS))}

    def holds(q: Column) -> Column:
        return (F.col("_before") < q) & (q <= F.col("_until"))

    edge = ranked.select(*strata, "_prefix", "_before", "_until", *[q.alias(n) for n, q in quota.items()])
    edge = edge.where(holds(F.col("_train")) | holds(F.col("_val")))
    inside = W.partitionBy(*strata, "_prefix").orderBy("_key", "_id")
    placed = join_groups(keyed, broadcast_within(edge), [*strata, "_prefix"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(inside)
    )
    placed = placed.where((F.col("_rank") == F.col("_train")) | (F.col("_rank") == F.col("_val")))
    at = F.struct("_key", "_id")
    cuts = placed.groupBy(*strata).agg(  # at most two rows per stratum
        F.max(F.when(F.col("_rank") == F.col("_train"), at)).alias("_train_cut"),
        F.max(F.when(F.col("_rank") == F.col("_val"), at)).alias("_val_cut"),
    )
    mine = F.struct(shuffle_key(F.col(row_id), seed).alias("_key"), F.col(row_id).alias("_id"))
    name = (
        F.when(mine <= F.col("_train_cut"), "train").when(mine <= F.col("_val_cut"), "val").otherwise("test")
    )
    out = join_groups(df, broadcast_within(cuts), strata, "left").withColumn("split", name)
    return out.select(*df.columns, "split")


def overlap(df: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """Keys found in more than one split; a disjoint split gives no rows."""
    pairs = df.select(key.alias("_k"), split).distinct()
    return pairs.groupBy("_k").agg(F.count(F.lit(1)).alias("splits")).where(F.col("splits") > 1)


def pairwise_overlap(df: DataFrame, key: Column, names: Sequence[str] = SPLITS) -> DataFrame:
    """Number of distinct keys shared by each pair of splits (0 when disjoint)."""
    flags = [F.max((F.col("split") == n).cast("int")).alias(n) for n in names]
    seen = df.groupBy(key.alias("_k")).agg(*flags)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = seen.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(f"`{a}|{b}`").alias("shared")) for a, b in pairs])
    return sums.select(F.inline(rows))
