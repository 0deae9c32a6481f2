"""Dataset profiles.

Word counts, labels, languages and scenarios have few distinct values, so every profile starts
from one map-side combined count per distinct combination and finishes on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.functions.numeric import ratio
from switchyard.plans.sizing import join_groups


def _counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def split_stats(df: DataFrame) -> DataFrame:
    """Rows, rows per label and mean label per split."""
    cells = _counts(df, "split", "label")
    ones, zeros = F.when(F.col("label") == 1, F.col("n")), F.when(F.col("label") == 0, F.col("n"))
    return cells.groupBy("split").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(zeros), F.lit(0)).alias("label_0"),
        F.coalesce(F.sum(ones), F.lit(0)).alias("label_1"),
        ratio(F.sum(F.col("label") * F.col("n")), F.sum("n")).alias("label_1_ratio"),
    )


def split_breakdown(df: DataFrame) -> DataFrame:
    """Rows per split, per split and language, per split and scenario: one scan, one table."""
    cells = _counts(df, "split", "language", "scenario")
    grouped = cells.groupingSets(
        [[F.col("split")], [F.col("split"), F.col("language")], [F.col("split"), F.col("scenario")]],
        "split", "language", "scenario",
    ).agg(
        F.sum("n").alias("rows"),
        F.grouping("language").alias("_gl"),
        F.grouping("scenario").alias("_gs"),
    )
    dimension = F.when(F.col("_gl") == 0, "language").when(F.col("_gs") == 0, "scenario").otherwise("split")
    value = F.when(F.col("_gl") == 0, F.col("language")).when(F.col("_gs") == 0, F.col("scenario"))
    return grouped.select("split", dimension.alias("dimension"), value.alias("value"), "rows")


def split_documents(df: DataFrame) -> DataFrame:
    """The same as one nested document per split, with maps of counts (a null key is written ``null``)."""
    parts = split_breakdown(df)
    entry = F.struct(F.coalesce("value", F.lit("null")).alias("value"), "rows")

    def as_map(name: str):
        picked = F.collect_list(F.when(F.col("dimension") == name, entry))
        return F.map_from_entries(F.sort_array(picked)).alias(f"{name}s")

    maps = parts.groupBy("split").agg(as_map("language"), as_map("scenario"))
    return join_groups(split_stats(df), maps, ["split"])


def eda_summary(df: DataFrame, splits: Sequence[str] = ("train", "val", "test"), focus: str = "train") -> DataFrame:
    """Rows per split (0 when a split is absent) and label and length figures of the focus split."""
    cells = _counts(df, "split", "label", "word_count")
    in_focus = F.col("split") == focus
    label_n = {v: F.coalesce(F.sum(F.when(in_focus & (F.col("label") == v), F.col("n"))), F.lit(0)) for v in (0, 1)}
    focus_n = F.coalesce(F.sum(F.when(in_focus, F.col("n"))), F.lit(0))
    totals = [F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"{s}_rows") for s in splits]
    words = F.when(in_focus, F.col("word_count"))
    return cells.agg(
        *totals,
        label_n[0].alias("label_0_count"),
        label_n[1].alias("label_1_count"),
        (ratio(label_n[0], focus_n) * 100.0).alias("label_0_pct"),
        (ratio(label_n[1], focus_n) * 100.0).alias("label_1_pct"),
        ratio(F.sum(words * F.col("n")), focus_n).alias("mean_word_count"),
        F.percentile(words, 0.5, F.col("n")).alias("median_word_count"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per value, most frequent first."""
    counted = _counts(df, column)
    whole = counted.agg(F.sum("n").alias("_t"))  # one row
    return (
        counted.join(F.broadcast(whole))
        .select(F.col(column).alias("value"), F.col("n").alias("rows"), ratio(F.col("n"), F.col("_t")).alias("share"))
        .orderBy(F.col("rows").desc(), F.col("value"))
    )


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return value_counts(df, column).limit(k)


def histogram(df: DataFrame, value: str = "word_count", by: str = "label", bins: int = 40) -> DataFrame:
    """Rows per equal-width bin between each group's own minimum and maximum, last bin closed.

    Every group has all its bins, empty ones too.  A group with a single value is spread over
    [value - 0.5, value + 0.5].
    """
    counts = _counts(df.where(F.col(value).isNotNull()), by, value)
    edges = counts.groupBy(by).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    flat = F.col("_min") == F.col("_max")
    low = F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min").cast("double"))
    high = F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max").cast("double"))
    edges = edges.select(by, low.alias("_lo"), high.alias("_hi"))
    place = F.floor((F.col(value) - F.col("_lo")) * float(bins) / (F.col("_hi") - F.col("_lo")))
    filled = (
        join_groups(counts, edges, [by]).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
        .groupBy(by, "bin").agg(F.sum("n").alias("rows"))
    )
    every = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return join_groups(every, filled, [by, "bin"], "left").select(
        by, "bin",
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / float(bins)).alias("bin_low"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def box_stats(df: DataFrame, value: str = "word_count", by: str = "language") -> DataFrame:
    """Quartiles and whiskers (most extreme values within 1.5 IQR of the box), largest group first."""
    counts = _counts(df.where(F.col(value).isNotNull()), by, value)
    boxes = counts.groupBy(by).agg(
        F.sum("n").alias("rows"),
        *[F.percentile(value, p, F.col("n")).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        join_groups(counts, boxes, [by])
        .groupBy(by, "rows", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        )
        .orderBy(F.col("rows").desc(), F.col(by))
    )


def count_or_zero(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows per wanted key, 0 for keys the table does not hold (e.g. an absent split)."""
    return names.join(_counts(df, key), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("rows"))


def example_coverage(keys: DataFrame, languages: DataFrame) -> DataFrame:
    """Distinct cell keys per language prefix, zero kept.

    The prefix is cut out of the key, which makes the prefix test an equi-join.
    """
    cells = keys.select("cell_id").distinct()
    per = cells.groupBy(F.substring_index("cell_id", "__", 1).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return languages.join(per, "language", "left").select("language", F.coalesce("n", F.lit(0)).alias("cells"))


def top_terms_per_class(df: DataFrame, tokens, k: int = 50, label: str = "label") -> DataFrame:
    """The ``k`` most frequent tokens of every class (ties by token)."""
    counted = (
        df.select(label, F.explode_outer(tokens).alias("term")).where(F.col("term").isNotNull())
        .groupBy(label, "term").agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.row_number().over(W.partitionBy(label).orderBy(F.col("n").desc(), F.col("term")))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def label_agreement(df: DataFrame, expected, by: str, target: float = 0.97) -> DataFrame:
    """Share of rows whose label equals the rule's, per group, and whether it reaches the target."""
    same = (F.col("label") == expected).cast("int")
    return (
        df.groupBy(by)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(same).alias("agree"))
        .withColumn("agreement", ratio(F.col("agree"), F.col("rows")))
        .withColumn("reached", F.col("agreement") >= target)
    )


def label_share_check(df: DataFrame, planned: DataFrame) -> DataFrame:
    """Actual against planned share per label."""
    actual = _counts(df, "label")
    both = planned.join(actual, "label", "full").select(
        "label", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("n", F.lit(0)).alias("actual")
    )
    whole = both.agg(F.sum("planned").alias("_p"), F.sum("actual").alias("_a"))  # one row
    return both.join(F.broadcast(whole)).select(
        "label", "planned", "actual",
        ratio(F.col("planned"), F.col("_p")).alias("expected_share"),
        ratio(F.col("actual"), F.col("_a")).alias("actual_share"),
    )
