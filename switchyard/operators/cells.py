"""Plan cells: counts from fractions, checks, lookups, resume and gap filling.

A cell is one (language, industry, scenario) with a target row count.  Plans are small; the message
tables they are compared with are not, so those are always counted per cell first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard import schema as S
from switchyard.functions import text as tx

KEYS = ["language", "industry", "scenario"]


def with_cell_id(df: DataFrame) -> DataFrame:
    return df.withColumn("cell_id", tx.cell_id(*map(F.col, KEYS)))


def filter_cells(
    df: DataFrame, language: str | None = None, industry: str | None = None, scenario: str | None = None
) -> DataFrame:
    """Keep rows equal to every given key; an omitted key does not filter."""
    for name, wanted in zip(KEYS, (language, industry, scenario), strict=True):
        if wanted:
            df = df.where(F.col(name) == wanted)
    return df


def default_plan(spark: SparkSession) -> DataFrame:
    """The default fraction tree, one row per cell."""
    share = dict(S.PLAN_LANGUAGES)
    rows = [
        (language, industry, scenario, share[language], part, fraction)
        for language, industry, part, *scenarios in S.PLAN_INDUSTRIES
        for scenario, fraction in zip(S.SCENARIOS, scenarios, strict=True)
    ]
    fractions = "language_fraction double, industry_fraction double, scenario_fraction double"
    return spark.createDataFrame(rows, f"language string, industry string, scenario string, {fractions}")


def nest_plan(fractions: DataFrame) -> DataFrame:
    """Flat fractions to one row per language holding its industries, each holding its scenarios.

    The group sizes are bounded by the vocabulary of keys, not by the messages.
    """
    leaf = F.struct("scenario", "scenario_fraction")
    branch = F.struct("industry", "industry_fraction", "scenarios")
    return (
        fractions.groupBy("language", "language_fraction", "industry", "industry_fraction")
        .agg(F.sort_array(F.collect_list(leaf)).alias("scenarios"))
        .groupBy("language", "language_fraction")
        .agg(F.sort_array(F.collect_list(branch)).alias("industries"))
    )


def expand_plan(nested: DataFrame) -> DataFrame:
    """The inverse of :func:`nest_plan`: one row per cell, in plan order."""
    industries = nested.select("language", "language_fraction", F.explode("industries").alias("i"))
    return industries.select(
        "language", "language_fraction", "i.industry", "i.industry_fraction", F.explode("i.scenarios").alias("s")
    ).select("language", "language_fraction", "industry", "industry_fraction", "s.*")


def plan_counts(fractions: DataFrame, total: int = S.PLAN_TOTAL) -> DataFrame:
    """Targets per level; every level rounds half-to-even the count above it times its fraction."""
    language = F.rint(F.lit(float(total)) * F.col("language_fraction"))
    industry = F.rint(F.col("_l") * F.col("industry_fraction"))
    scenario = F.rint(F.col("_i") * F.col("scenario_fraction"))
    return (
        fractions.withColumn("_l", language)
        .withColumn("_i", industry)
        .select(
            *KEYS,
            F.col("_l").cast("long").alias("language_count"),
            F.col("_i").cast("long").alias("industry_count"),
            scenario.cast("long").alias("target_count"),
        )
    )


def to_cells(counts: DataFrame) -> DataFrame:
    """Cells that need at least one row."""
    return counts.where(F.col("target_count") >= 1).select(*KEYS, "target_count")


def observed_fractions(messages: DataFrame) -> DataFrame:
    """The fraction tree that reproduces the mix of a message table."""
    cells = messages.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    lang, ind = W.partitionBy("language"), W.partitionBy("language", "industry")
    # Windows over per-cell counts: as many rows as cells.
    sized = cells.withColumn("_i", F.sum("_n").over(ind)).withColumn("_l", F.sum("_n").over(lang))
    whole = cells.agg(F.sum("_n").alias("_t"))  # one row
    return sized.join(F.broadcast(whole)).select(
        *KEYS,
        (F.col("_l") / F.col("_t")).alias("language_fraction"),
        (F.col("_i") / F.col("_l")).alias("industry_fraction"),
        (F.col("_n") / F.col("_i")).alias("scenario_fraction"),
    )


def plan_violations(fractions: DataFrame, tolerance: float = S.PLAN_TOLERANCE) -> DataFrame:
    """Nodes whose child fractions do not add up to one; no rows means the plan is sound."""
    languages = (
        fractions.select("language", "language_fraction").distinct()
        .agg(F.sum("language_fraction").alias("total"))
        .select(F.lit("plan").alias("level"), F.lit("all").alias("node"), "total")
    )
    industries = (
        fractions.select("language", "industry", "industry_fraction").distinct()
        .groupBy("language").agg(F.sum("industry_fraction").alias("total"))
        .select(F.lit("language").alias("level"), F.col("language").alias("node"), "total")
    )
    scenarios = (
        fractions.groupBy("language", "industry").agg(F.sum("scenario_fraction").alias("total"))
        .select(
            F.lit("industry").alias("level"), F.concat_ws("__", "language", "industry").alias("node"), "total"
        )
    )
    every = languages.unionByName(industries).unionByName(scenarios)
    return every.where(F.abs(F.col("total") - 1.0) > tolerance)


def planned_labels(cells: DataFrame, label: Column | None = None) -> DataFrame:
    """Planned rows per label."""
    label = tx.resolve_label(F.col("language"), F.col("scenario")) if label is None else label
    return cells.groupBy(label.alias("label")).agg(F.sum("target_count").alias("planned"))


def planned_by(counts: DataFrame, key: str) -> DataFrame:
    """Planned rows per language, industry or scenario."""
    return counts.groupBy(key).agg(F.sum("target_count").alias("planned"))


def language_summary(counts: DataFrame) -> DataFrame:
    """Planned rows per language as rounded at language level (not the sum of its cells)."""
    return counts.select("language", "language_count").distinct()


def find_cell(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Planned target for each wanted key; null where the plan has no such cell."""
    return wanted.select(*KEYS).join(cells, KEYS, "left")


def count_cells(messages: DataFrame) -> DataFrame:
    return with_cell_id(messages).groupBy("cell_id").agg(F.count(F.lit(1)).alias("rows"))


def completed_cells(messages: DataFrame) -> DataFrame:
    """Ids of the cells a checkpoint already holds rows for."""
    return with_cell_id(messages).select("cell_id").distinct()


def remaining_cells(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: planned cells without any row yet."""
    return with_cell_id(plan).join(completed_cells(done), "cell_id", "left_anti")


def remaining_ids(plan: DataFrame, done: DataFrame) -> DataFrame:
    """The same on ids alone, as a set difference."""
    return with_cell_id(plan).select("cell_id").subtract(completed_cells(done))


def gaps(plan: DataFrame, messages: DataFrame) -> DataFrame:
    """Underfilled cells with what they have and what they still lack."""
    have = F.coalesce(F.col("rows"), F.lit(0))
    return (
        with_cell_id(plan)
        .join(count_cells(messages), "cell_id", "left")
        .where(have < F.col("target_count"))
        .select("cell_id", *KEYS, have.alias("rows"), (F.col("target_count") - have).alias("missing"))
    )


def total_missing(gap_rows: DataFrame) -> DataFrame:
    return gap_rows.agg(
        F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing")
    )


def first_cells(plan: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` cells in plan order."""
    return plan.orderBy(*(order or KEYS)).limit(n)
