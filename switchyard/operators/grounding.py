"""Verification of the script rule on categorised texts, and length buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard import schema as S
from switchyard.functions import text as tx
from switchyard.functions.numeric import ratio


def verify_scripts(
    df: DataFrame, category: str = "script", text: str = "text",
    scripts: dict[str, tuple[int, int]] | None = None, mixed_prefix: str = "english_",
) -> DataFrame:
    """Caught flag and detected script per row; mixed categories keep only rows that hold a script."""
    checked = df.withColumn("caught", tx.has_script(F.col(text), scripts)).withColumn(
        "detected", F.coalesce(tx.script_language(F.col(text), scripts), F.lit("none"))
    )
    return checked.where(~F.col(category).startswith(mixed_prefix) | F.col("caught"))


def parse_caught(df: DataFrame, column: str = "caught") -> DataFrame:
    """'True'/'False' text to BOOLEAN; anything but 'true' in any case is false."""
    return df.withColumn(column, F.coalesce(F.lower(F.col(column)) == "true", F.lit(False)))


def catch_rates(df: DataFrame, category: str = "script") -> DataFrame:
    """Total, caught and rate per category, plus a TOTAL row (added up from the category rows)."""
    counted = df.groupBy(category).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("caught")).alias("hit"))
    rolled = counted.rollup(category).agg(
        F.sum("total").alias("total"), F.sum("hit").alias("hit"), F.grouping(category).alias("_all")
    )
    return rolled.select(
        F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(category)).alias(category),
        "total", F.col("hit").alias("caught"), ratio(F.col("hit"), F.col("total")).alias("rate"),
    )


def length_profile(spark: SparkSession) -> DataFrame:
    """The fixed length ranges as a table (seven rows)."""
    rows = [(s, i, *r) for s, ranges in S.LENGTH_PROFILE.items() for i, r in enumerate(ranges)]
    return spark.createDataFrame(rows, "scenario string, bucket int, min_words int, max_words int, fraction double")


def length_buckets(df: DataFrame) -> DataFrame:
    """Bucket of every message by its scenario's ranges; null outside all of them."""
    profile = length_profile(df.sparkSession).withColumnRenamed("scenario", "_s")
    fits = (F.col("scenario") == F.col("_s")) & F.col("word_count").between(F.col("min_words"), F.col("max_words"))
    return df.join(F.broadcast(profile), fits, "left").drop("_s")  # seven fixed rows


def length_fit(df: DataFrame) -> DataFrame:
    """Actual against planned share of every length range."""
    placed = length_buckets(df).groupBy("scenario", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    sizes = placed.groupBy("scenario").agg(F.sum("rows").alias("total"))
    return (
        length_profile(df.sparkSession).join(placed, ["scenario", "bucket"], "left").join(sizes, "scenario", "left")
        .select(
            "scenario", "bucket", "fraction", F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce(ratio(F.coalesce("rows", F.lit(0)), F.col("total")), F.lit(0.0)).alias("share"),
        )
    )
