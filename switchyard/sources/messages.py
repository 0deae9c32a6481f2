"""Message tables on disk: CSV exchange files and partitioned Parquet datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from switchyard import schema as S

_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8"}
# Written texts keep their outer blanks, and '' stays distinct from null.
_EXACT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_messages(spark: SparkSession, path: str, schema: T.StructType = S.MESSAGE) -> DataFrame:
    """CSV with header, columns taken by name; texts may hold line breaks.  Types are given, never inferred.

    A file without one of the columns, or with another order than the first file's, is an error.
    """
    header = spark.read.options(**_CSV, **_EXACT).csv(path).columns
    named = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.options(**_CSV, **_EXACT, enforceSchema=False).schema(named).csv(path)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write_messages(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV directory, one file per task (multi-line files are not splittable, so keep them small)."""
    options = {k: v for k, v in _CSV.items() if k != "multiLine"}
    df.write.mode(mode).options(**options, **_EXACT, emptyValue='""', quoteAll=True).csv(path)


def append_messages(df: DataFrame, path: str) -> None:
    write_messages(df, path, "append")


def write_dataset(df: DataFrame, path: str, dataset: str, mode: str = "append") -> None:
    """Parquet partitioned by dataset and split, so a split is read without scanning the others."""
    df.withColumn("dataset", F.lit(dataset)).write.mode(mode).partitionBy("dataset", "split").parquet(path)


def read_split(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """One split; a split or dataset that does not exist reads as no rows (partition pruning)."""
    table = spark.read.parquet(path)
    return table.where((F.col("dataset") == dataset) & (F.col("split") == split))


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType = S.MESSAGE) -> DataFrame:
    """One split file; a missing file reads as no rows."""
    try:
        return read_messages(spark, path, schema)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def list_datasets(table: DataFrame, column: str = "dataset") -> DataFrame:
    return table.select(column).distinct().orderBy(column)


def with_new_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows followed by new ones, by column name."""
    return existing.unionByName(new)
