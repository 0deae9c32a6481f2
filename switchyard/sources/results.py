"""Experiment result documents (JSON) and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard import schema as S


def scan_results(spark: SparkSession, root: str, file_name: str = "result.json") -> DataFrame:
    """Every result document below ``root``; unreadable files are skipped."""
    layout = T.StructType([*S.RESULT.fields, T.StructField("_corrupt_record", T.StringType())])
    found = (
        spark.read.schema(layout)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .json(root)
    )
    return found.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def parse_results(raw: DataFrame, column: str = "json") -> DataFrame:
    """The same layout from a text column; rows that are not JSON objects are skipped."""
    layout = T.StructType([*S.RESULT.fields, T.StructField("_corrupt_record", T.StringType())])
    doc = F.from_json(F.col(column), layout, {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = raw.where(F.col(column).isNotNull()).select(doc.alias("_d")).select("_d.*")
    return parsed.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def _text(name: str, default: Column | None = None) -> Column:
    return F.coalesce(F.col(name), F.lit("") if default is None else default)


def normalise_results(results: DataFrame, dataset: str = "") -> DataFrame:
    """Flat or nested documents to one nested layout: missing metrics 0, missing id from its parts."""
    nested = F.col("metrics").isNotNull()
    metrics = F.struct(
        *[
            F.coalesce(F.when(nested, F.col(f"metrics.{m}")).otherwise(F.col(m)), F.lit(0.0)).alias(m)
            for m in S.METRICS
        ]
    )
    from_parts = F.concat(_text("vectorizer_key"), F.lit("__"), _text("classifier_key"))
    given = F.when(F.col("experiment_id") != "", F.col("experiment_id"))
    return results.select(
        F.coalesce(given, from_parts).alias("experiment_id"),
        _text("approach", F.lit(S.APPROACHES[0])).alias("approach"),
        _text("dataset_name", F.lit(dataset)).alias("dataset_name"),
        _text("model_name", F.coalesce(given, from_parts)).alias("model_name"),
        metrics.alias("metrics"),
        _text("model_path").alias("model_path"),
        _text("mlflow_run_id").alias("mlflow_run_id"),
        _text("notes").alias("notes"),
    )


def flatten_results(nested: DataFrame) -> DataFrame:
    """Nested metrics to top-level columns."""
    return nested.select(*[c for c in nested.columns if c != "metrics"], "metrics.*")


def nest_results(flat: DataFrame) -> DataFrame:
    """Top-level metric columns to one struct."""
    rest = [c for c in flat.columns if c not in S.METRICS]
    return flat.select(*rest, F.struct(*S.METRICS).alias("metrics"))


def write_report(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "json") -> None:
    """A report table as JSON lines, CSV or Parquet."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def as_document(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_documents(documents: DataFrame, root: str, column: str = "document", folder: str = "folder") -> None:
    """``<root>/folder=<name>/result.json`` per document (result documents are few and small)."""
    documents.select(F.col(column).alias("value"), folder).write.partitionBy(folder).text(root)
    spark = documents.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(path(f"{root}/{folder}=*/part-*")):
        files.rename(part.getPath(), path(part.getPath().getParent(), "result.json"))
