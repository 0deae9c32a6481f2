"""The corpus pipeline: each stage works on the documents that the one before it kept.

1. ``language``: documents whose language cannot be told (no letter) go; the classifier learns from this table.
2. ``exact``: of equal normalised texts one stays.
3. ``near``: of every component of the five-word-shingle Jaccard join (0.8 or more) the smallest id stays.
4. ``mix``: every document is repeated as often as the mix takes its words: ``taken`` words of ``size`` give
   taken // size whole copies, and one more if the rest is at least half of the document.  Documents without
   words count as taken once.
5. ``tokens``: texts become ids of the byte-level vocabulary; the last stage adds n_tokens and the digests.

Every stage is written as Parquet in the shared folder and read again as the next one's documents.
Rows with a null id pass the near-duplicate stage (nothing names their group); an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import bpe, exact_dedup, langid, mixing, ngram_join
from switchyard.llm.queries import vocabulary_path
from switchyard.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies per document id; rows that repeat an id are averaged by their words."""
    mixed = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("_id")).agg(
        F.sum("size").alias("_size"), F.sum("taken").alias("_taken")
    )
    copies = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(1).cast("int")
    counted = mixed.select("_id", copies.alias("_copies")).where("_copies > 0")
    joined = docs.join(counted, F.col("doc_id").eqNullSafe(F.col("_id")))
    each = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], each).drop("_copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary_path(), ids=False)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: The language and token stages cannot be stated in SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
