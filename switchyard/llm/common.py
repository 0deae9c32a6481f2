"""What the operators of this package share: batch sizes, column lookups, Arrow passes over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch.  Texts may be long, so batches stay small; a batch is all a task holds of its input.
BATCH_ROWS = 256
#: The white space of the contracts: space and U+0009 to U+000D, all single bytes in UTF-8.
SPACE = b" \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Send long texts to Python in small batches (a session setting, it never changes results)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow_pass(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def narrow(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Only the id and the text, under fixed names: other columns never reach Python and cannot clash."""
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Copies that one array lists at most.
STRIDE = 4096


def numbered(rows: DataFrame, times: str, name: str) -> DataFrame:
    """Every row ``times`` times, with ``name`` from 1 on; no array grows with the number of copies."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / STRIDE)))
    blocks = rows.where(F.col(times) > 0).select("*", block.alias("_block"))
    last = F.least(F.col(times).cast("long"), (F.col("_block") + 1) * STRIDE)
    nth = F.explode(F.sequence(F.col("_block") * STRIDE + 1, last))
    return blocks.select(*[F.col(f"`{c}`") for c in rows.columns], nth.alias(name))
