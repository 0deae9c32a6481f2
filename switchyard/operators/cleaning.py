"""Row validation and exact deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.functions import text as tx
from switchyard.plans.sizing import join_groups
from switchyard.session import shared_dir


def _require(df: DataFrame, names: Sequence[str]) -> None:
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")


def is_valid(text: str = "text", label: str = "label") -> Column:
    """Text and label present, text not blank."""
    return F.col(text).isNotNull() & F.col(label).isNotNull() & ~tx.is_blank(F.col(text))


def validate_and_clean(df: DataFrame) -> DataFrame:
    """Keep valid rows, label as INT."""
    _require(df, ["text", "label"])
    return df.where(is_valid()).withColumn("label", F.col("label").cast("int"))


def dropped_rows(df: DataFrame, by: str = "split") -> DataFrame:
    """Rows before, rows after and rows dropped by validation, per split, in one pass."""
    _require(df, ["text", "label", by])
    kept = F.count_if(F.coalesce(is_valid(), F.lit(False)))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("before"), kept.alias("after"), (F.count(F.lit(1)) - kept).alias("dropped")
    )


def trim_and_drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, tx.strip(F.col(text))).where(F.col(text) != "")


def text_key(text: Column) -> Column:
    """32-byte SHA-256 digest: equal digests mean equal texts, and shuffles stay narrow."""
    return F.unhex(F.sha2(text, 256))


def keep_first(df: DataFrame, keys: Sequence[Column], order: str) -> DataFrame:
    """One row per key: the smallest ``order`` (null last), any one of the rows that share it.

    The rows are read twice.  First only digests and ids, which are counted by hash (map-side combined, so a text that makes
    up a third of the table under one id sends one row per task) and checkpointed together with what is decided on them.
    Then the ids that lost are taken out of the rows: texts are only moved if the losers are too many to broadcast, and
    nothing is sorted by text.  Only if several rows share key and smallest id a third pass collapses those, in map tasks first.
    """
    shared_dir(df.sparkSession)
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)))
    seen = keyed.groupBy(*names, F.col(order).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    first = seen.groupBy(*names).agg(F.min("_id").alias("_first"))
    met = join_groups(seen, first, names).withColumn("_wins", F.col("_id").eqNullSafe(F.col("_first")))
    marked = met.where("NOT _wins OR _n > 1").select(*[F.col(n).alias(f"_seen{n}") for n in names], "_id", "_wins").checkpoint()
    same = [F.col(n).eqNullSafe(F.col(f"_seen{n}")) for n in names] + [F.col(order).eqNullSafe(F.col("_id"))]
    alone = keyed.join(marked, same, "left_anti").select(*df.columns)
    shared = marked.where("_wins")
    if shared.isEmpty():
        return alone
    # The row limit is pushed below the shuffle: of a row repeated without end, each task sends one.
    nth = F.row_number().over(W.partitionBy(*names).orderBy(order))
    one = keyed.join(shared, same, "left_semi").withColumn("_nth", nth).where("_nth = 1").select(*df.columns)
    return alone.unionByName(one)


def dedup_exact(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Whole-table exact dedup, first row by ``order`` kept."""
    return keep_first(df, [text_key(F.col(text))], order)


def dedup_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows, kept rows and dropped rows of :func:`dedup_exact` without moving any text."""
    copies = df.groupBy(text_key(F.col(text)).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("kept")).withColumn(
        "dropped", F.col("rows") - F.col("kept")
    )


def dedup_within_cells(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """Trim, drop empty texts, keep the first copy of a text inside each cell."""
    cell = tx.cell_id(F.col("language"), F.col("industry"), F.col("scenario"))
    return keep_first(trim_and_drop_empty(df), [cell, text_key(F.col("text"))], order)


def cell_dedup_counters(df: DataFrame) -> DataFrame:
    """Rows seen, empty texts, duplicate texts and rows kept per cell."""
    trimmed = df.select(
        tx.cell_id(F.col("language"), F.col("industry"), F.col("scenario")).alias("cell_id"),
        tx.strip(F.col("text")).alias("_t"),
    )
    # Copies are merged per (cell, text) first, so a hot cell is spread over its texts.
    copies = trimmed.groupBy(
        "cell_id", (F.col("_t") == "").alias("_empty"), text_key(F.col("_t")).alias("_k")
    ).agg(F.count(F.lit(1)).alias("_n"))
    full = ~F.col("_empty")
    return copies.groupBy("cell_id").agg(
        F.sum("_n").alias("seen"),
        F.coalesce(F.sum(F.when(F.col("_empty"), F.col("_n"))), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.when(full, F.col("_n") - 1)), F.lit(0)).alias("dupes"),
        F.count_if(full).alias("kept"),
    )


def first_examples(df: DataFrame, n: int = 8, order: str = "doc_id") -> DataFrame:
    """Strip label prefixes, drop what becomes empty, keep the first ``n`` per cell.

    ``row_number() <= n`` is pushed below the shuffle (window group limit), so a hot cell sends at
    most ``n`` rows per task.
    """
    cell = tx.cell_id(F.col("language"), F.col("industry"), F.col("scenario"))
    cleaned = df.withColumn("cell_id", cell).withColumn("text", tx.strip_label_prefixes(F.col("text")))
    rank = F.row_number().over(W.partitionBy("cell_id").orderBy(order))
    return cleaned.where(F.col("text") != "").withColumn("rank", rank).where(F.col("rank") <= n)
