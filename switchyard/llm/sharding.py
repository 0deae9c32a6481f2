"""Shards under a byte limit by extendible hashing.

A document's place is the bit string of a hash of its id.  The directory starts with one bucket; a bucket
above the byte limit splits on the next bit, others stay.  Because a bucket never holds more than the one
it was cut from, the directory is known from byte totals per prefix alone: a document's bucket is its
shortest prefix whose bytes fit.  Totals are aggregated once at a fine depth (map-side combined) and summed
upwards; a bucket is in the directory if it fits and the one above it does not.  Only buckets still too large at
the fine depth are counted again, deeper, so work follows the oversized part.

A bucket whose documents share all bits (repeated ids, or one document above the limit) cannot be cut by
hashing; repeated rows are told apart by their rank under the hash first, so only a single document larger
than the limit is left alone in a bucket above it, marked ``oversize``.

Defined cases: a null id hashes as its own value; null and empty texts have 0 bytes; an empty table gives
an empty result; other columns are ignored by the assignment and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.llm.common import numbered
from switchyard.plans.sizing import join_groups
from switchyard.session import shared_dir

LIMIT_BYTES = 16 << 20
#: Bits that a directory may use.
BITS = 60
#: Bits that one counting pass looks deeper than the directory needs on average.
AHEAD = 4


def hash_bits(doc_id: Column, salt: Column | None = None) -> Column:
    """60 bits of the MD5 of the id (and of a row's rank among rows of the same id)."""
    plain = F.coalesce(doc_id.cast("string"), F.lit("null"))
    if salt is not None:
        plain = F.when(salt > 1, F.concat_ws("#", plain, salt.cast("string"))).otherwise(plain)
    return F.conv(F.substring(F.md5(plain), 1, 15), 16, 10).cast("long")


def prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, BITS - depth)


def directory(places: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """depth, bucket (the prefix), bytes, rows, oversize of every bucket; ``places`` has _bits and bytes.

    One round per ``AHEAD`` further bits, over the rows of oversized buckets only.
    """
    total = places.agg(F.sum("bytes")).first()[0] or 0
    found, open_rows, start = [], places, 0
    depth = min(BITS, max(0, (-(-total // limit)) - 1).bit_length() + AHEAD)
    while True:
        fine = (
            open_rows.groupBy(prefix(F.col("_bits"), depth).alias("_fine"))
            .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).checkpoint()
        )
        every = F.array(*[
            F.struct(F.lit(d).alias("depth"), F.shiftright("_fine", depth - d).alias("bucket"))
            for d in range(start, depth + 1)
        ])
        totals = (
            fine.select("bytes", "rows", F.inline(every)).groupBy("depth", "bucket")
            .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).checkpoint()
        )
        fits = (F.col("bytes") <= limit) | (F.col("depth") == BITS)
        split = totals.where(~fits).select((F.col("depth") + 1).alias("_depth"), F.col("bucket").alias("_above"))
        first = totals.where(fits & (F.col("depth") == start))
        later = totals.where(fits & (F.col("depth") > start)).join(
            split, (F.col("depth") == F.col("_depth")) & (F.shiftright("bucket", 1) == F.col("_above")), "left_semi"
        )
        found.append(first.unionByName(later))
        over = totals.where(~fits & (F.col("depth") == depth)).select(F.col("bucket").alias("_over"))
        if over.isEmpty():
            break
        open_rows = open_rows.join(over, prefix(F.col("_bits"), depth) == F.col("_over"), "left_semi")
        start, depth = depth + 1, min(BITS, depth + AHEAD)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select("depth", "bucket", "bytes", "rows", (F.col("bytes") > limit).alias("oversize"))


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bytes, _bits of every row; rows of the same id are told apart by their rank."""
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long").alias("bytes"),
    )
    # Equal (id, bytes) rows are interchangeable: they are counted, then numbered within the id.
    counted = rows.groupBy("doc_id", "bytes").agg(F.count(F.lit(1)).alias("_times"))
    before = W.partitionBy("doc_id").orderBy("bytes").rowsBetween(W.unboundedPreceding, -1)
    offset = counted.withColumn("_before", F.coalesce(F.sum("_times").over(before), F.lit(0)))
    nth = (F.col("_before") + F.col("_copy")).alias("nth")
    each = numbered(offset, "_times", "_copy").select("doc_id", "bytes", nth)
    return each.withColumn("_bits", hash_bits(F.col("doc_id"), F.col("nth")))


def assign_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, bytes, shard (prefix bits, ``*`` for the undivided table), depth, shard_bytes, shard_rows, oversize."""
    shared_dir(docs.sparkSession)
    rows = placed(docs, doc_id, text).checkpoint()
    buckets = directory(rows, limit).checkpoint()
    depths = [r[0] for r in buckets.select("depth").distinct().orderBy("depth").collect()]  # BITS at most
    by_depth = F.array(*[
        F.struct(F.lit(d).alias("depth"), prefix(F.col("_bits"), d).alias("bucket")) for d in depths
    ]) if depths else F.array().cast("array<struct<depth:int,bucket:bigint>>")
    tried = rows.select("doc_id", "nth", "bytes", F.inline(by_depth))
    found = tried.join(buckets.withColumnsRenamed({"bytes": "shard_bytes", "rows": "shard_rows"}), ["depth", "bucket"])
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(
        F.expr("lpad(conv(cast(bucket as string), 10, 2), depth, '0')")
    )
    return found.select("doc_id", "nth", "bytes", name.alias("shard"), "depth", "shard_bytes", "shard_rows", "oversize")


def ranked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with _id and _nth, the rank among the rows of the id that :func:`placed` counts: by bytes, ties by place.

    Rows are numbered inside the part they came in and parts are added up, so rows of one id need no common task.
    Parts are fixed by a checkpoint, as a rerun may deal rows out anew.
    """
    shared_dir(docs.sparkSession)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long")
    rows = docs.select(
        "*", F.col(f"`{doc_id}`").cast("long").alias("_id"), size.alias("_bytes"),
        F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"),
    ).checkpoint()
    counted = rows.groupBy("_id", "_bytes", "_part").agg(F.count(F.lit(1)).alias("_times"))
    before = W.partitionBy("_id").orderBy("_bytes", "_part").rowsBetween(W.unboundedPreceding, -1)
    offset = counted.withColumn("_before", F.coalesce(F.sum("_times").over(before), F.lit(0))).drop("_times")
    inside = F.row_number().over(W.partitionBy("_id", "_bytes", "_part").orderBy("_at"))
    joined = join_groups(rows.withColumn("_inside", inside), offset, ["_id", "_bytes", "_part"])
    return joined.withColumn("_nth", F.col("_before") + F.col("_inside")).drop("_bytes", "_part", "_at", "_inside", "_before")


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Write the rows with all columns as Parquet, one folder per shard (``shard=<bits>``); ids may repeat."""
    shards = assign_shards(docs, doc_id, text, limit).select(F.col("doc_id").alias("_id"), F.col("nth").alias("_nth"), "shard")
    keyed = join_groups(ranked(docs, doc_id, text), shards, ["_id", "_nth"]).drop("_id", "_nth")
    keyed.repartition("shard").write.partitionBy("shard").parquet(path)
