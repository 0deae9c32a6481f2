"""Streaming routing, resumable append, dedup and windowed shares."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard import schema as S
from switchyard.operators.routing import route, route_scoring_only_unscripted


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """File stream with a fixed schema; ``path`` may be a glob."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def route_stream(
    stream: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    threshold: float = S.CONFIDENCE_THRESHOLD,
    text: str = "text",
    scripts: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """The batch routing rule on a stream.  Stateless, so it scales with the source partitions.

    Without ``scorer`` the stream must already hold ``score``.
    """
    if scorer is None:
        return route(stream, threshold, "score", text, scripts)
    return route_scoring_only_unscripted(stream, scorer, threshold, text, scripts)


def append_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                     partition_by: Sequence[str] = ()) -> None:
    """Append everything available and stop.

    The checkpoint records what was written: running again adds only new rows, and a run cut short
    continues where it stopped without writing a row twice.
    """
    writer = (
        stream.writeStream.format(fmt).outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()


def event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Timestamps without zone cannot carry a watermark; read them in the session zone."""
    return stream.withColumn(column, F.col(column).cast(T.TimestampType()))


def dedup_stream(stream: DataFrame, keys: Sequence[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """First row per key; state is dropped once the watermark has passed the key by ``delay``."""
    return event_time(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def routed_share(stream: DataFrame, width: str, slide: str | None = None, time: str = "ts",
                 delay: str = "10 minutes") -> DataFrame:
    """Messages per route and event-time window, emitted once a window is closed.

    Every route gets its column in one row per window, so the state is one row per window and the
    share needs no second aggregate.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    strong = F.count_if(F.col("routed_label") == 1)
    total = F.count(F.lit(1))
    return (
        event_time(stream, time).withWatermark(time, delay)
        .groupBy(window.alias("window"))
        .agg(strong.alias("to_strong"), (total - strong).alias("to_cheap"), (strong / total).alias("strong_share"))
        .select("window.start", "window.end", "to_strong", "to_cheap", "strong_share")
    )
