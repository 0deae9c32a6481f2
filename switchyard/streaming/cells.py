"""Filling the cells of a plan from a stream: duplicates go, a full cell takes no more, gaps are reported.

Per cell the state holds the digests of the texts taken and five counters.  A row is trimmed, dropped if empty or already
taken, and passed on while the cell has room; once a cell is full its digests are given up.  A cell that has had no row for a while
of event time reports what it lacks, as soon as the watermark has passed that time.  Everything known lies in the checkpoint: a query that stops goes on where it stopped, and ``state_of_cells``
reads counters and gaps from there without the stream.

State with several variables needs the RocksDB store; ``fill_cells`` selects it for the streams that the session starts from then on.

A cell's rows pass one task in turn, digests stay in the state store and are looked up once per distinct text of a batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from switchyard.functions import text as tx
from switchyard.operators.cells import KEYS, with_cell_id
from switchyard.operators.cleaning import text_key
from switchyard.plans.sizing import broadcast_within
from switchyard.streaming.messages import event_time

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The session setting that names the state store, and the store that can hold several variables.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COUNTS = "target long, seen long, empty long, dupes long, kept long, late long, last long"
OUTPUT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("cell_id", T.StringType()), T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()), T.StructField("missing", T.LongType()),
])


class CellFiller(StatefulProcessor):
    """``row`` for every text taken, ``gap`` when a cell that is not full has waited ``wait`` milliseconds of event time for rows."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", COUNTS)
        self.taken = handle.getMapState("taken", "digest string", "doc_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        target, seen, empty, dupes, kept, late, last = self.counts.get() if self.counts.exists() else (0,) * 7
        for part in rows:
            target = int(part["target_count"].iloc[0])  # the plan may have changed
            last = max(last, int(part["ts"].max().timestamp() * 1000))
            out = []
            for doc_id, text, digest in zip(part["doc_id"], part["text"], part["digest"]):
                seen += 1
                if not text:
                    empty += 1
                elif kept >= target:
                    late += 1
                elif self.taken.containsKey((digest,)):
                    dupes += 1
                else:
                    self.taken.updateValue((digest,), (None if pd.isna(doc_id) else int(doc_id),))
                    kept += 1
                    out.append(("row", key[0], doc_id, text, None))
            yield pd.DataFrame(out, columns=OUTPUT.names)
        if kept >= target:
            self.taken.clear()
        self.counts.update((target, seen, empty, dupes, kept, late, last))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if kept < target:
            self.handle.registerTimer(last + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        target, _, _, _, kept, _, _ = self.counts.get()
        yield pd.DataFrame([("gap", key[0], None, None, target - kept)], columns=OUTPUT.names)

    def close(self) -> None:
        pass


def fill_cells(stream: DataFrame, plan: DataFrame, wait: int = 60_000, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """kind, cell_id, doc_id, text, missing.  ``plan`` has the cell keys and target_count; rows of other cells are left out.

    ``time`` is the event time (rows later than ``delay`` go), ``wait`` the milliseconds after which a cell reports its gap.
    """
    stream.sparkSession.conf.set(*STORE)
    targets = broadcast_within(with_cell_id(plan).select("cell_id", F.col("target_count").cast("long").alias("target_count")))
    timed = event_time(stream.withColumn("ts", F.col(time)), "ts").withWatermark("ts", delay)
    trimmed = with_cell_id(timed).withColumn("text", F.coalesce(tx.strip(F.col("text")), F.lit("")))
    asked = trimmed.select("cell_id", "doc_id", "text", "ts", F.hex(text_key(F.col("text"))).alias("digest")).join(targets, "cell_id")
    return asked.groupBy("cell_id").transformWithStateInPandas(
        statefulProcessor=CellFiller(int(wait)), outputStructType=OUTPUT, outputMode="Append", timeMode="eventTime"
    )


def state_of_cells(spark: SparkSession, checkpoint: str) -> DataFrame:
    """cell_id, target, seen, empty, dupes, kept, late, missing as of the last batch, from the checkpoint alone."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "counts").load()
    return state.select("key.cell_id", "value.*").drop("last").withColumn("missing", F.greatest(F.lit(0).cast("long"), F.col("target") - F.col("kept")))


def gaps_of_stream(spark: SparkSession, checkpoint: str, plan: DataFrame) -> DataFrame:
    """The batch gap table (cell_id, keys, rows, missing) of what the stream has taken; cells without any row included."""
    kept = state_of_cells(spark, checkpoint).select("cell_id", "kept")
    have = F.coalesce(F.col("kept"), F.lit(0).cast("long"))
    joined = with_cell_id(plan).join(kept, "cell_id", "left").where(have < F.col("target_count"))
    return joined.select("cell_id", *KEYS, have.alias("rows"), (F.col("target_count") - have).alias("missing"))
