"""Structured Streaming queries; each stream runs to the end of its input and is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchyard.checks.base import ANY_SCRIPT_SQL, SCORE_SQL, SCRIPTS, STRIP_SQL, check, r6, score_column, table
from switchyard.session import scratch_path
from switchyard.streaming import cells
from switchyard.streaming import messages as st


def _stream(spark, sf, name):
    # A glob, so that the table may be a file or a directory.
    return st.read_stream(spark, f"{sf}/{name[:-1]}[{name[-1]}].parquet", table(spark, sf, name).schema)


def _land(spark, stream):
    root = scratch_path(spark, "stream")
    st.append_available(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@check(
    "stream_route",
    f"""SELECT doc_id, CASE WHEN {ANY_SCRIPT_SQL} OR score >= 0.7 THEN 1 ELSE 0 END AS routed_label,
          CASE WHEN {ANY_SCRIPT_SQL} OR score >= 0.7 THEN 'gpt-4o' ELSE 'gpt-4o-mini' END AS routed_to,
          CASE WHEN {ANY_SCRIPT_SQL} THEN 1.0::DOUBLE ELSE score END AS confidence
        FROM (SELECT *, {SCORE_SQL} AS score FROM documents)""",
)
def _(spark, sf):
    routed = st.route_stream(
        _stream(spark, sf, "documents").select("doc_id", "text"),
        lambda rows: rows.withColumn("score", score_column()), 0.70, scripts=SCRIPTS,
    )
    return _land(spark, routed.select("doc_id", "routed_label", "routed_to", "confidence"))


@check(
    "stream_append_resume",
    "SELECT role, count(*) AS rows, count(DISTINCT (conv_id, turn)) AS messages FROM conversations GROUP BY 1",
)
def _(spark, sf):
    root = scratch_path(spark, "append")
    for _ in range(2):  # the second run finds nothing new
        st.append_available(_stream(spark, sf, "conversations"), f"{root}/out", f"{root}/checkpoint")
    landed = spark.read.parquet(f"{root}/out")
    return landed.groupBy("role").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("conv_id", "turn").alias("messages")
    )


@check(
    "stream_dedup",
    """SELECT user_id, event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day FROM events GROUP BY ALL""",
)
def _(spark, sf):
    events = _stream(spark, sf, "events").withColumn("ts", F.date_trunc("day", "ts"))
    kept = st.dedup_stream(events.select("user_id", "event_type", "ts"), ["user_id", "event_type", "ts"])
    return _land(spark, kept.select("user_id", "event_type", F.unix_timestamp("ts").alias("day")))


SHARE_SQL = """SELECT CAST(epoch(s) AS BIGINT) AS window_start, count(*) FILTER (hit) AS to_strong,
      count(*) FILTER (NOT hit) AS to_cheap, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS strong_share
    FROM (SELECT date_trunc('day', ts) - to_days(CAST(back AS INTEGER)) AS s, (event_id * 7919) % 1000 >= 700 AS hit
          FROM events, range({backs}) r(back))
    GROUP BY s HAVING s + to_days({width}) <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


def _share(spark, sf, width, slide=None):
    events = _stream(spark, sf, "events").select(
        "ts", (score_column(row_id="event_id") >= 0.7).cast("int").alias("routed_label")
    )
    shares = st.routed_share(events, width, slide)
    out = shares.select(F.unix_timestamp("start").alias("window_start"), "to_strong", "to_cheap", "strong_share")
    return r6(_land(spark, out), "strong_share")


@check("stream_share_tumbling", SHARE_SQL.format(backs=1, width=1))
def _(spark, sf):
    return _share(spark, sf, "1 day")


@check("stream_share_sliding", SHARE_SQL.format(backs=2, width=2))
def _(spark, sf):
    return _share(spark, sf, "2 days", "1 day")


@check(
    "stream_fill_cells",
    f"""WITH d AS (SELECT concat_ws('__', lang, 'all', 'all') AS cell_id, {STRIP_SQL} AS t FROM documents)
        SELECT cell_id, CAST(150 AS BIGINT) AS target, count(*) AS seen, count(*) FILTER (t = '') AS empty,
               least(150, count(DISTINCT t) FILTER (t <> '')) AS kept, greatest(0, 150 - count(DISTINCT t) FILTER (t <> '')) AS missing
        FROM d GROUP BY 1""",
)
def _(spark, sf):
    """Every language takes 150 different texts from the stream; the counters are read from the checkpoint."""
    all_ = F.lit("all")
    plan = table(spark, sf, "documents").select(F.col("lang").alias("language")).distinct().select(
        "language", all_.alias("industry"), all_.alias("scenario"), F.lit(150).alias("target_count")
    )
    stream = _stream(spark, sf, "documents").select(
        "doc_id", "text", F.col("lang").alias("language"), all_.alias("industry"), all_.alias("scenario"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
    )
    root = scratch_path(spark, "fill")
    st.append_available(cells.fill_cells(stream, plan), f"{root}/out", f"{root}/checkpoint")
    return cells.state_of_cells(spark, f"{root}/checkpoint").select("cell_id", "target", "seen", "empty", "kept", "missing")
