"""Registry of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard import schema as S
from switchyard.functions import text as tx

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    query: Query
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must return the same rows."""

    def register(query: Query) -> Query:
        if name in CHECKS:
            raise ValueError(f"duplicate query {name}")
        CHECKS[name] = Check(query, sql)
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The tables hold no Sinhala or Tamil, so the script rule runs on two Latin ranges.
SCRIPTS = {"latin1": (0x00C0, 0x00FF), "latin_ext": (0x0100, 0x024F)}
ANY_SCRIPT_SQL = r"regexp_matches(text, '[\x{C0}-\x{24F}]')"
WS_SQL = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORDS_SQL = f"len(list_filter(regexp_split_to_array(text, '{WS_SQL}+'), lambda w: w <> ''))"
STRIP_SQL = f"regexp_replace(regexp_replace(text, '^{WS_SQL}+', ''), '{WS_SQL}+$', '')"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as message rows: language, industry and scenario from lang, source, toxic."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("language"), F.col("source").alias("industry")
    )
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, S.PROXIMITY).otherwise(S.SIMPLE).alias("scenario"),
        F.col("quality").cast("int").alias("label"),
    )
    return docs.join(labels, "doc_id")


MESSAGES_SQL = f"""m AS (
  SELECT d.doc_id, d.text, d.lang AS language, d.source AS industry,
         CASE WHEN l.toxic = 1 THEN '{S.PROXIMITY}' ELSE '{S.SIMPLE}' END AS scenario,
         CAST(l.quality AS INTEGER) AS label
  FROM documents d JOIN labels l USING (doc_id))"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).withColumn("word_count", tx.word_count(F.col("text")))


MEASURED_SQL = f"{MESSAGES_SQL}, w AS (SELECT *, CAST({WORDS_SQL} AS INTEGER) AS word_count FROM m)"

# A stand-in model score per experiment: a fixed function of the id, so both engines agree.
MULTIPLIERS = {"exp_a": 7919, "exp_b": 104729, "exp_c": 1299709}


def score_column(multiplier: int = 7919, row_id: str = "doc_id") -> Column:
    return ((F.col(row_id) * multiplier) % 1000) / F.lit(1000.0)


SCORE_SQL = "((doc_id * 7919) % 1000) / 1000.0::DOUBLE"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score (no text needed)."""
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.col("quality").cast("int").alias("label"), score_column().alias("score"))


SCORED_SQL = f"s AS (SELECT doc_id, CAST(quality AS INTEGER) AS label, {SCORE_SQL} AS score FROM labels)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of several experiments: experiment_id, doc_id, label, score, pred."""
    labels = table(spark, sf_dir, "labels")
    runs = F.array(
        *[F.struct(F.lit(n).alias("experiment_id"), score_column(k).alias("score")) for n, k in MULTIPLIERS.items()]
    )
    long = labels.select("doc_id", F.col("quality").cast("int").alias("label"), F.inline(runs))
    return long.withColumn("pred", (F.col("score") >= 0.3).cast("int"))


PREDICTIONS_SQL = """p AS (
  SELECT experiment_id, doc_id, CAST(quality AS INTEGER) AS label,
         ((doc_id * k) % 1000) / 1000.0::DOUBLE AS score,
         CASE WHEN ((doc_id * k) % 1000) >= 300 THEN 1 ELSE 0 END AS pred
  FROM labels, (VALUES ('exp_a', 7919), ('exp_b', 104729), ('exp_c', 1299709)) v(experiment_id, k))"""

CONFUSION_SQL = """CAST(count(*) FILTER (label = 1 AND pred = 1) AS BIGINT) AS tp,
    CAST(count(*) FILTER (label = 0 AND pred = 1) AS BIGINT) AS fp,
    CAST(count(*) FILTER (label = 1 AND pred = 0) AS BIGINT) AS fn,
    CAST(count(*) FILTER (label = 0 AND pred = 0) AS BIGINT) AS tn"""


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


QUALITY_SQL = f"""round({div('tp', 'tp + fn')}, 6) AS recall_1,
    round({div('tp', 'tp + fp')}, 6) AS precision_1,
    round({div('tn', 'tn + fp')}, 6) AS recall_0,
    round({div('tn', 'tn + fn')}, 6) AS precision_0,
    round((({div('2 * tp', '2 * tp + fp + fn')}) + ({div('2 * tn', '2 * tn + fp + fn')})) / 2, 6) AS f1_macro,
    round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0
          ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
             / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc"""


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Round the named doubles for comparison between engines."""
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


