"""Table schemas and the fixed vocabularies of the routing domain."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)

# Metric names shared by every result, comparison and metrics table.
QUALITY_METRICS = (
    "recall_1", "precision_1", "recall_0", "precision_0",
    "f1_macro", "mcc", "roc_auc", "log_loss",
)
LATENCY_METRICS = (
    "latency_mean_ms", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms",
)
METRICS = QUALITY_METRICS + LATENCY_METRICS

METRICS_STRUCT = T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])

# One schema wide enough for both result layouts: metrics nested in a struct, or at top level.
RESULT = T.StructType(
    [
        T.StructField("experiment_id", T.StringType()),
        T.StructField("approach", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("vectorizer_key", T.StringType()),
        T.StructField("classifier_key", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("metrics", METRICS_STRUCT),
        *[T.StructField(m, T.DoubleType()) for m in METRICS],
        T.StructField("passes", T.BooleanType()),
        T.StructField("model_path", T.StringType()),
        T.StructField("mlflow_run_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)

CELL = T.StructType(
    [
        T.StructField("language", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("target_count", T.LongType()),
    ]
)

# The domain vocabulary.
LANGUAGES = (
    "pure_english", "singlish_light", "singlish_heavy", "tanglish_light", "tanglish_heavy",
)
INDUSTRIES = (
    "ecommerce", "healthcare", "banking", "insurance",
    "telecom", "logistics", "hospitality", "education",
)
SIMPLE = "simple_transactional"
PROXIMITY = "location_proximity"
SCENARIOS = (SIMPLE, PROXIMITY)
PLAIN_LANGUAGE = "pure_english"

# Defaults of the routing and evaluation rules.
CONFIDENCE_THRESHOLD = 0.70
RECALL_GATE = 0.90
STRONG_MODEL = "gpt-4o"
CHEAP_MODEL = "gpt-4o-mini"
STRONG_INPUT_PER_1M = 2.50
STRONG_OUTPUT_PER_1M = 10.00
CHEAP_INPUT_PER_1M = 0.15
CHEAP_OUTPUT_PER_1M = 0.60
INPUT_TOKENS = 200
OUTPUT_TOKENS = 150
PLAN_TOTAL = 60_000
PLAN_TOLERANCE = 0.005
APPROACHES = ("classical", "transformer")
LABEL_PREFIXES = ("label=0 ", "label=1 ", "label=0: ", "label=1: ")

# Message length profile per scenario (min_words, max_words, share), inclusive.
LENGTH_PROFILE = {
    SIMPLE: ((1, 2, 0.10), (3, 8, 0.36), (9, 20, 0.39), (21, 40, 0.15)),
    PROXIMITY: ((3, 10, 0.45), (11, 25, 0.40), (26, 45, 0.15)),
}

# The default plan, shares of all messages by language.
PLAN_LANGUAGES = (
    ("pure_english", 0.60),
    ("singlish_light", 0.20),
    ("singlish_heavy", 0.10),
    ("tanglish_light", 0.07),
    ("tanglish_heavy", 0.03),
)
# Language, industry, share of the industry in the language, shares of the simple and of the
# proximity scenario in the industry.
PLAN_INDUSTRIES = (
    ("pure_english", "ecommerce", 0.12, 0.84, 0.16),
    ("pure_english", "healthcare", 0.12, 0.82, 0.18),
    ("pure_english", "banking", 0.20, 0.85, 0.15),
    ("pure_english", "insurance", 0.12, 0.85, 0.15),
    ("pure_english", "telecom", 0.13, 0.83, 0.17),
    ("pure_english", "logistics", 0.06, 0.82, 0.18),
    ("pure_english", "hospitality", 0.15, 0.82, 0.18),
    ("pure_english", "education", 0.10, 0.83, 0.17),
    ("singlish_light", "ecommerce", 0.22, 0.60, 0.40),
    ("singlish_light", "healthcare", 0.17, 0.58, 0.42),
    ("singlish_light", "banking", 0.17, 0.62, 0.38),
    ("singlish_light", "insurance", 0.04, 0.65, 0.35),
    ("singlish_light", "telecom", 0.12, 0.62, 0.38),
    ("singlish_light", "logistics", 0.11, 0.55, 0.45),
    ("singlish_light", "hospitality", 0.10, 0.58, 0.42),
    ("singlish_light", "education", 0.07, 0.60, 0.40),
    ("singlish_heavy", "ecommerce", 0.25, 0.60, 0.40),
    ("singlish_heavy", "healthcare", 0.18, 0.58, 0.42),
    ("singlish_heavy", "banking", 0.17, 0.62, 0.38),
    ("singlish_heavy", "insurance", 0.04, 0.65, 0.35),
    ("singlish_heavy", "telecom", 0.13, 0.62, 0.38),
    ("singlish_heavy", "logistics", 0.10, 0.55, 0.45),
    ("singlish_heavy", "hospitality", 0.08, 0.58, 0.42),
    ("singlish_heavy", "education", 0.05, 0.60, 0.40),
    ("tanglish_light", "ecommerce", 0.16, 0.60, 0.40),
    ("tanglish_light", "healthcare", 0.18, 0.58, 0.42),
    ("tanglish_light", "banking", 0.18, 0.62, 0.38),
    ("tanglish_light", "insurance", 0.09, 0.65, 0.35),
    ("tanglish_light", "telecom", 0.14, 0.62, 0.38),
    ("tanglish_light", "logistics", 0.11, 0.55, 0.45),
    ("tanglish_light", "hospitality", 0.05, 0.58, 0.42),
    ("tanglish_light", "education", 0.09, 0.60, 0.40),
    ("tanglish_heavy", "ecommerce", 0.17, 0.60, 0.40),
    ("tanglish_heavy", "healthcare", 0.20, 0.58, 0.42),
    ("tanglish_heavy", "banking", 0.18, 0.62, 0.38),
    ("tanglish_heavy", "insurance", 0.09, 0.65, 0.35),
    ("tanglish_heavy", "telecom", 0.13, 0.62, 0.38),
    ("tanglish_heavy", "logistics", 0.10, 0.55, 0.45),
    ("tanglish_heavy", "hospitality", 0.05, 0.58, 0.42),
    ("tanglish_heavy", "education", 0.08, 0.60, 0.40),
)
