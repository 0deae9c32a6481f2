"""Metrics, thresholds, routing, ranking, result documents and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchyard import schema as S
from switchyard.checks.base import (
    ANY_SCRIPT_SQL, CONFUSION_SQL, MESSAGES_SQL, PREDICTIONS_SQL, QUALITY_SQL, SCORE_SQL, SCORED_SQL, SCRIPTS,
    STRIP_SQL, check, div, messages, predictions, r6, score_column, scored, table,
)
from switchyard.operators import costs, features, metrics, ranking, routing, thresholds
from switchyard.session import scratch_path
from switchyard.sources import results as docs_io

QUALITY = ("recall_1", "precision_1", "recall_0", "precision_0", "f1_macro", "mcc")
PAIRS_SQL = f"{PREDICTIONS_SQL}, n AS (SELECT experiment_id, {CONFUSION_SQL} FROM p GROUP BY 1)"

# ---- metrics -------------------------------------------------------------------------------


@check("confusion_matrix", f"WITH {PAIRS_SQL} SELECT * FROM n")
def _(spark, sf):
    return metrics.confusion(predictions(spark, sf), ["experiment_id"])


@check("quality_metrics", f"WITH {PAIRS_SQL} SELECT experiment_id, {QUALITY_SQL} FROM n")
def _(spark, sf):
    counts = metrics.confusion(predictions(spark, sf), ["experiment_id"])
    return r6(metrics.with_quality(counts).drop("tp", "fp", "fn", "tn"), *QUALITY)


AUC_SQL = """d AS (SELECT experiment_id, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
      FROM p GROUP BY ALL),
    c AS (SELECT *, sum(neg) OVER (PARTITION BY experiment_id ORDER BY score) AS cn,
                 sum(pos) OVER (PARTITION BY experiment_id ORDER BY score) AS cp,
                 sum(neg) OVER (PARTITION BY experiment_id) AS tn_, sum(pos) OVER (PARTITION BY experiment_id) AS tp_
          FROM d),
    auc AS (SELECT experiment_id, sum(pos * (cn - neg + neg / 2.0::DOUBLE)) / (max(tp_)::DOUBLE * max(tn_)) AS roc_auc
            FROM c GROUP BY 1)"""


@check("roc_auc", f"WITH {PREDICTIONS_SQL}, {AUC_SQL} SELECT experiment_id, round(roc_auc, 6) AS roc_auc FROM auc")
def _(spark, sf):
    return r6(metrics.roc_auc(predictions(spark, sf), ["experiment_id"]), "roc_auc")


@check(
    "roc_curve",
    f"""WITH {PREDICTIONS_SQL}, {AUC_SQL} SELECT experiment_id, score, CAST(tp_ - cp + pos AS BIGINT) AS tp,
          CAST(tn_ - cn + neg AS BIGINT) AS fp, round((tn_ - cn + neg) / tn_::DOUBLE, 6) AS fpr,
          round((tp_ - cp + pos) / tp_::DOUBLE, 6) AS tpr FROM c""",
)
def _(spark, sf):
    return r6(metrics.roc_curve(predictions(spark, sf), ["experiment_id"]), "fpr", "tpr")


LOSS_SQL = f"""ll AS (SELECT experiment_id, avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS log_loss
    FROM (SELECT *, greatest({metrics.EPSILON}::DOUBLE, least(1 - {metrics.EPSILON}::DOUBLE, score)) AS q FROM p)
    GROUP BY 1)"""


@check("log_loss", f"WITH {PREDICTIONS_SQL}, {LOSS_SQL} SELECT experiment_id, round(log_loss, 6) AS log_loss FROM ll")
def _(spark, sf):
    return r6(metrics.log_loss(predictions(spark, sf), ["experiment_id"]), "log_loss")


@check(
    "evaluate_experiments",
    f"""WITH {PAIRS_SQL}, {AUC_SQL}, {LOSS_SQL}
        SELECT n.experiment_id, {QUALITY_SQL}, round(roc_auc, 6) AS roc_auc, round(log_loss, 6) AS log_loss
        FROM n JOIN auc USING (experiment_id) JOIN ll USING (experiment_id)""",
)
def _(spark, sf):
    table_ = metrics.evaluate(predictions(spark, sf)).drop("tp", "fp", "fn", "tn")
    return r6(table_, *S.QUALITY_METRICS)


LATENCY_SQL = """round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
    round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms,
    round(max(value), 6) AS max_ms"""
LATENCY = ("mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")


@check("latency_stats", f"SELECT count(*) AS n, {LATENCY_SQL} FROM events")
def _(spark, sf):
    return r6(metrics.latency_stats(table(spark, sf, "events"), "value"), *LATENCY)


@check("latency_stats_by_type", f"SELECT event_type, count(*) AS n, {LATENCY_SQL} FROM events GROUP BY 1")
def _(spark, sf):
    return r6(metrics.latency_stats(table(spark, sf, "events"), "value", ["event_type"]), *LATENCY)


@check(
    "labelled_pairs",
    f"""SELECT l.doc_id, CAST(quality AS INTEGER) AS label, CASE WHEN s >= 0.3 THEN 1 ELSE 0 END AS pred
        FROM labels l JOIN (SELECT doc_id, {SCORE_SQL} AS s FROM documents) d USING (doc_id)""",
)
def _(spark, sf):
    # Predictions and truths come from different tables and meet on the id, never by position.
    preds = table(spark, sf, "documents").select("doc_id", (score_column() >= 0.3).cast("int").alias("pred"))
    truth = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return truth.join(preds, "doc_id")


@check(
    "class_weights",
    f"""WITH {SCORED_SQL} SELECT doc_id, label, round((SELECT count(*) FROM s) / (2.0::DOUBLE * n), 6) AS weight
        FROM s JOIN (SELECT label, count(*) AS n FROM s GROUP BY 1) USING (label)""",
)
def _(spark, sf):
    return r6(features.balanced_weights(scored(spark, sf)).select("doc_id", "label", "weight"), "weight")


@check(
    "false_negatives",
    f"""WITH {MESSAGES_SQL}, f AS (SELECT doc_id, industry FROM m WHERE label = 1 AND {SCORE_SQL} < 0.7)
        SELECT industry, doc_id, rank, missed FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY industry ORDER BY doc_id) AS INTEGER) AS rank,
                 count(*) OVER (PARTITION BY industry) AS missed FROM f) WHERE rank <= 5""",
)
def _(spark, sf):
    rows = messages(spark, sf).withColumn("pred", (score_column() >= 0.7).cast("int"))
    return metrics.false_negatives(rows, "industry")


# ---- thresholds ----------------------------------------------------------------------------

GRID_SQL = "g AS (SELECT (i * 5 + 30) / 100.0::DOUBLE AS threshold FROM range(13) r(i))"
ROUTER_PRED = "CASE WHEN score >= threshold THEN 1 ELSE 0 END"
SAFE_PRED = "CASE WHEN score >= threshold THEN CASE WHEN score >= 0.5 THEN 1 ELSE 0 END ELSE 1 END"


def _curve_sql(pred: str) -> str:
    return f"""{SCORED_SQL}, {GRID_SQL}, v AS (SELECT threshold, {CONFUSION_SQL}
        FROM (SELECT threshold, label, {pred} AS pred FROM s, g) GROUP BY 1),
      curve AS (SELECT threshold, {div('tp', 'tp + fn')} AS recall_1, {div('tp', 'tp + fp')} AS precision_1,
                (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, tp, fp, fn, tn FROM v)"""


CURVE_OUT = """threshold, round(recall_1, 6) AS recall_1, round(precision_1, 6) AS precision_1,
    round(accuracy, 6) AS accuracy, tp, fp, fn, tn"""
RATES = ("recall_1", "precision_1", "accuracy")


@check("threshold_curve", f"WITH {_curve_sql(ROUTER_PRED)} SELECT {CURVE_OUT} FROM curve")
def _(spark, sf):
    return r6(thresholds.threshold_curve(scored(spark, sf)), *RATES)


@check("threshold_curve_safe_default", f"WITH {_curve_sql(SAFE_PRED)} SELECT {CURVE_OUT} FROM curve")
def _(spark, sf):
    return r6(thresholds.threshold_curve(scored(spark, sf), mode="safe_default"), *RATES)


@check(
    "threshold_curve_by_experiment",
    f"""WITH {PREDICTIONS_SQL}, {GRID_SQL}, v AS (SELECT experiment_id, threshold, {CONFUSION_SQL}
          FROM (SELECT experiment_id, threshold, label, {ROUTER_PRED} AS pred FROM p, g) GROUP BY ALL)
        SELECT experiment_id, threshold, round({div('tp', 'tp + fn')}, 6) AS recall_1,
          round({div('tp', 'tp + fp')}, 6) AS precision_1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy,
          tp, fp, fn, tn FROM v""",
)
def _(spark, sf):
    return r6(thresholds.threshold_curve(predictions(spark, sf), by=["experiment_id"]), *RATES)


def _best_sql(pred: str, target: float) -> str:
    return f"""WITH {_curve_sql(pred)}, k AS (SELECT *, CAST(printf('%.4f', recall_1) AS DOUBLE) AS r4,
          CAST(printf('%.4f', precision_1) AS DOUBLE) AS p4 FROM curve)
        SELECT {CURVE_OUT}, {target}::DOUBLE AS min_recall_1_target FROM k
        ORDER BY r4 >= {target} DESC, CASE WHEN r4 >= {target} THEN threshold ELSE r4 END DESC, p4 DESC, threshold LIMIT 1"""


@check("best_threshold", _best_sql(ROUTER_PRED, 0.5))
def _(spark, sf):
    return r6(thresholds.best_threshold(thresholds.threshold_curve(scored(spark, sf)), 0.5), *RATES)


@check("best_threshold_unreached", _best_sql(ROUTER_PRED, 0.99))
def _(spark, sf):
    return r6(thresholds.best_threshold(thresholds.threshold_curve(scored(spark, sf)), 0.99), *RATES)


@check("best_threshold_safe_default", _best_sql(SAFE_PRED, 0.9))
def _(spark, sf):
    curve = thresholds.threshold_curve(scored(spark, sf), mode="safe_default")
    return r6(thresholds.best_threshold(curve, 0.9), *RATES)


@check(
    "threshold_curve_document",
    f"""WITH {_curve_sql(ROUTER_PRED)} SELECT t.threshold AS optimal_threshold,
          (SELECT count(*) FROM curve) AS points, round(t.recall_1, 6) AS optimal_recall_1,
          t.tp + t.fp + t.fn + t.tn AS val_rows
        FROM curve t WHERE recall_1 >= 0.5 ORDER BY threshold DESC LIMIT 1""",
)
def _(spark, sf):
    # Written, reloaded, then inspected.
    document = thresholds.curve_document(thresholds.threshold_curve(scored(spark, sf)), 0.5)
    path = scratch_path(spark, "curve")
    docs_io.write_report(document, path)
    back = docs_io.read_report(spark, path, document.schema)
    return r6(
        back.select(
            "optimal_threshold", F.size("curve").cast("long").alias("points"), "optimal_recall_1", "val_rows"
        ),
        "optimal_recall_1",
    )


# ---- routing -------------------------------------------------------------------------------

ROUTED_SQL = f"""CASE WHEN {ANY_SCRIPT_SQL} OR score >= 0.7 THEN 1 ELSE 0 END"""
REASON_SQL = f"""CASE WHEN {ANY_SCRIPT_SQL} THEN '{routing.SCRIPT_REASON}'
    WHEN score >= 0.7 THEN 'confidence ' || printf('%.3f', score) || ' ≥ threshold 0.70 → gpt-4o'
    ELSE 'confidence ' || printf('%.3f', score) || ' < threshold 0.70 → gpt-4o-mini' END"""


@check(
    "route_messages",
    f"""SELECT doc_id, {ROUTED_SQL} AS routed_label,
          CASE WHEN {ROUTED_SQL} = 1 THEN 'gpt-4o' ELSE 'gpt-4o-mini' END AS routed_to,
          CASE WHEN {ANY_SCRIPT_SQL} THEN 1.0::DOUBLE ELSE score END AS confidence, {REASON_SQL} AS routing_reason
        FROM (SELECT *, {SCORE_SQL} AS score FROM documents)""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").withColumn("score", score_column())
    out = routing.route(rows, 0.70, scripts=SCRIPTS)
    return out.select("doc_id", "routed_label", "routed_to", "confidence", "routing_reason")


@check(
    "route_script_rows_unscored",
    f"""SELECT doc_id, {ROUTED_SQL} AS routed_label,
          CASE WHEN {ANY_SCRIPT_SQL} THEN 1.0::DOUBLE ELSE score END AS confidence
        FROM (SELECT *, {SCORE_SQL} AS score FROM documents)""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    out = routing.route_scoring_only_unscripted(
        rows, lambda d: d.withColumn("score", score_column()), 0.70, scripts=SCRIPTS
    )
    return out.select("doc_id", "routed_label", "confidence")


@check(
    "route_lines",
    f"""SELECT doc_id, pos, {ROUTED_SQL} AS routed_label, score FROM (
          SELECT doc_id, pos, text, ((doc_id * 7919 + pos * 104729) % 1000) / 1000.0::DOUBLE AS score FROM (
            SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, {STRIP_SQL} AS text FROM (
              SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
                     generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE text <> '')""",
)
def _(spark, sf):
    lines = routing.split_lines(table(spark, sf, "documents").select("doc_id", "text"))
    score = ((F.col("doc_id") * 7919 + F.col("pos") * 104729) % 1000) / F.lit(1000.0)
    return routing.route(lines.withColumn("score", score), 0.70, scripts=SCRIPTS).select(
        "doc_id", "pos", "routed_label", "score"
    )


@check(
    "routing_baselines",
    f"""WITH {MESSAGES_SQL}, b AS (SELECT label, 'script_only' AS strategy, CAST({ANY_SCRIPT_SQL} AS INTEGER) AS pred FROM m
          UNION ALL SELECT label, 'all_strong', 1 FROM m UNION ALL SELECT label, 'all_cheap', 0 FROM m),
        n AS (SELECT strategy, {CONFUSION_SQL} FROM b GROUP BY 1)
        SELECT strategy, tp, fp, fn, tn, {QUALITY_SQL} FROM n""",
)
def _(spark, sf):
    return r6(routing.baselines(messages(spark, sf), SCRIPTS), *QUALITY)


# ---- results, ranking, costs ---------------------------------------------------------------


def _results(spark, sf):
    """One flat result row per experiment, as a training run would report it."""
    table_ = metrics.evaluate(predictions(spark, sf)).drop("tp", "fp", "fn", "tn")
    latency = {m: F.lit(i + 1.0) for i, m in enumerate(S.LATENCY_METRICS)}
    parts = F.split("experiment_id", "_")
    return r6(table_, *S.QUALITY_METRICS).withColumns(
        {
            **latency,
            "approach": F.when(F.col("experiment_id") == "exp_c", "transformer").otherwise("classical"),
            "vectorizer_key": parts[0],
            "classifier_key": parts[1],
            "dataset_name": F.lit("v1"),
        }
    )


RESULT_SQL = f"""{PAIRS_SQL}, {AUC_SQL}, {LOSS_SQL}, r AS (
    SELECT n.experiment_id, {QUALITY_SQL}, round(roc_auc, 6) AS roc_auc, round(log_loss, 6) AS log_loss,
      1.0::DOUBLE AS latency_mean_ms, 2.0::DOUBLE AS latency_p50_ms, 3.0::DOUBLE AS latency_p95_ms,
      4.0::DOUBLE AS latency_p99_ms,
      CASE WHEN n.experiment_id = 'exp_c' THEN 'transformer' ELSE 'classical' END AS approach, tp, fp, fn, tn
    FROM n JOIN auc USING (experiment_id) JOIN ll USING (experiment_id))"""
METRIC_LIST = ", ".join(S.METRICS)


@check(
    "report_round_trip",
    f"""WITH {RESULT_SQL} SELECT f AS format, experiment_id, recall_1, mcc
        FROM r, (VALUES ('csv'), ('json'), ('parquet')) v(f)""",
)
def _(spark, sf):
    """A comparison report written, and read again, in every format."""
    report = _results(spark, sf).select("experiment_id", "recall_1", "mcc")
    back = None
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(spark, f"report-{fmt}")
        docs_io.write_report(report, path, fmt=fmt)
        one = docs_io.read_report(spark, path, report.schema, fmt).withColumn("format", F.lit(fmt))
        back = one if back is None else back.unionByName(one)
    return back


@check("scan_results", f"WITH {RESULT_SQL} SELECT experiment_id, approach, {METRIC_LIST} FROM r")
def _(spark, sf):
    # Half of the documents are flat, half nested; each goes to a file of its own plus a broken one.
    flat = _results(spark, sf)
    root = scratch_path(spark, "experiments")
    nested = docs_io.nest_results(flat.where("experiment_id <> 'exp_a'"))
    name = F.get_json_object("document", "$.experiment_id").alias("folder")
    layout = docs_io.as_document(flat.where("experiment_id = 'exp_a'")).unionByName(docs_io.as_document(nested))
    broken = spark.createDataFrame([("{not json", "broken")], "document string, folder string")
    docs_io.write_documents(layout.select("document", name).unionByName(broken), f"{root}/models")
    found = docs_io.scan_results(spark, root)
    return docs_io.flatten_results(docs_io.normalise_results(found)).select("experiment_id", "approach", *S.METRICS)


@check(
    "parse_results",
    f"""WITH {RESULT_SQL} SELECT replace(experiment_id, '_', '__') AS experiment_id, 'v1' AS dataset_name,
          recall_1, mcc, 0.0::DOUBLE AS log_loss FROM r""",
)
def _(spark, sf):
    # The id and one metric are missing and must be filled in.
    raw = docs_io.as_document(_results(spark, sf).drop("experiment_id", "log_loss", "approach"), "json")
    bad = raw.limit(1).select(F.lit("[broken").alias("json"))
    parsed = docs_io.normalise_results(docs_io.parse_results(raw.unionByName(bad)))
    return docs_io.flatten_results(parsed).select("experiment_id", "dataset_name", "recall_1", "mcc", "log_loss")


@check("combine_results", f"WITH {RESULT_SQL} SELECT experiment_id, approach, recall_1, "
       "CASE WHEN approach = 'classical' THEN latency_p50_ms END AS latency_p50_ms FROM r")
def _(spark, sf):
    every = _results(spark, sf).select("experiment_id", "approach", "recall_1", "latency_p50_ms")
    classical = every.where(F.col("approach") == "classical")
    other = every.where(F.col("approach") != "classical").drop("latency_p50_ms")
    return ranking.combine_results(classical, other)


@check(
    "comparison_table",
    f"WITH {RESULT_SQL} SELECT experiment_id, approach, recall_1, mcc, recall_1 >= 0.7 AS passes FROM r",
)
def _(spark, sf):
    return ranking.comparison_table(_results(spark, sf), 0.7).select(
        "experiment_id", "approach", "recall_1", "mcc", "passes"
    )


def _pick_sql(gate: float) -> str:
    return f"""WITH {RESULT_SQL} SELECT experiment_id, recall_1, mcc, recall_1 >= {gate} AS passes FROM r
        ORDER BY recall_1 >= {gate} DESC, CASE WHEN recall_1 >= {gate} THEN mcc ELSE recall_1 END DESC,
                 latency_p50_ms, experiment_id LIMIT 1"""


@check("best_model", _pick_sql(0.5))
def _(spark, sf):
    return ranking.best_model(_results(spark, sf), 0.5).select("experiment_id", "recall_1", "mcc", "passes")


@check("best_model_none_passing", _pick_sql(0.99))
def _(spark, sf):
    return ranking.best_model(_results(spark, sf), 0.99).select("experiment_id", "recall_1", "mcc", "passes")


@check(
    "approach_lookup",
    f"""WITH {RESULT_SQL} SELECT k.experiment_id, coalesce(approach, 'classical') AS approach
        FROM (SELECT DISTINCT 'exp_' || substr(event_type, 1, 1) AS experiment_id FROM events) k
        LEFT JOIN r USING (experiment_id)""",
)
def _(spark, sf):
    wanted = table(spark, sf, "events").select(
        F.concat(F.lit("exp_"), F.substring("event_type", 1, 1)).alias("experiment_id")
    ).distinct()
    return ranking.approach_of(wanted, _results(spark, sf))


@check("sort_by_metric", f"WITH {RESULT_SQL} SELECT experiment_id, roc_auc FROM r ORDER BY roc_auc DESC")
def _(spark, sf):
    return ranking.sort_by_metric(_results(spark, sf), "roc_auc").select("experiment_id", "roc_auc")


STRONG = costs.Prices().strong
CHEAP = costs.Prices().cheap


def _cost_sql(share: str) -> str:
    return f"""WITH {RESULT_SQL}, x AS (
          SELECT 'router_' || experiment_id AS strategy, tp + fp + fn + tn AS messages, {share} AS pct_cheap, recall_1 FROM r
          UNION ALL SELECT 'all_strong', max(tp + fp + fn + tn), 0.0::DOUBLE, 1.0 FROM r
          UNION ALL SELECT 'all_cheap', max(tp + fp + fn + tn), 1.0, 0.0 FROM r),
        y AS (SELECT *, messages * ((1 - pct_cheap) * {STRONG}::DOUBLE + pct_cheap * {CHEAP}::DOUBLE) AS cost,
                     messages * {STRONG}::DOUBLE AS base FROM x)
        SELECT strategy, CAST(messages AS BIGINT) AS messages, recall_1, round(pct_cheap, 6) AS pct_cheap,
          round(1 - pct_cheap, 6) AS pct_strong, round(cost, 6) AS cost_usd, round(base, 6) AS baseline_usd,
          round(base - cost, 6) AS savings_usd, round((base - cost) / greatest(base, 1e-9) * 100, 6) AS savings_pct FROM y"""


COST_COLUMNS = ("pct_cheap", "pct_strong", "cost_usd", "baseline_usd", "savings_usd", "savings_pct")


def _experiments(spark, sf):
    counts = metrics.with_quality(metrics.confusion(predictions(spark, sf), ["experiment_id"]))
    return r6(counts, *QUALITY)


@check("cost_table_observed", _cost_sql("(tn + fn) / (tp + fp + fn + tn)::DOUBLE"))
def _(spark, sf):
    return r6(costs.cost_table(_experiments(spark, sf)), *COST_COLUMNS)


@check("cost_table_estimate", _cost_sql("greatest(0.0, least(1.0, precision_0 * (1 - recall_1)))"))
def _(spark, sf):
    return r6(costs.cost_table(_experiments(spark, sf), "estimate"), *COST_COLUMNS)


@check(
    "top_routers",
    f"""{_cost_sql('(tn + fn) / (tp + fp + fn + tn)::DOUBLE')} WHERE strategy LIKE 'router%'
        ORDER BY cost, strategy LIMIT 2""",
)
def _(spark, sf):
    return r6(costs.top_routers(costs.cost_table(_experiments(spark, sf)), 2), *COST_COLUMNS)


@check(
    "routed_cost_rollup",
    f"""SELECT strategy, to_strong, to_cheap, round(c, 6) AS cost_usd, round(b, 6) AS baseline_usd,
          round(b - c, 6) AS savings_usd, round((b - c) / greatest(b, 1e-9) * 100, 6) AS savings_pct FROM (
          SELECT *, to_strong * {STRONG}::DOUBLE + to_cheap * {CHEAP}::DOUBLE AS c,
                 (to_strong + to_cheap) * {STRONG}::DOUBLE AS b FROM (
            SELECT strategy, count(*) FILTER (y = 1) AS to_strong, count(*) FILTER (y = 0) AS to_cheap FROM (
              SELECT lang AS strategy, {ROUTED_SQL} AS y FROM (SELECT *, {SCORE_SQL} AS score FROM documents))
            GROUP BY 1))""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").withColumn("score", score_column())
    routed = routing.route(rows, 0.70, scripts=SCRIPTS).withColumnRenamed("lang", "strategy")
    return r6(costs.routed_rollup(routed), "cost_usd", "baseline_usd", "savings_usd", "savings_pct")
