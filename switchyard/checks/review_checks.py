"""Review queries: nearest neighbours of embeddings, place names in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchyard.checks.base import PREDICTIONS_SQL, check, predictions, r6, table
from switchyard.operators import metrics, neighbours, places, sketches
from switchyard.session import scratch_path

NEAREST_SQL = """u AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 9) AS similarity
  FROM u a JOIN u b ON a.vec_id <> b.vec_id),
n AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank FROM p
  QUALIFY rank <= 2)"""


@check(
    "nearest_pairs",
    f"""WITH {NEAREST_SQL} SELECT vec_id, rank, neighbour, round(similarity, 6) AS similarity,
        CASE WHEN similarity > 0.88 AND neighbour < vec_id THEN 'duplicate' ELSE 'keep' END AS decision FROM n""",
)
def _(spark, sf):
    return r6(neighbours.nearest(table(spark, sf, "embeddings")), "similarity")


@check(
    "closest_pairs",
    f"""WITH {NEAREST_SQL} SELECT DISTINCT least(vec_id, neighbour) AS vec_a, greatest(vec_id, neighbour) AS vec_b,
        round(similarity, 6) AS similarity
        FROM (SELECT * FROM (SELECT DISTINCT least(vec_id, neighbour) AS vec_id, greatest(vec_id, neighbour) AS neighbour, similarity FROM n)
              ORDER BY similarity DESC, vec_id, neighbour LIMIT 20)""",
)
def _(spark, sf):
    return r6(neighbours.closest_pairs(neighbours.nearest(table(spark, sf, "embeddings"))), "similarity")


# Names: the second and third word of every benchmark item.  SQL compares all distinct windows with all names: its edit distance
# counts bytes (two a letter at most here) and sorts most pairs out, the rest take the table of common subsequences row by row.
PLACES_SQL = r"""WITH RECURSIVE g AS (
  SELECT item_id AS name_id, array_to_string(list_sort(regexp_extract_all(lower(w[2] || ' ' || w[3]), '[\p{L}\p{N}]+')), ' ') AS name
  FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
x AS (
  SELECT doc_id, array_to_string(list_sort(w[i:i + k - 1]), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, (VALUES (1), (2), (3)) v(k))),
h AS (SELECT doc_id, win, count(*) AS times FROM x GROUP BY ALL),
c AS (
  SELECT DISTINCT win, name FROM (SELECT DISTINCT win FROM h) a JOIN (SELECT DISTINCT name FROM g) b
  ON length(win) * 115 >= length(name) * 85 AND length(name) * 115 >= length(win) * 85
  WHERE levenshtein(win, name) * 100 <= 2 * 15 * (length(win) + length(name))),
l AS (
  SELECT win, name, 0 AS i, list_transform(range(length(name) + 1), lambda z: 0) AS r FROM c
  UNION ALL SELECT win, name, i + 1, list_reduce(
    list_prepend([0], list_transform(range(1, length(name) + 1), lambda j: [CAST(j AS INTEGER)])),
    lambda acc, j: list_append(acc, CASE WHEN substr(win, i + 1, 1) = substr(name, j[1], 1) THEN r[j[1]] + 1
                                         ELSE greatest(acc[j[1]], r[j[1] + 1]) END))
  FROM l WHERE i < length(win)),
m AS (
  SELECT win, name, 200.0::DOUBLE * r[length(name) + 1] / (length(win) + length(name)) AS score FROM l
  WHERE i = length(win) AND 200 * r[length(name) + 1] >= 85 * (length(win) + length(name)))
SELECT h.doc_id, g.name_id, g.name, CAST(sum(times) AS BIGINT) AS hits, round(max(score), 6) AS score,
       first(win ORDER BY score DESC, win) AS best
FROM h JOIN m USING (win) JOIN g USING (name) GROUP BY h.doc_id, g.name_id, g.name"""


@check("place_names", PLACES_SQL)
def _(spark, sf):
    word = F.split("text", " ")
    names = table(spark, sf, "benchmark").select(F.col("item_id").alias("name_id"), F.concat_ws(" ", word[1], word[2]).alias("name"))
    return r6(places.place_names(table(spark, sf, "documents"), names), "score")


SPAN = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@check(
    "latency_sketches",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max, true AS p50_close, true AS p95_close, true AS p99_close
       FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    """Daily sketches, written, read and merged over all days; every quantile's exact rank is near the one asked for."""
    events = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    path = scratch_path(spark, "sketches")
    sketches.latency_sketches(events, "value", ["event_type"], "day").write.parquet(path)
    merged = sketches.merged_quantiles(spark.read.parquet(path), SPAN, ["event_type"])
    off = sketches.rank_errors(events, "value", merged, SPAN, ["event_type"])
    close = off.select("event_type", *[(F.col(n) <= sketches.RANK_ERROR).alias(f"{n}_close") for n in SPAN])
    return r6(merged.select("event_type", "n", "mean", "max"), "mean").join(close, "event_type")


@check(
    "binned_auc",
    f"""WITH {PREDICTIONS_SQL},
        b AS (SELECT experiment_id, CAST(least(99, floor(score * 100)) AS INTEGER) AS bin, count(*) FILTER (label = 1) AS ones,
                     count(*) FILTER (label = 0) AS zeros FROM p GROUP BY ALL),
        c AS (SELECT *, coalesce(sum(zeros) OVER (PARTITION BY experiment_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
        e AS (SELECT experiment_id, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS exact
              FROM p x JOIN p y USING (experiment_id) WHERE x.label = 1 AND y.label = 0 GROUP BY 1)
        SELECT experiment_id, round(sum(ones * below + ones * zeros / 2.0) / (sum(ones) * sum(zeros)), 6) AS auc,
               round(sum(ones * zeros / 2.0) / (sum(ones) * sum(zeros)), 6) AS error_bound,
               CAST(sum(ones) AS BIGINT) AS ones, CAST(sum(zeros) AS BIGINT) AS zeros,
               abs(sum(ones * below + ones * zeros / 2.0) / (sum(ones) * sum(zeros)) - any_value(exact))
                 <= sum(ones * zeros / 2.0) / (sum(ones) * sum(zeros)) + 1e-9 AS within
        FROM c JOIN e USING (experiment_id) GROUP BY 1""",
)
def _(spark, sf):
    """100 bins, merged from two halves of the rows; the exact value lies within the bound."""
    rows = predictions(spark, sf)
    path = scratch_path(spark, "bins")
    half = F.col("doc_id") % 2
    sketches.score_bins(rows.withColumn("day", half), ["experiment_id", "day"], bins=100).write.parquet(path)
    found = sketches.binned_auc(spark.read.parquet(path), ["experiment_id"])
    exact = metrics.roc_auc(rows, by=["experiment_id"]).withColumnRenamed("roc_auc", "_exact")
    within = F.abs(F.col("auc") - F.col("_exact")) <= F.col("error_bound") + 1e-9
    return r6(found.join(exact, "experiment_id").withColumn("within", within).drop("_exact"), "auc", "error_bound")
