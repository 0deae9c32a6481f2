"""Scalars, cells, dedup, split and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard import schema as S
from switchyard.checks.base import (
    ANY_SCRIPT_SQL, MEASURED_SQL, MESSAGES_SQL, SCRIPTS, STRIP_SQL, WORDS_SQL, WS_SQL,
    check, measured, messages, r6, table,
)
from switchyard.functions import numeric as nu
from switchyard.functions import text as tx
from switchyard.operators import cells, cleaning, grounding, profile, split
from switchyard.session import scratch_path
from switchyard.sources import messages as files

CELL_SQL = "concat_ws('__', language, industry, scenario)"
SPLIT_SQL = """CASE WHEN t < 8 THEN 'train' WHEN t < 9 THEN 'val' ELSE 'test' END"""
TENTH_SQL = "CAST(('0x' || substr(md5('42|' || doc_id), 1, 8)) AS BIGINT) % 10"
HASH_SPLIT_SQL = f"h AS (SELECT *, {SPLIT_SQL} AS split FROM (SELECT *, {TENTH_SQL} AS t FROM w))"


def docs(spark, sf):
    return table(spark, sf, "documents")


# ---- scalars -------------------------------------------------------------------------------


@check("word_count", f"SELECT doc_id, CAST({WORDS_SQL} AS INTEGER) AS word_count FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("word_count"))


@check(
    "trim_and_drop_empty",
    f"""SELECT doc_id, length(t) AS trimmed_chars, md5(t) AS trimmed_md5
        FROM (SELECT doc_id, {STRIP_SQL} AS t FROM documents) WHERE t <> ''""",
)
def _(spark, sf):
    rows = cleaning.trim_and_drop_empty(docs(spark, sf))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("trimmed_chars"), F.md5("text").alias("trimmed_md5")
    )


@check(
    "resolve_label",
    f"""WITH {MESSAGES_SQL} SELECT doc_id, rule_label,
          CASE WHEN rule_label = 1 THEN '1 (always)' ELSE '0' END AS caption
        FROM (SELECT doc_id, CASE WHEN language = 'en' AND scenario = '{S.SIMPLE}' THEN 0 ELSE 1 END AS rule_label
              FROM m)""",
)
def _(spark, sf):
    rule = tx.resolve_label(F.col("language"), F.col("scenario"), plain_language="en")
    rows = messages(spark, sf).select("doc_id", rule.alias("rule_label"))
    return rows.withColumn("caption", tx.label_caption(F.col("rule_label")))


@check("has_script", f"SELECT doc_id, {ANY_SCRIPT_SQL} AS has_script FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", tx.has_script(F.col("text"), SCRIPTS).alias("has_script"))


@check(
    "script_language",
    r"""SELECT doc_id, CASE WHEN a AND b THEN 'mixed_script' WHEN a THEN 'latin1' WHEN b THEN 'latin_ext' END AS script
        FROM (SELECT doc_id, regexp_matches(text, '[\x{C0}-\x{FF}]') AS a,
                     regexp_matches(text, '[\x{100}-\x{24F}]') AS b FROM documents)""",
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", tx.script_language(F.col("text"), SCRIPTS).alias("script"))


@check("native_script_scan", r"""SELECT count(*) AS rows,
          count(*) FILTER (regexp_matches(text, '[\x{D80}-\x{DFF}\x{B80}-\x{BFF}]')) AS caught FROM documents""")
def _(spark, sf):
    return docs(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count_if(tx.has_script(F.col("text"))).alias("caught"))


@check(
    "grounding_verify",
    r"""SELECT doc_id, script, caught, detected FROM (
          SELECT doc_id, CASE WHEN lang = 'en' THEN 'english_mixed' ELSE lang END AS script,
                 regexp_matches(text, '[\x{C0}-\x{24F}]') AS caught,
                 CASE WHEN regexp_matches(text, '[\x{C0}-\x{FF}]') AND regexp_matches(text, '[\x{100}-\x{24F}]')
                        THEN 'mixed_script'
                      WHEN regexp_matches(text, '[\x{C0}-\x{FF}]') THEN 'latin1'
                      WHEN regexp_matches(text, '[\x{100}-\x{24F}]') THEN 'latin_ext' ELSE 'none' END AS detected
          FROM documents) WHERE NOT starts_with(script, 'english_') OR caught""",
)
def _(spark, sf):
    script = F.when(F.col("lang") == "en", "english_mixed").otherwise(F.col("lang"))
    rows = docs(spark, sf).select("doc_id", "text", script.alias("script"))
    return grounding.verify_scripts(rows, scripts=SCRIPTS).select("doc_id", "script", "caught", "detected")


@check(
    "grounding_catch_rates",
    f"""SELECT coalesce(lang, 'TOTAL') AS script, count(*) AS total, count(*) FILTER (hit) AS caught,
          round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS rate
        FROM (SELECT lang, {ANY_SCRIPT_SQL} AS hit FROM documents) GROUP BY GROUPING SETS ((lang), ())""",
)
def _(spark, sf):
    rows = docs(spark, sf).select(
        F.col("lang").alias("script"), F.initcap(tx.has_script(F.col("text"), SCRIPTS).cast("string")).alias("caught")
    )
    return r6(grounding.catch_rates(grounding.parse_caught(rows)), "rate")


PREFIXED = "list_extract(['label=0 ', 'LABEL=1 ', 'Label=0: ', 'label=0 label=1: ', ''], CAST(doc_id % 5 + 1 AS INTEGER))"


@check(
    "first_examples_per_cell",
    f"""WITH {MESSAGES_SQL}, c AS (
          SELECT doc_id, {CELL_SQL} AS cell_id,
                 {STRIP_SQL} AS t FROM m)
        SELECT doc_id, cell_id, md5(t) AS text_md5, rank FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY doc_id) AS INTEGER) AS rank
          FROM c WHERE t <> '') WHERE rank <= 8""",
)
def _(spark, sf):
    kinds = F.array(*map(F.lit, ["label=0 ", "LABEL=1 ", "Label=0: ", "label=0 label=1: ", ""]))
    prefix = F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int"))
    rows = messages(spark, sf).withColumn("text", F.concat(prefix, F.col("text")))
    return cleaning.first_examples(rows).select("doc_id", "cell_id", F.md5("text").alias("text_md5"), "rank")


@check(
    "length_bucket",
    f"""WITH {MEASURED_SQL}, r(scenario, bucket, lo, hi, fraction) AS (VALUES
          ('{S.SIMPLE}', 0, 1, 2, 0.10::DOUBLE), ('{S.SIMPLE}', 1, 3, 8, 0.36), ('{S.SIMPLE}', 2, 9, 20, 0.39),
          ('{S.SIMPLE}', 3, 21, 40, 0.15), ('{S.PROXIMITY}', 0, 3, 10, 0.45), ('{S.PROXIMITY}', 1, 11, 25, 0.40),
          ('{S.PROXIMITY}', 2, 26, 45, 0.15))
        SELECT doc_id, word_count, bucket FROM w LEFT JOIN r
          ON w.scenario = r.scenario AND word_count BETWEEN lo AND hi""",
)
def _(spark, sf):
    return grounding.length_buckets(measured(spark, sf)).select("doc_id", "word_count", "bucket")


@check(
    "length_fit",
    f"""WITH {MEASURED_SQL}, r(scenario, bucket, lo, hi, fraction) AS (VALUES
          ('{S.SIMPLE}', 0, 1, 2, 0.10::DOUBLE), ('{S.SIMPLE}', 1, 3, 8, 0.36), ('{S.SIMPLE}', 2, 9, 20, 0.39),
          ('{S.SIMPLE}', 3, 21, 40, 0.15), ('{S.PROXIMITY}', 0, 3, 10, 0.45), ('{S.PROXIMITY}', 1, 11, 25, 0.40),
          ('{S.PROXIMITY}', 2, 26, 45, 0.15)),
        n AS (SELECT scenario, count(*) AS total FROM w GROUP BY 1)
        SELECT r.scenario, bucket, fraction, count(w.doc_id) AS rows,
               round(coalesce(count(w.doc_id) / max(total)::DOUBLE, 0.0), 6) AS share
        FROM r LEFT JOIN w ON w.scenario = r.scenario AND word_count BETWEEN lo AND hi
        LEFT JOIN n ON n.scenario = r.scenario GROUP BY ALL""",
)
def _(spark, sf):
    return r6(grounding.length_fit(measured(spark, sf)), "share")


@check(
    "report_rounding",
    """SELECT event_id, CAST(printf('%.2f', value / 8) AS DOUBLE) AS rounded_2,
              CAST(printf('%.3f', value / 16) AS DOUBLE) AS rounded_3,
              greatest(0.0, least(1.0, value / 100 - 0.5)) AS clamped,
              printf('%.1fms', value / 4) AS latency_text, printf('%.4f', value / 1000) AS metric_text,
              printf('%.1f%%', value / 500 * 100.0) AS percent_text, printf('$%.2f', value / 40) AS money_text
       FROM events""",
)
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id",
        nu.round_exact(v / 8, 2).alias("rounded_2"),
        nu.round_exact(v / 16, 3).alias("rounded_3"),
        nu.clamp(v / 100 - 0.5).alias("clamped"),
        nu.metric_text("latency_p50_ms", v / 4).alias("latency_text"),
        nu.metric_text("recall_1", v / 1000).alias("metric_text"),
        nu.percent_text(v / 500).alias("percent_text"),
        nu.money_text(v / 40, 2).alias("money_text"),
    )


# ---- sources -------------------------------------------------------------------------------

FILE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *S.MESSAGE.fields])
BACK_SQL = f"""WITH {MEASURED_SQL} SELECT doc_id, language, industry, scenario, label, word_count,
    length(text) AS chars, md5(text) AS text_md5 FROM w"""


def _digest(df):
    return df.select(
        "doc_id", "language", "industry", "scenario", "label", "word_count",
        F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"),
    )


@check("message_csv_round_trip", BACK_SQL)
def _(spark, sf):
    path = scratch_path(spark, "messages-csv")
    files.write_messages(measured(spark, sf).select(*FILE_SCHEMA.names), path)
    return _digest(files.read_messages(spark, path, FILE_SCHEMA))


@check("message_append", BACK_SQL)
def _(spark, sf):
    path = scratch_path(spark, "messages-append")
    rows = measured(spark, sf).select(*FILE_SCHEMA.names)
    files.append_messages(rows.where(F.col("language") == "en"), path)
    files.append_messages(rows.where(F.col("language") != "en"), path)
    return _digest(files.read_messages(spark, path, FILE_SCHEMA))


@check(
    "partitioned_split_read",
    f"""WITH {MEASURED_SQL}, {HASH_SPLIT_SQL}
        SELECT 'val' AS asked, language, count(*) AS rows FROM h WHERE split = 'val' GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "dataset")
    files.write_dataset(split.hash_split(measured(spark, sf)), path, "v1")
    found = files.read_split(spark, path, "v1", "val").unionByName(files.read_split(spark, path, "v2", "val"))
    return found.groupBy(F.lit("val").alias("asked"), "language").agg(F.count(F.lit(1)).alias("rows"))


@check(
    "optional_split_counts",
    f"""WITH {MEASURED_SQL}, {HASH_SPLIT_SQL}
        SELECT n.split, count(h.doc_id) AS rows FROM (VALUES ('train'), ('val'), ('test'), ('holdout')) n(split)
        LEFT JOIN h ON h.split = n.split GROUP BY n.split""",
)
def _(spark, sf):
    names = spark.createDataFrame([("train",), ("val",), ("test",), ("holdout",)], "split string")
    return profile.count_or_zero(split.hash_split(messages(spark, sf)), names, "split")


@check("list_datasets", "SELECT DISTINCT source AS dataset FROM documents")
def _(spark, sf):
    return files.list_datasets(docs(spark, sf).select(F.col("source").alias("dataset")))


@check("completed_cells", f"WITH {MESSAGES_SQL} SELECT DISTINCT {CELL_SQL} AS cell_id FROM m WHERE label = 1")
def _(spark, sf):
    return cells.completed_cells(messages(spark, sf).where("label = 1"))


# ---- cells and plans -----------------------------------------------------------------------


@check("cell_counts", f"WITH {MESSAGES_SQL} SELECT {CELL_SQL} AS cell_id, count(*) AS rows FROM m GROUP BY 1")
def _(spark, sf):
    return cells.count_cells(messages(spark, sf))


@check(
    "filter_cells",
    f"""WITH {MESSAGES_SQL} SELECT doc_id, language, industry, scenario FROM m
        WHERE language = 'en' AND scenario = '{S.SIMPLE}'""",
)
def _(spark, sf):
    rows = cells.filter_cells(messages(spark, sf), language="en", scenario=S.SIMPLE)
    return rows.select("doc_id", *cells.KEYS)


FRACTIONS_SQL = f"""{MESSAGES_SQL}, c AS (SELECT language, industry, scenario, count(*) AS n FROM m GROUP BY ALL),
    g AS (SELECT *, sum(n) OVER (PARTITION BY language, industry) AS i, sum(n) OVER (PARTITION BY language) AS l,
                 sum(n) OVER () AS t FROM c),
    f AS (SELECT language, industry, scenario, l / t::DOUBLE AS language_fraction,
                 i / l::DOUBLE AS industry_fraction, n / i::DOUBLE AS scenario_fraction FROM g)"""
PLAN_SQL = f"""{FRACTIONS_SQL}, q AS (
    SELECT language, industry, scenario, CAST(lc AS BIGINT) AS language_count, CAST(ic AS BIGINT) AS industry_count,
           CAST(round_even(ic * scenario_fraction, 0) AS BIGINT) AS target_count
    FROM (SELECT *, round_even(lc * industry_fraction, 0) AS ic
          FROM (SELECT *, round_even(60000.0::DOUBLE * language_fraction, 0) AS lc FROM f)))"""


def _plan(spark, sf):
    return cells.plan_counts(cells.observed_fractions(messages(spark, sf)))


@check("plan_counts", f"WITH {PLAN_SQL} SELECT * FROM q")
def _(spark, sf):
    return _plan(spark, sf)


@check(
    "nested_plan_round_trip",
    f"""WITH {FRACTIONS_SQL} SELECT language, industry, scenario, round(language_fraction, 6) AS language_fraction,
          round(industry_fraction, 6) AS industry_fraction, round(scenario_fraction, 6) AS scenario_fraction FROM f""",
)
def _(spark, sf):
    nested = cells.nest_plan(cells.observed_fractions(messages(spark, sf)))
    return r6(cells.expand_plan(nested), "language_fraction", "industry_fraction", "scenario_fraction")


@check(
    "plan_violations",
    f"""WITH {FRACTIONS_SQL}, k AS (SELECT language, industry, scenario,
          CAST(printf('%.2f', language_fraction) AS DOUBLE) AS lf, CAST(printf('%.2f', industry_fraction) AS DOUBLE) AS jf,
          CAST(printf('%.1f', scenario_fraction) AS DOUBLE) AS sf FROM f)
        SELECT level, node, round(total, 6) AS total FROM (
          SELECT 'plan' AS level, 'all' AS node, sum(lf) AS total FROM (SELECT DISTINCT language, lf FROM k)
          UNION ALL SELECT 'language', language, sum(jf) FROM (SELECT DISTINCT language, industry, jf FROM k)
            GROUP BY language
          UNION ALL SELECT 'industry', concat_ws('__', language, industry), sum(sf) FROM k GROUP BY language, industry)
        WHERE abs(total - 1.0) > 0.005""",
)
def _(spark, sf):
    # Published with two and one decimals the fractions no longer add up everywhere.
    published = cells.observed_fractions(messages(spark, sf)).withColumns(
        {
            "language_fraction": nu.round_exact(F.col("language_fraction"), 2),
            "industry_fraction": nu.round_exact(F.col("industry_fraction"), 2),
            "scenario_fraction": nu.round_exact(F.col("scenario_fraction"), 1),
        }
    )
    return r6(cells.plan_violations(published), "total")


@check(
    "planned_labels",
    f"""WITH {PLAN_SQL} SELECT CASE WHEN language = 'en' AND scenario = '{S.SIMPLE}' THEN 0 ELSE 1 END AS label,
          CAST(sum(target_count) AS BIGINT) AS planned FROM q WHERE target_count >= 1 GROUP BY 1""",
)
def _(spark, sf):
    rule = tx.resolve_label(F.col("language"), F.col("scenario"), plain_language="en")
    return cells.planned_labels(cells.to_cells(_plan(spark, sf)), rule)


@check(
    "planned_totals",
    f"""WITH {PLAN_SQL} SELECT 'scenario' AS dimension, scenario AS value, CAST(sum(target_count) AS BIGINT) AS planned
        FROM q GROUP BY ALL UNION ALL
        SELECT DISTINCT 'language', language, language_count FROM q""",
)
def _(spark, sf):
    plan = _plan(spark, sf)
    by_scenario = cells.planned_by(plan, "scenario").select(
        F.lit("scenario").alias("dimension"), F.col("scenario").alias("value"), "planned"
    )
    by_language = cells.language_summary(plan).select(
        F.lit("language").alias("dimension"), F.col("language").alias("value"), F.col("language_count").alias("planned")
    )
    return by_scenario.unionByName(by_language)


@check(
    "find_cell",
    f"""WITH {PLAN_SQL} SELECT k.language, k.industry, k.scenario, target_count
        FROM (SELECT DISTINCT lang AS language, source AS industry, '{S.PROXIMITY}' AS scenario FROM documents) k
        LEFT JOIN q USING (language, industry, scenario)""",
)
def _(spark, sf):
    wanted = docs(spark, sf).select(
        F.col("lang").alias("language"), F.col("source").alias("industry"), F.lit(S.PROXIMITY).alias("scenario")
    ).distinct()
    return cells.find_cell(_plan(spark, sf).select(*cells.KEYS, "target_count"), wanted)


# Rows of one label value stand for the work already done.
DONE = "label = 0"


@check(
    "resume_remaining",
    f"""WITH {PLAN_SQL} SELECT {CELL_SQL} AS cell_id, language, industry, scenario, target_count FROM q
        WHERE target_count >= 1 AND {CELL_SQL} NOT IN (SELECT {CELL_SQL} FROM m WHERE {DONE})""",
)
def _(spark, sf):
    return cells.remaining_cells(cells.to_cells(_plan(spark, sf)), messages(spark, sf).where(DONE))


@check(
    "resume_remaining_ids",
    f"""WITH {PLAN_SQL} SELECT {CELL_SQL} AS cell_id FROM q WHERE target_count >= 1
        EXCEPT SELECT {CELL_SQL} FROM m WHERE {DONE}""",
)
def _(spark, sf):
    return cells.remaining_ids(cells.to_cells(_plan(spark, sf)), messages(spark, sf).where(DONE))


GAPS_SQL = f"""{PLAN_SQL}, have AS (SELECT {CELL_SQL} AS cell_id, count(*) AS rows FROM m GROUP BY 1),
    gap AS (SELECT {CELL_SQL} AS cell_id, language, industry, scenario, coalesce(rows, 0) AS rows,
                   target_count // 100 - coalesce(rows, 0) AS missing
            FROM q LEFT JOIN have ON have.cell_id = {CELL_SQL}
            WHERE coalesce(rows, 0) < target_count // 100)"""


def _gaps(spark, sf):
    plan = _plan(spark, sf).select(*cells.KEYS, F.floor(F.col("target_count") / 100).alias("target_count"))
    return cells.gaps(plan, messages(spark, sf))


@check("fill_gaps", f"WITH {GAPS_SQL} SELECT * FROM gap")
def _(spark, sf):
    return _gaps(spark, sf)


@check(
    "total_missing",
    f"WITH {GAPS_SQL} SELECT count(*) AS cells, CAST(coalesce(sum(missing), 0) AS BIGINT) AS missing FROM gap",
)
def _(spark, sf):
    return cells.total_missing(_gaps(spark, sf))


@check(
    "first_cells",
    f"""WITH {PLAN_SQL} SELECT language, industry, scenario, target_count FROM q WHERE target_count >= 1
        ORDER BY language, industry, scenario LIMIT 10""",
)
def _(spark, sf):
    return cells.first_cells(cells.to_cells(_plan(spark, sf)), 10)


# ---- cleaning and dedup --------------------------------------------------------------------

MAYBE_SQL = f"""x AS (SELECT doc_id, text, CAST(quality AS INTEGER) AS label,
    {SPLIT_SQL} AS split FROM (SELECT *, {TENTH_SQL} AS t FROM documents LEFT JOIN labels USING (doc_id)))"""


def _maybe_labelled(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return split.hash_split(docs(spark, sf).select("doc_id", "text").join(labels, "doc_id", "left"))


@check(
    "validate_and_clean",
    f"""WITH {MAYBE_SQL} SELECT doc_id, label, md5(text) AS text_md5 FROM x
        WHERE text IS NOT NULL AND label IS NOT NULL AND NOT regexp_full_match(text, '{WS_SQL}*')""",
)
def _(spark, sf):
    rows = cleaning.validate_and_clean(_maybe_labelled(spark, sf))
    return rows.select("doc_id", "label", F.md5("text").alias("text_md5"))


@check(
    "dropped_rows",
    f"""WITH {MAYBE_SQL} SELECT split, count(*) AS before, count(*) FILTER (ok) AS after,
          count(*) - count(*) FILTER (ok) AS dropped
        FROM (SELECT *, label IS NOT NULL AND NOT regexp_full_match(text, '{WS_SQL}*') AS ok FROM x) GROUP BY split""",
)
def _(spark, sf):
    return cleaning.dropped_rows(_maybe_labelled(spark, sf))


@check(
    "dedup_exact",
    """SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM (
         SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""",
)
def _(spark, sf):
    kept = cleaning.dedup_exact(docs(spark, sf))
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@check(
    "dedup_counts",
    """SELECT count(*) AS rows, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS dropped
       FROM documents""",
)
def _(spark, sf):
    return cleaning.dedup_counts(docs(spark, sf))


DOC_CELL_SQL = "concat_ws('__', lang, 'all', 'all')"


def _lang_cells(spark, sf):
    return docs(spark, sf).select(
        "doc_id", "text", F.col("lang").alias("language"), F.lit("all").alias("industry"), F.lit("all").alias("scenario")
    )


@check(
    "dedup_within_cells",
    f"""SELECT doc_id, language, md5(t) AS text_md5 FROM (
          SELECT *, row_number() OVER (PARTITION BY language, t ORDER BY doc_id) AS r
          FROM (SELECT doc_id, lang AS language, {STRIP_SQL} AS t FROM documents) WHERE t <> '') WHERE r = 1""",
)
def _(spark, sf):
    return cleaning.dedup_within_cells(_lang_cells(spark, sf)).select("doc_id", "language", F.md5("text").alias("text_md5"))


@check(
    "cell_dedup_counters",
    f"""SELECT {DOC_CELL_SQL} AS cell_id, count(*) AS seen, count(*) FILTER (t = '') AS empty,
          count(*) FILTER (t <> '') - count(DISTINCT t) FILTER (t <> '') AS dupes,
          count(DISTINCT t) FILTER (t <> '') AS kept
        FROM (SELECT lang, {STRIP_SQL} AS t FROM documents) GROUP BY 1""",
)
def _(spark, sf):
    return cleaning.cell_dedup_counters(_lang_cells(spark, sf))


@check(
    "merge_batches",
    """SELECT doc_id, lang, source FROM (
         SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM (
           SELECT doc_id, lang, source, text FROM documents
           UNION ALL SELECT conv_id * 1000 + turn + 1000000000, 'chat', role, text FROM conversations)) WHERE r = 1""",
)
def _(spark, sf):
    have = docs(spark, sf).select("doc_id", "lang", "source", "text")
    new = table(spark, sf, "conversations").select(
        "text", F.lit("chat").alias("lang"), F.col("role").alias("source"),
        (F.col("conv_id") * 1000 + F.col("turn") + 1000000000).alias("doc_id"),
    )
    return cleaning.dedup_exact(files.with_new_rows(have, new)).select("doc_id", "lang", "source")


# ---- split ---------------------------------------------------------------------------------

STRATIFIED_SQL = f"""{MESSAGES_SQL}, k AS (SELECT *,
    row_number() OVER (PARTITION BY label, scenario ORDER BY md5('42|' || doc_id), doc_id) AS rn,
    count(*) OVER (PARTITION BY label, scenario) AS n FROM m),
    st AS (SELECT *, CASE WHEN rn * 10 <= n * 8 THEN 'train' WHEN rn * 10 <= n * 9 THEN 'val' ELSE 'test' END AS split
           FROM k)"""


@check("stratified_split", f"WITH {STRATIFIED_SQL} SELECT doc_id, label, scenario, split FROM st")
def _(spark, sf):
    return split.stratified_split(messages(spark, sf).select("doc_id", "label", "scenario"))


@check("hash_split", f"SELECT doc_id, {SPLIT_SQL} AS split FROM (SELECT doc_id, {TENTH_SQL} AS t FROM documents)")
def _(spark, sf):
    return split.hash_split(docs(spark, sf)).select("doc_id", "split")


@check(
    "split_overlap_texts",
    f"""SELECT md5(text) AS text_md5, count(DISTINCT split) AS splits
        FROM (SELECT text, {SPLIT_SQL} AS split FROM (SELECT *, {TENTH_SQL} AS t FROM documents))
        GROUP BY text HAVING count(DISTINCT split) > 1""",
)
def _(spark, sf):
    rows = split.overlap(split.hash_split(docs(spark, sf)), F.md5("text"))
    return rows.withColumnRenamed("_k", "text_md5")


PAIRS_SQL = """SELECT a || '|' || b AS pair, (SELECT count(*) FROM (SELECT doc_id FROM st WHERE split = a
    INTERSECT SELECT doc_id FROM st WHERE split = b)) AS shared FROM"""


@check(
    "split_disjoint_ids",
    f"WITH {STRATIFIED_SQL} {PAIRS_SQL} (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) v(a, b)",
)
def _(spark, sf):
    rows = split.stratified_split(messages(spark, sf).select("doc_id", "label", "scenario"))
    return split.pairwise_overlap(rows, F.col("doc_id"))


# ---- profiles ------------------------------------------------------------------------------

SPLIT_M_SQL = f"{MEASURED_SQL}, {HASH_SPLIT_SQL}"


def _split_measured(spark, sf):
    return split.hash_split(measured(spark, sf))


@check(
    "split_stats",
    f"""WITH {SPLIT_M_SQL} SELECT split, count(*) AS rows, count(*) FILTER (label = 0) AS label_0,
          count(*) FILTER (label = 1) AS label_1, round(avg(label), 6) AS label_1_ratio FROM h GROUP BY split""",
)
def _(spark, sf):
    return r6(profile.split_stats(split.hash_split(messages(spark, sf))), "label_1_ratio")


@check(
    "split_breakdown",
    f"""WITH {SPLIT_M_SQL} SELECT split, 'split' AS dimension, NULL AS value, count(*) AS rows FROM h GROUP BY 1
        UNION ALL SELECT split, 'language', language, count(*) FROM h GROUP BY ALL
        UNION ALL SELECT split, 'scenario', scenario, count(*) FROM h GROUP BY ALL""",
)
def _(spark, sf):
    return profile.split_breakdown(split.hash_split(messages(spark, sf)))


@check(
    "eda_summary",
    f"""WITH {SPLIT_M_SQL} SELECT count(*) FILTER (split = 'train') AS train_rows,
          count(*) FILTER (split = 'val') AS val_rows, count(*) FILTER (split = 'test') AS test_rows,
          count(*) FILTER (split = 'train' AND label = 0) AS label_0_count,
          count(*) FILTER (split = 'train' AND label = 1) AS label_1_count,
          round(avg(CASE WHEN label = 0 THEN 100.0 ELSE 0 END) FILTER (split = 'train'), 6) AS label_0_pct,
          round(avg(CASE WHEN label = 1 THEN 100.0 ELSE 0 END) FILTER (split = 'train'), 6) AS label_1_pct,
          round(avg(word_count) FILTER (split = 'train'), 6) AS mean_word_count,
          round(median(word_count) FILTER (split = 'train'), 6) AS median_word_count FROM h""",
)
def _(spark, sf):
    rows = profile.eda_summary(_split_measured(spark, sf))
    return r6(rows, "label_0_pct", "label_1_pct", "mean_word_count", "median_word_count")


@check(
    "value_counts",
    "SELECT lang AS value, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1",
)
def _(spark, sf):
    return r6(profile.value_counts(docs(spark, sf), "lang"), "share")


@check(
    "top_values",
    """SELECT source AS value, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share
       FROM documents GROUP BY 1 ORDER BY rows DESC, value LIMIT 5""",
)
def _(spark, sf):
    return r6(profile.top_values(docs(spark, sf), "source", 5), "share")


@check(
    "split_documents",
    f"""WITH {SPLIT_M_SQL} SELECT s.split, s.rows, l.value AS language, l.n AS language_rows FROM
          (SELECT split, count(*) AS rows FROM h GROUP BY 1) s
          JOIN (SELECT split, language AS value, count(*) AS n FROM h GROUP BY ALL) l USING (split)""",
)
def _(spark, sf):
    found = profile.split_documents(split.hash_split(messages(spark, sf)))
    return found.select("split", "rows", F.explode("languages").alias("language", "language_rows"))


@check(
    "word_count_histogram",
    f"""WITH {MEASURED_SQL}, e AS (SELECT label, min(word_count) AS lo, max(word_count) AS hi FROM w GROUP BY 1),
        z AS (SELECT label, CASE WHEN lo = hi THEN lo - 0.5::DOUBLE ELSE lo::DOUBLE END AS lo,
                     CASE WHEN lo = hi THEN hi + 0.5::DOUBLE ELSE hi::DOUBLE END AS hi FROM e),
        b AS (SELECT w.label, CAST(least(floor((word_count - lo) * 40.0 / (hi - lo)), 39) AS INTEGER) AS bin
              FROM w JOIN z ON w.label = z.label),
        k AS (SELECT label, lo, hi, CAST(unnest(range(40)) AS INTEGER) AS bin FROM z)
        SELECT k.label, k.bin, round(lo + (hi - lo) * k.bin / 40.0::DOUBLE, 6) AS bin_low, count(b.bin) AS rows
        FROM k LEFT JOIN b ON b.label = k.label AND b.bin = k.bin GROUP BY k.label, k.bin, lo, hi""",
)
def _(spark, sf):
    return r6(profile.histogram(measured(spark, sf)), "bin_low")


@check(
    "word_count_box_stats",
    f"""WITH {MEASURED_SQL}, b AS (SELECT language, count(*) AS rows, quantile_cont(word_count, 0.25) AS q1,
          quantile_cont(word_count, 0.5) AS median, quantile_cont(word_count, 0.75) AS q3 FROM w GROUP BY 1)
        SELECT b.language, rows, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          min(word_count) FILTER (word_count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
          max(word_count) FILTER (word_count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
          count(*) FILTER (word_count NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM w JOIN b USING (language) GROUP BY ALL""",
)
def _(spark, sf):
    return r6(profile.box_stats(measured(spark, sf)), "q1", "median", "q3")


@check(
    "example_coverage",
    f"""WITH {MESSAGES_SQL}, c AS (SELECT DISTINCT {CELL_SQL} AS cell_id FROM m WHERE label = 0)
        SELECT l.language, count(cell_id) AS cells FROM (SELECT DISTINCT lang AS language FROM documents) l
        LEFT JOIN c ON starts_with(cell_id, l.language || '__') GROUP BY 1""",
)
def _(spark, sf):
    keys = cells.with_cell_id(messages(spark, sf).where("label = 0"))
    return profile.example_coverage(keys, docs(spark, sf).select(F.col("lang").alias("language")).distinct())


@check(
    "top_terms_per_class",
    f"""WITH {MESSAGES_SQL}, t AS (SELECT label, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
          FROM m), c AS (SELECT label, term, count(*) AS n FROM t GROUP BY ALL)
        SELECT label, term, n, rank FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS INTEGER) AS rank FROM c)
        WHERE rank <= 50""",
)
def _(spark, sf):
    return profile.top_terms_per_class(messages(spark, sf), tx.model_tokens(F.col("text")))


@check(
    "rule_label_agreement",
    f"""WITH {MESSAGES_SQL} SELECT industry, count(*) AS rows, count(*) FILTER (label = rule) AS agree,
          round(count(*) FILTER (label = rule) / count(*)::DOUBLE, 6) AS agreement,
          count(*) FILTER (label = rule) / count(*)::DOUBLE >= 0.97 AS reached
        FROM (SELECT *, CASE WHEN language = 'en' AND scenario = '{S.SIMPLE}' THEN 0 ELSE 1 END AS rule FROM m)
        GROUP BY 1""",
)
def _(spark, sf):
    rule = tx.resolve_label(F.col("language"), F.col("scenario"), plain_language="en")
    return r6(profile.label_agreement(messages(spark, sf), rule, "industry"), "agreement")


@check(
    "label_share_check",
    f"""WITH {PLAN_SQL}, e AS (SELECT CASE WHEN language = 'en' AND scenario = '{S.SIMPLE}' THEN 0 ELSE 1 END AS label,
          CAST(sum(target_count) AS BIGINT) AS planned FROM q WHERE target_count >= 1 GROUP BY 1),
        a AS (SELECT label, count(*) AS actual FROM m GROUP BY 1)
        SELECT label, planned, actual, round(planned / sum(planned) OVER (), 6) AS expected_share,
               round(actual / sum(actual) OVER (), 6) AS actual_share
        FROM (SELECT coalesce(e.label, a.label) AS label, coalesce(planned, 0) AS planned, coalesce(actual, 0) AS actual
              FROM e FULL JOIN a ON e.label = a.label)""",
)
def _(spark, sf):
    rule = tx.resolve_label(F.col("language"), F.col("scenario"), plain_language="en")
    planned = cells.planned_labels(cells.to_cells(_plan(spark, sf)), rule)
    return r6(profile.label_share_check(messages(spark, sf), planned), "expected_share", "actual_share")
