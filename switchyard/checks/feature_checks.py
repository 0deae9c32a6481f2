"""TF-IDF and Word2Vec queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchyard.checks.base import WS_SQL, check, r6, table
from switchyard.operators import features


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


WORD_GRAMS_SQL = r"""wt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
    wg AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))
             AS term FROM wt),
    wn AS (SELECT doc_id, term, count(*) AS n FROM wg GROUP BY ALL)"""
CHAR_GRAMS_SQL = f"""ct AS (SELECT doc_id, ' ' || w || ' ' AS w FROM (
        SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{WS_SQL}+')) AS w FROM documents) WHERE w <> ''),
    cs AS (SELECT doc_id, w, unnest(range(2, least(5, length(w)) + 1)) AS k FROM ct),
    cg AS (SELECT doc_id, unnest(list_transform(range(1, length(w) - k + 2), lambda i: substr(w, i, k))) AS term FROM cs),
    cn AS (SELECT doc_id, term, count(*) AS n FROM cg GROUP BY ALL)"""


def _weights_sql(counts: str, limit: int, prefix: str) -> str:
    return f"""{prefix}v AS (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM {counts} GROUP BY 1
        HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT {limit}),
      {prefix}x AS (SELECT doc_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1)
        AS w FROM {counts} JOIN {prefix}v USING (term)),
      {prefix}z AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM {prefix}x)"""


SUMMARY_SQL = """SELECT d.doc_id, CAST(count(term) AS INTEGER) AS terms, round(coalesce(sum(weight), 0.0), 6) AS total,
      round(coalesce(max(weight), 0.0), 6) AS top FROM documents d LEFT JOIN"""


def _summary(vectors):
    values = F.unwrap_udt("features")["values"]
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return r6(
        vectors.select(
            "doc_id", F.size(values).alias("terms"), total.alias("total"),
            F.coalesce(F.array_max(values), F.lit(0.0)).alias("top"),
        ),
        "total", "top",
    )


@check("tfidf_word_vocabulary", f"WITH {WORD_GRAMS_SQL}, {_weights_sql('wn', 50000, 'w')} SELECT term, tf, df FROM wv")
def _(spark, sf):
    return features.vocabulary(_docs(spark, sf), features.WORD)


@check("tfidf_char_vocabulary", f"WITH {CHAR_GRAMS_SQL}, {_weights_sql('cn', 100000, 'c')} SELECT term, tf, df FROM cv")
def _(spark, sf):
    return features.vocabulary(_docs(spark, sf), features.CHAR)


@check(
    "tfidf_word_weights",
    f"WITH {WORD_GRAMS_SQL}, {_weights_sql('wn', 50000, 'w')} SELECT doc_id, term, round(weight, 6) AS weight FROM wz",
)
def _(spark, sf):
    docs = _docs(spark, sf)
    model = features.Tfidf.fit(docs, features.WORD)
    return r6(model.weights(model.transform(docs, keep=["doc_id"])), "weight")


@check(
    "tfidf_char_vectors",
    f"WITH {CHAR_GRAMS_SQL}, {_weights_sql('cn', 100000, 'c')} {SUMMARY_SQL} cz USING (doc_id) GROUP BY 1",
)
def _(spark, sf):
    docs = _docs(spark, sf)
    return _summary(features.Tfidf.fit(docs, features.CHAR).transform(docs, keep=["doc_id"]))


@check(
    "tfidf_combined_vectors",
    f"""WITH {CHAR_GRAMS_SQL}, {_weights_sql('cn', 80000, 'c')}, {WORD_GRAMS_SQL}, {_weights_sql('wn', 40000, 'w')},
        z AS (SELECT * FROM cz UNION ALL SELECT * FROM wz) {SUMMARY_SQL} z USING (doc_id) GROUP BY 1""",
)
def _(spark, sf):
    docs = _docs(spark, sf)
    return _summary(features.TfidfUnion.fit(docs).transform(docs, keep=["doc_id"]))
