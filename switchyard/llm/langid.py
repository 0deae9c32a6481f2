"""Language by hierarchical discrimination: the family first, then one-versus-one linear SVMs inside it.

Features are the byte 1- to 4-grams of the text, A-Z lowered (digits, signs and white space count as one
blank), hashed to ``DIMENSIONS`` columns and divided by the number of letters, so a text's margin is a sum over its
positions: prediction is one vectorised pass with table lookups over whole texts, whatever their length.

Both levels are one-versus-one support vector machines with squared hinge loss, trained by Newton steps on
the dual of a bounded sample: at most ``SAMPLE`` labelled rows per language (smallest hash of the id first,
held-out rows never).  Everything else covers all rows.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, or when no language could be
learned (``keep_identified`` then drops only texts without a letter); a single learned language is predicted with score 1; rows with null lang teach nothing; an
empty table gives an empty result; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.llm.common import arrow_pass, narrow
from switchyard.plans.sizing import broadcast_within
from switchyard.session import shared_dir

SAMPLE = 500
DIMENSIONS = 1 << 13
ORDERS = 4
RIDGE = 0.02
#: Margins grow by this before they become scores.
STEEPNESS = 3.0
#: Language families by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu", "ur", "si", "or", "as"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "am", "mt"),
    "malayic": ("id", "ms", "tl", "jv", "su"),
}
LETTER = re.compile(r"[^\W\d_]")
BLANK = 32
GAP = b"   "  # between the texts of a batch, so that no n-gram holds letters of two


def _letters() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    table[ord("A") : ord("Z") + 1] += 32
    keep = np.zeros(256, bool)
    keep[ord("a") : ord("z") + 1] = keep[ord("A") : ord("Z") + 1] = keep[128:] = True
    table[~keep] = BLANK
    return table


LETTERS = _letters()


def family(language: str) -> str:
    return next((name for name, codes in FAMILIES.items() if language in codes), language)


def columns_of(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-gram columns by order (0 is unused), start of each text, number of letters of each text."""
    data = np.frombuffer(b"".join(GAP + t for t in texts) + GAP, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(GAP)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    code = LETTERS[data]
    blank = code == BLANK
    follows = np.append(blank[1:], True)
    dead = blank & follows
    mixed, found = np.zeros(len(code), np.uint32), []
    for order in range(ORDERS):
        mixed = (mixed * np.uint32(0x01000193)) ^ (np.append(code[order:], np.full(order, BLANK, np.uint32)) + np.uint32(order << 9))
        index = ((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int32)
        index[dead] = 0
        found.append(index)
    letters = np.add.reduceat((~blank).astype(np.int64), starts) if len(texts) else np.zeros(0, np.int64)
    return found, starts, letters


def features(text: bytes) -> np.ndarray:
    """The dense row of one text, for training."""
    columns, _, letters = columns_of([text])
    row = sum(np.bincount(c, minlength=DIMENSIONS) for c in columns).astype(np.float32)
    row[0] = 0
    return row / max(1, int(letters[0]))


def train_svm(kernel: np.ndarray, sign: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Dual weights of a squared-hinge SVM; the support set is updated until it is stable."""
    scale = ridge * float(np.mean(np.diag(kernel)))
    support, beta = np.ones(len(sign), bool), np.zeros(len(sign))
    for _ in range(30):
        beta[:] = 0
        inner = kernel[np.ix_(support, support)]
        inner[np.diag_indices_from(inner)] += scale
        beta[support] = np.linalg.solve(inner, sign[support])
        now = sign * (kernel @ beta) < 1
        if (now == support).all() or not now.any():
            break
        support = now
    return beta


@dataclass
class Model:
    """One column of weights per pair of families, then per pair of languages of one family."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]  # level ("" or the family), positive, negative
    weights: np.ndarray  # pairs x DIMENSIONS
    bias: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        if not self.pairs:
            return np.zeros((len(texts), 0))
        columns, starts, letters = columns_of(texts)
        out = np.empty((len(texts), len(self.pairs)))
        for k, weights in enumerate(self.weights):
            total = weights[columns[0]]
            for c in columns[1:]:
                total += weights[c]
            out[:, k] = np.add.reduceat(total.astype(np.float64), starts) / np.maximum(letters, 1) + self.bias[k]
        return out

    def vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Winner by votes, ties by summed margins, with the score of its closest duel."""
        n = len(margins)
        if len(names) == 1:
            return names * n, np.ones(n)
        votes, sums = np.zeros((n, len(names))), np.zeros((n, len(names)))
        closest = np.full((n, len(names)), np.inf)
        for k, (at, a, b) in enumerate(self.pairs):
            if at != level:
                continue
            i, j, m = names.index(a), names.index(b), margins[:, k]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            sums[:, i] += m
            sums[:, j] -= m
            closest[:, i] = np.minimum(closest[:, i], m)
            closest[:, j] = np.minimum(closest[:, j], -m)
        best = np.argmax(votes + 0.5 / (1 + np.exp(-sums)), axis=1)
        sure = 1 / (1 + np.exp(-STEEPNESS * np.clip(closest[np.arange(n), best], -10, 10)))
        return [names[i] for i in best], sure

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.families else []
        languages, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not known:
            return languages, scores
        margins = self.margins([texts[i].encode() for i in known])
        chosen, sure = self.vote("", self.families, margins)
        for name in set(chosen):
            rows = [r for r, f in enumerate(chosen) if f == name]
            inside, surer = self.vote(name, self.members[name], margins[rows])
            for r, language, s in zip(rows, inside, surer):
                languages[known[r]], scores[known[r]] = language, float(sure[r] * s)
        return languages, scores


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that teaches nothing."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled rows per language."""
    shared_dir(docs.sparkSession)
    plain = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
    ).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ranked = plain.select("doc_id", "lang").withColumn("_nth", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    chosen = ranked.where(f"_nth <= {int(sample)}").select("doc_id", "lang").distinct()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense = [features(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            used = [np.flatnonzero(d).astype(np.int32) for d in dense]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([u.tobytes() for u in used], pa.binary()),
                 pa.array([d[u].tobytes() for d, u in zip(dense, used)], pa.binary())],
                names=["doc_id", "lang", "at", "value"],
            )

    # ``sample`` rows per language: counted before it is broadcast, so the texts are not shuffled.
    taught = plain.join(broadcast_within(chosen), ["doc_id", "lang"], "left_semi")
    taught = arrow_pass(taught, rows_of, "doc_id long, lang string, at binary, value binary").where(F.length("at") > 0)
    # A chosen id may repeat without end: the bound holds before the rows leave Spark (and in each task before the shuffle).
    nth = F.row_number().over(W.partitionBy("lang").orderBy(*order, "value", "at"))
    found = taught.withColumn("_nth", nth).where(f"_nth <= {int(sample)}").drop("_nth").collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, bytes(r["value"])))
    taken: dict[str, int] = {}
    kept = []
    for r in found:  # ids may repeat, the bound holds all the same
        if len(r["at"]) and taken.setdefault(r["lang"], 0) < sample:
            taken[r["lang"]] += 1
            kept.append(r)
    rows = np.zeros((len(kept), DIMENSIONS), np.float32)
    for row, r in zip(rows, kept):
        row[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
    return train(rows, [r["lang"] for r in kept])


def train(rows: np.ndarray, languages: list[str]) -> Model:
    """All duels share one table of products between the rows; the bias is a constant feature."""
    members: dict[str, list[str]] = {}
    for language in sorted(set(languages)):
        members.setdefault(family(language), []).append(language)
    families = sorted(members)
    products = (rows @ rows.T).astype(np.float64) + 1.0
    own, group = np.array(languages, object), np.array([family(x) for x in languages], object)
    pairs, weights, bias = [], [], []
    for level, names, side in [("", families, group)] + [(f, members[f], own) for f in families]:
        for a, b in combinations(names, 2):
            at = np.flatnonzero((side == a) | (side == b))
            beta = train_svm(products[np.ix_(at, at)], np.where(side[at] == a, 1.0, -1.0))
            w = np.zeros(DIMENSIONS, np.float32)
            for i, x in zip(at.tolist(), beta.tolist()):
                w += np.float32(x) * rows[i]
            w[0] = 0
            pairs.append((level, a, b))
            weights.append(w)
            bias.append(float(beta.sum()))
    return Model(families, members, pairs, np.array(weights, np.float32), np.array(bias))


#: Bytes that one vectorised step takes at once; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def _steps(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += 4 + (len(t) if t else 0)
        if size >= STEP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _predicted(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    languages, scores = [], []
    for some in _steps(texts):
        a, b = model.predict(some)
        languages += a
        scores += b
    return languages, scores


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = _predicted(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    out = arrow_pass(narrow(docs, doc_id, text), work, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language could be told (not ``und``), with all their columns.

    A model that could learn no language rejects only what has no letter.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            if model.families:
                told = pa.array([x != "und" for x in _predicted(model, texts)[0]], pa.bool_())
            else:
                told = pa.array([bool(t and LETTER.search(t)) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(told)

    texts = F.col(names[docs.columns.index(text)]).cast("string")
    return arrow_pass(plain.withColumn("_text", texts), work, schema).toDF(*docs.columns)
