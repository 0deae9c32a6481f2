"""Word vectors (continuous bag of words, negative sampling) with vocabulary and weights sharded by word.

The texts are dealt over a number of shards that follows from the words of the table alone, so vectors do not depend on the
machine.  In every epoch the weights of the words that a shard holds, or draws as noise, are joined to the shard; it trains on
its texts in order and returns what it has; a word's weights are the mean over its shards, weighted by the word's
occurrences there, and become the next epoch's table.  Weights live in tables in the shared folder, both of a word as one binary value
that Spark moves whole: neither the driver nor a broadcast ever holds the vocabulary, and there is no limit on it.  An epoch's shuffle files go when its table is written, and its table takes the
place of the last but one, so the disk holds one epoch whatever their number.

Per text the words of the vocabulary count; a frequent word is left out with the usual probability (``SAMPLE``); the window around
a word is drawn from 1 to ``window``; the mean of the vectors inside it predicts the word against ``negative`` noise words drawn in
proportion to (occurrences ** 0.75).  All draws are seeded by shard and epoch.  A shard's noise comes from a pool of about ``NOISE``
words, drawn from the whole vocabulary anew for every epoch.

A text's vector is the mean over its known words, zeros when none is known.  Up to ``BROADCAST_WORDS`` words (counted) the
vectors are broadcast and a text is one step of a map; beyond, words meet their vectors in a join.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard.functions import text as tx
from switchyard.session import scratch_path, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of text in one shard, about, which with their vectors is what a task holds; there are two shards at least.
SHARD_WORDS = 100_000
#: Noise words that a shard draws per epoch.
NOISE = 8_000
#: Words whose vectors may be broadcast.
BROADCAST_WORDS = 200_000
#: The session setting under which a query's shuffle files go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words whose weights are one Arrow array, at most.
PACKED = 100_000
#: Copies of a text that one array lists.
COPIES = 4096
#: Above this share of all words a word is thinned out.
SAMPLE = 1e-3
#: Learning rate at the start and at the end.
RATES = (0.025, 0.0001)
#: Words that are trained on together, and how often one row may move in full in that time.
STEP, ROOM = 128, 8
#: Repeats of a row that are added rank by rank.
RANKS = 8


def train_shard(
    texts: Sequence[np.ndarray], weights: np.ndarray, outputs: np.ndarray, keep: np.ndarray, noise: np.ndarray,
    window: int, negative: int, rates: tuple[float, float], rng: np.random.Generator,
) -> None:
    """One epoch over the texts (indices of words), changing both weight matrices in place."""
    kept = [t[rng.random(len(t)) < keep[t]] for t in texts]
    lengths = np.array([len(t) for t in kept])
    if not lengths.sum():
        return
    flat = np.concatenate(kept)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = np.repeat(np.cumsum(lengths), lengths)
    reach = rng.integers(1, window + 1, len(flat))
    offsets = np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])
    steps = range(0, len(flat), STEP)
    for nth, at in enumerate(steps):
        rate = rates[0] + (rates[1] - rates[0]) * nth / len(steps)
        centre = np.arange(at, min(at + STEP, len(flat)))
        around = centre[:, None] + offsets
        inside = (np.abs(offsets) <= reach[centre][:, None]) & (around >= first[centre][:, None]) & (around < last[centre][:, None])
        some = inside.any(axis=1)
        centre, around, inside = centre[some], around[some], inside[some]
        if not len(centre):
            continue
        context = flat[np.where(inside, around, 0)]
        size = inside.sum(axis=1)
        mean = np.einsum("ij,ijk->ik", inside.astype(np.float32), weights.take(context, axis=0)) / size[:, None].astype(np.float32)
        drawn = noise[rng.integers(0, len(noise), (len(centre), negative))]
        target = np.concatenate([flat[centre][:, None], drawn], axis=1)
        wanted = np.zeros(target.shape, np.float32)
        wanted[:, 0] = 1.0
        out = outputs.take(target, axis=0)
        guess = 1.0 / (1.0 + np.exp(-np.clip(np.einsum("ik,ijk->ij", mean, out), -30, 30)))
        push = (wanted - guess).astype(np.float32) * np.float32(rate)
        push[:, 1:][drawn == flat[centre][:, None]] = 0.0  # a word is no noise for itself
        # Library rule: the error goes to every word of the window undivided.
        back = np.einsum("ij,ijk->ik", push, out)
        _add(outputs, target.ravel(), (push[:, :, None] * mean[:, None, :]).reshape(-1, mean.shape[1]))
        row, place = np.nonzero(inside)
        _add(weights, context[row, place], back.take(row, axis=0))


def _add(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add values to rows of a table; a row that repeats more than ROOM times in a step moves by ROOM times its mean.

    All values come from the state before the step; without the limit a word that fills the step would overshoot.
    """
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    often = np.diff(np.append(starts, len(rows)))
    # Rows that repeat most go first, so that those with an nth value are a slice.
    first = np.argsort(-often, kind="stable")
    starts, often = starts[first], often[first]
    total = values.take(order[starts], axis=0)
    # Most rows come once or a few times: the second values of all rows together, then the third; long runs by themselves.
    for nth in range(1, RANKS):
        more = int(np.searchsorted(-often, -nth))
        if not more:
            break
        total[:more] += values.take(order[starts[:more] + nth], axis=0)
    for i in range(int(np.searchsorted(-often, -RANKS))):
        total[i] += values.take(order[starts[i] + RANKS : starts[i] + often[i]], axis=0).sum(axis=0)
    over = int(np.searchsorted(-often, -ROOM))
    total[:over] *= (ROOM / often[:over])[:, None].astype(np.float32)
    names = rows[starts]
    table[names] = table.take(names, axis=0) + total


def _shards(words: DataFrame, size: int) -> int:
    total = words.agg(F.sum(F.size("words") * F.col("_times"))).first()[0] or 0
    return int(max(2, -(-total // size)))


def _start(word: Column, size: int, seed: int) -> Column:
    """The first vector of a word, from hashes of the word: uniform, at most 1 / (2 size) in every direction."""
    draw = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.pmod(F.xxhash64(word, i, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20))
    return F.transform(draw, lambda x: ((x - 0.5) / size).cast("float"))


def _pack(weights: np.ndarray) -> list[pa.Array]:
    """Every row as one binary value of 32-bit floats."""
    out = []
    for at in range(0, len(weights), PACKED):
        some = np.ascontiguousarray(weights[at : at + PACKED], np.float32)
        ends = np.arange(len(some) + 1, dtype=np.int32) * np.int32(4 * some.shape[1])
        out.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(some)]))
    return out or [pa.array([], pa.binary())]


def _unpack(values: pa.Array, width: int) -> np.ndarray:
    """The rows of an array made by ``_pack``."""
    if not len(values):
        return np.empty((0, width), np.float32)
    first = int(np.frombuffer(values.buffers()[1], np.int32)[values.offset])
    return np.frombuffer(values.buffers()[2], np.float32, len(values) * width, first).reshape(len(values), width)


def _packed(table: DataFrame, size: int) -> DataFrame:
    """word, n, keep, and ``state``: the vector and as many zeros."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            weights = np.zeros((batch.num_rows, 2 * size), np.float32)
            weights[:, :size] = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for nth, state in enumerate(_pack(weights)):
                part = batch.slice(nth * PACKED, len(state))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], state], names=["word", "n", "keep", "state"])

    return table.mapInArrow(work, "word string, n long, keep double, state binary")


def _vectors(table: DataFrame, size: int) -> DataFrame:
    """word, n, vector of packed weights."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.ascontiguousarray(_unpack(batch.column("state"), 2 * size)[:, :size]).ravel()
            ends = pa.array(np.arange(batch.num_rows + 1) * size, pa.int32())
            vector = pa.ListArray.from_arrays(ends, pa.array(flat), type=pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vector], names=["word", "n", "vector"])

    return table.select("word", "n", "state").mapInArrow(work, "word string, n long, vector array<float>")


def fit_vectors(
    df: DataFrame, text: str = "text", size: int = 100, window: int = 5, min_count: int = 2, epochs: int = 10,
    seed: int = 42, negative: int = 5, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """word, n, vector (array of float) of every word that occurs ``min_count`` times, as a table in the shared folder."""
    spark = df.sparkSession
    shared_dir(spark)
    # Copies of a text are counted, then dealt out one by one: a hot text is in all shards.
    texts = df.select(F.lower(F.col(text)).alias("_text")).groupBy("_text").agg(F.count(F.lit(1)).alias("_times"))
    words = texts.select(tx.words(F.col("_text")).alias("words"), "_times").where(F.size("words") > 0).checkpoint()
    shards = _shards(words, shard_words)
    # A copy's shard and order follow from the text and its number, so a rerun deals the same.
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(COPIES).cast("long"))).alias("_first")
    last = F.least(F.col("_first") + COPIES, F.col("_times")) - 1
    copies = words.select("words", "_times", first).select("words", F.explode(F.sequence(F.col("_first"), last)).alias("_copy"))
    named = copies.select("words", F.xxhash64("words", "_copy", F.lit(seed)).alias("hash"))
    dealt = named.withColumn("shard", F.pmod(F.col("hash"), F.lit(shards)).cast("int")).repartition("shard").checkpoint()
    counts = dealt.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).checkpoint()
    totals = counts.agg(F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(0.75))).alias("power")).first()
    if not totals["n"]:
        return counts.select("word", "n", F.array().cast("array<float>").alias("vector"))
    share = F.col("n") / F.lit(float(totals["n"]))
    keep = F.least(F.lit(1.0), F.sqrt(F.lit(SAMPLE) / share) + F.lit(SAMPLE) / share)
    table = _packed(counts.select("word", "n", keep.alias("keep"), _start(F.col("word"), size, seed).alias("vector")), size)
    # Which words a shard holds: one row per (shard, word), the same in all epochs.
    held = dealt.select("shard", F.explode("words").alias("word")).groupBy("shard", "word").agg(F.count(F.lit(1)).alias("here")).join(
        counts.select("word"), "word", "left_semi"
    ).checkpoint()
    paths = [scratch_path(spark, "word-vectors") for _ in range(2)]
    for epoch in range(epochs):
        rates = tuple(RATES[0] + (RATES[1] - RATES[0]) * (epoch + d) / epochs for d in (0, 1))
        drawn = _noise(counts, totals["power"], shards, seed, epoch)
        asked = held.select("shard", "word", "here", F.lit(0).cast("long").alias("noise")).unionByName(
            drawn.select("shard", "word", F.lit(0).cast("long").alias("here"), "noise")
        ).groupBy("shard", "word").agg(F.sum("here").alias("here"), F.sum("noise").alias("noise"))
        given = asked.join(table, "word").select(F.col("shard").alias("place"), "word", "here", "noise", "keep", "state")
        trained = dealt.select("shard", "hash", "words").groupBy("shard").cogroup(given.groupBy("place")).applyInArrow(
            _trainer(size, window, negative, rates, seed, epoch), "word string, shard int, here long, state binary"
        )
        # Shards are weighted by occurrences; those that only drew a word as noise count as one.
        mean = _mean(trained, size)
        _write(counts.join(mean, "word").select("word", "n", keep.alias("keep"), "state"), paths[epoch % 2])
        table = spark.read.parquet(paths[epoch % 2])
    path = scratch_path(spark, "word-vectors")
    _write(_vectors(table, size), path)
    return spark.read.parquet(path)


def _write(table: DataFrame, path: str) -> None:
    """Write a table, over an older one, and leave no shuffle files behind."""
    spark = table.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # Planned anew under the setting.
        table.select("*").write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def _noise(counts: DataFrame, power: float, shards: int, seed: int, epoch: int) -> DataFrame:
    """shard, word, noise: how often each shard draws a word, about NOISE draws in all per shard."""
    each = F.pow("n", F.lit(0.75)) * (NOISE / power)  # expected draws per shard
    luck = lambda *c: F.pmod(F.xxhash64("word", *c, F.lit(seed), F.lit(epoch)), F.lit(1 << 30)) / float(1 << 30)
    # At most NOISE words are expected in every shard; the rest are drawn over all shards and dealt out.
    often = counts.where(each >= 1.0).select("word", each.alias("_each"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    often = often.select("shard", "word", F.floor(F.col("_each") + luck("shard")).cast("long").alias("noise"))
    copies = F.floor(each * shards + luck()).cast("int")
    seldom = counts.where((each < 1.0) & (copies > 0)).select("word", F.explode(F.sequence(F.lit(1), copies)).alias("_copy"))
    shard = F.pmod(F.xxhash64("word", "_copy", F.lit(seed), F.lit(epoch)), F.lit(shards)).cast("int")
    return often.unionByName(seldom.groupBy(shard.alias("shard"), "word").agg(F.count(F.lit(1)).alias("noise")))


def _trainer(size: int, window: int, negative: int, rates: tuple[float, float], seed: int, epoch: int):
    def work(key, texts, given):
        order = np.argsort(given["word"].to_numpy(zero_copy_only=False))  # one order whatever the shuffle
        words = given["word"].take(pa.array(order))
        plain = words.to_pylist()
        number = {w: i for i, w in enumerate(plain)}
        take = lambda name: given[name].combine_chunks().take(pa.array(order))
        state = np.concatenate([_unpack(x, 2 * size) for x in given["state"].chunks] or [np.empty((0, 2 * size), np.float32)])[order]
        weights, outputs = np.ascontiguousarray(state[:, :size]), np.ascontiguousarray(state[:, size:])
        listed = texts["words"].to_pylist()
        sequence = sorted(range(len(listed)), key=lambda i: (texts["hash"][i].as_py(), listed[i]))
        known = [np.array([number[w] for w in listed[i] if w in number], np.int64) for i in sequence]
        noise = np.repeat(np.arange(len(plain)), take("noise").to_numpy())
        rng = np.random.default_rng([seed, epoch, key[0].as_py()])
        if len(noise):
            train_shard(known, weights, outputs, take("keep").to_numpy(), noise, window, negative, rates, rng)
        state = pa.chunked_array(_pack(np.concatenate([weights, outputs], axis=1)))
        shard = pa.array(np.full(len(plain), key[0].as_py(), np.int32))
        return pa.table({"word": words, "shard": shard, "here": take("here"), "state": state})

    return work


def _mean(trained: DataFrame, size: int) -> DataFrame:
    """word, state: weighted means over the shards, by ranges of word hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by word and shard; of a batch's last word the sum so far is held, so a task holds one batch.
        now, total, held = None, 0.0, None

        def means(words: pa.Array, totals: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for nth, state in enumerate(_pack(sums / totals[:, None])):
                yield pa.RecordBatch.from_arrays([words.slice(nth * PACKED, len(state)), state], names=["word", "state"])

        for batch in batches:
            if not batch.num_rows:
                continue
            word, weight = batch.column("word"), np.maximum(1, batch.column("here").to_numpy()).astype(float)
            rows = _unpack(batch.column("state"), 2 * size) * weight[:, None]
            starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)]))
            often = np.diff(np.append(starts, len(word)))
            sums, totals = np.zeros((len(starts), 2 * size)), np.add.reduceat(weight, starts)
            if now is not None:
                if word[0].as_py() == now:
                    sums[0], totals[0] = held, totals[0] + total
                else:
                    yield from means(pa.array([now], pa.string()), np.array([total]), held[None])
            # The nth rows of all words together, one after another within a word.
            order = np.argsort(-often, kind="stable")
            for nth in range(int(often.max())):
                some = order[: np.searchsorted(-often[order], -nth)]
                sums[some] += rows[starts[some] + nth]
            now, total, held = word[int(starts[-1])].as_py(), totals[-1], sums[-1]
            yield from means(word.take(pa.array(starts[:-1])), totals[:-1], sums[:-1])
        if now is not None:
            yield from means(pa.array([now], pa.string()), np.array([total]), held[None])

    # Sums run in the order of shards, so that two fits are equal to the last bit.
    parts = int(trained.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = trained.repartition(parts, "word").sortWithinPartitions("word", "shard")
    return dealt.mapInArrow(work, "word string, state binary")


@dataclass
class MeanWordVectors:
    """Mean of the vectors of the known words of a text, zeros when none is known."""

    vectors: DataFrame  # word, n, vector
    size: int = 100

    @classmethod
    def fit(
        cls, df: DataFrame, text: str = "text", size: int = 100, window: int = 5, min_count: int = 2,
        epochs: int = 10, seed: int = 42, shard_words: int = SHARD_WORDS,
    ) -> MeanWordVectors:
        return cls(fit_vectors(df, text, size, window, min_count, epochs, seed, shard_words=shard_words), size)

    def transform(
        self, df: DataFrame, text: str = "text", output: str = "features", keep: Sequence[str] | None = None
    ) -> DataFrame:
        kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name != output]
        rows = df.select(*[F.col(f"`{f.name}`") for f in kept], F.lower(F.col(text)).alias("_text"))
        if self.vectors.count() <= BROADCAST_WORDS:
            return self._mapped(rows, kept, output)
        return self._joined(rows, kept, output)

    def _mapped(self, rows: DataFrame, kept: Sequence[T.StructField], output: str) -> DataFrame:
        table, size = self.vectors.select("word", "vector").toArrow(), self.size  # BROADCAST_WORDS rows at most
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        shared = rows.sparkSession.sparkContext.broadcast((table["word"].to_pylist(), np.array(flat, np.float32).reshape(-1, size)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, vectors = shared.value
            number = {w: i for i, w in enumerate(words)}
            for batch in batches:
                means = np.zeros((batch.num_rows, size))
                for i, body in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    at = [number[w] for w in (body or "").split() if w in number]
                    if at:
                        means[i] = vectors[at].mean(axis=0, dtype=np.float64)
                ends = pa.array(np.arange(batch.num_rows + 1) * size, pa.int32())
                mean = pa.ListArray.from_arrays(ends, pa.array(means.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], mean], names=[*batch.schema.names[:-1], output])

        schema = T.StructType([*kept, T.StructField(output, T.ArrayType(T.DoubleType()))])
        return rows.mapInArrow(work, schema).withColumn(output, array_to_vector(output))

    def _joined(self, rows: DataFrame, kept: Sequence[T.StructField], output: str) -> DataFrame:
        """Words are counted per text first; rows are fixed by a checkpoint, as both sides of the last join read them."""
        numbered = rows.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
        words = numbered.select("_row", F.explode(tx.words(F.col("_text"))).alias("word")).groupBy("_row", "word").agg(F.count(F.lit(1)).alias("_times"))
        mean = Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")), F.col("_times").cast("double"))
        means = words.join(self.vectors.select("word", "vector"), "word").groupBy("_row").agg(mean.alias(output))
        zeros = array_to_vector(F.array_repeat(F.lit(0.0), self.size))
        joined = numbered.join(means, "_row", "left")
        return joined.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(output, zeros).alias(output))
