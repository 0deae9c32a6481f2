"""Place names in messages, by approximate matching of a gazetteer against windows of one to three words.

A window and a name are lower-cased, their words sorted and joined by a blank.  They match when the edit ratio
``100 * (1 - indel / (len(window) + len(name)))`` reaches the threshold; indel counts the characters to insert and delete.

The gazetteer is indexed by segments.  For a name and a length of window the threshold allows at most ``t`` edits, so of
``t + 1`` segments of the name one stands unchanged in any matching window, and how far it can have moved is known.  Every
segment becomes a 64-bit key (lengths, segment number, text).

1. One pass over the messages cuts windows and looks the keys of their substrings up in a bit table of fixed size (every matching window hits).
2. An index of up to ``INDEX_KEYS`` rows (counted) goes along with the pass: hits meet its names at once, and only matches leave the task.
   With a larger one the windows that hit are kept, and the distinct ones meet the index in an equi-join on the key.
3. Either way a pair is first held against a lower bound of its edits, the difference of character counts in ``CLASSES`` classes; what is left is
   verified, and matches go back to the messages by window: broadcast if they are few (counted), else shuffled.

Nothing but the bit table (4 MB), an index of at most that many rows and the list of name lengths leaves the cluster, whatever the sizes of the tables.

Defined cases: null or wordless messages and names match nothing; names that repeat are matched under each id; null ids stay; messages that
repeat an id count together; an empty gazetteer gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.plans.sizing import broadcast_within
from switchyard.session import scratch_path, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 85
MAX_WORDS = 3
#: Size of the bit table: 2 ** 25 bits.
TABLE_BITS = 25
#: Messages that one batch of the window pass holds.
BATCH_ROWS = 256
#: Words of one text that are cut at a time, and windows that are looked up at a time.
STEP_WORDS, STEP_WINDOWS = 50_000, 150_000
#: Rows of the index that may go along with the pass over the messages, pairs that are looked at together, and classes of characters.
INDEX_KEYS, STEP_PAIRS, CLASSES = 200_000, 200_000, 32
WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def windows(words: Sequence[str], old: int = 0, most: int = MAX_WORDS) -> list[str]:
    """All windows that end after the first ``old`` words, each with its words sorted."""
    found = list(words[old:])
    for n in range(2, most + 1):
        found += [" ".join(sorted(words[i : i + n])) for i in range(max(0, old - n + 1), len(words) - n + 1)]
    return found


def cut_text(text: str, step: int | None = None, most: int = MAX_WORDS) -> Iterator[list[str]]:
    """The windows of a text, from ``step`` words at a time."""
    found, carried = WORD.finditer(text), []
    while words := [m[0] for m in islice(found, step or STEP_WORDS)]:
        yield windows(carried + words, len(carried), most)
        carried = (carried + words)[1 - most :]


def normalise(name: str) -> str:
    return " ".join(sorted(WORD.findall(name)))


def edits(window: int, name: int, threshold: int = THRESHOLD) -> int:
    """The most insertions and deletions between a window and a name of these lengths; -1 if they cannot match."""
    most, least = (100 - threshold) * (window + name) // 100, abs(window - name)
    most -= (most - least) & 1  # an odd difference of lengths takes an odd number of edits
    return most if most >= least else -1


def segments(length: int, count: int) -> list[tuple[int, int]]:
    """(start, size) of ``count`` nearly equal parts."""
    cuts = [length * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - indel / (len(a) + len(b))), by a bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


class Texts:
    """Texts of one length as a matrix of characters, with hashes of all their substrings."""

    def __init__(self, texts: Sequence[str]):
        self.length = len(texts[0])
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), self.length)
        self.before = np.zeros((self.length + 1, len(texts)), np.uint64)
        self.powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for i in range(self.length):
                self.before[i + 1] = self.before[i] * _ODD + chars[:, i].astype(np.uint64) + np.uint64(1)
                self.powers.append(self.powers[-1] * _ODD)

    def key(self, start: int, size: int, window: int, name: int, segment: int) -> np.ndarray:
        """Keys of a substring as the given segment of a name of that length, met by windows of that length."""
        with np.errstate(over="ignore"):
            h = self.before[start + size] - self.before[start] * self.powers[size]
            h = (h ^ np.uint64((window << 40 | name << 16 | segment) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)) * _MIX
            return h ^ (h >> np.uint64(29))

    def probes(self, lengths: Sequence[int], threshold: int) -> Iterator[np.ndarray]:
        """Keys that a window of this length has to look up, one array per place of a segment."""
        la = self.length
        for lb in lengths:
            t = edits(la, lb, threshold)
            if t < 0:
                continue
            for k, (start, size) in enumerate(segments(lb, t + 1)):
                # A segment moves by no more than the edits on its left and those on its right allow.
                first = max(0, start - k, start + la - lb - (t - k))
                last = min(la - size, start + k, start + la - lb + (t - k))
                for at in range(first, last + 1):
                    yield self.key(at, size, la, lb, k)


def class_counts(texts: Sequence[str]) -> np.ndarray:
    """How often characters of every class occur, one row per text.

    The sum of differences between two rows is at most the number of characters to insert and delete.
    """
    out = np.zeros((len(texts), CLASSES), np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    np.add.at(out.reshape(-1), np.repeat(np.arange(len(texts)), sizes) * CLASSES + chars % CLASSES, 1)
    return out


def near_pairs(group: Sequence[str], names: Sequence[str], a: np.ndarray, b: np.ndarray, counts: tuple, threshold: int) -> np.ndarray:
    """Which pairs (windows of one length, names) the difference of character counts allows to match."""
    room = np.array([edits(len(group[0]), len(n), threshold) for n in names], np.int64)
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), STEP_PAIRS):
        x, y = a[at : at + STEP_PAIRS], b[at : at + STEP_PAIRS]
        out[at : at + STEP_PAIRS] = np.abs(counts[0][x] - counts[1][y]).sum(axis=1) <= room[y]
    return out


def by_length(texts: Sequence[str]) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for t in texts:
        groups.setdefault(len(t), []).append(t)
    yield from groups.values()


def place_index(gazetteer: DataFrame, name_id: str, name: str, threshold: int = THRESHOLD) -> DataFrame:
    """name_id, name (as normalised), key: one row per name, length of window and segment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, keys = [], [], []
            for i, raw in zip(*(c.to_pylist() for c in batch.columns)):
                plain = normalise(raw)
                if not plain:
                    continue
                text, lb = Texts([plain]), len(plain)
                # Beyond these lengths the difference alone is more than the threshold allows.
                for la in range(lb * threshold // (200 - threshold), lb * (200 - threshold) // threshold + 2):
                    t = edits(la, lb, threshold)
                    if la and t >= 0:
                        found = [int(text.key(s, n, la, lb, k).view(np.int64)[0]) for k, (s, n) in enumerate(segments(lb, t + 1))]
                        keys += found
                        ids += [i] * len(found)
                        names += [plain] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(keys, pa.int64())],
                names=["name_id", "name", "key"],
            )

    named = gazetteer.select(F.col(f"`{name_id}`").alias("name_id"), F.lower(F.col(f"`{name}`").cast("string")).alias("name"))
    kind = named.schema["name_id"].dataType.simpleString()
    return named.where("name is not null").mapInArrow(work, f"name_id {kind}, name string, key long")


def bit_table(index: DataFrame) -> np.ndarray:
    """The keys of the index as a table of 2 ** TABLE_BITS bits; what is collected has a fixed size."""
    place = F.shiftrightunsigned("key", 64 - TABLE_BITS)
    word, bit = F.shiftright(place, 6).cast("int"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - TABLE_BITS}) & 63 as int))")
    rows = index.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << TABLE_BITS - 6, np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint8)


def known(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - TABLE_BITS)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1)


def place_names(
    messages: DataFrame, gazetteer: DataFrame, doc_id: str = "doc_id", text: str = "text", name_id: str = "name_id",
    name: str = "name", threshold: int = THRESHOLD,
) -> DataFrame:
    """doc_id, name_id, name, hits (windows that match), score (the best ratio), best (its window, the least of equals)."""
    spark = messages.sparkSession
    shared_dir(spark)
    index = place_index(gazetteer, name_id, name, threshold).checkpoint()
    lengths = sorted(r[0] for r in index.select(F.length("name")).distinct().collect())
    carried = None
    if index.count() <= INDEX_KEYS:
        rows = index.select("name", "key").distinct().sort("key", "name").toArrow()
        found = rows["name"].combine_chunks().dictionary_encode()
        plain_names = found.dictionary.to_pylist()
        carried = rows["key"].to_numpy().view(np.uint64), found.indices.to_numpy(), plain_names, class_counts(plain_names)
        order = np.argsort(carried[0], kind="stable")
        carried = carried[0][order], carried[1][order], *carried[2:]
    shared = spark.sparkContext.broadcast((bit_table(index), lengths, carried))

    def matching(group: list[str], probes: Iterator[np.ndarray], table: np.ndarray, index: tuple) -> Iterator[tuple[str, str, float]]:
        """window, name and score of all matches of windows of one length."""
        keys, owner, names, counts = index
        pairs = []
        for asked in probes:
            at = np.flatnonzero(known(table, asked))
            low, high = (np.searchsorted(keys, asked[at], side) for side in ("left", "right"))
            some = high > low
            at, low, size = at[some], low[some], (high - low)[some]
            if len(at):
                which = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
                pairs.append(np.unique(np.repeat(at, size) * len(names) + owner[which]))
        if pairs:
            a, b = np.divmod(np.unique(np.concatenate(pairs)), len(names))
            near = near_pairs(group, names, a, b, (class_counts(group), counts), threshold)
            for i, j in zip(a[near].tolist(), b[near].tolist()):
                score = indel_ratio(group[i], names[j])
                if score >= threshold:
                    yield group[i], names[j], score

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths, index = shared.value

        def passed(cuts: list[tuple[object, list[str]]], kind: pa.DataType) -> pa.RecordBatch:
            kept: dict[str, list] = {}
            for group in by_length({w for _, c in cuts for w in c}):
                possible = [n for n in lengths if edits(len(group[0]), n, threshold) >= 0]
                if possible and index:
                    for w, n, score in matching(group, Texts(group).probes(possible, threshold), table, index):
                        kept.setdefault(w, []).append((n, score))
                elif possible:
                    hit = np.zeros(len(group), np.uint8)
                    for keys in Texts(group).probes(possible, threshold):
                        hit |= known(table, keys)
                    kept.update((group[i], [()]) for i in np.flatnonzero(hit))
            rows = [(i, w, n, *m) for i, c in cuts for w, n in Counter(x for x in c if x in kept).items() for m in kept[w]]
            kinds = (kind, pa.string(), pa.int64(), *((pa.string(), pa.float64()) if index else ()))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=["doc_id", "window", "times", "name", "score"][: len(kinds)],
            )

        for batch in batches:
            cuts, size, kind = [], 0, batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in cut_text(t or ""):
                    cuts.append((i, found))
                    size += len(found)
                    if size >= STEP_WINDOWS:
                        yield passed(cuts, kind)
                        cuts, size = [], 0
            if cuts:
                yield passed(cuts, kind)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths, _ = shared.value
        for batch in batches:
            for group in by_length(batch.column(0).to_pylist()):
                texts = np.array(group, object)
                for keys in Texts(group).probes(lengths, threshold):
                    at = np.flatnonzero(known(table, keys))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(texts[at], pa.string()), pa.array(keys[at].view(np.int64))], names=["window", "key"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, names = batch.column("window").to_pylist(), batch.column("name").to_pylist()
            room = np.array([edits(len(a), len(b), threshold) for a, b in zip(windows, names)], np.int64)
            near = np.flatnonzero(np.abs(class_counts(windows) - class_counts(names)).sum(axis=1) <= room)
            found = [indel_ratio(windows[i], names[i]) for i in near]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(near)).columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    plain = messages.select(F.col(f"`{doc_id}`").alias("doc_id"), F.lower(F.col(f"`{text}`").cast("string")).alias("text"))
    kinds = [plain.schema["doc_id"].dataType.simpleString(), index.schema["name_id"].dataType.simpleString()]
    best = F.min_by("window", F.struct(-F.col("score"), "window"))
    totals = F.sum("times").alias("hits"), F.max("score").alias("score"), best.alias("best")
    if carried:
        # Few rows: one per match of a piece of a text.
        matched = plain.mapInArrow(cut, f"doc_id {kinds[0]}, window string, times long, name string, score double")
        ids = broadcast_within(index.select("name_id", "name").distinct())
        return matched.join(ids, "name").groupBy("doc_id", "name_id", "name").agg(*totals)
    path = scratch_path(spark, "windows")
    plain.mapInArrow(cut, f"doc_id {kinds[0]}, window string, times long").write.parquet(path)
    held = spark.read.parquet(path)
    asked = held.select("window").distinct().mapInArrow(ask, "window string, key long")
    candidates = asked.join(index, "key").select("window", "name_id", "name").distinct()
    scored = candidates.mapInArrow(score, f"window string, name_id {kinds[1]}, name string, score double")
    matches = broadcast_within(scored.where(F.col("score") >= threshold))
    return held.join(matches, "window").groupBy("doc_id", "name_id", "name").agg(*totals)
