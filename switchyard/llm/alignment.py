"""Alignment of the tokens of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cut the same bytes (space, then the text).  A byte offset at which tokens of both end is a shared cut.
An interval of tokens is divided at a shared cut near its middle, found by bisecting the other side's ends for the ends
of tokens from the middle outwards; both halves are divided again, and an interval without a shared cut inside is a group.
All intervals of a batch of documents take one step at a time, in vectorised form: the documents' own ends are the
first cuts, so one very long document is divided like any other.

Tokens that end together are a link, one per group.  Of two tokens that end together one is a suffix of the other, so all
id pairs that can ever be linked follow from the two vocabularies (:class:`Pairs`); their number does not depend on the
documents.  Documents are tokenized once, links are kept as pair numbers in a table in the shared folder, tasks add their
links up to one count per pair before the shuffle, and the table of counts, which is at most as long as the list of pairs,
is broadcast to score the links.

The first vocabulary is a byte-level BPE file whose merge order is the order of ids; a rank encoder does the same merges
several times faster than the library that reads the file itself, which is used for texts with very long runs of white
space.  Vocabulary files are parameters.

Defined cases: a null or empty text, and one whose tokens of either side do not give back space and text, has no tokens:
zeros and an empty digest; a null id stays null; repeated rows count as often as they stand; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.bpe import PATTERN, byte_letters
from switchyard.llm.common import arrow_pass, narrow
from switchyard.session import scratch_path

#: A longer run of white space is more than the rank encoder's pattern engine takes.
SPACES = re.compile(r"\s{1000}")
#: Bytes of text that are tokenized and divided at a time (or one text).
STEP_BYTES = 1 << 19
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class ByteLevel:
    """The byte-level vocabulary: ids of texts, bytes of ids."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        known = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(known[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.tokens = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for data, i in ranks.items():
            self.tokens[i] = data
        order = []
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            order.append(spec["model"]["vocab"][left + right])
        self.ranked = order == sorted(order) and len(set(order)) == len(order) == len(ranks) - 256
        self.content, self._library = content, None
        if self.ranked:
            import tiktoken

            self._ranks = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.content.decode())
            self._library.encode_special_tokens = True
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def encode(self, text: str) -> list[int]:
        if self.ranked and not SPACES.search(text):
            return self._ranks.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """The piece model: ids of texts (it puts the space in front itself), bytes of ids."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.tokens = [self._bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        byte = BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pairs:
    """All id pairs of which one token is a suffix of the other, as sorted keys ``a << 32 | b``; a link is an index."""

    def __init__(self, a_tokens: list[bytes], b_tokens: list[bytes]):
        found = set()
        for shorter, longer, first in ((b_tokens, a_tokens, True), (a_tokens, b_tokens, False)):
            ids: dict[bytes, list[int]] = {}
            for i, data in enumerate(shorter):
                if data:
                    ids.setdefault(data, []).append(i)
            for i, data in enumerate(longer):
                for at in range(len(data)):
                    for j in ids.get(data[at:], ()):
                        found.add(i << 32 | j if first else j << 32 | i)
        self.keys = np.array(sorted(found), np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Indices of pairs that are in the list."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slots()[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)  # pairs whose slot another pair has
        at[other] = np.searchsorted(self.keys, keys[other])
        assert (self.keys[np.minimum(at[other], len(self.keys) - 1)] == keys[other]).all()
        return at

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)

    def _slots(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << 21, np.int32)
            self._table[self._slot(self.keys)] = np.arange(len(self.keys))
        return self._table


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Indices into ``a_ends`` of all ends that ``b_ends`` has too; ``known`` are such indices, the last one included.

    Intervals are (first, last): tokens whose ends lie strictly between two cuts.  In each step every open interval
    bisects ``b_ends`` for one end, next the middle and then ever further out on either side; a hit divides it.
    """
    cuts = [known]
    first, last = np.concatenate([[0], known[:-1] + 1]), known  # candidates are first <= i < last
    tries = np.zeros(len(first), np.int64)
    while True:
        is_open = tries < last - first
        first, last, tries = first[is_open], last[is_open], tries[is_open]
        if not len(first):
            break
        # Middle, middle + 1, middle - 1, middle + 2, ...: each candidate once.
        middle = (first + last - 1) >> 1
        away = (tries + 1) >> 1
        probe = np.where(tries & 1, middle + away, middle - away)
        ends = a_ends[probe]
        at = np.searchsorted(b_ends, ends)
        hit = b_ends[at] == ends  # the last end of b is no smaller than any of a
        cut = probe[hit]
        cuts.append(cut)
        # What failed around the middle before a hit is left out of both halves: each end is tried once in all.
        middle, tried, right = middle[hit], tries[hit], (tries[hit] & 1).astype(bool)
        first, last, tries = (
            np.concatenate([first[~hit], first[hit], np.where(right, cut + 1, middle + (tried >> 1) + 1)]),
            np.concatenate([last[~hit], np.where(right, middle - ((tried - 1) >> 1), cut), last[hit]]),
            np.concatenate([tries[~hit] + 1, np.zeros(2 * len(cut), np.int64)]),
        )
    return np.sort(np.concatenate(cuts))


class Aligner:
    """Tokenizes and aligns texts in one task."""

    def __init__(self, a_content: bytes, b_content: bytes, pairs: np.ndarray):
        self.a, self.b = ByteLevel(a_content), Pieces(b_content)
        self.pairs = Pairs.__new__(Pairs)
        self.pairs.keys = pairs
        self.sizes = [np.array(list(map(len, v.tokens)), np.int64) for v in (self.a, self.b)]
        # Decimal ids followed by their separator: within a side, after the side, after the group.
        self.names = [
            np.array([f"{i}{sign}".encode() for sign in signs for i in range(len(v.tokens))], object)
            for v, signs in ((self.a, ",|"), (self.b, ",;"))
        ]

    def tokens(self, text: str, b_ids: list[int]) -> tuple[list[int], list[int]] | None:
        """Ids of both sides; None if they do not give back a blank and the text."""
        whole = " " + text
        data = whole.encode()
        a_ids = self.a.encode(whole)
        a, b = self.a.tokens, self.b.tokens
        same = b"".join([a[i] for i in a_ids]) == data == b"".join([b[i] for i in b_ids])
        return (a_ids, b_ids) if same else None

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """Per text n_a, n_b, n_groups, groups_sha256 and its links."""
        out: list = [(0, 0, 0, "", np.empty(0, np.int32))] * len(texts)
        filled = [i for i, t in enumerate(texts) if t]
        a_flat, b_flat, spans = [], [], []
        for i, b_ids in zip(filled, self.b.encode([texts[i] for i in filled])):
            ids = self.tokens(texts[i], b_ids)
            if ids:
                a_flat += ids[0]
                b_flat += ids[1]
                spans.append((i, len(a_flat), len(b_flat)))
        if not spans:
            return out
        a_ids, b_ids = np.array(a_flat, np.int64), np.array(b_flat, np.int64)
        a_ends, b_ends = np.cumsum(self.sizes[0][a_ids]), np.cumsum(self.sizes[1][b_ids])
        a_cuts = shared_cuts(a_ends, b_ends, np.array([a for _, a, _ in spans]) - 1)
        b_cuts = np.searchsorted(b_ends, a_ends[a_cuts])
        links = self.pairs.of(a_ids[a_cuts], b_ids[b_cuts])
        # Tokens in order of groups, first the a side: a token moves by the tokens of the other side before it.
        a_last, b_last = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        a_last[a_cuts] = b_last[b_cuts] = 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        words = np.empty(len(a_ids) + len(b_ids), object)
        words[np.arange(len(a_ids)) + np.concatenate([[0], b_cuts + 1])[a_group]] = self.names[0][a_ids + a_last * len(self.sizes[0])]
        words[np.arange(len(b_ids)) + a_cuts[b_group] + 1] = self.names[1][b_ids + b_last * len(self.sizes[1])]
        listed = words.tolist()
        a_from = b_from = g_from = 0
        for i, a_to, b_to in spans:
            g_to = int(np.searchsorted(a_cuts, a_to))
            groups = b"".join(listed[a_from + b_from : a_to + b_to])[:-1]
            out[i] = (a_to - a_from, b_to - b_from, g_to - g_from, hashlib.sha256(groups).hexdigest(), links[g_from:g_to])
            a_from, b_from, g_from = a_to, b_to, g_to
        return out


_IN_PROCESS: dict[str, Aligner] = {}


def _steps(texts: list[str | None]) -> Iterator[slice]:
    """Ranges of texts of about STEP_BYTES."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= STEP_BYTES:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """One pass over the texts: doc_id, n_a, n_b, n_groups, groups_sha256, links (indices of pairs); and the pairs' keys."""
    contents = Path(a_path).read_bytes(), Path(b_path).read_bytes()
    keys = Pairs(ByteLevel(contents[0]).tokens, Pieces(contents[1]).tokens).keys
    name = hashlib.sha256(b"".join(contents)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((*contents, keys))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _IN_PROCESS:
            _IN_PROCESS.clear()
            _IN_PROCESS[name] = Aligner(*shared.value)
        aligner = _IN_PROCESS[name]
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for part in _steps(texts):
                found = aligner.align(texts[part])
                counts = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
                offsets = np.cumsum([0, *(len(f[4]) for f in found)])
                links = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([f[4] for f in found]), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids[part], *counts, pa.array([f[3] for f in found], pa.string()), links],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
                )

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"
    return arrow_pass(narrow(docs, doc_id, text), work, schema), keys


def pair_counts(rows: DataFrame, n_pairs: int) -> DataFrame:
    """link, n: links per pair over all rows; a task sends each pair once at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            links = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(links, minlength=n_pairs)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["link", "n"])

    return rows.select("links").mapInArrow(work, "link int, n long").groupBy("link").agg(F.sum("n").alias("n"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair is linked as often in all documents as any pair with that b id; count_sum adds up
    the counts of the document's links.
    """
    spark = docs.sparkSession
    rows, keys = aligned(docs, a_path, b_path, doc_id, text)
    path = scratch_path(spark, "alignment")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    counted = np.zeros(len(keys), np.int64)
    found = pair_counts(rows, len(keys)).toArrow()  # at most one row per pair of the vocabularies
    counted[found["link"].to_numpy()] = found["n"].to_numpy()
    highest = np.zeros(int((keys & 0xFFFFFFFF).max()) + 1, np.int64)
    np.maximum.at(highest, keys & 0xFFFFFFFF, counted)
    shared = spark.sparkContext.broadcast((counted, counted == highest[keys & 0xFFFFFFFF]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            links = batch.column("links")
            flat = links.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))
            sums = [np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])] for v in (best[flat], count[flat])]
            plain = {n: batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            columns = [*plain.values(), plain["n_groups"], *(pa.array(np.diff(s), pa.int64()) for s in sums)]
            yield pa.RecordBatch.from_arrays(columns, names=[*plain, "n_links", "n_best", "count_sum"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    return arrow_pass(rows, work, schema).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
