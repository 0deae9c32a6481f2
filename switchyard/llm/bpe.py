"""Byte-level BPE by speculation: greedy longest-match proposes, pair checks verify, failing words are merged.

A token sequence is what BPE gives for a word exactly if BPE gives back every two neighbours when it
encodes their joined bytes.  So the new words of a batch are cut greedily into longest vocabulary
entries, all their neighbouring pairs are checked at once against a sorted array of known pairs (an
unknown pair is decided once, by merging its own bytes), and only words with a failing pair are merged exactly, all of them one
merge at a time in vectorised form.  Finished words stay in a memo of two bounded generations, so a task pays for a word about
once.

Texts are cut in pieces first: at special tokens, then before every " x" with x not white space (there the
pre-tokenizer always cuts, whatever stands around), and only pieces not seen before meet the pattern.  A piece that is one
word and the word are one entry of the memo.

The vocabulary file is a parameter; it is read from the given path on the driver and shipped to the tasks
(its size is fixed by the file).  Defined cases: a null text counts as empty and gives no ids; an empty
table gives an empty result; repeated rows and other columns are passed over row by row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from switchyard.llm.common import arrow_pass, narrow

#: How a byte-level vocabulary cuts text (fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and words that a generation of a task's memo holds, and pairs that it remembers.
MEMO = 400_000
#: Rank of a pair that is never merged.
NEVER = 1 << 60
#: Longer pieces are not remembered.
MEMO_CHARS = 64
#: Words of at most so many bytes are merged all at once, so many at a time.
SHORT, STEP = 40, 4_000
#: Single words of the pattern when they follow letters.
MARKS = frozenset(".,;:!?")
#: Stands between words and is in none.
STOP = "\u0100"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(odd)) for b in range(256)]


class Vocabulary:
    """Tokens by bytes, merge ranks by id pair, special tokens by text."""

    def __init__(self, path: str):
        content = Path(path).read_bytes()
        self.key = hashlib.sha256(content).hexdigest()
        spec = json.loads(content)
        known = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(known[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: b for b, i in self.ids.items()}
        self.tokens.update({i: s.encode() for s, i in self.special.items()})
        self.merges: dict[int, int] = {}  # left << 32 | right: rank
        made: list[int] = []  # by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[self.ids[left] << 32 | self.ids[right]] = rank
            made.append(self.ids[left + right])
        self.made = np.array(made, np.int64)
        self.single = [self.ids[bytes([b])] for b in range(256)]
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], order  # merges are listed by rank


#: A blank before white space or the end: there the border of a piece is not certain.
ODD = re.compile(r" (?:\s|$)")
BORDER = re.compile(r"(?= \S)")


def key_of(word: str) -> str:
    """Words and pieces as keys of the memo: one leading blank goes, another start is marked by a blank."""
    return word[1:] if word[0] == " " and word[1:2] != " " else " " + word


def text_of(key: str) -> str:
    return key[1:] if key[:1] == " " else " " + key


class Encoder:
    """Encodes and decodes in one task; memo and known pairs grow with what the task meets, up to ``memo``."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        self.v, self.limit = vocabulary, memo
        self.pattern = regex.compile(PATTERN)
        specials = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        # Ids joined by commas, by key; a table of plain strings costs the garbage collector nothing.
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.pairs = np.empty(0, np.int64)  # sorted keys left << 32 | right
        self.fits = np.empty(0, bool)
        self.exact = 0  # words that needed merging
        import ahocorasick  # in tasks only

        self.longest = ahocorasick.Automaton()
        for data, i in vocabulary.ids.items():
            self.longest.add_word(data.decode("latin-1"), i)
        self.longest.make_automaton()
        self.names = {i: str(i) for i in vocabulary.ids.values()}
        self.bytes_of = {str(i): data for i, data in vocabulary.tokens.items()}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NEVER for those that do not merge; a right side of -1 is none."""
        keys = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.v.merge_keys, keys), len(self.v.merge_keys) - 1)
        return np.where((self.v.merge_keys[at] == keys) & (right >= 0), self.v.merge_ranks[at], NEVER)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """The exact merges of short words, all words one merge at a time: best rank first, leftmost of equals."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max()) + 1
        ids = np.full((len(words), width), -1, np.int64)
        ids[np.arange(width) < sizes[:, None]] = np.array(self.v.single, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width), NEVER, np.int64)
        rank[:, :-1] = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        out: list[list[int]] = [[]] * len(words)
        rows, places = np.arange(len(words)), np.arange(width)
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            done = best == NEVER
            if done.any():
                for i, row in zip(rows[done].tolist(), ids[done].tolist()):
                    out[i] = row[: row.index(-1)]
                rows, ids, rank, at, best = rows[~done], ids[~done], rank[~done], at[~done], best[~done]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            # The right one of the pair goes, what follows moves up.
            source = np.minimum(places + (places > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[each, at] = self.v.made[best]
            rank[each, at] = self.ranks(ids[each, at], ids[each, at + 1])
            before = np.flatnonzero(at)
            rank[before, at[before] - 1] = self.ranks(ids[before, at[before] - 1], ids[before, at[before]])
        return out

    def merge_long(self, data: bytes) -> list[int]:
        """The same result for long words, with a heap over linked neighbours instead of passes."""
        merges, ids = self.v.merges, [self.v.single[b] for b in data]
        n = len(ids)
        after, before, live = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        pairs = [a << 32 | b for a, b in zip(ids, ids[1:])]
        heap = [(merges[p], i, p) for i, p in enumerate(pairs) if p in merges]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], live[j] = int(self.v.made[rank]), False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := ids[a] << 32 | ids[b]) in merges:
                    heapq.heappush(heap, (merges[p], a, p))
        return [x for x, alive in zip(ids, live) if alive]

    def of_bytes(self, words: list[bytes]) -> list[list[int]]:
        """What merging makes of the bytes of every word."""
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        out: list[list[int]] = [[]] * len(words)
        for at in range(0, len(short), STEP):
            some = short[at : at + STEP]
            for i, ids in zip(some, self.merge_all([words[i] for i in some])):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self.merge_long(w)
        return out

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words, one after another: token ids, and the word of each."""
        ends = np.cumsum([len(w) + 1 for w in words])
        found = np.fromiter(chain.from_iterable(self.longest.iter_long(STOP.join([w.decode("latin-1") for w in words]))), np.int64).reshape(-1, 2)
        return found[:, 1], np.searchsorted(ends, found[:, 0], "right")

    def learn(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of new words."""
        flat, owner = self.propose(words)
        inside = owner[1:] == owner[:-1]
        keys, of = ((flat[:-1] << 32) | flat[1:])[inside], owner[1:][inside]
        failing: list[int] = []
        if len(keys):
            distinct = np.unique(keys)
            if len(self.pairs) > 2 * self.limit:
                self.pairs, self.fits = np.empty(0, np.int64), np.empty(0, bool)
            at = np.searchsorted(self.pairs, distinct)
            new = distinct[(at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != distinct)] if len(self.pairs) else distinct
            if len(new):
                tokens, both = self.v.tokens, list(zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist()))
                fit = [ids == [*pair] for ids, pair in zip(self.of_bytes([tokens[a] + tokens[b] for a, b in both]), both)]
                at = np.searchsorted(self.pairs, new)
                self.pairs, self.fits = np.insert(self.pairs, at, new), np.insert(self.fits, at, fit)
            failing = np.unique(of[~self.fits[np.searchsorted(self.pairs, keys)]]).tolist()
        cuts, listed = np.searchsorted(owner, np.arange(len(words) + 1)).tolist(), flat.tolist()
        tokens_of = [listed[a:b] for a, b in zip(cuts, cuts[1:])]
        self.exact += len(failing)
        for i, ids in zip(failing, self.of_bytes([words[i] for i in failing])):
            tokens_of[i] = ids
        return tokens_of

    def cut(self, text: str) -> list[str]:
        """Keys of the pieces, at whose borders the pattern always cuts, in order."""
        if ODD.search(text) is None:
            keys = text.split(" ")
            keys[0] = " " + keys[0]
            return keys if len(keys[0]) > 1 else keys[1:]
        return [key_of(p) for p in BORDER.split(text) if p]

    def parts_of(self, key: str) -> list[str]:
        """Keys of the words of a piece."""
        if key.isalpha():
            return [key]
        if key[-1:] in MARKS and key[:-1].isalpha():
            return [key[:-1], " " + key[-1]]
        return [key_of(w) for w in self.pattern.findall(text_of(key))]

    def prepare(self, keys: set[str]) -> list[str]:
        """Bring keys that are not there into the young generation; returns those that are too long to stay."""
        young, old = self.young, self.old
        split: dict[str, list[str]] = {}
        words: set[str] = set()
        for k in keys:
            if k in old:
                young[k] = old[k]
                continue
            found = self.parts_of(k)
            if len(found) > 1:
                split[k] = found
                words.update(found)
            else:
                words.add(k)
        new = []
        for k in words.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                new.append(k)
        if new:
            names = self.names
            for k, ids in zip(new, self.learn([text_of(k).encode() for k in new])):
                young[k] = ",".join([names[t] for t in ids])
        for k, ks in split.items():
            young[k] = ",".join([young[x] for x in ks])
        return [k for k in chain(new, split) if len(k) > MEMO_CHARS]

    def decode(self, joined: str) -> str:
        """The text of ids joined by commas."""
        return b"".join(map(self.bytes_of.__getitem__, joined.split(","))).decode("utf-8", "replace") if joined else ""

    def encode_batch(self, texts: list[str]) -> list[str]:
        """Per text its ids joined by commas."""
        plans = []
        for text in texts:
            if self.special and any(s in text for s in self.v.special):
                plans.append([
                    str(self.v.special[part]) if part in self.v.special else self.cut(part)
                    for part in self.special.split(text) if part
                ])
            else:
                plans.append([self.cut(text)] if text else [])
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        missing: set[str] = set()
        for part in chain.from_iterable(plans):
            if part.__class__ is list:
                missing.update([k for k in part if k not in self.young])
        long, get = self.prepare(missing), self.young.__getitem__
        out = [",".join([",".join(map(get, part)) if part.__class__ is list else part for part in plan]) for plan in plans]
        for k in long:
            del self.young[k]
        return out


_IN_PROCESS: dict[str, Encoder] = {}


def encoder_for(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this Python worker, so that tasks which share a worker share its memo."""
    if vocabulary.key not in _IN_PROCESS:
        _IN_PROCESS.clear()
        _IN_PROCESS[vocabulary.key] = Encoder(vocabulary)
    return _IN_PROCESS[vocabulary.key]


def encode_ids(encoder: Encoder, texts: list[str]) -> list[list[int]]:
    return [[int(i) for i in ids.split(",")] if ids else [] for ids in encoder.encode_batch(texts)]


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    return b"".join(vocabulary.tokens[i] for i in ids).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (with ``ids``) the ids and the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            joined = encoder.encode_batch(texts)
            counts = [j.count(",") + 1 if j else 0 for j in joined]
            decoded = [encoder.decode(j) for j in joined]
            columns = [
                batch.column("doc_id"), pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [
                    pa.array([[int(i) for i in j.split(",")] if j else [] for j in joined], pa.list_(pa.int32())),
                    pa.array(decoded, pa.string()),
                ]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_pass(narrow(docs, doc_id, text), work, schema + (", ids array<int>, decoded string" if ids else ""))
