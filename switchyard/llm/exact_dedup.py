"""Exact duplicates by Patricia tries over normalised texts.

A map-side trie collapses the copies that one task sees, so a text that fills a third of the table
leaves each task as one row.  The collapsed rows are dealt by text length and content hash; every
reduce task inserts the full byte strings of a (length, hash) slot into a compressed radix trie whose
terminal nodes keep the owner (the row that stays) and the number of copies.  Slots arrive in order, so
a finished subtree is emitted and released, and a trie above its memory budget emits its largest subtree
early (the reduce side merges such parts).  Documents then take their class by content hash.

Defined cases: a null text counts as empty; a null id sorts after every other id; of fully repeated rows
(same id, same text) exactly one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.llm.common import SPACE, arrow_pass, narrow, numbered, partitions, text_bytes

#: Bytes of text that a trie holds before it emits its largest subtree.
TRIE_BYTES = 32 << 20

LAST_ID = (1 << 63) - 1


def normalise(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def shared_prefix(a: bytes, i: int, b: bytes, j: int, limit: int) -> int:
    """Length of the common prefix of ``a[i:]`` and ``b[j:]``, ``limit`` at most."""
    if a[i : i + limit] == b[j : j + limit]:
        return limit
    low, step = 0, 16
    while a[i + low : i + low + step] == b[j + low : j + low + step]:
        low += step
        step *= 2
    high = min(low + step, limit)  # a mismatch lies in [low, high)
    while high - low > 1:
        mid = (low + high) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    """An edge label ``ref[start:end]``, the children by first byte, and the owner if a string ends here."""

    __slots__ = ("ref", "start", "end", "children", "owner")

    def __init__(self, ref: bytes, start: int, end: int):
        self.ref, self.start, self.end = ref, start, end
        self.children: dict[int, Node] = {}
        self.owner: list | None = None  # [-code points, id, copies]


class OwnerTrie:
    """Byte strings with their smallest (-code points, id) and their number of copies."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.budget = budget
        self.root = Node(b"", 0, 0)
        self.held: dict[int, int] = {}  # bytes below each child of the root
        self.total = 0

    def insert(self, key: bytes, points: int, doc_id: int, copies: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key, at, len(key))
                self.held[key[0]] = self.held.get(key[0], 0) + len(key)
                self.total += len(key)
                node, at = child, len(key)
                break
            size = child.end - child.start
            same = shared_prefix(child.ref, child.start, key, at, min(size, len(key) - at))
            if same < size:  # split the edge
                upper = Node(child.ref, child.start, child.start + same)
                child.start += same
                upper.children[child.ref[child.start]] = child
                node.children[key[at]] = upper
                child = upper
            node, at = child, at + same
        mine = (-points, doc_id)
        if node.owner is None:
            node.owner = [*mine, copies]
        else:
            if mine < (node.owner[0], node.owner[1]):
                node.owner[:2] = mine
            node.owner[2] += copies

    def drain(self, top: Node | None = None) -> Iterator[tuple[bytes, int, int, int]]:
        """(string, code points, id, copies) of a subtree, of all by default; it is removed."""
        stack = [(top or self.root, b"")]
        while stack:
            node, before = stack.pop()
            here = before + node.ref[node.start : node.end] if node.children else None
            if node.owner:
                yield (before + node.ref[node.start : node.end], -node.owner[0], node.owner[1], node.owner[2])
            stack.extend((child, here) for child in node.children.values())
        if top is None:
            self.root, self.held, self.total = Node(b"", 0, 0), {}, 0

    def spill(self) -> Iterator[tuple[bytes, int, int, int]]:
        """Emit largest subtrees until half of the budget is free."""
        while self.total > self.budget // 2 and self.held:
            first = max(self.held, key=self.held.get)
            yield from self.drain(self.root.children.pop(first))
            self.total -= self.held.pop(first)


PART = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("points", pa.int64()),
                  ("owner", pa.int64()), ("copies", pa.int64())])
CLASS = pa.schema([("digest", pa.binary()), ("best", pa.int64()), ("owner", pa.int64()), ("copies", pa.int64())])


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _parts(items: Iterator[tuple[bytes, int, int, int]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for body, points, owner, copies in items:
        rows.append((len(body), hashlib.sha256(body).digest(), body, points, owner, copies))
        size += len(body)
        if len(rows) >= 1024 or size >= 4 << 20:
            yield _flush(rows, PART)
            rows, size = [], 0
    if rows:
        yield _flush(rows, PART)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = OwnerTrie()
    for batch in batches:
        points = pc.utf8_length(batch.column("text")).to_pylist()
        for text, n, doc_id in zip(text_bytes(batch), points, batch.column("doc_id").to_pylist()):
            trie.insert(normalise(text), n or 0, LAST_ID if doc_id is None else doc_id)
        if trie.total > trie.budget:
            yield from _parts(trie.spill())
    yield from _parts(trie.drain())


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries over one slot after another; rows come ordered by (length, digest)."""
    trie, slot, out = OwnerTrie(), None, []

    def close() -> None:
        out.extend((slot[1], points, owner, copies) for _, points, owner, copies in trie.drain())

    for batch in batches:
        for length, digest, body, points, owner, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if slot != (length, digest):
                if slot is not None:
                    close()
                slot = (length, digest)
            trie.insert(body, points, owner, copies)
        if len(out) >= 4096:
            yield _flush(out, CLASS)
            out.clear()
    if slot is not None:
        close()
    if out:
        yield _flush(out, CLASS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest = [hashlib.sha256(normalise(t)).digest() for t in text_bytes(batch)]
        points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digest, pa.binary()), points], names=["doc_id", "digest", "points"]
        )


def text_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct normalised text: digest, best (code points), owner (id), copies."""
    spark = docs.sparkSession
    parts = arrow_pass(
        narrow(docs, doc_id, text), _combine,
        "length long, digest binary, body binary, points long, owner long, copies long",
    )
    dealt = parts.repartition(partitions(spark), "length", "digest").sortWithinPartitions("length", "digest")
    return arrow_pass(dealt, _own, "digest binary, best long, owner long, copies long")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too."""
    rows = arrow_pass(narrow(docs, doc_id, text), _digests, "doc_id long, digest binary, points long")
    counted = rows.groupBy("doc_id", "digest", "points").agg(F.count(F.lit(1)).alias("times"))
    joined = counted.join(text_classes(docs, doc_id, text), "digest")
    owner = F.when(F.col("owner") != LAST_ID, F.col("owner"))
    stays = F.col("doc_id").eqNullSafe(owner) & (F.col("points") == F.col("best"))
    classed = joined.select(
        "doc_id", owner.alias("keep_id"), F.col("copies").alias("group_size"), stays.alias("_stays"),
        F.lower(F.hex("digest")).alias("text_sha256"), "times",
    )
    kept = (F.col("_stays") & (F.col("_nth") == 1)).alias("kept")
    return numbered(classed, "times", "_nth").select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def _with_digest(schema: pa.Schema | None = None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = [hashlib.sha256(normalise(t)).digest() for t in text_bytes(batch, "_text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(digest, pa.binary())], names=[*batch.schema.names[:-1], "_digest"]
            )

    return work


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    ids, texts = names[docs.columns.index(doc_id)], names[docs.columns.index(text)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    keyed = arrow_pass(plain.withColumn("_text", F.col(texts).cast("string")), _with_digest(), f"{kinds}, _digest binary")
    classes = text_classes(docs, doc_id, text).toDF("_digest", "_best", "_owner", "_copies")
    points = F.coalesce(F.length(F.col(texts).cast("string")), F.lit(0))
    best = keyed.join(classes, "_digest").where(
        F.coalesce(F.col(ids).cast("long"), F.lit(LAST_ID)).eqNullSafe(F.col("_owner")) & (points == F.col("_best"))
    )
    first = F.row_number().over(W.partitionBy("_digest").orderBy(*names))
    return best.withColumn("_nth", first).where("_nth = 1").select(*names).toDF(*docs.columns)
