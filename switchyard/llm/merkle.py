"""Merkle manifest of a dataset by incremental witnesses.

Every row is a leaf: the SHA-256 of its fields, each ``-`` if null, else byte count, ``:``, value.  Leaves of one
source ascend by id and form a tree of runs of three; the roots of all sources form a tree in the same way.

Leaves are appended to a :class:`Subtree` in order.  Each open run keeps its nodes and the leaves below them; a leaf's
witness (its siblings, level by level) is partial until a run closes, which extends the witnesses of everything
below by one level.  Work is cut at places where runs of every lower level end: a block is ``3 ** LEVELS``
consecutive leaves of a source, one task appends it as a stream and holds one block.  The roots of blocks are then
appended as the leaves of a further round, and so on until every source has one node; a leaf's witness is the
concatenation of the witnesses of its block, of the block's block and of its source.  A source that holds most rows is
many blocks.  Positions come from a range partitioning by (source, id, leaf, place), counted per part: no task sorts a
source, and rows that repeat everything still spread.

A witness is one binary value: per level one byte (siblings to the left times 16, plus those to the right) and their
digests, 32 bytes each.  ``fold`` recomputes a root from any leaf and a witness.

Defined cases: null fields are part of the leaf; null ids come first and are never counted as tampered by the query; a
null source is a tree of its own and comes first; rows that share source and id are ordered by leaf; repeated rows
are leaves of their own; a source with one row has that leaf as its root; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.llm.common import partitions
from switchyard.plans.sizing import broadcast_within
from switchyard.session import shared_dir

ARITY = 3
#: Levels of a block, so 729 leaves; what a task holds of its input at a time.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(nodes: Sequence[bytes]) -> bytes:
    """The node above a run: SHA-256 of its nodes in hexadecimal, one after another."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def leaf(values: Sequence[Column]) -> Column:
    """The leaf of a row as binary."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def depth(size: int) -> int:
    """Levels above ``size`` leaves."""
    levels = 0
    while ARITY**levels < size:
        levels += 1
    return levels


class Subtree:
    """Appends leaves to a tree of a known height; ``witnesses`` grow as runs close, ``top`` is there in the end."""

    def __init__(self, levels: int):
        self.levels, self.top = levels, None
        self.witnesses: list[bytearray] = []
        self.runs: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels)]

    def append(self, node: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append(bytearray())
        self._add(0, node, at, at + 1)

    def finish(self) -> None:
        """Close every open run, even of one node."""
        for level, run in enumerate(self.runs):
            if run:
                self._close(level)

    def _add(self, level: int, node: bytes, first: int, end: int) -> None:
        if level == self.levels:
            self.top = node
            return
        run = self.runs[level]
        run.append((node, first, end))
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        nodes = [n for n, _, _ in self.runs[level]]
        spans = [(first, end) for _, first, end in self.runs[level]]
        self.runs[level].clear()
        for k, (first, end) in enumerate(spans):
            step = bytes([k << 4 | len(nodes) - 1 - k]) + b"".join(nodes[:k] + nodes[k + 1 :])
            for i in range(first, end):
                self.witnesses[i] += step
        self._add(level + 1, digest(nodes), spans[0][0], spans[-1][1])


def steps(witness: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Per level the digests to the left and to the right."""
    at = 0
    while at < len(witness):
        left, right = witness[at] >> 4, witness[at] & 15
        middle, end = at + 1 + 32 * left, at + 1 + 32 * (left + right)
        yield witness[at + 1 : middle], witness[middle:end]
        at = end


def fold(node: bytes, witness: bytes) -> bytes:
    for left, right in steps(witness):
        node = digest([left, node, right])
    return node


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each tree inside a sorted part."""
    part, tree, nth = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        local = []
        for t in batch.column("tree").to_pylist():
            nth = nth + 1 if t == tree else 0
            tree = t
            local.append(nth)
        columns = [*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "local"])


def positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (checkpointed, with a ``tree`` that is not null) with pos, from 0 within the tree, and the tree's size."""
    keys = ["tree", *order, "_at"]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = dealt.sortWithinPartitions(*keys).drop("_at").mapInArrow(_place, f"{kinds}, part int, local long").checkpoint()
    counted = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select(
        "tree", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy("tree")).alias("size"),
    )
    joined = placed.join(broadcast_within(offsets), ["tree", "part"])
    return joined.withColumn("pos", F.col("_before") + F.col("local")).drop("part", "local", "_before")


def _append(names: Sequence[str]):
    """Rows sorted by (tree, block, pos) in; the kept columns, tree, block, pos, size, witness and top of their block out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, grown = None, Subtree(0)

        def done(schema: pa.Schema) -> pa.RecordBatch:
            grown.finish()
            columns = [pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*held))]
            columns += [pa.array([bytes(w) for w in grown.witnesses], pa.binary()), pa.array([grown.top] * len(held), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "witness", "top"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(batch.column(n).to_pylist() for n in names), batch.column("node").to_pylist()):
                block = row[:2]
                if block != now:
                    if held:
                        yield done(schema)
                    now, held, grown = block, [], Subtree(min(LEVELS, depth(row[2])))
                held.append(row[:-1])
                grown.append(row[-1])
        if held:
            yield done(schema)

    return work


def append_round(nodes: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """One round over tree, pos, size, node and ``kept``: the witness inside the block and the block's root, ``top``."""
    names = ["tree", "block", "size", "pos", *kept]
    dealt = nodes.withColumn("block", F.floor(F.col("pos") / ARITY**LEVELS).cast("long")).select(*names, "node")
    sorted_ = dealt.repartition(partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "pos")
    kinds = ", ".join(f"`{n}` {sorted_.schema[n].dataType.simpleString()}" for n in names)
    return sorted_.mapInArrow(_append(names), f"{kinds}, witness binary, top binary").checkpoint()


def grow(nodes: DataFrame, kept: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Append all rounds.  Returns the nodes as tree, kept, witness and root, and the roots as tree and root."""
    rounds, finished = [append_round(nodes, kept)], []
    while True:
        first = rounds[-1].where(F.col("pos") % ARITY**LEVELS == 0)
        above = F.ceil(F.col("size") / ARITY**LEVELS).cast("long")
        tops = first.select("tree", F.col("block").alias("pos"), above.alias("size"), F.col("top").alias("node"))
        finished.append(tops.where("size = 1").select("tree", F.col("node").alias("root")))
        more = tops.where("size > 1")
        if more.isEmpty():
            break
        rounds.append(append_round(more))
    upper = None
    for r in reversed(rounds):
        if upper is None:
            upper = r.withColumn("root", F.col("top"))
            continue
        above = upper.select("tree", F.col("pos").alias("block"), F.col("witness").alias("_more"), F.col("root"))
        joined = r.join(broadcast_within(above), ["tree", "block"], "left")
        whole = F.concat("witness", F.coalesce("_more", F.lit(b"")))
        upper = joined.withColumns({"witness": whole, "root": F.coalesce("root", "top")})
    roots = finished[0]
    for f in finished[1:]:
        roots = roots.unionByName(f)
    return upper.select("tree", *kept, "witness", "root"), roots


def manifest(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS,
    presented: Mapping[str, Column] | None = None,
) -> DataFrame:
    """doc_id, source, leaf, presented, witness, subroot, root (digests as binary).

    ``presented`` replaces fields by what a holder shows of the row; its leaf is ``presented`` (the leaf itself without it).
    """
    shared_dir(docs.sparkSession)
    plain = {f: F.col(f"`{f}`") for f in fields}
    shown = {**plain, **(presented or {})}
    same = F.lit(True)
    for f in presented or {}:
        same = same & plain[f].eqNullSafe(shown[f])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("tree"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), leaf(list(plain.values())).alias("node"),
        (F.when(same, F.lit(None)).otherwise(leaf(list(shown.values())))).cast("binary").alias("other"),
    ).checkpoint()
    placed = positions(rows, ["doc_id", "node"]).withColumn("leaf", F.col("node"))
    leaves, subroots = grow(placed, ["doc_id", "leaf", "other"])
    # The roots of the sources are the leaves of one more tree.
    ordered = positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node")).checkpoint(), ["source"])
    sources, _ = grow(ordered.withColumn("subroot", F.col("node")), ["source", "subroot"])
    above = sources.select(F.col("source").alias("tree"), F.col("witness").alias("_more"), "subroot", F.col("root").alias("_root"))
    joined = leaves.join(broadcast_within(above), "tree")
    name = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return joined.select(
        "doc_id", name.alias("source"), "leaf", F.coalesce("other", "leaf").alias("presented"),
        F.concat("witness", "_more").alias("witness"), "subroot", F.col("_root").alias("root"),
    )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        proofs, folded = [], []
        for node, witness in zip(column["presented"], column["witness"]):
            proofs.append(hashlib.sha256(b"".join(l + r for l, r in steps(witness)).hex().encode()).hexdigest())
            folded.append(fold(node, witness))
        hexed = lambda values: pa.array([v.hex() for v in values], pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), hexed(column["leaf"]), hexed(column["subroot"]), hexed(column["root"]),
                pa.array(proofs, pa.string()), hexed(folded), pa.array([f == r for f, r in zip(folded, column["root"])], pa.bool_()),
            ],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def verify(rows: DataFrame) -> DataFrame:
    """Check what is presented against the root, with the rows of :func:`manifest`; digests become hexadecimal text.

    proof_sha256 is the digest of all siblings from the leaf to the root, left to right in each level.
    """
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.select("doc_id", "leaf", "presented", "witness", "subroot", "root").mapInArrow(_verify, schema)
