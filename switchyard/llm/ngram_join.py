"""Jaccard join of five-word shingle sets over a token-group matrix.

Two documents link when 100 * |intersection| >= 80 * |union|; the result is every document's component.

1. Equal sets become one class (smallest id), so copies cost one row each.
2. A document can only link if 80 % of its shingles occur in another class.  Shingles are counted in
   packed, hash-ranged buckets: a task sends each distinct shingle of a chunk once, with the document it
   belongs to, or a marker if several classes of the chunk have it.  The rest of the corpus drops out here.
3. Similar classes are grouped: classes that agree in a min-hash band meet a leader, likely pairs are
   verified on the full sets, and verified links make groups.
4. The token-group matrix: groups are cut in bounded pieces, and the union of a piece's shingles is held
   against all other groups the same way as in 2.  A piece whose union shares too little with the rest
   cannot hold a partner of anything and stays closed.
5. In what is left, shingles are ordered by how many documents have them; a query meets a piece if they share
   a shingle so early in that order that both still hold enough to link.  The piece bounds the
   overlap by |query & union|, is opened only if that reaches 80 % of the query, and verifies its members.

Steps 2 to 5 only drop pairs that cannot link, whatever the grouping of step 3 finds; shingles are 64-bit
hashes, so equality is up to a hash collision.  Links are never listed beyond one per query and piece.

Defined cases: null and empty texts have no shingles and link with nothing; a null id links with nothing
(component null); rows that repeat an id are one document; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.llm.common import arrow_pass, narrow, partitions, text_bytes
from switchyard.llm.components import components
from switchyard.llm.shingles import common, mix, shingle_sets
from switchyard.session import shared_dir

PERCENT = 80
HASHES, BANDS, ROWS = 16, 5, 3
#: Min-hashes that must agree before a pair is worth a verification, and leaders tried per class.
LIKELY, LEADERS = 9, 2
CHUNK, BUCKET = 2_000_000, 1_000_000
PIECE, ASKERS = 256, 512
_SALTS = np.random.default_rng(31).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def links(both: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return both > 0 and 100 * both >= percent * (a + b - both)


def reach(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of ``n`` must share with any partner."""
    return -(-percent * n // 100)


def min_hashes(found: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([(found * s).min() for s in _SALTS], np.uint64)


def band_keys(least: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[r * BANDS : (r + 1) * BANDS])
    return keys.view(np.int64).tolist()


def _signature(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _owner(signature: bytes) -> int:
    return int.from_bytes(signature[:8], "little", signed=True)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, found in zip(batch.column("doc_id").to_pylist(), shingle_sets(text_bytes(batch))):
            if len(found) and doc_id is not None:
                least = min_hashes(found)
                short = (least >> np.uint64(48)).astype(np.uint16).astype(np.int16).tolist()
                sig = _signature(found)
                rows.append((doc_id, len(found), sig, _owner(sig), band_keys(least), short))
            else:
                rows.append((doc_id, len(found), None, None, None, None))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int16())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n", "sig", "doc", "bands", "least"]
        )


class Packer:
    """Sets of a chunk, sent as one packed row per bucket.

    A row holds the shingles of the bucket as differences, the place of each one's document in ``docs``
    (0xFFFF: several owners in this chunk), and the documents and owners.  Row -1 has what the chunk
    could count by itself.
    """

    NAMES = ["bucket", "tokens", "place", "docs", "owners", "counts"]
    KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    SCHEMA = "bucket int, tokens binary, place binary, docs binary, owners binary, counts binary"
    MARK = 0xFFFF

    def __init__(self, bits: int, buckets: int):
        self.shift, self.buckets, self.bits = np.uint64(64 - bits), buckets, bits
        self.clear()

    def clear(self) -> None:
        self.sets, self.docs, self.owners, self.size = [], [], [], 0

    def add(self, doc: int, owner: int, found: np.ndarray) -> bool:
        """True when the chunk is full."""
        self.sets.append(found >> self.shift)
        self.docs.append(doc)
        self.owners.append(owner)
        self.size += len(found)
        return self.size >= CHUNK or len(self.docs) >= self.MARK

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        sizes = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        docs, owners = np.array(self.docs, np.int64), np.array(self.owners, np.int64)
        tokens, place = np.concatenate(self.sets), np.repeat(np.arange(len(docs)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, place = tokens[order], place[order]
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        starts = np.flatnonzero(new)
        mine = owners[place]
        several = np.minimum.reduceat(mine, starts) != np.maximum.reduceat(mine, starts)
        run = np.cumsum(new) - 1
        local = np.bincount(place[several[run]], minlength=len(docs))
        sent = ~several[run] | new
        place = np.where(several[run], self.MARK, place)[sent].astype(np.uint16)
        tokens = tokens[sent]
        edges = [-(-(b << self.bits) // self.buckets) for b in range(1, self.buckets)]
        cuts = [0, *np.searchsorted(tokens, np.array(edges, np.uint64)).tolist(), len(tokens)]
        out = [(-1, b"", b"", docs.tobytes(), owners.tobytes(), local.astype(np.int64).tobytes())]
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                here, spot = tokens[i:j], place[i:j]
                used, again = np.unique(spot[spot != self.MARK], return_inverse=True)
                local_place = spot.copy()
                local_place[spot != self.MARK] = again.astype(np.uint16)
                gaps = np.diff(here, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()
                out.append((b, gaps.tobytes(), local_place.tobytes(), docs[used].tobytes(), owners[used].tobytes(), b""))
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out[i : i + 64]), self.KINDS)], names=self.NAMES
            )
        self.clear()


PARTIAL = "part int, docs binary, shared binary"


def _tally(table: pa.Table, parts: int) -> pa.Table:
    """Of one bucket: how many shingles of each document another owner has too, packed by part of the documents."""
    tokens, docs, owners, marks = [], [], [], []
    total: dict[str, list[np.ndarray]] = {"doc": [], "shared": []}
    for bucket, gaps, place, d, o, counts in zip(*(table.column(c).to_pylist() for c in Packer.NAMES)):
        d, o = np.frombuffer(d, np.int64), np.frombuffer(o, np.int64)
        if bucket < 0:
            total["doc"].append(d)
            total["shared"].append(np.frombuffer(counts, np.int64))
            continue
        planes = np.frombuffer(gaps, np.uint8).reshape(8, -1)
        tokens.append(np.cumsum(planes.T.copy().view(np.uint64).ravel(), dtype=np.uint64))
        spot = np.frombuffer(place, np.uint16)
        mark = spot == Packer.MARK
        spot = np.where(mark, 0, spot)
        docs.append(d[spot] if len(d) else np.zeros(len(spot), np.int64))
        owners.append(o[spot] if len(o) else np.zeros(len(spot), np.int64))
        marks.append(mark)
    if tokens:
        t, d, o, m = map(np.concatenate, (tokens, docs, owners, marks))
        order = np.argsort(t, kind="stable")
        t, d, o, m = t[order], d[order], o[order], m[order]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        starts = np.flatnonzero(new)
        shared = (np.minimum.reduceat(o, starts) != np.maximum.reduceat(o, starts)) | np.logical_or.reduceat(m, starts)
        keep = shared[np.cumsum(new) - 1] & ~m
        who, count = np.unique(d[keep], return_counts=True)
        total["doc"].append(who)
        total["shared"].append(count)
    doc, shared = _summed(total["doc"], total["shared"])
    part = (doc.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    doc, shared, part = doc[order], shared[order], part[order]
    found, at = np.unique(part, return_index=True)
    ends = [*at[1:].tolist(), len(part)]
    rows = [(doc[i:j].tobytes(), shared[i:j].tobytes()) for i, j in zip(at.tolist(), ends)]
    return pa.table({"part": found, "docs": pa.array([r[0] for r in rows], pa.binary()), "shared": pa.array([r[1] for r in rows], pa.binary())})


def _summed(docs: list[np.ndarray], shared: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, at = np.unique(np.concatenate(docs), return_inverse=True)
    total = np.zeros(len(doc), np.int64)
    np.add.at(total, at, np.concatenate(shared))
    return doc, total


def _gather(table: pa.Table) -> pa.Table:
    """The totals of one part of the documents over all buckets."""
    docs, shared = ([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()] for c in ("docs", "shared"))
    doc, total = _summed(docs, shared)
    return pa.table({"doc": doc, "shared": total})


def shared_shingles(rows: DataFrame, packed: Callable[[Packer], Callable], shingles: int) -> DataFrame:
    """doc, shared: an upper bound of the shingles that another owner has, for documents with any.

    Shingles are cut to so many bits that a hundredth of them or fewer seem shared by chance.
    """
    bits = min(64, max(32, shingles.bit_length() + 7))
    buckets = max(partitions(rows.sparkSession), -(-shingles // BUCKET))
    sent = arrow_pass(rows, packed(Packer(bits, buckets)), Packer.SCHEMA)
    partial = sent.groupBy("bucket").applyInArrow(lambda table: _tally(table, buckets), PARTIAL)
    return partial.groupBy("part").applyInArrow(_gather, "doc long, shared long")


def _pack_texts(packer: Packer):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer.clear()
        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), shingle_sets(text_bytes(batch))):
                if len(found) and doc_id is not None:
                    owner = _owner(_signature(found))
                    if packer.add(owner, owner, found):
                        yield from packer.rows()
        yield from packer.rows()

    return work


def _pack_pieces(packer: Packer):
    """Unions of pieces; rows come ordered by piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer.clear()
        held, at, owner = [], None, None

        def union() -> np.ndarray:
            return np.unique(np.concatenate(held)) if len(held) > 1 else held[0]

        for batch in batches:
            for piece, group, tokens in zip(*(batch.column(c).to_pylist() for c in ("piece", "component", "tokens"))):
                if at is not None and piece != at:
                    full = packer.add(at, owner, union())
                    held.clear()
                    if full:
                        yield from packer.rows()
                at, owner = piece, group
                held.append(np.frombuffer(tokens, np.uint64))
        if at is not None:
            packer.add(at, owner, union())
        yield from packer.rows()

    return work


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, tokens = [], []
        for i, (found, sig) in enumerate(zip(shingle_sets(text_bytes(batch)), batch.column("sig").to_pylist())):
            if len(found) and _signature(found) == sig:
                keep.append(i)
                tokens.append(found.tobytes())
        out = batch.select(["rep", "n"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(tokens, pa.binary())], names=["rep", "n", "tokens"])


def _verify(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("a_tokens", "b_tokens"))
            ok = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(links(common(x, y), len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return work


def likely_pairs(classes: DataFrame) -> DataFrame:
    """a, b: each class with its likeliest leaders, the smallest classes of its min-hash bands."""
    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    leaders = banded.groupBy("band", "key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size"))
    met = banded.join(leaders.where("size > 1"), ["band", "key"]).where("rep <> leader").select("rep", "leader").distinct()
    a, b = classes.select("rep", "least"), classes.select(F.col("rep").alias("leader"), F.col("least").alias("other"))
    agree = F.size(F.filter(F.zip_with("least", "other", lambda x, y: x == y), lambda same: same))
    scored = met.join(a, "rep").join(b, "leader").select("rep", "leader", agree.alias("agree")).where(F.col("agree") >= LIKELY)
    nth = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("agree"), "leader"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= LEADERS).select(F.col("rep").alias("a"), F.col("leader").alias("b"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    first = pairs.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("a_tokens")), "a")
    both = first.join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("b_tokens")), "b")
    return arrow_pass(both.select("a", "b", "a_tokens", "b_tokens"), _verify(percent), "a long, b long")


def _open_pieces(percent: int):
    """Of one piece and a block of its queries: one link per query, if it has any."""

    def work(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        reps, asks = table.column("rep").to_pylist(), table.column("asks").to_pylist()
        members = [i for i, q in enumerate(asks) if not q]
        a, b = [], []
        if members:
            union = np.unique(np.concatenate([sets[i] for i in members]))
            for q in (i for i, asking in enumerate(asks) if asking):
                n = len(sets[q])
                if common(sets[q], union) < reach(n, percent):
                    continue  # the piece stays closed
                partner = next((m for m in members if links(common(sets[q], sets[m]), n, len(sets[m]), percent)), None)
                if partner is not None:
                    a.append(reps[q])
                    b.append(reps[partner])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work


def _spread_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(t, np.int64) for t in batch.column("tokens").to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        narrow_part = batch.select(["rep", "component", "piece", "n"]).take(pa.array(np.repeat(np.arange(len(sets)), sizes)))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        whole = pa.RecordBatch.from_arrays([*narrow_part.columns, pa.array(flat)], names=["rep", "component", "piece", "n", "token"])
        for at in range(0, len(whole), 65536):
            yield whole.slice(at, 65536)


def open_links(held: DataFrame, percent: int) -> DataFrame:
    """a, b: verified links between groups; ``held`` has rep, component, piece, n, tokens of what may link."""
    tokens = arrow_pass(held, _spread_tokens, "rep long, component long, piece long, n long, token long")
    stats = tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), (F.min("component") != F.max("component")).alias("across")
    )
    order = W.partitionBy("rep").orderBy(F.when(F.col("across"), F.col("df")).otherwise(F.lit(0)), "token")
    rarest = (
        tokens.join(stats, "token").withColumn("nth", F.row_number().over(order))
        .where(F.col("across") & (F.col("nth") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
        .select("rep", "component", "piece", "n", "token", (F.col("n") - F.col("nth") + 1).alias("left")).checkpoint()
    )
    groups = rarest.groupBy("token", F.col("component").alias("_group"), F.col("piece").alias("_piece")).agg(
        F.min("n").alias("_least"), F.max("n").alias("_most"), F.max("left").alias("_left")
    )
    # From this shingle on both must still hold what two sets of their sizes need in common.
    possible = (
        f"component > _group AND {percent} * n <= 100 * _most AND {percent} * _least <= 100 * n"
        f" AND least(left, _left) * {100 + percent} >= {percent} * (n + _least)"
    )
    asked = (
        rarest.join(groups, "token").where(possible)
        .select("rep", F.col("_piece").alias("piece")).distinct().checkpoint()
    )
    pieces = asked.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("blocks"))
    sets = held.select("rep", "tokens")
    members = held.select("rep", "piece", "tokens").join(pieces, "piece").select(
        "piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "tokens", F.lit(False).alias("asks")
    )
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    askers = asked.join(pieces, "piece").join(sets, "rep").select(
        "piece", block.alias("block"), "rep", "tokens", F.lit(True).alias("asks")
    )
    return members.unionByName(askers).groupBy("piece", "block").applyInArrow(_open_pieces(percent), "a long, b long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    spark = docs.sparkSession
    shared_dir(spark)
    plain = narrow(docs, doc_id, text)
    rows = arrow_pass(plain, _describe, "doc_id long, n long, sig binary, doc long, bands array<long>, least array<short>").checkpoint()
    classes = rows.where("sig is not null").groupBy("sig", "doc", "n").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("least").alias("least")
    ).checkpoint()
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    able = (
        classes.join(shared_shingles(plain, _pack_texts, shingles), "doc")
        .where(f"100 * shared >= {percent} * n").select("rep", "n", "sig", "bands", "least").checkpoint()
    )
    texts = plain.join(able.select(F.col("rep").alias("doc_id"), F.col("rep"), "n", "sig"), "doc_id")
    sets = arrow_pass(texts.select("rep", "n", "sig", "text"), _sets_of, "rep long, n long, tokens binary").checkpoint()
    found = components(verified(likely_pairs(able), sets, percent)).checkpoint()
    grouped = sets.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    sizes = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("long").alias("pieces"))
    pieced = grouped.join(sizes, "component", "left").withColumn(
        "piece", F.xxhash64("component", F.pmod(F.xxhash64("rep"), F.coalesce("pieces", F.lit(1))))
    ).select("rep", "n", "component", "piece", "tokens").checkpoint()
    within = pieced.agg(F.sum("n")).first()[0] or 0
    ordered = pieced.select("piece", "component", "tokens").repartition(partitions(spark), "piece").sortWithinPartitions("piece")
    sharing = shared_shingles(ordered, _pack_pieces, within).withColumnRenamed("doc", "piece")
    least_n = pieced.groupBy("piece").agg(F.min("n").alias("least_n"))
    opening = sharing.join(least_n, "piece").where(f"100 * shared >= {percent} * least_n").select("piece")
    held = pieced.join(opening, "piece", "left_semi").checkpoint()
    group_of = pieced.select("rep", "component")
    more = (
        open_links(held, percent)
        .join(group_of.select(F.col("rep").alias("a"), F.col("component").alias("ga")), "a")
        .join(group_of.select(F.col("rep").alias("b"), F.col("component").alias("gb")), "b").select("ga", "gb")
    )
    merged = components(more, "ga", "gb")
    final = (
        group_of.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_top")), "component", "left")
        .select("rep", F.coalesce("_top", "component").alias("component"))
    )
    named = classes.select("sig", "rep").join(final, "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    return rows.select("doc_id", "n", "sig").join(named, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
