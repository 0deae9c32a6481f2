"""Near-duplicate vectors by counting collisions of one-dimensional projections.

1. Equal vectors of a label become one, with the smallest id and a multiplicity.
2. Vectors are dealt to cells: bit t of a cell says on which side of the label's median projection t lies; a
   label has as many bits as its size needs.  A vector is at home in one cell and, as a query, visits
   every cell that its window around the projections reaches, so each partner is met exactly once.
3. In a cell all projections are sorted; a query's window is a rank interval in each, and the intervals that
   hold a pair are counted.  Pairs with at least the calibrated count are verified by cosine in double
   precision: none below the threshold links.
4. A cell returns link counts and the root of each of its vectors, never pairs; roots are joined by
   ``components``.  Large cells are cut in blocks of members and queries, all combinations of which are met.

The window and the count follow from the threshold: a pair at cosine t differs by N(0, 2 - 2t) in a Gaussian
projection, ``REACH`` deviations wide windows miss it seldom, and the count is the largest that a pair at the
threshold reaches with probability ``RECALL``.

Defined cases: vectors that are null, zero or hold null or non-finite components, null labels and null ids
link with nothing (0 links, a component of their own); vectors of different lengths never link; repeated rows
link with each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import arrow_pass
from switchyard.llm.components import components
from switchyard.session import shared_dir

THRESHOLD = 0.93
PROJECTIONS = 24
REACH = 2.5
RECALL = 0.9995
#: Vectors that a cell should hold, bits at most, and the blocks of a larger cell.
CELL, MOST_BITS = 1024, 16
MEMBERS, QUERIES = 2048, 8192
SEED = 11


def directions(dim: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, PROJECTIONS))


def window(threshold: float) -> float:
    return REACH * math.sqrt(max(0.0, 2 - 2 * threshold))


def least_count(recall: float = RECALL) -> int:
    """Collisions that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(REACH / math.sqrt(2))
    tail = 0.0
    for k in range(PROJECTIONS, -1, -1):
        tail += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if tail >= recall:
            return k
    return 0


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    rows = flat.astype(np.float64).reshape(-1, dim)
    largest = np.abs(rows).max(axis=1)
    odd = (largest > 1e140) | (largest < 1e-140)  # their squares leave the range of doubles
    rows[odd] /= largest[odd, None]
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False), dim)


class Roots:
    """Union-find over the places of one block, small root wins."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist()):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def block_links(
    ids: np.ndarray, queries: np.ndarray, members: np.ndarray, q_ids: np.ndarray, m_ids: np.ndarray,
    weight: np.ndarray, threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of every query among the members, and the root id of each of ``ids`` (sorted)."""
    wide, least = window(threshold), least_count()
    aim = directions(queries.shape[1])
    pq, pm = queries @ aim, members @ aim
    order = np.argsort(pm, axis=0)
    lines = np.take_along_axis(pm, order, axis=0)
    ranks = np.empty_like(order, dtype=np.uint16)
    np.put_along_axis(ranks, order, np.broadcast_to(np.arange(len(pm), dtype=np.uint16)[:, None], order.shape), axis=0)
    low = np.stack([np.searchsorted(lines[:, j], pq[:, j] - wide, "left") for j in range(PROJECTIONS)], axis=1)
    high = np.stack([np.searchsorted(lines[:, j], pq[:, j] + wide, "right") for j in range(PROJECTIONS)], axis=1)
    low, high = low.astype(np.uint16), high.astype(np.uint16)
    links, roots = np.zeros(len(queries), np.int64), Roots(len(ids))
    q_at, m_at = np.searchsorted(ids, q_ids), np.searchsorted(ids, m_ids)
    for at in range(0, len(queries), 256):
        rows = slice(at, at + 256)
        count = np.zeros((len(queries[rows]), len(members)), np.uint8)
        for j in range(PROJECTIONS):
            r = ranks[:, j]
            count += (r >= low[rows, j, None]) & (r < high[rows, j, None])
        passed = count >= least
        if passed.mean() > 0.05:
            linked = passed & (queries[rows] @ members.T >= threshold)
        else:
            i, j = np.nonzero(passed)
            linked = np.zeros_like(passed)
            linked[i, j] = np.einsum("ij,ij->i", queries[rows][i], members[j]) >= threshold
        linked &= q_ids[rows, None] != m_ids
        links[rows] = linked @ weight
        # A star per query, then a star per member, then what is still apart.
        some = np.flatnonzero(linked.any(axis=1))
        roots.join(q_at[rows][some], m_at[linked[some].argmax(axis=1)])
        some = np.flatnonzero(linked.any(axis=0))
        roots.join(q_at[rows][linked[:, some].argmax(axis=0)], m_at[some])
        label = roots.labels()
        i, j = np.nonzero(linked)
        a, b = label[q_at[rows][i]], label[m_at[j]]
        apart = np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0)
        roots.join(apart[:, 0], apart[:, 1])
    return links, ids[roots.labels()]


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """label, vec, rep (smallest id), times of the vectors that can link."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
        & F.exists("vec", lambda x: x != 0)
    )
    return usable.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"))


def visits(distinct: DataFrame, threshold: float) -> DataFrame:
    """One row per vector and cell that it visits, ``home`` in its own cell."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(batch), MOST_BITS))
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == dim)
                out[some] = (matrix(batch.column("vec").take(pa.array(some)), dim) @ directions(dim))[:, :MOST_BITS]
            spots = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), MOST_BITS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, spots], names=[*batch.schema.names, "spots"])

    plain = distinct.select("label", F.size("vec").alias("dim"), "rep", "times", "vec")
    kind = plain.schema["label"].dataType.simpleString()
    vec = plain.schema["vec"].dataType.simpleString()
    spotted = arrow_pass(plain, project, f"label {kind}, dim int, rep long, times long, vec {vec}, spots array<double>")
    group = ["label", "dim"]
    cuts = spotted.groupBy(*group).agg(
        F.array(*[F.percentile_approx(F.col("spots")[t], 0.5, 1000) for t in range(MOST_BITS)]).alias("cuts"),
        F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / CELL)))).cast("int").alias("bits"),
    )
    wide = window(threshold)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes, homes = [], [], []
            for i, (spots, cut, bits) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("spots", "cuts", "bits")))):
                reached = [0]
                home = 0
                for t in range(bits):
                    side = spots[t] > cut[t]
                    home |= side << t
                    if abs(spots[t] - cut[t]) <= wide:
                        reached += [c | 1 << t for c in reached]
                    elif side:
                        reached = [c | 1 << t for c in reached]
                at += [i] * len(reached)
                codes += reached
                homes += [c == home for c in reached]
            out = batch.select(["label", "dim", "rep", "times", "vec"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(codes, pa.int32()), pa.array(homes, pa.bool_())], names=[*out.schema.names, "code", "home"]
            )

    joined = spotted.join(cuts, group)
    return arrow_pass(joined, route, f"label {kind}, dim int, rep long, times long, vec {vec}, code int, home boolean")


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    shared_dir(vectors.sparkSession)
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("vec"), F.col(f"`{label}`").alias("label")
    )
    distinct = distinct_vectors(rows).checkpoint()
    seen = visits(distinct, threshold).checkpoint()
    cell = ["label", "dim", "code"]
    cells = seen.groupBy(*cell).agg(
        F.ceil(F.count_if("home") / MEMBERS).cast("int").alias("m_blocks"),
        F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q_blocks"),
    ).where("m_blocks > 0")
    placed = seen.join(cells, cell)
    own_m = F.pmod(F.xxhash64("rep"), F.col("m_blocks")).cast("int")
    own_q = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("q_blocks")).cast("int")
    keep = [*cell, "rep", "times", "vec"]
    asked = placed.select(*keep, F.lit(False).alias("member"), own_q.alias("q"), F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("m"))
    held = placed.where("home").select(*keep, F.lit(True).alias("member"), own_m.alias("m"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"))

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table.column("dim")[0].as_py()
        ids, member = table.column("rep").to_numpy(), table.column("member").to_numpy(zero_copy_only=False)
        both = matrix(table.column("vec").combine_chunks(), dim)
        times, known = table.column("times").to_numpy(), np.unique(ids)
        if not member.any() or member.all():
            return pa.table({"rep": known, "links": np.zeros(len(known), np.int64), "root": known})
        links, roots = block_links(known, both[~member], both[member], ids[~member], ids[member], times[member], threshold)
        total = np.zeros(len(known), np.int64)
        total[np.searchsorted(known, ids[~member])] = links
        return pa.table({"rep": known, "links": total, "root": roots})

    counted = (
        asked.unionByName(held).groupBy(*cell, "m", "q").applyInArrow(count, "rep long, links long, root long").checkpoint()
    )
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = components(counted.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    reps = distinct.join(links, "rep", "left").join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    linkable = F.col("vec_id").isNotNull()
    out = rows.join(reps, ["label", "vec"], "left").select(
        "vec_id", F.when(linkable, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linkable, F.coalesce("component", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
