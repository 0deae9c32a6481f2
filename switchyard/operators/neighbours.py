"""Near-duplicate review: the nearest neighbours of every vector, and the closest pairs of a table.

An exact k-nearest-neighbour join.  Vectors are scaled to length one, so cosine and distance say the same.

1. Copies of a vector are one point that keeps the ``k + 1`` smallest ids; whatever else it has in copies cannot be among
   the nearest ``k`` of any row.
2. Pivots are a bounded sample of the points (one in ``CELL``, ``MAX_PIVOTS`` at most), so dense regions get more of them.
   Every point lives in the cell of its nearest pivot.
3. In its own cell a point fills a heap of its ``k`` nearest; the worst of a full heap is its radius from then on, else the
   radius follows from the least cosine asked for.
4. A point visits another cell only if its distance to the plane between the two pivots, and to the cell's ball, is
   within its radius (triangle inequality), so no neighbour is lost.  Heaps of all visits are merged per point.

How many cells a point visits depends on the data: few where near copies lie in groups, all of them for vectors without any
structure, where every exact method compares all pairs.  Cells are worked through in blocks, and the visitors of a cell are
dealt over parts.  Driver and broadcast hold the pivots and one size per cell.  Cosines are rounded to nine digits before they
are compared; ties go to the smaller id.

Defined cases: vectors that are null, of length zero, or hold null or non-finite components have no neighbours, nor have
null ids; of vectors of different lengths only those of the most frequent length count; an id counts once, with its least
vector; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Above this cosine a row with a neighbour of smaller id is a duplicate; neighbours per row; pairs shown.
DUPLICATE, TOP, CLOSEST = 0.88, 2, 20
#: Points per pivot, and the most pivots that are broadcast.
CELL, MAX_PIVOTS = 4096, 8192
#: Rows of a cell that are compared at a time, visitors of a cell in one part, distances to pivots held at a time.
BLOCK, PART, HELD = 2048, 16384, 2_000_000
#: A vector with more than 1 / HOT of all rows has its rows named by a broadcast.
HOT = 1000
#: Room for rounding in distances; it only adds visits.
SLACK = 1e-6
HEAP = "array<struct<similarity: double, point: bigint>>"


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def members(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (length one), same (a digest of v); one row per id."""
    raw = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    sound = raw.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    # Scaling by the largest component first keeps squares in range.
    sized = sound.withColumn("_m", F.array_max(F.transform("v", F.abs))).where("_m > 0")
    even = sized.select("vec_id", F.transform("v", lambda x: x / F.col("_m")).alias("v"))
    length = even.withColumn("_n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    unit = length.select("vec_id", F.transform("v", lambda x: x / F.col("_n")).alias("v"), F.size("v").alias("_size"))
    common = unit.groupBy("_size").count().orderBy(F.desc("count"), "_size").limit(1).select("_size")
    once = unit.join(F.broadcast(common), "_size", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return once.withColumn("same", F.sha2(F.col("v").cast("string"), 256))


def points(rows: DataFrame, k: int = TOP) -> DataFrame:
    """same, point (smallest id), ids (the k + 1 smallest), v; one row per distinct vector of ``members``."""
    # Numbering within a digest cuts off in the map tasks already: rows beyond k + 1 never move.
    nth = F.row_number().over(W.partitionBy("same").orderBy("vec_id"))
    few = rows.withColumn("_nth", nth).where(F.col("_nth") <= k + 1)
    return few.groupBy("same").agg(
        F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("v", "vec_id").alias("v")
    )


def _pivots(rows: DataFrame, cell: int, most: int) -> np.ndarray:
    """About one point in ``cell`` by hash, ``most`` at most."""
    wanted = min(most, max(1, rows.count() // cell))
    table = rows.orderBy(F.xxhash64("point", F.lit(11)), "point").limit(wanted).select("v").toArrow()
    return _matrix(table["v"].combine_chunks()) if table.num_rows else np.empty((0, 0))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, rows)):
            yield batch.slice(at, max(1, rows))


def _heaps(similarity: np.ndarray, ids: np.ndarray, k: int) -> Iterator[list[tuple[float, int]]]:
    """Per row its k best (similarity, id) of one block; similarities below the row's limit are -inf."""
    if similarity.shape[1] > 4 * k:
        # Everything that ties with the k-th best stays, so ids decide ties exactly.
        worst = np.partition(similarity, -k, axis=1)[:, -k, None]
        similarity = np.where(similarity >= worst, similarity, -np.inf)
    for row in similarity:
        at = np.flatnonzero(row > -np.inf)
        yield sorted(zip((-row[at]).tolist(), ids[at].tolist()))[:k]


def _search(query: np.ndarray, own: np.ndarray, limit: np.ndarray, homes: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
    """The k best of ``homes`` (blocks of ids and vectors) per query, itself left out, with at least ``limit``."""
    best: list[list[tuple[float, int]]] = [[] for _ in own]
    for ids, vectors in homes:
        found = np.round(query @ vectors.T, 9)
        found[(found < limit[:, None]) | (own[:, None] == ids[None, :])] = -np.inf
        for i, heap in enumerate(_heaps(found, ids, k)):
            if heap:
                best[i] = sorted(best[i] + heap)[:k]
    return best


def _blocks(ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(ids), BLOCK):
        yield ids[at : at + BLOCK], vectors[at : at + BLOCK]


def _heap_column(heaps: list[list[tuple[float, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("similarity", pa.float64()), ("point", pa.int64())]))
    return pa.array([[{"similarity": -s, "point": p} for s, p in h] for h in heaps], kind)


def neighbour_heaps(rows: DataFrame, k: int = TOP, least: float = -1.0, cell: int = CELL, most: int = MAX_PIVOTS) -> DataFrame:
    """point, heap: the k nearest other points with cosine ``least`` or more; ``rows`` are checkpointed points."""
    spark = rows.sparkSession
    least = least if least > -1.0 else -2.0  # rounding must not cut off opposites
    pivots = _pivots(rows, cell, most)
    if not len(pivots):
        return spark.createDataFrame([], f"point long, heap {HEAP}")
    shared = spark.sparkContext.broadcast(pivots)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each point's cell and its distance to the pivot."""
        for batch in _slices(batches, HELD // len(shared.value)):
            near = _matrix(batch.column("v")) @ shared.value.T
            at = near.argmax(axis=1)
            far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * near[np.arange(len(at)), at]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("point"), batch.column("v"), pa.array(at.astype(np.int32)), pa.array(far)], names=["point", "v", "cell", "far"]
            )

    homes = rows.select("point", "v").mapInArrow(settle, "point long, v array<double>, cell int, far double").checkpoint()
    balls = homes.groupBy("cell").agg(F.max("far").alias("far")).toArrow()  # one row per pivot
    radius = np.full(len(pivots), -np.inf)
    radius[balls["cell"].to_numpy()] = balls["far"].to_numpy()
    rings = spark.sparkContext.broadcast(radius)
    start = float(np.sqrt(2.0 - 2.0 * max(-1.0, least)))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells that may hold a neighbour within a point's radius, its own cell left out."""
        pivots, radius = shared.value, rings.value
        for batch in _slices(batches, HELD // len(pivots)):
            v, own = _matrix(batch.column("v")), batch.column("cell").to_numpy()
            each, within = np.arange(len(own)), batch.column("within").to_numpy()[:, None] + SLACK
            squared = np.maximum(0.0, 2.0 - 2.0 * (v @ pivots.T))
            apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots[own] @ pivots.T)))
            # Distance to the plane between both pivots; pivots at one place have no plane between them.
            plane = (squared - squared[each, own][:, None]) / np.maximum(2.0 * apart, 1e-9)
            meets = (np.sqrt(squared) - radius[None, :] <= within) & ((plane <= within) | (apart < 1e-6))
            meets[each, own] = False
            for at in range(0, len(pivots), 64):  # a slice of the visits at a time
                who, where = np.nonzero(meets[:, at : at + 64])
                if len(who):
                    taken = batch.take(pa.array(who))
                    cell = pa.array((where + at).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([taken["point"], taken["v"], cell, taken["least"]], names=["point", "v", "cell", "least"])

    def inside(key, table):
        """Heaps of a cell's own points."""
        ids, v = table["point"].to_numpy(), _matrix(table["v"].combine_chunks())
        heaps: list[list[tuple[float, int]]] = []
        for some, vectors in _blocks(ids, v):
            heaps += _search(vectors, some, np.full(len(some), least), _blocks(ids, v), k)
        # A full heap's worst member is all that a visit has to reach; equals may still win by id.
        worst = [-h[-1][0] if len(h) == k else least for h in heaps]
        reach = np.minimum(start, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (np.array(worst) - 1e-9))))
        return pa.table({
            "point": table["point"], "v": table["v"], "cell": table["cell"], "heap": _heap_column(heaps),
            "within": pa.array(reach, pa.float64()), "least": pa.array(worst, pa.float64()),
        })

    local = homes.groupBy("cell").applyInArrow(
        inside, f"point long, v array<double>, cell int, heap {HEAP}, within double, least double"
    ).checkpoint()
    asked = local.select("point", "v", "cell", "within", "least").mapInArrow(visits, "point long, v array<double>, cell int, least double")

    def outside(key, visitors, residents):
        ids, v = residents["point"].to_numpy(), _matrix(residents["v"].combine_chunks())
        own, query = visitors["point"].to_numpy(), _matrix(visitors["v"].combine_chunks())
        limit = visitors["least"].to_numpy()
        heaps: list[list[tuple[float, int]]] = []
        for at in range(0, len(own), BLOCK):
            part = slice(at, at + BLOCK)
            heaps += _search(query[part], own[part], limit[part], _blocks(ids, v), k)
        kept = [i for i, h in enumerate(heaps) if h]
        return pa.table({"point": pa.array(own[kept], pa.int64()), "heap": _heap_column([heaps[i] for i in kept])})

    # A cell with many visitors is copied once per part of them.
    asked = asked.checkpoint()
    counted = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # one row per pivot
    dealt = asked.join(F.broadcast(counted), "cell").withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))
    copies = homes.join(F.broadcast(counted), "cell").select("point", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    visited = dealt.groupBy("cell", "part").cogroup(copies.groupBy("cell", "part")).applyInArrow(outside, f"point long, heap {HEAP}")
    return local.select("point", "heap").unionByName(visited)


def nearest(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = TOP, least: float = -1.0,
    duplicate: float = DUPLICATE, cell: int = CELL, most: int = MAX_PIVOTS,
) -> DataFrame:
    """vec_id, rank, neighbour, similarity, decision: the k nearest other rows with cosine ``least`` or more.

    ``decision`` is ``duplicate`` where the similarity is above ``duplicate`` and the neighbour has the smaller id, else ``keep``.
    """
    shared_dir(vectors.sparkSession)
    every = members(vectors, vec_id, embedding).checkpoint()
    rows = points(every, k).checkpoint()
    near = neighbour_heaps(rows.select("point", "v"), k, least, cell, most).select("point", F.inline("heap").alias("similarity", "other"))
    found = near.join(rows.select(F.col("point").alias("other"), "ids"), "other").select("point", "similarity", F.explode("ids").alias("neighbour"))
    own = rows.select("point", F.lit(1.0).alias("similarity"), F.explode("ids").alias("neighbour"))
    # k candidates and the row itself are enough for every copy of the point.
    order = W.partitionBy("point").orderBy(F.desc("similarity"), "neighbour")
    best = found.unionByName(own).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k + 1)
    heaps = best.groupBy("point").agg(F.collect_list(F.struct((-F.col("similarity")).alias("less"), "neighbour")).alias("near"))
    listed = rows.select("point", "same").join(heaps, "point").select("same", "near").checkpoint()
    # Rows of a vector with very many copies are named by a broadcast (fewer than HOT vectors), the rest by a join.
    plain = every.select("vec_id", "same")
    counted = plain.groupBy("same").agg(F.count(F.lit(1)).alias("_n"))
    hot = counted.where(F.col("_n") > 1 + every.count() / HOT).select("same")
    some = F.broadcast(listed.join(F.broadcast(hot), "same", "left_semi").checkpoint())
    rest = plain.join(some.select("same"), "same", "left_anti")
    whole = plain.join(some, "same").unionByName(rest.join(listed, "same"))
    others = whole.select("vec_id", F.filter("near", lambda x: x["neighbour"] != F.col("vec_id")).alias("near"))
    ranked = others.select("vec_id", F.posexplode(F.slice(F.sort_array("near"), 1, k)).alias("_at", "_found"))
    similarity, neighbour = -F.col("_found.less"), F.col("_found.neighbour")
    return ranked.select(
        "vec_id", (F.col("_at") + 1).alias("rank"), neighbour.alias("neighbour"), similarity.alias("similarity"),
        F.when((similarity > duplicate) & (neighbour < F.col("vec_id")), "duplicate").otherwise("keep").alias("decision"),
    )


def closest_pairs(review: DataFrame, n: int = CLOSEST) -> DataFrame:
    """The n closest distinct pairs of a review, each once: vec_a < vec_b, similarity (a top-n that merges per task)."""
    pair = review.select(
        F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b"), "similarity"
    ).distinct()
    return pair.orderBy(F.desc("similarity"), "vec_a", "vec_b").limit(n)
