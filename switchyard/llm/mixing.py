"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

1. Targets: sources share ``share`` of all words by weight; a source stops at ``most`` times its words and
   the excess goes to the others by weight (water filling, in closed form over one row per source).
2. The mix is cut in equal blocks of ``block_words``.  Blocks go to sources by highest quotients
   target / (2s + 1), and each source's blocks go to its shards the same way with the shards' words as
   weights, so every (source, shard) has an integer quota and the quotas of a source add up.
3. Inside a (source, shard) documents are laid end to end in a seeded order; the quota takes whole rounds
   of the shard, then the first blocks of the next round.

Shards are cut by a hash of the id, as many as the words need, so no source, however large, is ordered in
one task.  A source that would get fewer than ``CELL_BLOCKS`` blocks of words per shard pools neighbouring shards
until it has them, as a quota above ``MOST`` times its shard is lost: that is about a block per shard at most.  Only ids, sources and sizes are shuffled.  One row per source (and per shard of a source) is
ranked in one task; those are a dimension of the data, not its rows.

Defined cases: a null source is a source of its own and sorts last; null and empty texts have size 0 and
take 0; repeated rows each have a place of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from switchyard.session import shared_dir

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 32
SHARD_WORDS = 500_000
#: Words of a source per shard of it, in blocks, at least (on average); a smaller source is one shard.
CELL_BLOCKS = 512
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def apportion(parties: DataFrame, by: list[str], order: str, weight: str, seats: str) -> DataFrame:
    """Add ``quota``: ``seats`` (equal within ``by``) dealt by highest quotients of ``weight``; ties by ``order``.

    Rounding at the ideal divisor is within half a seat per party of the right total; only the quotients
    next to that cut are ranked, never all seats.
    """
    group = W.partitionBy(*by)
    total, n = F.sum(weight).over(group), F.count(F.lit(1)).over(group)
    first = parties.withColumns({"_total": total, "_n": n}).withColumn(
        "_low",
        F.when((F.col("_total") > 0) & (F.col(seats) > 0),
               F.floor(F.col(weight) * F.col(seats) / F.col("_total") + 0.5)).otherwise(F.lit(0)).cast("long"),
    ).withColumn("_missing", F.when(F.col("_total") > 0, F.col(seats) - F.sum("_low").over(group)).otherwise(F.lit(0)))
    # So many more (or fewer) seats one party may get, at most.
    reach = (F.ceil(F.col(weight) / F.col("_total") * (F.abs("_missing") + F.col("_n"))) + 2).cast("int")
    steps = F.when(F.col("_missing") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), reach))
    next_up = F.col(weight) / (2 * (F.col("_low") + F.col("_step")) - 1)
    last_in = F.col(weight) / (2 * (F.col("_low") - F.col("_step")) + 1)
    moves = (
        first.where("_missing <> 0").withColumn("_step", F.explode(steps))
        .where("_missing > 0 OR _step <= _low")
        .withColumn("_quotient", F.when(F.col("_missing") > 0, -next_up).otherwise(last_in))
    )
    tie = F.when(F.col("_missing") > 0, F.col(order)).otherwise(-F.col(order))
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_quotient", tie, "_step"))
    moved = (
        moves.withColumn("_rank", rank).where("_rank <= abs(_missing)")
        .groupBy(*by, order).agg(F.sum(F.signum(F.col("_missing").cast("double"))).cast("long").alias("_moved"))
    )
    keys = [*by, order]
    return (
        first.join(moved, keys, "left").withColumn("quota", F.col("_low") + F.coalesce("_moved", F.lit(0)))
        .drop("_total", "_n", "_low", "_missing", "_moved")
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, rank, source_size, target from one row per source (source, source_size)."""
    everything = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weight: Column = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"_w": weight, "_cap": F.col("source_size") * F.lit(float(most))})
    level = everything.orderBy(F.col("_cap") / F.col("_w"), "rank")
    before = level.rowsBetween(W.unboundedPreceding, -1)
    goal = F.sum("source_size").over(everything) * F.lit(float(share))
    left = goal - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    tried = capped.withColumns({"_level": left / open_weight, "_at": F.row_number().over(level)})
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_at"))
    found = tried.withColumn("_lambda", F.min_by("_level", fits).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_lambda") * F.col("_w"), F.col("_cap")))
    return found.select("source", "rank", "source_size", target.alias("target"))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words) of every document."""
    words = F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD))
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        F.coalesce(words, F.lit(0)).cast("long").alias("size"),
    )


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    shared_dir(docs.sparkSession)
    rows = sized(docs, doc_id, text, source).checkpoint()
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    placed = rows.withColumn("_digest", digest).withColumn(
        "shard", F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") % F.lit(shards)
    )
    cells = rows_per_cell(placed).checkpoint()  # one row per source and shard
    sources = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")))
    goal = F.sum("target").over(W.partitionBy(F.lit(0)))
    blocks = sources.withColumn("_blocks", F.round(goal / block_words).cast("long"))
    quotas = apportion(blocks.withColumn("_all", F.lit(0)), ["_all"], "rank", "target", "_blocks").select(
        "source", "rank", "source_size", "target", F.col("quota").alias("_source_quota")
    )
    here, there = cells.alias("c"), quotas.alias("q")
    room = F.floor(F.col("source_size") / (CELL_BLOCKS * block_words))
    own = F.greatest(F.lit(1), F.least(F.lit(shards), room)).cast("long")
    dealt = here.join(there, F.col("c.source").eqNullSafe(F.col("q.source"))).select(
        "c.source", "shard", "cell_size", "rank", "source_size", "target", "_source_quota",
        F.floor(F.col("shard") * own / shards).cast("long").alias("pool"),  # the shard itself if own = shards
    ).checkpoint()
    pools = dealt.groupBy("rank", "pool").agg(
        F.sum("cell_size").alias("pool_size"), F.first("_source_quota").alias("_source_quota")
    )
    pool_quotas = apportion(pools, ["rank"], "pool", "pool_size", "_source_quota").drop("_source_quota")
    cell_quotas = dealt.drop("cell_size", "_source_quota").join(pool_quotas, ["rank", "pool"])
    a, b = placed.alias("a"), cell_quotas.alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.shard") == F.col("b.shard"))).select(
        "a.doc_id", "a.size", "a._digest", "b.rank", "b.pool", "b.source_size", "b.target", F.col("b.pool_size").alias("cell_size"),
        F.least(F.col("b.quota") * block_words, F.col("b.pool_size") * MOST).alias("_quota"),
    )
    line = W.partitionBy("rank", "pool").orderBy("_digest", "doc_id", "size")
    end = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0))
    rounds = F.when(F.col("cell_size") > 0, F.floor(F.col("_quota") / F.col("cell_size"))).otherwise(F.lit(0)).cast("long")
    part = F.greatest(
        F.lit(0), F.least(F.col("_end"), F.col("_quota") - F.col("_rounds") * F.col("cell_size")) - F.col("_end") + F.col("size")
    )
    return joined.withColumns({"_end": end, "_rounds": rounds}).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("_rounds") + part).cast("long").alias("taken")
    )


def rows_per_cell(placed: DataFrame) -> DataFrame:
    return placed.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
