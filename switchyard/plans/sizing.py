"""Size-checked broadcasts and null-safe joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.session import shared_dir

# A broadcast side is held whole by the driver and by every executor.
BROADCAST_ROWS = 200_000


def broadcast_within(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting the rows; beyond the bound leave the join to AQE.

    The counted table is an aggregate, computed once and cut from its lineage by a checkpoint in the shared
    folder, which goes when the last reference does: there is nothing to release.
    """
    shared_dir(small.sparkSession)
    kept = small.checkpoint()
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` so that a null key meets a null key; the keys and columns of ``rows`` come first."""
    if not keys:
        return rows.join(F.broadcast(groups))  # one row
    marked = groups.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return rows.join(marked, on, how).drop(*[f"_right_{k}" for k in keys])
