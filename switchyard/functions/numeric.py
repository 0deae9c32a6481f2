"""Numeric expressions: guarded ratios, clamping, exact decimal rounding, report formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as DOUBLE, 0 on an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round_exact(x: Column, digits: int = 0) -> Column:
    """Round the binary value half-to-even, e.g. 2.675 -> 2.67, 0.125 -> 0.12.

    ``bround`` rounds the shortest decimal text instead (2.675 -> 2.68).  The scaled product is
    split into head and exact remainder (Veltkamp split), so a tie is seen only when it is one.
    """
    scale = float(10**digits)
    product = x * scale
    spread = x * 134217729.0
    head = spread - (spread - x)
    error = (head * scale - product) + (x - head) * scale
    below = F.floor(product).cast("double")
    offset = product - below
    up = (offset > 0.5) | ((offset == 0.5) & ((error > 0) | ((error == 0) & (below % 2 != 0))))
    return F.when(up, below + 1).otherwise(below) / scale


def metric_text(name: str, value: Column) -> Column:
    """One metric as shown in a table: latency in ms with one decimal, all else four decimals."""
    if name.startswith("latency_"):
        return F.format_string("%.1fms", round_exact(value, 1))
    return F.format_string("%.4f", round_exact(value, 4))


def percent_text(value: Column) -> Column:
    """Share as percent with one decimal."""
    return F.format_string("%.1f%%", round_exact(value * 100.0, 1))


def money_text(value: Column, digits: int = 4) -> Column:
    return F.format_string(f"$%.{digits}f", round_exact(value, digits))
