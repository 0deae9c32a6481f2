"""Token cost of routing strategies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard import schema as S
from switchyard.functions.numeric import clamp, ratio


@dataclass(frozen=True)
class Prices:
    """USD per million tokens, and tokens per message."""

    strong_in: float = S.STRONG_INPUT_PER_1M
    strong_out: float = S.STRONG_OUTPUT_PER_1M
    cheap_in: float = S.CHEAP_INPUT_PER_1M
    cheap_out: float = S.CHEAP_OUTPUT_PER_1M
    tokens_in: int = S.INPUT_TOKENS
    tokens_out: int = S.OUTPUT_TOKENS

    @property
    def strong(self) -> float:
        return (self.tokens_in * self.strong_in + self.tokens_out * self.strong_out) / 1_000_000

    @property
    def cheap(self) -> float:
        return (self.tokens_in * self.cheap_in + self.tokens_out * self.cheap_out) / 1_000_000


def savings_percent(saved: Column, baseline: Column) -> Column:
    return saved / F.greatest(baseline, F.lit(1e-9)) * 100.0


def routed_share(mode: str = "observed") -> Column:
    """Share sent to the cheap model.

    ``observed`` is what was routed there, (tn + fn) / n.  ``estimate`` is
    ``precision_0 * (1 - recall_1)`` clamped to [0, 1], for tables that hold metrics only.
    """
    if mode == "estimate":
        return clamp(F.coalesce("precision_0", F.lit(0.0)) * (1.0 - F.col("recall_1")))
    if mode == "observed":
        return ratio(F.col("tn") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    raise ValueError(f"unknown mode {mode!r}")


def with_costs(df: DataFrame, share: Column, prices: Prices = Prices()) -> DataFrame:
    """Shares, cost of the counted ``messages``, baseline and saving against all-strong."""
    n = F.col("messages")
    return (
        df.withColumn("pct_cheap", share)
        .withColumn("pct_strong", 1.0 - F.col("pct_cheap"))
        .withColumn("cost_usd", n * (F.col("pct_strong") * prices.strong + F.col("pct_cheap") * prices.cheap))
        .withColumn("baseline_usd", n * prices.strong)
        .withColumn("savings_usd", F.col("baseline_usd") - F.col("cost_usd"))
        .withColumn("savings_pct", savings_percent(F.col("savings_usd"), F.col("baseline_usd")))
    )


def cost_table(experiments: DataFrame, mode: str = "observed", prices: Prices = Prices()) -> DataFrame:
    """Baselines first, then one row per experiment by saving: what the evaluated rows themselves cost.

    No traffic is assumed; the messages are those that the confusion counts hold (for the baselines, those
    of the largest experiment).
    """
    n = (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("messages")
    routers = experiments.select(
        F.concat(F.lit("router_"), F.col("experiment_id")).alias("strategy"), n,
        routed_share(mode).alias("_share"), "recall_1", F.lit(2).alias("_rank"),
    )
    baselines = F.array(
        F.struct(F.lit("all_strong").alias("strategy"), F.lit(0.0).alias("_share"), F.lit(1.0).alias("recall_1"), F.lit(0).alias("_rank")),
        F.struct(F.lit("all_cheap").alias("strategy"), F.lit(1.0).alias("_share"), F.lit(0.0).alias("recall_1"), F.lit(1).alias("_rank")),
    )
    fixed = routers.agg(F.max("messages").alias("messages")).select("messages", F.inline(baselines))
    every = with_costs(fixed.unionByName(routers), F.col("_share"), prices)
    return every.orderBy("_rank", F.col("savings_usd").desc(), "strategy").drop("_share", "_rank")


def routed_rollup(routed: DataFrame, by: str = "strategy", prices: Prices = Prices()) -> DataFrame:
    """What the routed rows themselves cost per strategy (no daily estimate)."""
    strong = F.count_if(F.col("routed_label") == 1)
    cheap = F.count_if(F.col("routed_label") == 0)
    return (
        routed.groupBy(by)
        .agg(strong.alias("to_strong"), cheap.alias("to_cheap"))
        .withColumn("cost_usd", F.col("to_strong") * prices.strong + F.col("to_cheap") * prices.cheap)
        .withColumn("baseline_usd", (F.col("to_strong") + F.col("to_cheap")) * prices.strong)
        .withColumn("savings_usd", F.col("baseline_usd") - F.col("cost_usd"))
        .withColumn("savings_pct", savings_percent(F.col("savings_usd"), F.col("baseline_usd")))
    )


def top_routers(costs: DataFrame, k: int = 10) -> DataFrame:
    routers = costs.where(F.col("strategy").startswith("router_"))
    return routers.orderBy(F.col("savings_usd").desc(), "strategy").limit(k)
