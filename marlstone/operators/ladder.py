"""Order-book ladders: depth with running size, and the top of the book."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def depth(levels: DataFrame, keys: Sequence[str], max_levels: int | None = None) -> DataFrame:
    """Levels (keys, side bid|ask, price, size) in book order with level_index from 0 and cumulative_size; best first."""
    price = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    order = Window.partitionBy(*keys, "side").orderBy(price)
    found = levels.select(*keys, "side", "price", "size", (F.row_number().over(order) - 1).alias("level_index"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_size"))
    return found if max_levels is None else found.where(F.col("level_index") < max_levels)


def top_of_book(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best bid and ask of each book with sizes, mid, spread, spread_bps, quality_flags (sorted) and valid_state."""
    usable = (F.col("price") >= 0) & (F.col("size") > 0)
    bid, ask = usable & (F.col("side") == "bid"), usable & (F.col("side") == "ask")
    best = levels.groupBy(*keys).agg(
        F.max(F.when(bid, F.struct("price", "size"))).alias("b"),
        F.min(F.when(ask, F.struct(F.col("price"), (-F.col("size")).alias("neg")))).alias("a"),
    )
    rows = best.select(*keys, F.col("b.price").alias("best_bid"), F.col("b.size").alias("bid_size"), F.col("a.price").alias("best_ask"), (-F.col("a.neg")).alias("ask_size"))
    return with_metrics(rows)


def with_metrics(rows: DataFrame) -> DataFrame:
    """Adds mid, spread, spread_bps, quality_flags and valid_state to rows with best_bid and best_ask."""
    mid, spread = (F.col("best_bid") + F.col("best_ask")) / 2, F.col("best_ask") - F.col("best_bid")
    flags = F.array(
        F.when(spread <= 0, "crossed_book"),
        F.when(F.col("best_ask").isNull(), "empty_ask"),
        F.when(F.col("best_bid").isNull(), "empty_bid"),
        F.when(spread < 0, "negative_spread"),
    )
    return rows.withColumns({"mid": mid, "spread": spread, "spread_bps": F.when(mid > 0, spread / mid * 10_000), "quality_flags": F.array_compact(flags)}).withColumn(
        "valid_state", F.size("quality_flags") == 0
    )
