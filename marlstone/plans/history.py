"""Price histories and candles: reconciliation of points, flattening, sample intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile_points(points: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """One row per key with counts that sum to n_raw: accepted, duplicates, conflicts, rejected (null or outside 0..1), outside [start, end).

    Of a time with one price, one row is accepted and the others are duplicates; of a time with several, all are conflicts."""
    bad = F.col("t").isNull() | F.col("p").isNull() | ~F.col("p").between(0, 1)
    outside = (F.col("t") < start) | (F.col("t") >= end)
    kind = F.when(bad, "rejected").when(outside, "outside").otherwise("point")
    per_time = points.select(key, "t", "p", kind.alias("kind")).groupBy(key, "t", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("_lo"), F.max("p").alias("_hi"))
    one, point = F.col("_lo") == F.col("_hi"), F.col("kind") == "point"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_time.groupBy(key).agg(
        total("n").alias("n_raw"),
        total(F.when(point & one, 1)).alias("n_accepted"),
        total(F.when(point & one, F.col("n") - 1)).alias("n_duplicates"),
        total(F.when(point & ~one, F.col("n"))).alias("n_conflicts"),
        total(F.when(F.col("kind") == "rejected", F.col("n"))).alias("n_rejected"),
        total(F.when(F.col("kind") == "outside", F.col("n"))).alias("n_outside"),
    )


def flatten_candles(candles: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per candle and value that isn't null: keys, price_type, price."""
    rows = F.array(*[F.struct(F.lit(v).alias("price_type"), F.col(v).alias("price")) for v in values])
    return candles.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where("price is not null")


def sample_interval(rows: DataFrame, key: str, t: str) -> DataFrame:
    """key, interval: the upper median of positive steps between consecutive times."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    steps = rows.select(key, step.alias("d")).where("d > 0")
    # ranks from counts of equal steps: no key's steps are ever held in one list
    counts = steps.groupBy(key, "d").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy("d")
    upto = counts.select(key, "d", F.sum("n").over(order).alias("_upto"), F.sum("n").over(Window.partitionBy(key)).alias("_all"))
    return upto.where("_upto > _all div 2").groupBy(key).agg(F.min("d").alias("interval"))


def off_grid(candles: DataFrame, end: str, minutes: int) -> DataFrame:
    """Candles whose end isn't on the grid: whole periods in UTC, or midnight in New York for days."""
    if minutes == 1440:
        local = F.from_utc_timestamp(F.timestamp_seconds(end), "America/New_York")
        return candles.where((F.hour(local) != 0) | (F.minute(local) != 0) | (F.second(local) != 0))
    return candles.where(F.col(end) % (minutes * 60) != 0)
