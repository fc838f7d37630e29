"""Feed health: rollups over shards, staleness, lag and causal selection of the latest evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.times import micros


def rollup(instruments: DataFrame, shard: str) -> DataFrame:
    """By shard: n, n_valid, n_invalid, n_stale, flags (sorted union) from rows valid, stale, flag."""
    return instruments.groupBy(shard).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("valid")).alias("n_valid"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.count_if(F.col("stale")).alias("n_stale"),
        F.array_sort(F.collect_set("flag")).alias("flags"),
    )


def stale(rows: DataFrame, observed: str, event: str, received: str, max_age_s: float) -> DataFrame:
    """Rows whose book is older than allowed, with age_s; the receive time stands in where the event has none."""
    age = (micros(rows, observed) - F.coalesce(micros(rows, event), micros(rows, received))) / 1e6
    return rows.withColumn("age_s", age).where(F.col("age_s") > max_age_s)


def lag_statistics(rows: DataFrame, key: str, ts: str, lag: str, window_s: int = 60) -> DataFrame:
    """Per row: the last lag, and the greatest and number of lags in the window before and at it."""
    recent = Window.partitionBy(key).orderBy(micros(rows, ts)).rangeBetween(-(window_s * 1_000_000 - 1), 0)
    return rows.select(key, ts, F.col(lag).alias("last_lag"), F.max(lag).over(recent).alias("max_lag"), F.count(lag).over(recent).alias("n"))


def latency_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """count, total, least, p50, p95, p99 (exact, interpolated) and greatest, by key."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    found = rows.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), p.alias("p"), F.max(value).alias("greatest"))
    return found.select(key, "n", "total", "least", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "greatest")


def causal_selection(health: DataFrame, shard: str, at: str, detail: str) -> DataFrame:
    """The latest row of each shard's time, and the latest detail that isn't empty, which may be older."""
    filled = F.col(detail).isNotNull() & (F.col(detail) != "") & (F.col(detail) != "[]")
    return health.groupBy(shard).agg(F.max(at).alias("latest_at"), F.max_by(detail, F.when(filled, F.col(at))).alias("detail"), F.max(F.when(filled, F.col(at))).alias("detail_at"))
