"""Latest and distinct rows per key, duplicate keys and conflicting payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; the planner limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows share, nulls counting as equal, with their number of rows n."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflicts_at_latest(rows: DataFrame, keys: Sequence[str], at: str, payload: str) -> DataFrame:
    """Keys whose rows at their greatest `at` differ in payload, with n_payloads.

    A pre-aggregated maximum and an equi-join, so no task holds a key's whole history."""
    top = rows.groupBy(*keys).agg(F.max(at).alias("_top"))
    at_top = rows.join(top, list(keys)).where(F.col(at) == F.col("_top"))
    return at_top.groupBy(*keys).agg(F.countDistinct(payload).alias("n_payloads")).where("n_payloads > 1")


def profile(rows: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """One row: rows, distinct keys, rows with a null key, rows with a null payload, keys of several rows."""
    key = F.struct(*keys)
    null_key = F.lit(False)
    for c in keys:
        null_key |= F.col(c).isNull()
    per_key = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(payload).isNull()).alias("_p"), F.any_value(null_key).alias("_null"), F.any_value(key).alias("_k")
    )
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count_if(~F.col("_null")).alias("n_keys"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).cast("long").alias("n_null_keys"),
        F.coalesce(F.sum("_p"), F.lit(0)).cast("long").alias("n_null_payloads"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated"),
    )
