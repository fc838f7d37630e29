"""Open interest, positions, wallets and venue facts per key: what was asked against what came, and whether it is all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def answers(requested: DataFrame, returned: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, status of each id asked or returned: served (zero is a value), omitted, unexpected, duplicate or invalid."""
    counts = returned.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias("_v"))
    asked = requested.select(key).distinct().withColumn("_asked", F.lit(True))
    number = F.col("_v").try_cast("decimal(38,12)")
    status = (
        F.when(F.col("_asked").isNull(), "unexpected")
        .when(F.col("_n").isNull(), "omitted")
        .when(F.col("_n") > 1, "duplicate")
        .when(number.isNull() | (number < 0), "invalid")
        .otherwise("served")
    )
    return asked.join(counts, key, "full_outer").select(key, F.when(status == "served", number).alias("value"), status.alias("status"))


def coverage(answered: DataFrame) -> DataFrame:
    """One row: n_requested, n_served, n_omitted, n_wrong, complete and coverage_rate."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    found = answered.agg(count("served", "omitted", "duplicate", "invalid").alias("n_requested"), count("served").alias("n_served"), count("omitted").alias("n_omitted"), count("unexpected", "duplicate", "invalid").alias("n_wrong"))
    return found.withColumns({"complete": (F.col("n_omitted") == 0) & (F.col("n_wrong") == 0), "coverage_rate": F.try_divide("n_served", "n_requested")})


def participants(positions: DataFrame, cursors: DataFrame, key: str = "condition_id") -> DataFrame:
    """A row per key and wallet with its open and its closed positions, and whether both lists of the key were read to their ends."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("outcome", "size")))).alias(f"{s.lower()}_positions") for s in ("OPEN", "CLOSED")]
    whole = cursors.groupBy(key).agg((F.count_if(F.col("exhausted") & F.col("feed").isin("OPEN", "CLOSED")) == 2).alias("complete"))
    return positions.groupBy(key, "wallet").agg(*lists).join(whole, key, "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def wallet_history(feeds: dict[str, DataFrame], cursors: DataFrame) -> DataFrame:
    """The rows of a wallet's feeds with `feed`, and whether all its feeds were read to their ends."""
    rows = None
    for name, frame in feeds.items():
        tagged = frame.withColumn("feed", F.lit(name))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    whole = cursors.where(F.col("feed").isin(list(feeds))).groupBy("wallet").agg((F.count_if("exhausted") == len(feeds)).alias("complete"))
    return rows.join(whole, "wallet", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def profit_steps(series: DataFrame, key: str, at: str, total: str) -> DataFrame:
    """A cumulative series with its steps; the first row's step is its total."""
    return series.withColumn("step", F.col(total) - F.coalesce(F.lag(total).over(Window.partitionBy(key).orderBy(at)), F.lit(0)))


def ranked(rows: DataFrame, rank: str, value: str) -> DataFrame:
    """A provider's ranking with whether each row keeps it: values don't rise with the rank."""
    return rows.withColumn("in_order", F.coalesce(F.col(value) <= F.lag(value).over(Window.partitionBy("board").orderBy(rank)), F.lit(True)))


def newest_per_raw_key(rows: DataFrame, key: str, at: str, payload_hash: str) -> DataFrame:
    """One row per key, the one of the greatest (time, payload hash); a row without a key is an error when it is read."""
    named = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit(f"a row lacks {key}")).cast(rows.schema[key].dataType))
    best = rows.groupBy(named.alias(key)).agg(F.max_by(F.struct(*rows.columns), F.struct(at, payload_hash)).alias("r"))
    return best.select("r.*")


def conflicts_to_read(rows: DataFrame, key: str, at: str, payload_hash: str) -> DataFrame:
    """key, newest hash and `tied`: another payload has the same newest time, so the market must be read again."""
    top = rows.groupBy(key).agg(F.max(at).alias("_t"))
    newest = rows.join(top, key).where(F.col(at) == F.col("_t"))
    return newest.groupBy(key).agg(F.max(payload_hash).alias("payload_hash"), (F.countDistinct(payload_hash) > 1).alias("tied"))


def key_problems(rows: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Up to `most` keys that are null, blank or of several rows, with n, the most frequent first: a report."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    bad = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "") | (F.col("n") > 1)
    return counts.where(bad).orderBy(F.desc("n"), key).limit(most)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def issues(rows: DataFrame, most: int = 20) -> DataFrame:
    """code, severity, n and up to `most` examples, the smallest, without holding the others."""
    keys = ["code", "severity"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("example"))
    examples = rows.select(*keys, "example").distinct().withColumn("_k", place).where(F.col("_k") <= most)
    listed = examples.groupBy(*keys).agg(F.array_sort(F.collect_list("example")).alias("examples"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(listed, keys, "left")


def cut_off(rows: DataFrame, created: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(rows from the cutoff on, rows before it); rows without a time are before it."""
    on = F.coalesce(F.col(created) >= cutoff, F.lit(False))
    return rows.where(on), rows.where(~on)


def since_watermark(rows: DataFrame, created: str, watermark: Column, overlap_s: int) -> DataFrame:
    """Rows created after the watermark less an overlap, which covers rows that came late."""
    return rows.where(F.col(created) >= watermark - F.make_interval(secs=F.lit(overlap_s)))


def out_of_order(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value isn't above the one of the row before."""
    by = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_before", F.lag(value).over(by)).where(F.col(value) <= F.col("_before")).drop("_before")
