"""Time bars of quotes with rolling variation of logit returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.prices import logit
from marlstone.functions.times import floored, micros


def bar_features(quotes: DataFrame, bar_seconds: int = 60, window_seconds: int = 600, tie: str | None = None) -> DataFrame:
    """token_id, bar_start, mid_last, spread_bps_mean, rv, n_obs from ts (timestamp, or seconds), token_id, mid, spread_bps.

    rv is the population deviation of logit returns in the left-open window before and at a row. Rows of one (token_id, ts)
    follow each other by `tie`, or by mid and spread if none is named, and a later one is in no earlier one's
    window; rows without a time are left out. One shuffle, on token_id.
    """
    last = F.col(tie) if tie else F.struct("mid", "spread_bps")
    rows = quotes.select("token_id", micros(quotes, "ts").alias("us"), last.alias("tie"), floored(quotes, "ts", bar_seconds).alias("bar_start"), "mid", "spread_bps").where("us is not null")
    by = Window.partitionBy("token_id").orderBy("us", "tie")
    numbered = rows.withColumns({"ret": logit(F.col("mid")) - F.lag(logit(F.col("mid"))).over(by)})
    # a window by time holds all rows of the row's own time: the later ones are taken off again, as sums
    recent = Window.partitionBy("token_id").orderBy("us").rangeBetween(-(window_seconds * 1_000_000 - 1), 0)
    later = Window.partitionBy("token_id", "us").orderBy("tie").rowsBetween(1, Window.unboundedFollowing)
    whole = numbered.withColumns({"rv": F.stddev_pop("ret").over(recent), "k": F.count("ret").over(recent), "mean": F.avg("ret").over(recent)})
    m2 = F.col("rv") * F.col("rv") * F.col("k")
    out = {"k2": F.count("ret").over(later), "s2": F.sum("ret").over(later), "q2": F.var_pop("ret").over(later)}
    cut = whole.withColumns(out)
    left = F.col("k") - F.col("k2")
    mean = (F.col("mean") * F.col("k") - F.coalesce("s2", F.lit(0.0))) / left
    off = F.col("q2") * F.col("k2") + left * F.col("k2") / F.col("k") * (mean - F.col("s2") / F.col("k2")) * (mean - F.col("s2") / F.col("k2"))
    rv = F.when(F.col("k2") == 0, F.col("rv")).when(left > 0, F.sqrt(F.greatest(m2 - off, F.lit(0.0)) / left))
    with_rv = cut.withColumn("rv", rv).withColumn("place", F.struct("us", "tie"))
    return with_rv.groupBy("token_id", "bar_start").agg(
        F.max_by("mid", F.when(F.col("mid").isNotNull(), F.col("place"))).alias("mid_last"),
        F.avg("spread_bps").alias("spread_bps_mean"),
        F.max_by("rv", F.when(F.col("rv").isNotNull(), F.col("place"))).alias("rv"),
        F.count(F.lit(1)).alias("n_obs"),
    )


def with_metadata(features: DataFrame, markets: DataFrame) -> DataFrame:
    """Left join with the markets' metadata by each of their token_ids; several markets of a token multiply its rows."""
    if "token_ids" not in markets.columns:
        return features
    names = [c for c in ("slug", "question", "volume", "liquidity", "closed") if c in markets.columns]
    meta = markets.select(F.explode("token_ids").alias("token_id"), *names).where("token_id is not null")
    return features.join(meta.withColumn("token_id", F.col("token_id").cast("string")), "token_id", "left")


def ohlc(trades: DataFrame, key: str, ts: str, price: str, seconds: int) -> DataFrame:
    """key, bar_start, open, high, low, close, n: candles of trades; of equal times the larger price closes and the smaller opens."""
    at = F.struct(ts, price)
    return trades.groupBy(key, floored(trades, ts, seconds).alias("bar_start")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).alias("n")
    )
