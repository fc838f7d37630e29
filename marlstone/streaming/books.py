"""Live order books as keyed state: snapshots replace, changes set sizes, gaps in sequence invalidate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE = "book string, seq long, kind string, side string, price double, size double"
TOP = "book string, seq long, best_bid double, best_ask double, valid boolean"


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: last sequence, whether valid, prices, sizes and sides. One row out per message sequence that changes the top."""
    last, valid, sides, prices, sizes, shown = state.get if state.exists else (-1, False, [], [], [], "")
    ladder = {(s, p): z for s, p, z in zip(sides, prices, sizes)}
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    out = []
    for seq, part in rows.groupby("seq", sort=False):
        if seq <= last:
            continue  # a repeat of what is already in the state
        if (part["kind"] == "snapshot").any():
            ladder, valid = {}, True
        elif last >= 0 and seq != last + 1:
            valid = False
        for side, price, size in zip(part["side"], part["price"], part["size"]):
            if size and size > 0:
                ladder[side, price] = size
            else:
                ladder.pop((side, price), None)
        last = int(seq)
        bid = max((p for s, p in ladder if s == "bid"), default=None)
        ask = min((p for s, p in ladder if s == "ask"), default=None)
        if (now := f"{bid} {ask} {valid}") != shown:
            out.append((key[0], last, bid, ask, valid))
            shown = now
    state.update((last, valid, [s for s, _ in ladder], [p for _, p in ladder], list(ladder.values()), shown))
    yield pd.DataFrame(out, columns=["book", "seq", "best_bid", "best_ask", "valid"])


def live_tops(messages: DataFrame) -> DataFrame:
    """A stream of changed tops from a stream of messages (see MESSAGE)."""
    state = "last long, valid boolean, sides array<string>, prices array<double>, sizes array<double>, shown string"
    return messages.groupBy("book").applyInPandasWithState(_apply, TOP, state, "append", GroupStateTimeout.NoTimeout)


def lag_windows(messages: DataFrame, ts: str, lag: str, key: str) -> DataFrame:
    """Sliding minute of lags each second, for monitoring: a late row only misses its window's figure."""
    return messages.withWatermark(ts, "2 minutes").groupBy(F.window(ts, "60 seconds", "1 second"), key).agg(F.max(lag).alias("max_lag"), F.count(lag).alias("n"))


def bars(messages: DataFrame, ts: str, key: str, price: str, width: str = "60 seconds") -> DataFrame:
    return messages.withWatermark(ts, "2 minutes").groupBy(F.window(ts, width), key).agg(F.max_by(price, ts).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.count(price).alias("n"))


def record(rows: DataFrame, path: str, checkpoint: str, partition_by: list[str]):
    """A recording query: exactly-once Parquet output in micro-batches; restarting it from its checkpoint recovers."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partition_by).trigger(availableNow=True).start()


def fan_out(rows: DataFrame, checkpoint: str, sinks: list):
    """Each micro-batch goes to several sinks, callables of (frame, batch id), which must be idempotent by batch id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, batch_id)
        finally:
            held.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
