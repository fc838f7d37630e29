"""Merging of redundant recordings of one feed, with explicit lateness.

The watermark is the greatest receive time over all copies up to a row, less the lateness. Nothing is dropped for
being late: such rows come out marked. A message that copies hold is one occurrence; where a copy holds it k
times, so does the result, as often as the copy that has it most.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.texts import sorted_digest
from marlstone.operators.sequences import running_max

LATENESS_MS = 120_000


def receive_clock(rows: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Adds `clock`, each copy's receive time made monotone in the order of its sequence. Copies are few, so each is cut into ranges."""
    return running_max(rows, ["copy"], "seq", "received_ms", ties=ties).withColumnRenamed("running", "clock")


def with_lateness(rows: DataFrame, lateness_ms: int = LATENESS_MS, ties: Sequence[str] = ()) -> DataFrame:
    """Adds `clock` and `late`: the venue time lies before the watermark, or further past the receipt than the lateness.

    Copies are merged in the order of their clocks, so the greatest clock up to a row is the row's own, and the
    watermark needs no order over the whole feed."""
    timed = receive_clock(rows, ties)
    late = (F.col("venue_ms") < F.col("clock") - lateness_ms) | (F.col("venue_ms") > F.col("received_ms") + lateness_ms)
    return timed.withColumn("late", F.coalesce(late, F.lit(False)))


def merge(rows: DataFrame, lateness_ms: int = LATENESS_MS, ties: Sequence[str] = ()) -> DataFrame:
    """scope, venue_ms, digest, k, copies (sorted), first_received_ms, late: one row per message occurrence.

    Input rows: copy, seq, received_ms, scope, venue_ms, digest. An occurrence is late only if all its copies are.
    Where a copy's sequence isn't unique, `ties` names the columns that order its equals."""
    k = F.row_number().over(Window.partitionBy("copy", "scope", "venue_ms", "digest").orderBy("seq", *ties))
    numbered = with_lateness(rows, lateness_ms, ties).withColumn("k", k)
    return numbered.groupBy("scope", "venue_ms", "digest", "k").agg(
        F.array_sort(F.collect_set("copy")).alias("copies"), F.min("received_ms").alias("first_received_ms"), F.min(F.col("late").cast("int")).cast("boolean").alias("late")
    )


#: Of untimed matches: the place of a group is the earliest place that one of its occurrences gave it.
MATCHED = "scope string, digest string, group int, copies array<string>, order_ms long, first_received_ms long, n int"


def untimed_matches(rows: DataFrame, tolerance_ms: int = 5_000, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """MATCHED: occurrences of equal digests of different copies, from rows copy, seq, received_ms, scope, digest and sent_ms (or null).

    In the order of receipt an occurrence goes to the first open group of its digest that its copy hasn't joined yet and whose place
    is within the tolerance of its own (the sending time, else the receipt); else it begins a group. So a copy's genuine repeats
    are groups of their own. A digest's rows are one sorted stream, and groups close when the watermark has passed them by the
    tolerance, so a task holds the open groups only."""
    at = F.coalesce("sent_ms", "received_ms") if "sent_ms" in rows.columns else F.col("received_ms")
    light = rows.select(F.col("scope").cast("string"), F.col("digest").cast("string"), F.col("copy").cast("string"), "seq", "received_ms", at.alias("at"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, done = None, 0, []
        pending: list[dict] = []

        def closed(groups: list[dict]) -> list[tuple]:
            return [(*key, g["group"], sorted(g["copies"]), g["at"], g["received"], g["n"]) for g in groups]

        for batch in batches:
            for scope, digest, copy, received, at in zip(batch["scope"], batch["digest"], batch["copy"], batch["received_ms"], batch["at"]):
                if (scope, digest) != key:
                    if key:
                        done += closed(pending)
                    key, n, pending = (scope, digest), 0, []
                limit = received - lateness_ms - tolerance_ms
                done += closed([g for g in pending if g["at"] < limit])
                pending = [g for g in pending if g["at"] >= limit]
                for g in pending:
                    if copy not in g["copies"] and abs(at - g["at"]) <= tolerance_ms:
                        g["copies"].add(copy)
                        g["at"], g["received"], g["n"] = min(g["at"], at), min(g["received"], received), g["n"] + 1
                        break
                else:
                    n += 1
                    pending.append({"group": n, "copies": {copy}, "at": at, "received": received, "n": 1})
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=NAMES)
                done = []
        if key:
            done += closed(pending)
        yield pd.DataFrame(done, columns=NAMES)

    NAMES = [c.split()[0] for c in MATCHED.split(", ")]
    dealt = light.repartition("scope", "digest").sortWithinPartitions("scope", "digest", "received_ms", "copy", "seq")
    return dealt.mapInPandas(fold, MATCHED)


def message_keys(rows: DataFrame, venue: str, payload: str = "message") -> DataFrame:
    """Adds kind, scope, venue_ms, sent_ms and digest of decoded messages (JSON text).

    The digest is of the message with its keys sorted, without the fields that name a Kalshi connection; equal messages have
    equal digests whatever their spacing and order of keys."""
    text = F.col(payload)
    if venue == "polymarket":
        kind, scope, at, sent = "$.event_type", ["$.market", "$.asset_id"], "$.timestamp", None
    elif venue == "kalshi":
        kind, scope, at, sent = "$.type", ["$.msg.market_ticker", "$.msg.event_ticker"], "$.msg.ts_ms", "$.sending_ts_ms"
    else:
        raise ValueError(f"unknown venue {venue}")
    milliseconds = lambda path: F.when(F.get_json_object(text, path).rlike("^[0-9]+$"), F.get_json_object(text, path).cast("long")) if path else F.lit(None).cast("long")
    named = [F.nullif(F.get_json_object(text, p), F.lit("")) for p in scope]
    return rows.withColumns(
        {
            "kind": F.coalesce(F.get_json_object(text, kind), F.lit("")),
            "scope": F.coalesce(*named, F.lit("")),
            "venue_ms": milliseconds(at),
            "sent_ms": milliseconds(sent),
            "digest": sorted_digest(text, CONNECTION_FIELDS if venue == "kalshi" else ()),
        }
    )


#: Fields of a Kalshi message that tell of its connection and not of its content.
CONNECTION_FIELDS = ("sid", "seq", "sending_ts_ms")


def stream_ranks(rows: DataFrame) -> DataFrame:
    """copy, scope, venue_ms, held, rank: in a group the copies that hold most messages come first, ties by name."""
    held = rows.groupBy("scope", "venue_ms", "copy").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("scope", "venue_ms").orderBy(F.desc("held"), "copy")
    return held.withColumn("rank", F.row_number().over(order))


ORDERED = "scope string, venue_ms long, digest string, k int, place int, ambiguous boolean, conflicts int"


def ordered(rows: DataFrame) -> DataFrame:
    """ORDERED: the messages of each (scope, venue_ms) group in an order that keeps every copy's own order where it can.

    Copies are taken by rank; of a copy's neighbouring messages the order is kept unless stronger copies already say otherwise, which is
    a conflict. Where several messages could be next, the one of the strongest copy's earliest place is, and the choice is marked.
    Groups are messages of one market at one millisecond."""
    k = F.row_number().over(Window.partitionBy("copy", "scope", "venue_ms", "digest").orderBy("seq"))
    ranked = rows.withColumn("k", k).join(stream_ranks(rows).drop("held"), ["scope", "venue_ms", "copy"])
    light = ranked.select(F.col("scope").cast("string"), "venue_ms", F.col("digest").cast("string"), "k", "rank", "seq")

    def order(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "seq"])
        first: dict[tuple, int] = {}
        after: dict[tuple, set[tuple]] = defaultdict(set)
        conflicts = 0

        def leads(a: tuple, b: tuple) -> bool:
            seen, stack = set(), [a]
            while stack:
                x = stack.pop()
                if x == b:
                    return True
                if x not in seen:
                    seen.add(x)
                    stack += after[x]
            return False

        for _, part in frame.groupby("rank", sort=True):
            items = list(zip(part["digest"], part["k"]))
            for item in items:
                first.setdefault(item, len(first))
            for a, b in zip(items, items[1:]):
                if b in after[a]:
                    continue
                if leads(b, a):
                    conflicts += 1
                else:
                    after[a].add(b)
        waits = Counter(b for followers in after.values() for b in followers)
        ready = [(place, item) for item, place in first.items() if not waits[item]]
        heapq.heapify(ready)
        out = []
        while ready:
            ambiguous = len(ready) > 1
            _, item = heapq.heappop(ready)
            out.append((str(key[0]), key[1], item[0], item[1], len(out), ambiguous, conflicts))
            for b in after[item]:
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(ready, (first[b], b))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ORDERED.split(", ")])

    return light.groupBy("scope", "venue_ms").applyInPandas(order, ORDERED)


def clock_epochs(rows: DataFrame) -> DataFrame:
    """Adds `epoch` and `reset` to book messages (copy, scope, seq, clock): a copy's clock that falls, zeros apart, begins an epoch."""
    timed = F.when(F.col("clock") > 0, F.col("clock"))
    order = Window.partitionBy("copy", "scope").orderBy("seq")
    before = F.last(timed, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("reset", F.coalesce(timed < before, F.lit(False)))
    return marked.withColumn("epoch", F.sum(F.col("reset").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def snapshot_placement(rows: DataFrame) -> DataFrame:
    """Adds `placed_by` to snapshots with clock and reset: clock, or why the sending time stands in: missing, zero, decreased."""
    return rows.withColumn("placed_by", F.when(F.col("clock").isNull(), "missing").when(F.col("clock") == 0, "zero").when(F.col("reset"), "decreased").otherwise("clock"))


def snapshot_class(checkpoint: Column, reconnect: Column, n_levels: Column) -> Column:
    """Of a full book: reconnect (the first after a subscription), empty or later; null of other messages."""
    return F.when(checkpoint, F.when(reconnect, "reconnect").when(n_levels == 0, "empty").otherwise("later"))


def statistics(merged: DataFrame) -> DataFrame:
    """One row of counts over merged occurrences (copies, k, late, and n, venue_ms, first_received_ms where they are)."""
    have = set(merged.columns)
    occurrences = F.sum("n") if "n" in have else F.sum(F.size("copies"))
    found = {
        "n_messages": F.count(F.lit(1)),
        "n_occurrences": F.coalesce(occurrences, F.lit(0)).cast("long"),
        "n_repeats_merged": F.coalesce(occurrences, F.lit(0)).cast("long") - F.count(F.lit(1)),
        "n_shared": F.count_if(F.size("copies") > 1),
        "n_single": F.count_if(F.size("copies") == 1),
        "n_late": F.count_if(F.col("late")),
        "n_repeats": F.count_if(F.col("k") > 1),
    }
    if {"venue_ms", "first_received_ms"} <= have:
        found |= {"n_untimed": F.count_if(F.col("venue_ms").isNull()), "n_future": F.count_if(F.col("venue_ms") > F.col("first_received_ms") + LATENESS_MS)}
    return merged.agg(*[c.alias(name) for name, c in found.items()])
