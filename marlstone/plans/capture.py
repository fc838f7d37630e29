"""What a capture is worth: evidence per instrument, completeness with its reasons, coverage windows, staleness and recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reconnections a minute that evidence may hold, and ends of a capture that are failures.
MOST_RECONNECTS = 2.0
FAILURES = ["cancelled", "stream_error", "persistence_error", "finalization_error"]
UNSAVED = ["persistence_error", "finalization_error"]


def instrument_summary(rows: DataFrame, late_ms: float) -> DataFrame:
    """One row of counters over instruments (instrument_id, eligibility_status, established, first_snapshot_latency_ms, snapshots, invalid_snapshots).

    An instrument counts once, by its best attempt."""
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    one = rows.groupBy("instrument_id").agg(
        flag(F.col("eligibility_status") == "eligible").alias("eligible"),
        flag(F.col("eligibility_status") == "ineligible").alias("ineligible"),
        flag(F.col("established")).alias("established"),
        F.min("first_snapshot_latency_ms").alias("latency"),
        F.coalesce(F.sum("snapshots"), F.lit(0)).alias("snapshots"),
        F.coalesce(F.sum("invalid_snapshots"), F.lit(0)).alias("invalid"),
        F.count(F.lit(1)).alias("attempts"),
    )
    seen, denominator = F.col("snapshots") > 0, ~F.col("ineligible") | F.col("eligible")
    return one.agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count_if("eligible").alias("n_eligible"),
        F.count_if(F.col("ineligible") & ~F.col("eligible")).alias("n_ineligible"),
        F.count_if(~F.col("eligible") & ~F.col("ineligible")).alias("n_unknown"),
        F.count_if("established").alias("n_established"),
        F.count_if(F.col("eligible") & F.col("established")).alias("n_eligible_established"),
        F.count_if(seen).alias("n_initial_snapshot"),
        F.count_if(seen & F.col("eligible")).alias("n_eligible_snapshot"),
        F.count_if(seen & (F.col("latency") > late_ms)).alias("n_late"),
        F.count_if(denominator & ~seen).alias("n_missing"),
        F.count_if(denominator).alias("n_denominator"),
        F.count_if(F.col("invalid") > 0).alias("n_with_invalid"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("n_attempts"),
        F.coalesce(F.sum("snapshots"), F.lit(0)).alias("n_snapshots"),
        F.max("latency").alias("longest_latency_ms"),
    ).withColumn("coverage_rate", F.try_divide("n_initial_snapshot", "n_denominator"))


def completeness(runs: DataFrame) -> DataFrame:
    """Adds reconnects_per_minute, execution_status and capture_status, each with its reasons, and status to runs.

    Runs: intent (operational or smoke), terminal_reason, seconds_actual, seconds_requested, n_reconnects, and the counters of instrument_summary.
    Only operational runs are judged by their end and their rate."""
    rate = F.when(F.col("seconds_actual") > 0, F.col("n_reconnects") * 60 / F.col("seconds_actual"))
    judged, end = F.col("intent") == "operational", F.col("terminal_reason")
    due = end == "deadline_reached"
    execution = F.array_compact(
        F.array(
            F.when(end.isin(FAILURES), F.concat(F.lit("terminated via "), end)),
            F.when(judged & ~due, "ended before its deadline"),
            F.when(judged & due & (F.col("seconds_actual") + 0.05 < F.col("seconds_requested")), "shorter than requested"),
            F.when(judged & (rate > MOST_RECONNECTS), "too many reconnections"),
        )
    )
    failed = (
        F.when(end.isin(UNSAVED), "not saved")
        .when(judged & (F.col("n_denominator") > 0) & (F.col("n_initial_snapshot") == 0), "no initial snapshot")
        .when(judged & (F.col("n_eligible") > 0) & (F.col("n_eligible_established") == 0), "no subscription established")
        .when(judged & (F.col("n_eligible") > 0) & (F.col("n_eligible_snapshot") == 0), "no snapshot of an eligible instrument")
    )
    partial = F.array_compact(
        F.array(
            F.when((F.col("n_unknown") > 0) | (F.col("n_late") > 0) | (F.col("n_missing") > 0), F.when(~judged, "smoke coverage is not judged")),
            F.when(F.col("n_unknown") > 0, "unknown eligibility"),
            F.when(F.col("n_late") > 0, "late snapshots"),
            F.when(F.col("n_missing") > 0, "missing snapshots"),
        )
    )
    found = runs.withColumns({"reconnects_per_minute": rate, "execution_reasons": execution, "_failed": failed, "_partial": partial})
    found = found.withColumns(
        {
            "execution_status": F.when(F.size("execution_reasons") > 0, "failed").otherwise("success"),
            "capture_reasons": F.when(F.col("_failed").isNotNull(), F.array("_failed")).otherwise(F.col("_partial")),
            "capture_status": F.when(F.col("_failed").isNotNull(), "failed").when(F.size("_partial") > 0, "partial").otherwise("complete"),
        }
    )
    status = (
        F.when((F.col("execution_status") == "success") & (F.col("capture_status") == "complete"), "success")
        .when(end.isin(UNSAVED) | ((F.col("capture_status") == "failed") & (F.col("n_initial_snapshot") == 0)), "failed")
        .otherwise("partial")
    )
    return found.withColumn("status", status).drop("_failed", "_partial")


def coverage_windows(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stretches in which a feed was covered: keys, window, start, end, n, started_by, ended_by.

    Frames: at, seq, generation, kind (data, error, pause, chunk_gap, end), venue_seq or null. A window ends where the generation changes, at
    markers, and where a venue sequence misses numbers; markers themselves cover nothing."""
    by = Window.partitionBy(*keys).orderBy("seq")
    data = F.col("kind") == "data"
    last = F.last(F.when(data, F.col("venue_seq")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    cause = (
        F.when(F.lag("kind").over(by).isNull(), "begin")
        .when(F.col("generation") != F.lag("generation").over(by), "generation")
        .when(F.lag("kind").over(by) != "data", F.lag("kind").over(by))
        .when(data & (F.col("venue_seq") != last + 1), "seq_gap")
    )
    marked = frames.withColumn("_cause", cause).withColumn("_new", F.col("_cause").isNotNull().cast("int"))
    numbered = marked.withColumn("window", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.coalesce(F.when(~data, F.col("kind")), F.lead("_cause").over(by), F.when(F.lead("kind").over(by) != "data", F.lead("kind").over(by))))
    found = numbered.where(data).groupBy(*keys, "window").agg(
        F.min("at").alias("start"), F.max("at").alias("end"), F.count(F.lit(1)).alias("n"), F.min_by("_cause", "seq").alias("started_by"), F.max_by("_next", "seq").alias("ended_by")
    )
    return found.withColumns({"started_by": F.coalesce("started_by", F.lit("marker")), "ended_by": F.coalesce("ended_by", F.lit("open"))})


def feed_states(books: DataFrame, now: Column, message_age: int, book_age: int) -> DataFrame:
    """Books (shard, book, last_message, last_valid, valid) with state: live, stale_message, stale_book, invalid or missing, and deadline, when that would change."""
    m, b = now - F.col("last_message"), now - F.col("last_valid")
    state = F.when(F.col("last_message").isNull(), "missing").when(m > message_age, "stale_message").when(~F.coalesce("valid", F.lit(False)), "invalid").when(b > book_age, "stale_book").otherwise("live")
    deadline = F.least(F.col("last_message") + message_age, F.col("last_valid") + book_age)
    return books.withColumns({"state": state, "deadline": F.when(state == "live", deadline)})


def shard_summary(states: DataFrame) -> DataFrame:
    """By shard: n and how many books are in each state, and the connection's: live, degraded or down."""
    count = lambda s: F.count_if(F.col("state") == s)
    kinds = ("live", "stale_message", "stale_book", "invalid", "missing")
    found = states.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *[count(s).alias(f"n_{s}") for s in kinds])
    return found.withColumn("connection", F.when(F.col("n_live") == F.col("n"), "live").when(F.col("n_live") > 0, "degraded").otherwise("down"))


def feed_summary(shards: DataFrame) -> DataFrame:
    """One row over all shards."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in shards.columns if c.startswith("n")]
    return shards.agg(F.count(F.lit(1)).alias("shards"), F.count_if(F.col("connection") == "live").alias("shards_live"), F.count_if(F.col("connection") == "down").alias("shards_down"), *sums)


def recovery_actions(states: DataFrame) -> DataFrame:
    """What to do for each shard, with its reason and books: reconnect where all messages are old, else resubscribe what lacks or is invalid."""
    worst = states.groupBy("shard").agg(
        F.count_if(F.col("state") == "stale_message").alias("s"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(F.col("state").isin("invalid", "missing", "stale_book"), F.col("book")))).alias("books")
    )
    action = F.when(F.col("s") == F.col("n"), "reconnect").when(F.size("books") > 0, "resubscribe").otherwise("none")
    reason = F.when(action == "reconnect", "no messages").when(action == "resubscribe", "books to recover")
    return worst.select("shard", action.alias("action"), reason.alias("reason"), F.when(action == "resubscribe", F.col("books")).otherwise(F.array().cast("array<string>")).alias("books"))


def book_checks(rows: DataFrame) -> DataFrame:
    """One row of totals of replayed books against recorded ones: compared, equal, different, late and reconnect ones apart."""
    counted = ~F.col("late") & ~F.col("reconnect")
    return rows.agg(
        F.count_if(counted).alias("n_compared"),
        F.count_if(counted & F.col("equal")).alias("n_equal"),
        F.count_if(counted & ~F.col("equal")).alias("n_different"),
        F.count_if(F.col("late")).alias("n_late"),
        F.count_if(F.col("reconnect") & ~F.col("late")).alias("n_reconnect"),
    )


def polling_gaps(polled: DataFrame, wanted: DataFrame, max_age_ms: int) -> DataFrame:
    """Gap rows of polling cycles, which are numbered in a row (cycle, instrument_id, observed_ms, exchange_ms, received_ms, error): fetch_error, missing or stale."""
    span = polled.agg(F.min("cycle"), F.max("cycle")).first()
    if span[0] is None:
        return polled.sparkSession.createDataFrame([], "cycle long, instrument_id string, reason string, age_ms long")
    cycles = F.sequence(F.lit(span[0]).cast("long"), F.lit(span[1]).cast("long"))
    asked = wanted.select("instrument_id").distinct().select(F.explode(cycles).alias("cycle"), "instrument_id")
    both = asked.join(polled, ["cycle", "instrument_id"], "left")
    age = F.col("observed_ms") - F.coalesce("exchange_ms", "received_ms")
    reason = F.when(F.col("error").isNotNull(), "fetch_error").when(F.col("observed_ms").isNull(), "missing").when(age > max_age_ms, "stale")
    return both.select("cycle", "instrument_id", reason.alias("reason"), F.when(reason == "stale", age).alias("age_ms")).where("reason is not null")
