"""Changes, gaps, islands and holes in ordered streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], state: Sequence[str], at: str) -> DataFrame:
    """Rows whose state differs null-safely from the row before, the first included, with `next_at`, the place of the next row of any kind."""
    window = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(*state)).over(window)
    marked = rows.select("*", before.alias("_before"), F.struct(*state).alias("_now"), F.lead(at).over(window).alias("next_at"))
    return marked.where("not (_before <=> _now)").drop("_before", "_now")


def sequence_gaps(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Rows whose sequence isn't the one before plus one: keys, previous, seq, missing (0 where it went back or stood)."""
    before = F.lag(seq).over(Window.partitionBy(*keys).orderBy(seq))
    found = rows.select(*keys, F.col(seq).alias("seq"), before.alias("previous")).where("previous is not null and seq != previous + 1")
    return found.select(*keys, "previous", "seq", F.greatest(F.col("seq") - F.col("previous") - 1, F.lit(0)).alias("missing"))


def islands(rows: DataFrame, keys: Sequence[str], at: str, starts: Column) -> DataFrame:
    """Runs of rows that begin where `starts` holds, or at a key's first row: keys, island (from 1), start, end, n."""
    order = Window.partitionBy(*keys).orderBy(at)
    first = F.row_number().over(order) == 1
    flagged = rows.select(*keys, F.col(at).alias("_at"), (first | F.coalesce(starts, F.lit(False))).cast("int").alias("_new"))
    running = F.sum("_new").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return flagged.select(*keys, "_at", running.alias("island")).groupBy(*keys, "island").agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.count(F.lit(1)).alias("n"))


def holes(intervals: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Stretches between a key's intervals that none covers: keys, hole_start, hole_end."""
    seen = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = intervals.select(*keys, F.max(end).over(seen).alias("hole_start"), F.col(start).alias("hole_end"))
    return reached.where("hole_start is not null and hole_end > hole_start")


def running_max(rows: DataFrame, keys: Sequence[str], order: str, value: str, ranges: int = 64, ties: Sequence[str] = ()) -> DataFrame:
    """Adds `running`: the greatest value of a key's rows up to each, rows of one place included; with `ties`, which order those, up to the row itself.

    Few keys may hold all rows, so each key is cut into ranges of the order (approximate quantiles, one pass): maxima run within a
    range, and the maxima of the ranges before it, of which there are `ranges` a key, are joined to it."""
    cuts = sorted(set(rows.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.001)))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order).cast("double"))) if cuts else F.lit(0)
    cut = rows.withColumn("_range", place)
    tops = cut.groupBy(*keys, "_range").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_range", F.max("_top").over(before).alias("_before"))
    within = Window.partitionBy(*keys, "_range").orderBy(order, *ties)
    within = within.rowsBetween(Window.unboundedPreceding, 0) if ties else within.rangeBetween(Window.unboundedPreceding, 0)
    run = cut.withColumn("_within", F.max(value).over(within))
    return run.join(tops, [*keys, "_range"], "left").withColumn("running", F.greatest("_before", "_within")).drop("_range", "_within", "_before")
