"""Null-safe reconciliation of two tables, set partitions and multisets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-12


def differs(a: Column, b: Column, numeric: bool) -> Column:
    """Distinct from each other; numbers by more than the tolerance."""
    if not numeric:
        return ~a.eqNullSafe(b)
    return F.when(a.isNull() | b.isNull(), ~a.eqNullSafe(b)).otherwise(F.abs(a - b) > TOLERANCE)


def reconcile(source: DataFrame, derived: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer join on null-safe keys: the keys, status (match, mismatch, missing, extra), and s_ and d_ values."""
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in (*keys, *values)], F.lit(True).alias("_s"))
    d = derived.select(*[F.col(c).alias(f"d_{c}") for c in (*keys, *values)], F.lit(True).alias("_d"))
    same = F.lit(True)
    for c in keys:
        same &= F.col(f"s_{c}").eqNullSafe(F.col(f"d_{c}"))
    unequal = F.lit(False)
    for c in values:
        unequal |= differs(F.col(f"s_{c}"), F.col(f"d_{c}"), isinstance(source.schema[c].dataType, T.NumericType))
    status = F.when(F.col("_d").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(unequal, "mismatch").otherwise("match")
    named = [F.when(F.col("_s").isNotNull(), F.col(f"s_{c}")).otherwise(F.col(f"d_{c}")).alias(c) for c in keys]
    return s.join(d, same, "full_outer").select(*named, status.alias("status"), *[F.col(f"{side}_{c}") for c in values for side in "sd"])


def partition_check(whole: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """Rows that break a partition of whole into parts, with `problem`: uncovered, foreign or shared."""
    both = parts[0].distinct()
    shared = None
    for part in parts[1:]:
        common = both.intersect(part)
        shared = common if shared is None else shared.union(common)
        both = both.union(part).distinct()
    found = whole.subtract(both).withColumn("problem", F.lit("uncovered")).union(both.subtract(whole).withColumn("problem", F.lit("foreign")))
    return found if shared is None else found.union(shared.distinct().withColumn("problem", F.lit("shared")))


def multiset_union(rows: DataFrame, stream: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The union of streams that keeps each item as often as the stream that has it most often: keys, k, streams (sorted)."""
    k = F.row_number().over(Window.partitionBy(stream, *keys).orderBy(*order))
    return rows.select(stream, *keys, k.alias("k")).groupBy(*keys, "k").agg(F.array_sort(F.collect_set(stream)).alias("streams"))
