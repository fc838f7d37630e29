"""As-of joins as one window over the union of both sides: no range join, no Cartesian product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, *, forward: bool = False, prefix: str = "r_", tie: Sequence[str] = ()) -> DataFrame:
    """Each left row with the last right row at or before it (forward: the first at or after it), by the `on` columns.

    Right columns come out under `prefix`; all null where nothing matches. One shuffle, on the keys.
    Of right rows at one place the last by the `tie` columns is taken (forward: the first), or by all their columns if none are
    named; keys and places are compared as they are, nulls match nothing.
    """
    payload = [c for c in right.columns if c not in on]
    keys = [F.col(c) for c in on]
    rights = right.where(F.col(right_at).isNotNull()).select(
        *keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*payload).alias("_right"), F.struct(*(tie or payload)).alias("_tie"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left")
    )
    lefts = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(rights.schema["_right"].dataType).alias("_right"), F.lit(None).cast(rights.schema["_tie"].dataType).alias("_tie"), F.struct("*").alias("_left"))
    order = [F.col("_at").desc(), F.col("_side"), F.col("_tie").desc()] if forward else [F.col("_at"), F.col("_side"), F.col("_tie")]
    window = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    usable = F.lit(True)
    for c in on:
        usable &= F.col(c).isNotNull()
    found = rights.unionByName(lefts).withColumn("_match", F.when(usable & F.col("_at").isNotNull(), F.last("_right", ignorenulls=True).over(window)))
    return found.where("_side = 1").select("_left.*", *[F.col("_match").getField(c).alias(prefix + c) for c in payload])
