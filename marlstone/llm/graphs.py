"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum per node and an equi-join, so a node with very many links meets
its minimum, never a list of its neighbours. Every step is written to the shared folder, which cuts the
lineage; only two sums a step reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import staged


def _both(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _step(links: DataFrame) -> DataFrame:
    # large star: a node's larger neighbours go to its smallest, itself included
    sides = _both(links)
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    # small star: a node and its smaller neighbours go to the smallest of them
    small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = small.groupBy("a").agg(F.min("b").alias("m"))
    moved = small.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
    return moved.select("l.*").where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label for each node of links (a, b): label is the smallest node that can be reached. Nodes of one orderable type."""
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    mark = None
    while True:
        # equal sets of links in two steps running: every node then points at its label
        sums = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark or not sums[0]:
            break
        mark = tuple(sums)
        now = staged(_step(now), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b"), F.col("b")).distinct())
