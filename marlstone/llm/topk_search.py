"""Exact top-k inner-product search, block at a time.

Vectors count as documents and dimensions as terms. Candidates lie in blocks of consecutive ids, each with a
forward index (its rows) and the maxima and minima of every dimension. For a query, a block's bound is the sum
over dimensions of the larger of the query's value times the maximum or minimum. Blocks are scored in
the order of their bounds until a bound falls below the query's k-th score, and ties at it are still scored.

The stated query set meets all rows in tiles: a tile has up to `TILE` queries, and a group has about `GROUP` blocks, so a task
holds some tiles and one group. All tiles meet one group first; the k-th scores found there are where the other
groups begin, so a block that can't beat them is never scored. The best k of each tile and group are merged by rank.

Vectors that are null, or hold null or non-finite components, take no part, nor do null ids; equal rows count once,
and rows of a query's id are the query's own. Shorter vectors count as ending in zeros. An empty table gives no rows.
Components beyond a long count as its limits. Scores are compared exactly; one beyond a long is returned as its limit.
Columns other than vec_id and embedding play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import shards, staged

BLOCK, GROUP, TILE = 512, 16, 4096


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, floor(256 * x) of each component as long; only vectors that take part, each once."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    part = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return part.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v")).distinct()


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """part, n, dim, ids and values (packed 64-bit integers): consecutive rows in the order of ids."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[int]]] = []

        def table(rows: list[tuple[int, list[int]]]) -> pa.RecordBatch:
            dim = max(len(v) for _, v in rows)
            values = np.array([[*v, *[0] * (dim - len(v))] for _, v in rows], "<i8")
            ids = np.array([k for k, _ in rows], "<i8")
            return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["n", "dim", "ids", "values"])

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            while len(held) >= size:
                yield table(held[:size])
                held = held[size:]
        if held:
            yield table(held)

    return rows.repartitionByRange(shards(rows), "vec_id").sortWithinPartitions("vec_id").mapInArrow(go, "n int, dim int, ids binary, values binary")


def _unpacked(frame: pd.DataFrame, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for n, d, ids, values in zip(frame["n"], frame["dim"], frame["ids"], frame["values"]):
        matrix = np.zeros((n, dim), np.int64)
        matrix[:, :d] = np.frombuffer(values, "<i8").reshape(n, d)
        out.append((np.frombuffer(ids, "<i8"), matrix))
    return out


def best_of(query_ids: np.ndarray, queries: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], k: int, floors: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of each query's best k among the blocks, by pruning, and the (query, block) scorings that it took.

    `floors` has k-th scores that are known of queries: what scores less may be missing then.
    """
    largest = float(np.abs(queries.astype(float)).max(initial=0)) * max(float(np.abs(m.astype(float)).max(initial=0)) for _, m in found) * max(1, queries.shape[1])
    kind = np.float64 if largest < 2**53 else object  # sums of whole numbers below 2^53 are exact
    q = queries.astype(kind)
    tops = np.array([m.max(axis=0) for _, m in found]).astype(kind)
    lows = np.array([m.min(axis=0) for _, m in found]).astype(kind)
    bound = np.maximum(q, 0) @ tops.T + np.minimum(q, 0) @ lows.T
    order = np.argsort(-bound, axis=1, kind="stable")
    none = -float("inf")
    floor = np.array([(floors or {}).get(x, none) for x in query_ids.tolist()], kind)
    scores = np.full((len(q), k), none, kind)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)
    alive, scored = np.arange(len(q)), 0
    for turn in range(len(found)):
        at = order[alive, turn]
        on = np.asarray((bound[alive, at] >= scores[alive, -1]) & (bound[alive, at] >= floor[alive]), bool)
        alive, at = alive[on], at[on]
        if not len(alive):
            break
        scored += len(alive)
        for b in np.unique(at):
            rows = alive[at == b]
            names, matrix = found[b]
            got = q[rows] @ matrix.astype(kind).T
            got[query_ids[rows][:, None] == names[None, :]] = none
            both = np.concatenate([scores[rows], got], axis=1)
            named = np.concatenate([ids[rows], np.broadcast_to(names, got.shape)], axis=1)
            if kind is object:
                picked = np.array([sorted(range(both.shape[1]), key=lambda j, r=r: (-both[r, j], named[r, j]))[:k] for r in range(len(rows))])
            else:
                picked = np.lexsort((named, -both), axis=-1)[:, :k]
            scores[rows] = np.take_along_axis(both, picked, 1)
            ids[rows] = np.take_along_axis(named, picked, 1)
    row, slot = np.nonzero((scores != none) & (scores >= floor[:, None]))
    return row, ids[row, slot], scores[row, slot], scored


def _longs(scores: np.ndarray) -> list[int]:
    """Scores as longs, those beyond as its limits."""
    return [min(max(int(s), -(2**63)), 2**63 - 1) for s in scores.tolist()]


BEST = "query_id long, vec_id long, score long, exact string"


def _ordered(scores: np.ndarray) -> list[str]:
    """Scores as texts of their order, so that ones beyond a long are still merged by rank."""
    return [f"{int(s) + 2**160:050d}" for s in scores.tolist()]


def met(tiles: DataFrame, held: DataFrame, n_tiles: int, k: int, groups: range) -> DataFrame:
    """BEST of each tile (with `floors`) and each of the groups of blocks."""

    def go(key: tuple, asked_part: pd.DataFrame, held_part: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple] = []
        if len(held_part):
            for (_, tile) in asked_part.iterrows():
                dim = int(max(tile["dim"], held_part["dim"].max()))
                ((query_ids, queries),) = _unpacked(pd.DataFrame([tile]), dim)
                floors = dict(zip(*np.frombuffer(tile["floors"], "<i8").reshape(2, -1).tolist())) if tile["floors"] is not None else None
                row, ids, scores, _ = best_of(query_ids, queries, _unpacked(held_part, dim), k, floors)
                made += zip(query_ids[row].tolist(), ids.tolist(), _longs(scores), _ordered(scores))
        return pd.DataFrame(made, columns=["query_id", "vec_id", "score", "exact"])

    part = held.where(F.col("g").between(groups[0], groups[-1]))
    left = tiles.select("bucket", "n", "dim", "ids", "values", "floors", F.explode(F.sequence(F.lit(groups[0]), F.lit(groups[-1]))).alias("g"))
    right = part.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("bucket"))
    return left.groupBy("bucket", "g").cogroup(right.groupBy("bucket", "g")).applyInPandas(go, BEST)


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank int (from 1), vec_id, score long: for each row that is a query its k best other rows, ties to the smaller id."""
    rows = staged(quantised(vectors), "vectors")
    held = staged(blocks(rows, BLOCK), "blocks")
    asked = staged(blocks(rows.where(is_query), TILE), "queries")
    groups, n_tiles = max(1, -(-held.count() // GROUP)), asked.count()
    if not n_tiles:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    held = held.select("*", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("g"))
    tiles = asked.select("*", F.pmod(F.xxhash64("ids"), F.lit(n_tiles)).cast("int").alias("bucket"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id"))
    best = staged(met(tiles.withColumn("floors", F.lit(None).cast("binary")), held, n_tiles, k, range(1)), "first")
    if groups > 1:
        reached = best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(f"n = {k} and abs(floor) < {2**62}")
        best = best.union(met(floored(tiles, reached), held, n_tiles, k, range(1, groups)))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def floored(tiles: DataFrame, reached: DataFrame) -> DataFrame:
    """The tiles with `floors`: their queries' ids and k-th scores, packed."""

    def go(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        packed = np.array([frame["query_id"].tolist(), frame["floor"].tolist()], "<i8").tobytes()
        return pd.DataFrame({"name": [key[0]], "floors": [packed]})

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), name)), pa.array(held)], ["name", "query_id"])

    named = tiles.withColumn("name", F.xxhash64("ids"))
    of = named.select("name", "ids").mapInArrow(names, "name long, query_id long").distinct()
    known = of.join(reached, "query_id").groupBy("name").applyInPandas(go, "name long, floors binary")
    return named.join(known, "name", "left")
