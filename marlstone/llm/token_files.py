"""Token files: flat unsigned integers with 64-bit document offsets, memory-mapped on reading.

A corpus is a folder of shards. `part-N.ids` holds the ids of a shard's documents in a row, as unsigned
16-bit integers where the vocabulary allows it and 32-bit ones otherwise, little-endian and without a header.
`part-N.offsets` holds unsigned 64-bit integers: n + 1 offsets into the ids, then the n document ids
(signed; the smallest long stands for null). Shards are ranges of doc_id, so their order is the corpus's
order, and a shard's base, the number of ids before it, is a prefix sum over the shards' sizes.

Each shard is written by one task under a name of its own and moved into place, so a task that runs again
writes the same bytes. The folder must be in the shared folder of the cluster and reachable as a file path.
Null texts count as empty and null ids come first. Rows of one id are ordered by the first characters of their texts, and
then by their place in the table, and may lie in several shards, so an id of very many rows is split; rows are never merged.
Texts of any length are encoded whole, an empty table writes no ids and gives no rows, and columns other than doc_id and
text play no part.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.llm.common import shards, shared_dir

NULL_ID = -(2**63)
SHARDS = "shard int, path string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def local_path(uri: str) -> str:
    """The file path of a shared folder that is mounted on every machine."""
    scheme, _, rest = uri.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"token files need a mounted folder, not {uri}")
    return "/" + rest.lstrip("/")


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, width: int = 2) -> DataFrame:
    """Writes the shards into `folder`; a lazy frame of one row per shard, whose action does the writing."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokens.rest:
            yield from written(batches)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = tokens.encoder(vocabulary).encode, TaskContext.get().partitionId()
        os.makedirs(folder, exist_ok=True)
        path, own = f"{folder}/part-{shard:06d}", uuid.uuid4().hex
        offsets, ids, at = [0], [], 0
        with open(f"{path}.{own}.ids", "wb") as out:
            for batch in (whole.slice(k, 4000) for whole in batches for k in range(0, len(whole), 4000)):
                for doc_id, found in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    values = np.append(np.frombuffer(found, "<u4"), np.uint32(end_id))
                    if width == 2 and values.max() > 0xFFFF:
                        raise ValueError("an id needs more than 16 bits: write with width=4")
                    out.write(values.astype(kind).tobytes())
                    at += len(values)
                    offsets.append(at)
                    ids.append(NULL_ID if doc_id is None else doc_id)
        with open(f"{path}.{own}.offsets", "wb") as out:
            out.write(np.array(offsets, "<u8").tobytes())
            out.write(np.array(ids, "<i8").tobytes())
        for end in ("ids", "offsets"):
            os.replace(f"{path}.{own}.{end}", f"{path}.{end}")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([at], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    # samples of the range's keys reach the driver, so the key holds a text's beginning only
    keys = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first(), F.col("place").asc()]
    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")).repartitionByRange(shards(docs), *keys)
    return placed.sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(run, SHARDS)


def read(spark: SparkSession, shards: list[tuple[int, str, int, int]], width: int = 2) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    base, rows = 0, []
    for _, path, n_docs, n_ids in sorted(shards):
        if n_docs:
            rows.append((path, n_docs, n_ids, base))
        base += n_ids
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                n = shard["n_docs"]
                head = np.memmap(f"{shard['path']}.offsets", "<u8", "r")
                ids = np.memmap(f"{shard['path']}.ids", kind, "r") if shard["n_ids"] else np.empty(0, kind)
                if len(head) != 2 * n + 1 or len(ids) != shard["n_ids"]:
                    raise ValueError(f"{shard['path']} is not whole")
                offsets, names = head[: n + 1].astype(np.int64), head[n + 1 :].view("<i8")
                for a in range(0, n, 10_000):
                    cut = offsets[a : a + 10_001]
                    crcs = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(cut[:-1], cut[1:])]
                    named = np.array(names[a : a + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(named, pa.int64(), mask=named == NULL_ID), pa.array(cut[:-1] + shard["base"]), pa.array(np.diff(cut)), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    frame = spark.createDataFrame(rows, "path string, n_docs long, n_ids long, base long")
    return frame.repartition(max(1, len(rows))).mapInArrow(run, READ)


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Writes a corpus to the shared folder and returns what its files hold. The driver sees a row per shard."""
    spark = docs.sparkSession
    folder = f"{local_path(shared_dir(spark))}/tokens-{uuid.uuid4().hex}"
    shards = [tuple(r) for r in write(docs, folder, vocabulary, end_id).collect()]
    return read(spark, shards)
