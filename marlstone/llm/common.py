"""Shared pieces: table access, shared scratch tables, the word and line conventions."""

from __future__ import annotations

import ctypes
import math
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, as a character class of Java, Python and DuckDB patterns.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Unset, it is set here: to a temporary folder if the master is local, where driver and executors are one process,
    and otherwise to a folder in the warehouse, which a cluster shares.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if (spark.conf.get("spark.master", None) or "").startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # a static setting in some versions: remembered on the context instead
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext.getCheckpointDir() or base
    return base.rstrip("/")


def shards(df: DataFrame, each: int = 256 << 20) -> int:
    """Tasks for a shuffle of a frame's rows: the session's number, or more where the tables that it reads hold more than `each` bytes a task."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(n for n in sizes if n < 1 << 60)  # above: Spark's mark of an unknown size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(known / each))


Batches = Iterator[pa.RecordBatch]


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`run` for mapInArrow, which gives freed memory back when a task ends: workers live on between tasks."""

    def go(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            trim()

    return go


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and about `size` bytes of the texts in `column`; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(batch):
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


class Rest:
    """A worker's tables stay from task to task, and go when it has had no task for `AFTER` seconds."""

    AFTER = 3.0

    def __init__(self, clear: Callable[[], None]):
        self.clear, self.lock, self.tasks, self.timer = clear, threading.Lock(), 0, None

    def __enter__(self) -> None:
        with self.lock:
            self.tasks += 1
            if self.timer:
                self.timer.cancel()

    def __exit__(self, *_) -> None:
        with self.lock:
            self.tasks -= 1
            self.timer = threading.Timer(self.AFTER, self.idle)
            self.timer.daemon = True
            self.timer.start()

    def idle(self) -> None:
        with self.lock:
            if not self.tasks:
                self.clear()
                trim()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the frame to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def has_word(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS)) != ""
