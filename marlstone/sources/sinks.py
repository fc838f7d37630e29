"""Writes that appear whole or not at all, partitioned segments and verified exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.validation import Spec, convert


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_atomic(rows: DataFrame, path: str, *, overwrite: bool = False, spec: Spec | None = None, partition_by: Sequence[str] = ()) -> None:
    """Writes beside the target and renames; with a specification only what converts without loss is written.

    An overwritten target moves aside first and comes back if the new one can't take its place."""
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex}.staging"
    writer = (convert(rows, spec) if spec else rows).write.option("compression", "zstd")
    writer.partitionBy(*partition_by).parquet(staging) if partition_by else writer.parquet(staging)
    aside = _fs(spark, f"{staging}.replaced")[1]
    replaced = fs.exists(target) and fs.rename(target, aside)
    if not fs.rename(_fs(spark, staging)[1], target):
        if replaced:
            fs.rename(aside, target)
        raise OSError(f"cannot move the staged write to {path}")
    if replaced:
        fs.delete(aside, True)


def append_segments(rows: DataFrame, path: str, partition_by: Sequence[str] = ("exchange", "date"), max_rows: int = 50_000) -> None:
    rows.write.option("maxRecordsPerFile", max_rows).option("compression", "zstd").mode("append").partitionBy(*partition_by).parquet(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", "true").csv(path)


def export_verified(rows: DataFrame, path: str) -> dict:
    """Writes, reads back, and fails unless rows and their order-free digest agree; returns the manifest, which it also writes."""
    spark = rows.sparkSession
    digest = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("*").cast("decimal(38,0)")).alias("digest")]
    write_atomic(rows, path)
    back = spark.read.parquet(path)
    want, got = rows.agg(*digest).first(), back.select(*rows.columns).agg(*digest).first()
    if want != got or [f.dataType for f in rows.schema] != [back.schema[f.name].dataType for f in rows.schema]:
        raise OSError(f"{path} differs from what was written")
    manifest = {"rows": want["n"], "digest": str(want["digest"]), "columns": rows.columns}
    fs, at = _fs(spark, f"{path.rstrip('/')}/_manifest.json")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return manifest
