"""Parquet datasets as SQL views, and ad-hoc SQL over them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Literals, quoted names and comments, which are kept as they are, or a star's exclusion.
_LITERAL = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/)|\*\s+exclude\s*\(""", re.I | re.S)


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a view name: {name!r}")
    return name


def _existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths, each checked with the file system that holds it; globs must match something."""
    if not paths:
        raise ValueError("no paths are given")
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        if found is None or not len(found):
            raise FileNotFoundError(path)
    return list(paths)


def read_parquet(spark: SparkSession, paths: str | Sequence[str], *, by_name: bool = True, hive_partitions: bool = True) -> DataFrame:
    known = _existing(spark, [paths] if isinstance(paths, str) else paths)
    reader = spark.read.option("mergeSchema", str(by_name).lower())
    return (reader if hive_partitions else reader.option("recursiveFileLookup", "true")).parquet(*known)


def with_file(rows: DataFrame) -> DataFrame:
    """Adds the file and the row's place in it."""
    return rows.select("*", F.col("_metadata.file_path").alias("filename"), F.col("_metadata.row_index").alias("file_row_number"))


def register(spark: SparkSession, name: str, paths: str | Sequence[str], *, by_name: bool = True) -> None:
    read_parquet(spark, paths, by_name=by_name).createOrReplaceTempView(check_name(name))


def register_all(spark: SparkSession, datasets: Mapping[str, str | Sequence[str]]) -> None:
    if not datasets:
        raise ValueError("no datasets are given")
    for name, paths in datasets.items():
        register(spark, name, paths)


def describe(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    schema = read_parquet(spark, paths).schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "column_name string, column_type string")


def query(spark: SparkSession, sql: str, datasets: Mapping[str, str | Sequence[str]], limit: int = 0) -> DataFrame:
    """SQL over datasets by name, in a session of its own. `* EXCLUDE` outside literals is taken for `* EXCEPT`; a limit of 0 is none."""
    own = spark.newSession()
    register_all(own, datasets)
    found = own.sql(_LITERAL.sub(lambda m: m[0] if m[1] else "* EXCEPT (", sql))
    return found.limit(limit) if limit else found


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: parquet, csv (with a header) or JSON lines."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return read_parquet(spark, path)
    if suffix == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if suffix in ("jsonl", "ndjson", "json"):
        return spark.read.json(path)
    raise ValueError(f"unknown kind of table: {path}")
