"""Manifests of runs and datasets: counts, content hashes, verification, lineage, and publication behind a pointer."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.texts import flags
from marlstone.sources.sinks import _fs


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """relative, sha256, size of every Parquet file below a path, read by the tasks."""
    root = _fs(spark, path)[1]
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    plain = F.regexp_replace("path", "^[a-z0-9+.-]+:/*", "/")
    relative = F.when(plain == full, F.element_at(F.split(plain, "/"), -1)).otherwise(F.substring(plain, len(full) + 2, 100_000))
    return whole.select(relative.alias("relative"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))


def tree_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over each file's relative name and its own SHA-256, by name. The driver sees a row per file."""
    found = file_hashes(spark, path).orderBy("relative").toLocalIterator()
    digest, n = hashlib.sha256(), 0
    for row in found:
        digest.update(row.relative.encode())
        digest.update(bytes.fromhex(row.sha256))
        n += 1
    if not n:
        raise FileNotFoundError(f"no Parquet files under {path}")
    return digest.hexdigest()


def values_hash(rows: DataFrame, column: str, *, skip_blank: bool = False) -> str:
    """SHA-256 of the JSON array of a column's sorted distinct trimmed values, as a stream: the array itself is never held."""
    value = F.coalesce(F.trim(F.col(column).cast("string")), F.lit(""))
    found = rows.select(value.alias("value")).distinct()
    digest, first = hashlib.sha256(b"["), True
    for row in (found.where("value != ''") if skip_blank else found).orderBy("value").toLocalIterator():
        digest.update(("" if first else ",").encode() + json.dumps(row.value).encode())
        first = False
    digest.update(b"]")
    return digest.hexdigest()


def content_digest(rows: DataFrame) -> DataFrame:
    """One row: n_rows and a digest of the rows that no order changes, of columns by name."""
    named = sorted(rows.columns)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*named).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def dataset_counts(rows: DataFrame, venue: str | None = None, instrument: str | None = None, flag: str | None = None) -> dict:
    """Rows, rows by venue, instruments and flags of a dataset: what a manifest tells of it."""
    found: dict = {"rows": rows.count()}
    if venue in rows.columns:
        found["venues"] = {r[0]: r[1] for r in rows.groupBy(venue).count().orderBy(venue).collect()}
    if instrument in rows.columns:
        found["instruments"] = rows.select(instrument).distinct().count()
    if flag in rows.columns:
        each = F.col(flag) if dict(rows.dtypes)[flag].startswith("array") else flags(F.col(flag))
        found["flags"] = {r[0]: r[1] for r in rows.select(F.explode(each).alias("f")).groupBy("f").count().orderBy("f").collect()}
    return found


def dataset_stats(rows: DataFrame, flag: str = "quality_flags") -> dict:
    """What `dataset stats` prints: rows, columns, rows by schema version, flags."""
    found = dataset_counts(rows, flag=flag) | {"columns": rows.columns}
    if "schema_version" in rows.columns:
        found["schema_versions"] = {r[0]: r[1] for r in rows.groupBy("schema_version").count().orderBy("schema_version").collect()}
    return found


def build(spark: SparkSession, run_id: str, datasets: dict[str, str], **told) -> dict:
    """A run's manifest: for each dataset its path, rows, schema and tree hash, beside what the caller tells of the run."""
    tables = {}
    for name, path in sorted(datasets.items()):
        rows = spark.read.parquet(path)
        tables[name] = {"path": path, "rows": rows.count(), "schema": json.loads(rows.schema.json()), "tree_sha256": tree_hash(spark, path)}
    return {"run_id": run_id, "datasets": tables, **told}


def problems(spark: SparkSession, manifest: dict, *, content: bool = True) -> list[str]:
    """What of a manifest isn't so: missing datasets, row counts, schemas and, with `content`, hashes."""
    found = []
    for name, said in manifest["datasets"].items():
        fs, at = _fs(spark, said["path"])
        if not fs.exists(at):
            found.append(f"{name}: missing")
            continue
        rows = spark.read.parquet(said["path"])
        if json.loads(rows.schema.json()) != said["schema"]:
            found.append(f"{name}: another schema")
        if rows.count() != said["rows"]:
            found.append(f"{name}: another number of rows")
        if content and tree_hash(spark, said["path"]) != said["tree_sha256"]:
            found.append(f"{name}: another content")
    return found


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Writes beside the file and renames it over."""
    fs, at = _fs(spark, f"{path}.new")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    out.close()
    target = _fs(spark, path)[1]
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(at, target):
        raise OSError(f"cannot move {path} into place")


def put(spark: SparkSession, path: str, **values) -> dict:
    """Sets keys of a JSON file of metadata."""
    whole = (read_json(spark, path) or {}) | values
    write_json(spark, path, whole)
    return whole


def manifest_hash(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def publish(spark: SparkSession, pointer: str, manifest: dict, *, parent: str | None) -> str:
    """Makes a manifest the current one if `parent` still is; else another publication came first, and this is an error.

    The manifest goes to a file of its own name beside the pointer, the pointer names it by its hash."""
    now = read_json(spark, pointer)
    if (now or {}).get("manifest_sha256") != parent:
        raise RuntimeError("the parent is no longer current")
    linked = manifest | {"parent": parent}
    digest = manifest_hash(linked)
    write_json(spark, str(PurePosixPath(pointer).parent / f"{digest}.json"), linked)
    write_json(spark, pointer, {"manifest_sha256": digest})
    return digest


def lineage(load: Callable[[str], dict | None], head: str, until: str | None = None) -> list[dict]:
    """The manifests from `until` (or the first) to the head, the oldest first; a missing link, a cycle or a hash that doesn't fit is an error."""
    found, seen, at = [], set(), head
    while at is not None:
        if at in seen:
            raise ValueError(f"the lineage has a cycle at {at}")
        seen.add(at)
        manifest = load(at)
        if manifest is None:
            raise ValueError(f"the lineage lacks {at}")
        if manifest_hash(manifest) != at:
            raise ValueError(f"{at} was changed")
        found.append(manifest)
        if at == until:
            break
        at = manifest.get("parent")
    else:
        if until is not None:
            raise ValueError(f"{until} is not in the lineage")
    return found[::-1]


def segments(spark: SparkSession, path: str, closed: Sequence[str] | None = None) -> DataFrame:
    """A dataset's rows: of the segments that its `_segments.json`, or the caller, calls closed; of all files without either."""
    if closed is None:
        said = read_json(spark, f"{path}/_segments.json")
        closed = None if said is None else [s["name"] for s in said["segments"] if s["state"] == "closed"]
    return spark.read.parquet(path) if closed is None else spark.read.parquet(*[f"{path}/{name}" for name in closed])


def constraint_problems(snapshots: DataFrame, levels: DataFrame, trades: DataFrame) -> DataFrame:
    """problem, n of a recording: keys, orphans, sides, prices, quantities, level counts and trade ids."""
    key = ["run_id", "snapshot_id"]
    counts = [
        snapshots.groupBy(*key).count().where("count > 1").agg(F.lit("snapshot key").alias("problem"), F.count(F.lit(1)).alias("n")),
        levels.join(snapshots.select(*key).distinct(), key, "left_anti").agg(F.lit("level without snapshot").alias("problem"), F.count(F.lit(1)).alias("n")),
        levels.groupBy(*key, "side", "price").count().where("count > 1").agg(F.lit("level key").alias("problem"), F.count(F.lit(1)).alias("n")),
        levels.where("not coalesce(side in ('bid', 'ask'), false) or not coalesce(price between 0 and 1, false) or not coalesce(quantity > 0, false)").agg(F.lit("level values").alias("problem"), F.count(F.lit(1)).alias("n")),
        trades.where("venue_trade_id is not null").groupBy("run_id", "venue", "venue_trade_id").count().where("count > 1").agg(F.lit("trade id").alias("problem"), F.count(F.lit(1)).alias("n")),
    ]
    found = counts[0]
    for one in counts[1:]:
        found = found.union(one)
    return found.where("n > 0")


def reconciled_snapshots(snapshots: DataFrame, levels: DataFrame) -> DataFrame:
    """Snapshots whose bid or ask levels aren't as many as their header says."""
    key = ["run_id", "snapshot_id"]
    sides = levels.groupBy(*key).agg(F.count_if(F.col("side") == "bid").alias("bids"), F.count_if(F.col("side") == "ask").alias("asks"))
    joined = snapshots.join(sides, key, "left").select(*key, "bid_count", "ask_count", F.coalesce("bids", F.lit(0)).alias("bids"), F.coalesce("asks", F.lit(0)).alias("asks"))
    return joined.where("not (bid_count <=> bids) or not (ask_count <=> asks)")
