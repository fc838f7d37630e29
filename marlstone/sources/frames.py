"""Raw capture frames: gzipped JSON lines of venue messages, decoding, gaps between chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME = (
    "schema string, venue string, recording_id string, connection_generation int, local_frame_seq long, received_utc string,"
    " received_monotonic_ns long, frame_type string, direction string, payload_raw string"
)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME).json(path).select("*", F.col("_metadata.file_path").alias("chunk"))


def messages(frames: DataFrame) -> DataFrame:
    """One row per venue message of the received text frames: list payloads give a row each with their position; payloads that aren't JSON one with parsed false."""
    text = frames.where("frame_type = 'text' and direction = 'received'")
    parsed = text.withColumn("_json", F.try_parse_json("payload_raw")).withColumn("_is_list", F.col("payload_raw").rlike(r"^\s*\["))
    items = F.when(F.col("_json").isNotNull() & F.col("_is_list"), F.from_json("payload_raw", "array<string>")).otherwise(F.array("payload_raw"))
    rows = parsed.select(*frames.columns, F.col("_json").isNotNull().alias("parsed"), "_is_list", F.posexplode(items).alias("position", "message"))
    return rows.withColumn("position", F.when(F.col("parsed") & F.col("_is_list"), F.col("position"))).drop("_is_list", "payload_raw")


def chunk_gaps(manifest: DataFrame) -> DataFrame:
    """Breaks between a recording's chunks (recording_id, chunk, first_frame_seq, last_frame_seq, sha256, previous_chunk_sha256): missing frames or a broken hash chain."""
    order = Window.partitionBy("recording_id").orderBy("first_frame_seq")
    rows = manifest.select("*", F.lag("last_frame_seq").over(order).alias("_last"), F.lag("sha256").over(order).alias("_hash"))
    found = rows.where("_last is not null and (first_frame_seq != _last + 1 or not (previous_chunk_sha256 <=> _hash))")
    return found.select("recording_id", "chunk", F.col("_last").alias("after"), F.col("first_frame_seq").alias("before"), (F.col("previous_chunk_sha256").eqNullSafe(F.col("_hash"))).alias("chained"))
