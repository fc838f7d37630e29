"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, substring dedup, packing.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, n_chars counting the code points of the text as it
then is. Documents of which a stage leaves nothing go; ones that were empty before stay as they are. Null ids stay null
and are never anyone's copy; an empty table gives an empty table; further columns of documents are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import line_dedup, near_dedup, packing, quality_rules, substring_dedup
from marlstone.llm.common import DOCUMENT_COLUMNS, staged, table
from marlstone.llm.queries import vocabulary

CARRIED = ["lang", "source"]


def documents(frame: DataFrame) -> DataFrame:
    return frame.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass version v1 of the quality policy."""
    return quality_rules.keep_good(docs.select(*DOCUMENT_COLUMNS), "v1")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that stand earlier in the corpus."""
    left = line_dedup.dedup_lines(docs, CARRIED)
    return documents(left.where("n_removed_lines < n_lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: shingles of five words, similarity of 0.8 or more. Rows go by doc_id and text."""
    found = near_dedup.near_duplicates(docs, size=5, percent=80)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone"), F.col("h").alias("gone_h")).distinct()
    same = (F.col("doc_id") == F.col("gone")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("gone_h"))
    return docs.join(gone, same, "left_anti").select(*DOCUMENT_COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows of 35 words that stand at several places."""
    left = substring_dedup.without_repeats(docs, carry=CARRIED)
    return documents(left.where("n_words = 0 or n_removed < n_words"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens, packed into sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("packing", packed),
]

#: SQL has no tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
