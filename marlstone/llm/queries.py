"""The registered queries of the ten operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import html_extraction, line_dedup, near_dedup, packing, quality_rules, sentence_pieces, substring_dedup, token_files, topk_search, url_filters
from marlstone.llm.common import table, words_of

URL_RULES = [
    url_filters.path_rule("allow", "org/"),
    url_filters.path_rule("block", "example.org/es/"),
    url_filters.path_rule("block", "example.org/en/1"),
    url_filters.path_rule("allow", "com/fr/"),
    url_filters.path_rule("block", "com/de/"),
    *url_filters.PATTERNS,
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.array_join(words_of(F.col("text")), " "), 256)
    return left.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.stored(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"),
        quality_rules.passes("v1").alias("kept"),
        F.col("failures"),
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), vocabulary())


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_packing": op3_packing,
    "op4_url_filters": op4_url_filters,
    "op5_topk_search": op5_topk_search,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_files": op9_token_files,
    "op10_sentence_pieces": op10_sentence_pieces,
}
