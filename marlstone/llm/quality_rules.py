"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one long of failure
bits (bit set: the rule fails). A policy is a versioned set of rules, that is a mask; applying one, or
counting what each rule rejects alone, is bitwise work on the ledger and never looks at a text again.

Everything is row-wise DataFrame work: no shuffle, no Python. Repeated windows of words are found by 64-bit keys and
confirmed by their words; a text where keys of different words meet is compared by words throughout.
Null texts count as empty, texts of any length are measured whole, null ids are ids like others. Rows are
judged one by one, so repeated rows get equal results, an empty table gives an empty ledger, and columns other than doc_id
and text play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import has_word, staged, words_of

SYMBOLS = "#*$%&|<>"

#: Rule name -> failure condition over the measurements. The position is the bit, so rules are only ever appended.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Policy version -> the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    return sum(BIT[rule] for rule in POLICIES[policy])


#: Whether neighbours among the windows that met by hash differ in their words. If so, windows are compared by the words themselves.
_MIXED = (
    "exists(transform(ks, (x, i) -> named_struct('a', cast(x & ~high as int), 'b', if(i > 0 and ((x ^ ks[i - 1]) & high) = 0, cast(ks[i - 1] & ~high as int), null))),"
    " y -> y.b is not null and not (words[y.a] = words[y.b] and words[y.a + 1] = words[y.b + 1] and words[y.a + 2] = words[y.b + 2]))"
)
_SORTED = "sort_array(transform(sequence(0, size(words) - 3), i -> named_struct('w', concat(words[i], ' ', words[i + 1], ' ', words[i + 2]), 'p', i)))"
_BY_WORDS = (
    f"aggregate(array({_SORTED}), cast(array() as array<int>), (none, ws) -> array_sort(transform("
    "filter(ws, (x, i) -> coalesce(x.w = get(ws, i - 1).w, false) or coalesce(x.w = get(ws, i + 1).w, false)), x -> x.p)))"
)


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and, for each row, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
        (F.size(F.split(text, f"[{re.escape(SYMBOLS)}]")) - 1).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), has_word).alias("lines"),
    )
    plain = ["doc_id", "words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    counted = split.select(
        "doc_id",
        "words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # windows of three words as sorted longs: a hash in the high bits, the place in as many low ones as places need
    high = counted.select(*plain, F.expr("shiftleft(-1L, length(bin(cast(size(words) as bigint))))").alias("high"))
    windows = F.expr(
        "if(size(words) < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, size(words) - 3),"
        " i -> (xxhash64(words[i], words[i + 1], words[i + 2]) & high) | cast(i as bigint))))"
    )
    ordered = high.select(*plain, "high", windows.alias("ks"))
    met = ordered.select(*plain, "high", F.expr("filter(ks, (x, i) -> coalesce(((x ^ get(ks, i - 1)) & high) = 0, false) or coalesce(((x ^ get(ks, i + 1)) & high) = 0, false))").alias("ks"))
    starts = met.select(*plain, F.expr(f"if({_MIXED}, {_BY_WORDS}, array_sort(transform(ks, x -> cast(x & ~high as int))))").alias("ps"))
    # a window covers three words, or as many as lie before the next repeated window
    covered = F.expr("aggregate(transform(ps, (p, i) -> least(3, coalesce(get(ps, i + 1) - p, 3))), 0L, (a, x) -> a + x)")
    return starts.select("doc_id", F.size("words").cast("long").alias("n_words"), *plain[2:], covered.alias("n_repeat_words"))


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for rule, condition in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[rule]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the measurements and `failures`, the bits of the rules that fail."""
    return measurements(docs).withColumn("failures", failure_bits())


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder: policies and ablations read it and no text."""
    return staged(ledger(docs), "ledger")


def passes(policy: str, failures: Column | str = "failures") -> Column:
    column = F.col(failures) if isinstance(failures, str) else failures
    return column.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects. One pass, one output row per rule."""
    judged = F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long"))
    rules = POLICIES[policy]
    sums = [F.count_if(judged.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias(f"f_{r}") for r in rules]
    alone = [F.count_if(judged == BIT[r]).alias(f"a_{r}") for r in rules]
    one = book.agg(F.count(F.lit(1)).alias("n"), F.count_if(judged != 0).alias("n_rejected"), *sums, *alone)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_fail"), F.col(f"a_{r}").alias("n_fail_alone")) for r in rules])
    return one.select("n", "n_rejected", F.explode(rows).alias("r")).select("r.*", "n", "n_rejected")


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows whose text passes the policy, with doc_id and text as they came and further columns unchanged."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    packed = docs.select(row.alias("doc_id"), "text")  # the whole row travels in the place of the id
    # a row number keeps the test above the ledger: pushed down, it would evaluate every measurement again inside itself
    numbered = ledger(packed).withColumn("row", F.monotonically_increasing_id())
    return numbered.where(passes(policy) & (F.col("row") >= 0)).select(*[F.col("doc_id").getField(c).alias(c) for c in names])
