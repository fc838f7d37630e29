"""Terminal labels of settled markets, exact fractions as numerator/denominator text, and chain logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binary_payout_label(yes: Column, no: Column) -> Column:
    """yes, no, refund (both whole), payout:yes=..,no=.. for other pairs; null outside [0, 1], for two zeros or nulls.

    Exact for decimals of up to 9 digits behind the point: fractions are reduced over 10^9."""
    sane = yes.between(0, 1) & no.between(0, 1) & ((yes + no == 1) | ((yes == 1) & (no == 1)))
    other = F.concat(F.lit("payout:yes="), fraction(yes), F.lit(",no="), fraction(no))
    return F.when(sane, F.when((yes == 1) & (no == 0), "yes").when((yes == 0) & (no == 1), "no").when((yes == 1) & (no == 1), "refund").otherwise(other))


def fraction(x: Column) -> Column:
    """A number of [0, 1] with up to 9 decimals as a reduced fraction n/d, by Euclid's steps over an array."""
    top = F.round(x * 1_000_000_000).cast("long")
    low = F.lit(1_000_000_000).cast("long")
    steps = F.sequence(F.lit(1), F.lit(44))
    pair = F.struct(top.alias("a"), low.alias("b"))
    divisor = F.aggregate(steps, pair, lambda s, _: F.when(s["a"] == 0, s).otherwise(F.struct((s["b"] % s["a"]).alias("a"), s["a"].alias("b"))), lambda s: s["b"])
    return F.concat((top / divisor).cast("long").cast("string"), F.lit("/"), (low / divisor).cast("long").cast("string"))


def settlement_label(value: Column) -> Column:
    """yes at 1, no at 0, scalar:n/d between; null for values that aren't numbers of [0, 1]."""
    number = value.try_cast("double")
    return F.when(number == 1, "yes").when(number == 0, "no").when(number.between(0, 1), F.concat(F.lit("scalar:"), fraction(number)))


def training_quality(label: Column, state: Column, canonical: Column) -> tuple[Column, Column]:
    """(quality, exclusion_reason) of a label for training: final canonical yes or no is usable."""
    reason = (
        F.when(~F.coalesce(canonical, F.lit(False)), "noncanonical")
        .when(~F.coalesce(state == "final", F.lit(False)), "not_final")
        .when(label.isNull(), "terminal_label_unavailable")
        .when(~label.isin("yes", "no"), "nonbinary_terminal_label")
    )
    quality = F.when(reason.isNull(), "canonical_binary").when(reason == "nonbinary_terminal_label", "canonical_nonbinary").when(reason == "not_final", "provisional").otherwise("unavailable")
    return quality, reason


def log_word(data: Column, k: int) -> Column:
    """The k-th 32-byte word of a log's data, as 64 hex digits."""
    return F.substring(F.regexp_replace(data, "^0x", ""), 64 * k + 1, 64)


def word_address(word: Column) -> Column:
    """A word's address, lower-cased; null where the upper bytes aren't zero."""
    return F.when(F.left(word, F.lit(24)) == "0" * 24, F.concat(F.lit("0x"), F.lower(F.right(word, F.lit(40)))))


def word_number(word: Column) -> Column:
    """A word's number where it fits in a long; null beyond. Token ids stay hex text."""
    return F.when(F.left(word, F.lit(49)) == "0" * 49, F.conv(F.right(word, F.lit(15)), 16, 10).cast("long"))


def block_pieces(first: Column, last: Column, span: int) -> Column:
    """Array of (from_block, to_block) pieces of at most `span` blocks."""
    return F.transform(F.sequence(first, last, F.lit(span).cast("long")), lambda a: F.struct(a.alias("from_block"), F.least(a + span - 1, last).alias("to_block")))
