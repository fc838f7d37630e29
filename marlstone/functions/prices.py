"""Probabilities and two-ladder quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logit(p: Column, eps: float = 1e-6) -> Column:
    """ln(p / (1 - p)) with p clamped to [eps, 1 - eps]; null where p isn't a number."""
    value = F.nullif(p.try_cast("double"), F.lit(float("nan")))
    clamped = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(eps)), F.lit(1 - eps)))
    return F.ln(clamped / (1 - clamped))


def complement(p: Column) -> Column:
    return F.round(1 - p, 10)


def is_probability(p: Column) -> Column:
    return p.between(0, 1)


def _origin(value: Column, derived: bool) -> Column:
    return F.when(value.isNull(), "missing").otherwise("complement_derived" if derived else "direct")


def quotes(yes_bid: Column, no_ladder: Column, yes_size: Column, no_size: Column, *, no_in_yes_prices: bool, legacy: bool = False) -> dict[str, Column]:
    """YES and NO quotes, sizes and origins from a YES bid ladder's best and a NO ladder's best.

    A NO ladder given in YES prices is a direct YES ask, else a direct NO bid; the other one is its complement.
    The legacy policy calls every present quote direct.
    """
    yes_ask = no_ladder if no_in_yes_prices else complement(no_ladder)
    no_bid = complement(no_ladder) if no_in_yes_prices else no_ladder
    no_ask = complement(yes_bid)
    return {
        "yes_bid": yes_bid,
        "yes_ask": yes_ask,
        "no_bid": no_bid,
        "no_ask": no_ask,
        "yes_bid_size": yes_size,
        "yes_ask_size": no_size,
        "no_bid_size": no_size,
        "no_ask_size": yes_size,
        "yes_bid_source": _origin(yes_bid, False),
        "yes_ask_source": _origin(yes_ask, not legacy and not no_in_yes_prices),
        "no_bid_source": _origin(no_bid, not legacy and no_in_yes_prices),
        "no_ask_source": _origin(no_ask, not legacy),
    }


def canonical_decimal(x: Column) -> Column:
    """A number's plain decimal text without trailing zeros."""
    text = x.try_cast("decimal(38,18)").cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
