"""The resolution cache: merging of retained and fresh settlements, summaries and folds of chain wallets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.prices import canonical_decimal
from marlstone.functions.texts import sorted_digest
from marlstone.operators.latest import latest_per_key

FINAL, CANONICAL = "final", "canonical"
CONFLICT = "MarketResolutionCacheConflict"


def canonical_final(prefix: str) -> Column:
    state, confidence = F.col(f"{prefix}.resolution_state"), F.col(f"{prefix}.confidence")
    return F.coalesce((state == FINAL) & (confidence == CANONICAL), F.lit(False))


def terminal_key(prefix: str) -> Column:
    """What a row settled to, comparable between rows: a scalar's settlement or result, else yes, no or refund, else payouts, settlement, result."""
    text = lambda name: F.nullif(F.trim(F.col(f"{prefix}.{name}")), F.lit(""))
    number = lambda value: F.coalesce(canonical_decimal(value), F.lower(value))
    settlement, result = text("settlement_value_dollars"), text("result")
    tagged = lambda tag, value: F.when(value.isNotNull(), F.concat(F.lit(tag + ":"), value))
    binary = lambda value: F.when(F.lower(value).isin("yes", "no", "refund"), F.lower(value))
    values = F.coalesce(tagged("settlement", number(settlement)), tagged("result", number(result)))
    payouts = F.when(~text("payouts_json").isin("[]", "{}", "null"), sorted_digest(text("payouts_json")))
    other = F.coalesce(tagged("terminal", F.coalesce(binary(text("winner")), binary(result))), tagged("payouts", payouts), values)
    return F.when(F.col(f"{prefix}.result_type") == "scalar", F.coalesce(values, other)).otherwise(other)


def merge_cache(retained: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("platform", "market_key"), legacy: Sequence[str] = ()) -> DataFrame:
    """The rows of the cache after a run, with `action`. Both sides have the keys and resolution columns, one row a key.

    - retained: only there, as the run didn't ask for it; added: only fresh.
    - inconsistent: both final and canonical, to different ends. The row says so, and has no end.
    - carried: the retained row is such a conflict, or the fresh one is weaker than a canonical final one (and neither disputed nor
      inconsistent itself): the retained row stays.
    - refreshed: else, and where the retained row's resolver version is one of `legacy` and there's no conflict.
    """
    columns = [c for c in retained.columns if c not in keys]
    r = retained.select(*keys, F.struct(*columns).alias("r"))
    f = fresh.select(*keys, F.struct(*[F.col(c) if c in fresh.columns else F.lit(None).cast(retained.schema[c].dataType).alias(c) for c in columns]).alias("f"))
    both = r.join(f, list(keys), "full_outer")
    old, new = terminal_key("r"), terminal_key("f")
    conflict = canonical_final("r") & canonical_final("f") & F.coalesce(old != new, F.lit(False))
    held = F.coalesce((F.col("r.resolution_state") == "inconsistent") & (F.col("r.error_type") == CONFLICT), F.lit(False))
    weaker = ~canonical_final("f") & ~F.coalesce(F.col("f.resolution_state").isin("disputed", "inconsistent"), F.lit(False))
    is_legacy = F.coalesce(F.col("r.resolver_version").isin(list(legacy)), F.lit(False)) if legacy else F.lit(False)
    action = (
        F.when(F.col("f").isNull(), "retained")
        .when(F.col("r").isNull(), "added")
        .when(conflict & ~held, "inconsistent")
        .when(~is_legacy & (held | weaker), "carried")
        .otherwise("refreshed")
    )
    stated = {"resolution_state": F.lit("inconsistent"), "result_type": F.lit("unknown"), "confidence": F.lit("inconsistent"), "error_type": F.lit(CONFLICT)}
    ends = {"winner", "result", "payouts_json", "settlement_value_dollars", "terminal_label"}
    merged = both.withColumn("action", action)

    def value(c: str) -> Column:
        own = F.when(F.col("action").isin("retained", "carried"), F.col(f"r.{c}")).otherwise(F.col(f"f.{c}"))
        return F.when(F.col("action") == "inconsistent", stated.get(c, F.lit(None).cast(retained.schema[c].dataType) if c in ends else own)).otherwise(own)

    return merged.select(*keys, *[value(c).alias(c) for c in columns], "action")


def reusable(cache: DataFrame, resolver_version: str, max_age_s: int, now: Column) -> DataFrame:
    """Rows that a run needn't resolve again: of the resolver's version, and canonical final ones or observed recently enough."""
    final = (F.col("resolution_state") == FINAL) & (F.col("confidence") == CANONICAL)
    young = F.unix_micros(now) - F.unix_micros(F.col("observed_at_utc").try_cast("timestamp")) <= max_age_s * 1_000_000
    return cache.where((F.col("resolver_version") == resolver_version) & F.coalesce(final | young, F.lit(False)))


def latest_fresh(rows: DataFrame, key: str, times: Sequence[str]) -> DataFrame:
    """The row of each key that was fresh last: by the greatest of its times, then by each, then by the row's own text."""
    at = [F.coalesce(F.unix_micros(F.col(c).try_cast("timestamp")), F.lit(-1)) for c in times]
    text = F.to_json(F.struct(*sorted(c for c in rows.columns if c != "close_time")))
    return latest_per_key(rows.where(F.col(key).isNotNull()), [key], [(F.greatest(*at) if len(at) > 1 else at[0]).desc(), *[c.desc() for c in at], text.desc()])


def in_universe(rows: DataFrame, key: str, matches: DataFrame, columns: Sequence[str], *, before: str | None = None) -> DataFrame:
    """Rows whose key the match table names in the first of `columns` that it has, cut before a separator if one is given; none if it has none."""
    named = next((c for c in columns if c in matches.columns), None)
    if named is None:
        return rows.where("false")
    value = F.col(named).cast("string")
    keys = matches.select((F.substring_index(value, before, 1) if before else value).alias(key)).where(F.col(key).isNotNull()).distinct()
    return rows.join(keys, key, "left_semi")


def fold_wallets(witnesses: DataFrame) -> DataFrame:
    """wallet, first_block, last_block, roles (bits), evidence of the first (block, log_index)."""
    return witnesses.groupBy("wallet").agg(
        F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.bit_or("role").alias("roles"), F.min_by("evidence", F.struct("block", "log_index")).alias("evidence")
    )


def summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column in one pass: dimension, value, n."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
