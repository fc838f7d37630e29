"""Logs of exchange contracts and pools as tables: fills, witnesses of wallets, and the registries that they join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.labels import log_word, word_address, word_number

WORDS = 7


def quantity(text: Column) -> Column:
    """A hexadecimal quantity of up to 60 bits; null for other texts."""
    return F.when(text.rlike("^0x[0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 15), 16, 10).cast("long"))


def uint256(word: Column) -> Column:
    """A word's number as decimal text, exact however large: two halves of hex digits through decimals, joined by their place.

    38 digits hold a third of the range; beyond, the word itself is the answer, as `0x` text."""
    high, low = F.conv(F.substring(word, 33, 16), 16, 10).cast("decimal(38,0)"), F.conv(F.substring(word, 49, 16), 16, 10).cast("decimal(38,0)")
    small = F.left(word, F.lit(32)) == "0" * 32
    fits = small & (F.lower(F.substring(word, 33, 32)) <= f"{10**38 - 1:032x}")
    exact = (high * F.lit(2**32).cast("decimal(38,0)")).cast("decimal(38,0)") * F.lit(2**32).cast("decimal(11,0)") + low
    return F.when(fits, exact.cast("decimal(38,0)").cast("string")).when(word.isNotNull(), F.concat(F.lit("0x"), word))


def order_fills(logs: DataFrame, contracts: Sequence[str], topic: str) -> DataFrame:
    """Decoded fills with `problem`: rows (address, topics, data, blockNumber, logIndex, transactionHash) of known contracts.

    Four topics (signature, order, maker, taker), seven words (side, token, two amounts, fee, builder, metadata). A log that
    isn't so has a problem and no values. Token ids stay text, as they are wider than any number."""
    address, data = F.lower("address"), F.lower("data")
    side = word_number(log_word(data, 0))
    maker, taker = [word_address(F.substring(F.lower(F.get("topics", F.lit(k))), 3, 64)) for k in (2, 3)]
    problem = (
        F.when(~F.coalesce(address.isin([c.lower() for c in contracts]), F.lit(False)), "unknown contract")
        .when(F.coalesce(F.size("topics"), F.lit(0)) != 4, "not four topics")
        .when(F.lower(F.get("topics", F.lit(0))) != topic.lower(), "another event")
        .when(~F.coalesce(data.rlike(f"^0x[0-9a-f]{{{64 * WORDS}}}$"), F.lit(False)), "not seven words")
        .when(~F.coalesce(side.isin(0, 1), F.lit(False)), "side is neither 0 nor 1")
        .when(maker.isNull() | taker.isNull(), "address with padding")
        .when(quantity(F.col("blockNumber")).isNull() | quantity(F.col("logIndex")).isNull(), "no place")
    )
    values = {
        "block_number": quantity(F.col("blockNumber")),
        "log_index": quantity(F.col("logIndex")),
        "transaction_hash": F.lower("transactionHash"),
        "contract": address,
        "order_hash": F.lower(F.get("topics", F.lit(1))),
        "maker": maker,
        "taker": taker,
        "side": side,
        "token_id": uint256(log_word(data, 1)),
        "maker_amount": uint256(log_word(data, 2)),
        "taker_amount": uint256(log_word(data, 3)),
        "fee": uint256(log_word(data, 4)),
        "builder": F.concat(F.lit("0x"), log_word(data, 5)),
        "metadata": F.concat(F.lit("0x"), log_word(data, 6)),
    }
    always = ("block_number", "log_index", "transaction_hash", "contract")
    return logs.withColumn("_problem", problem).select(*[(c if n in always else F.when(F.col("_problem").isNull(), c)).alias(n) for n, c in values.items()], F.col("_problem").alias("problem"))


#: Bits of the roles that a wallet was seen in.
ROLES = {"maker": 1, "taker": 2, "pool_trader": 4, "pool_provider": 8}


def witnesses(fills: DataFrame) -> DataFrame:
    """wallet, role (bit), block, log_index, evidence of decoded fills: two rows each."""
    parties = F.array(*[F.struct(F.col(who).alias("wallet"), F.lit(ROLES[who]).cast("long").alias("role")) for who in ("maker", "taker")])
    return fills.where("problem is null").select(F.explode(parties).alias("p"), F.col("block_number").alias("block"), "log_index", F.col("transaction_hash").alias("evidence")).select("p.*", "block", "log_index", "evidence")


def pool_logs(logs: DataFrame, pools: DataFrame, trader_word: int = 1, role: str = "pool_trader") -> tuple[DataFrame, DataFrame]:
    """(witnesses of pools' logs, logs of no known pool): a log's address is looked up in the registry, its wallet is one of its topics."""
    known = pools.select(F.lower("address").alias("_pool")).distinct()
    keyed = logs.withColumn("_pool", F.lower("address"))
    wallet = word_address(F.substring(F.lower(F.get("topics", F.lit(trader_word))), 3, 64))
    found = keyed.join(known, "_pool").select(wallet.alias("wallet"), F.lit(ROLES[role]).cast("long").alias("role"), quantity(F.col("blockNumber")).alias("block"), quantity(F.col("logIndex")).alias("log_index"), F.lower("transactionHash").alias("evidence"))
    return found.where("wallet is not null"), keyed.join(known, "_pool", "left_anti").drop("_pool")


def with_provenance(rows: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Rows with the request that they come from; one without is an error when it is read."""
    found = rows.join(requests.withColumn("_known", F.lit(True)), key, "left")
    lacking = F.raise_error(F.concat(F.lit(f"no request {key}="), F.col(key).cast("string"))).cast(rows.schema[key].dataType)
    return found.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(lacking)).drop("_known")


def repaired(wallets: DataFrame, found: DataFrame) -> DataFrame:
    """Wallets whose first witness was of a pool's log, with an earlier one of the same block where `found` has one."""
    earlier = found.groupBy("wallet", F.col("block").alias("first_block")).agg(F.min(F.struct("log_index", "evidence")).alias("e"))
    joined = wallets.join(earlier, ["wallet", "first_block"], "left")
    better = F.coalesce(F.col("e.log_index") < F.col("log_index"), F.lit(False))
    return joined.withColumns({"log_index": F.when(better, F.col("e.log_index")).otherwise(F.col("log_index")), "evidence": F.when(better, F.col("e.evidence")).otherwise(F.col("evidence"))}).drop("e")


def stream_totals(ranges: DataFrame) -> DataFrame:
    """stream, n_ranges, n_logs, n_qualified of scanned ranges (stream, logs, qualified)."""
    return ranges.groupBy("stream").agg(F.count(F.lit(1)).alias("n_ranges"), F.sum("logs").alias("n_logs"), F.sum("qualified").alias("n_qualified"))
